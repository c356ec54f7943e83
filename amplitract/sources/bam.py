"""BAM files as a Spark data source: spark.read.format("bam").load(path), and df.write.format("bam").save(path).

A BAM file is a run of BGZF blocks (gzip members of at most 64 KB that tell their own size), so it can be read from its middle: a
partition is a range of bytes of a file and holds the records that begin in blocks which begin in the range. To find the first
record of a range without an index, places in the first block's text are tried until several records in a row make sense;
the first range begins behind the header. Files are opened through Arrow's file systems, so a path may be local or a URI (s3, gs, hdfs).

Options: split_bytes (compressed bytes a partition, 16 MB), contig (records of that reference only). Records without a reference have a
null contig. aligned is the sequence without its soft clips, as read_sam gives it. Columns that a schema given to the reader (read_bam's
columns) leaves out aren't built. Rows go in and out by Arrow batches.
"""

from __future__ import annotations

import binascii
import glob
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "read_id string, flag int, contig string, pos int, mapq int, cigar string, seq string, qual string, aligned string"
SPLIT_BYTES = 16 << 20
#: The most bytes of a BGZF block, and of its text.
BLOCK = 1 << 16
# Fixed values of the format: the letters of base and CIGAR codes, and the empty block that ends a file.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
# Texts of bases and qualities as what a record holds of them, and back, by bytes.
_TO_HEX = bytes(b"0123456789abcdef"[BASES.find(chr(c))] if chr(c) in BASES else 102 for c in range(256))
_FROM_HEX = bytes(ord(BASES[int(chr(c), 16)]) if chr(c) in "0123456789abcdef" else c for c in range(256))
_TO_QUALITY = bytes((c - 33) % 256 for c in range(256))
_FROM_QUALITY = bytes((c + 33) % 256 for c in range(256))
_NO_QUALITY = bytes(range(33))
_PRINTED = bytes(range(33, 127))
#: Of compression: level 6 takes six times as long and saves a seventh, on reads of one amplicon.
LEVEL = 3
#: Rows of a batch that is read.
BATCH_ROWS = 4096
#: How many records in a row must make sense where a partition begins.
IN_A_ROW = 8
#: Bytes of text behind the place of a first record, against which it is held.
CONTEXT = 4096


def opened(path: str):
    """A file of any of Arrow's file systems, for random access, and its size."""
    system, inside = pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+]*:", path) else (pa.fs.LocalFileSystem(), path)
    return system.open_input_file(inside), system.get_file_info(inside).size


def listed(path: str) -> list[str]:
    """The BAM files of a path: a file, a folder, or a local pattern."""
    if not re.match(r"[a-z][a-z0-9+]*:", path):
        return sorted(glob.glob(f"{path.rstrip('/')}/*.bam") if os.path.isdir(path) else glob.glob(path))
    system, inside = pa.fs.FileSystem.from_uri(path)
    info = system.get_file_info(inside)
    if info.type == pa.fs.FileType.File:
        return [path]
    head = path[: len(path) - len(inside)] if path.endswith(inside) else path.split(":")[0] + "://"
    return sorted(head + f.path for f in system.get_file_info(pa.fs.FileSelector(inside)) if f.path.endswith(".bam"))


def block_size(head: bytes) -> int:
    """The bytes of the BGZF block that begins with head, 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(end, len(head)):
        length = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and length == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return 0


class Blocks:
    """The blocks of a file from a byte on: each with where it begins and its text."""

    def __init__(self, file, size: int, at: int) -> None:
        self.file, self.size, self.at = file, size, at

    def find(self) -> None:
        """Moves to the first block that begins at or behind the byte: one that others follow up to the end or three times."""
        self.file.seek(self.at)
        window = self.file.read(2 * BLOCK)
        begin = window.find(b"\x1f\x8b\x08\x04")
        while begin >= 0:
            at, good = begin, 0
            while good < 3 and self.at + at < self.size and at < len(window) and (n := block_size(window[at : at + 64])):
                at, good = at + n, good + 1
            if good == 3 or (good and (self.at + at >= self.size or at >= len(window))):
                self.at += begin
                return
            begin = window.find(b"\x1f\x8b\x08\x04", begin + 1)
        self.at = self.size

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.size:
            self.file.seek(self.at)
            raw = self.file.read(BLOCK)
            n = block_size(raw)
            if not n or n > len(raw):
                raise ValueError(f"no BGZF block at byte {self.at}")
            begin, self.at = self.at, self.at + n
            yield begin, zlib.decompress(raw[:n], 31)


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    #: How many bytes of text it takes.
    size: int


def read_header(blocks: Iterator[tuple[int, bytes]]) -> Header:
    data = b""
    need = lambda n: data if len(data) >= n else None

    def upto(n: int) -> None:
        nonlocal data
        while need(n) is None:
            more = next(blocks, None)
            if more is None:
                raise ValueError("the header ends early")
            data += more[1]

    upto(12)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    length = struct.unpack_from("<i", data, 4)[0]
    upto(12 + length)
    text, count, at = data[8 : 8 + length].rstrip(b"\0").decode(), struct.unpack_from("<i", data, 8 + length)[0], 12 + length
    names, lengths = [], []
    for _ in range(count):
        upto(at + 4)
        n = struct.unpack_from("<i", data, at)[0]
        upto(at + 8 + n)
        names.append(data[at + 4 : at + 3 + n].decode())
        lengths.append(struct.unpack_from("<i", data, at + 4 + n)[0])
        at += 8 + n
    return Header(text, names, lengths, at)


_FIXED = struct.Struct("<iiiBBHHHiiii")


def record_size(data: bytes, at: int, header: Header) -> int:
    """The bytes of the record that begins at a place, 0 if what stands there can't be one, -1 if its fixed part isn't all there."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, name, mapq, _, n_ops, flag, length, mate, mate_pos, _ = _FIXED.unpack_from(data, at)
    count = len(header.names)
    good = -1 <= ref < count and -1 <= mate < count and name > 0 and length >= 0
    good = good and -1 <= pos < (header.lengths[ref] if ref >= 0 else 1 << 31) and -1 <= mate_pos < (header.lengths[mate] if mate >= 0 else 1 << 31)
    good = good and 32 + name + 4 * n_ops + (length + 1) // 2 + length <= size < 1 << 28
    end = at + 36 + name
    if good and end <= len(data):
        good = data[end - 1] == 0 and not data[at + 36 : end - 1].translate(None, _PRINTED)
        if n_ops:
            good = good and all(op & 15 < 9 for op in data[end : end + 4 * n_ops : 4])
    return size + 4 if good else 0


def first_record(data: bytes, header: Header, edge: int) -> int:
    """The first place before edge at which IN_A_ROW records (or all up to the end of data) make sense; edge if there is none."""
    for begin in range(edge):
        at, n = begin, 0
        while n < IN_A_ROW and at < len(data):
            size = record_size(data, at, header)
            if size <= 0:
                break
            at, n = at + size, n + 1
        else:
            return begin
        if size < 0 and n:
            return begin
    return edge


def parsed(data: bytes, at: int, header: Header, columns: list[str]) -> dict[str, object]:
    size, ref, pos, name, mapq, _, n_ops, flag, length, _, _, _ = _FIXED.unpack_from(data, at)
    ops_at = at + 36 + name
    seq_at = ops_at + 4 * n_ops
    row: dict[str, object] = {"flag": flag, "contig": header.names[ref] if ref >= 0 else None, "pos": pos + 1, "mapq": mapq}
    if "read_id" in columns:
        row["read_id"] = data[at + 36 : ops_at - 1].decode()
    if "cigar" in columns or "aligned" in columns:
        ops = struct.unpack_from(f"<{n_ops}I", data, ops_at)
        row["cigar"] = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"
    if "seq" in columns or "aligned" in columns:
        row["seq"] = binascii.hexlify(data[seq_at : seq_at + (length + 1) // 2])[:length].translate(_FROM_HEX).decode()
    if "qual" in columns:
        quality = data[seq_at + (length + 1) // 2 : seq_at + (length + 1) // 2 + length]
        row["qual"] = "*" if quality[:1] == b"\xff" else quality.translate(_FROM_QUALITY).decode("latin-1")
    if "aligned" in columns:
        inner = [x for x in ops if x & 15 != 5]
        front, back = (inner[k] >> 4 if inner and inner[k] & 15 == 4 else 0 for k in (0, -1))
        row["aligned"] = row["seq"][front : length - back] if len(inner) > 1 or not front else ""
    return row


class Range(InputPartition):
    """Bytes of a file."""

    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


def records(part: Range, columns: list[str], contig: str | None = None) -> Iterator[dict[str, object]]:
    """The records that begin in the blocks which begin in a range of bytes."""
    file, size = opened(part.path)
    with file:
        header = read_header(iter(Blocks(file, size, 0)))
        wanted = None if contig is None else header.names.index(contig) if contig in header.names else -2
        source = Blocks(file, size, part.begin)
        if part.begin:
            source.find()
        blocks = iter(source)
        data, at, edge = b"", 0, 0  # records that begin before edge belong to the range

        def more() -> bool:
            nonlocal data, at, edge
            begin, text = next(blocks, (None, b""))
            if begin is None:
                return False
            data, at, edge = data[at:] + text, 0, max(0, edge - at)
            if begin < part.end:
                edge = len(data)
            return True

        if part.begin == 0:
            while len(data) < header.size and more():
                pass
            at = header.size
        else:
            if not more() or not edge:
                return
            search = edge
            while True:
                while len(data) < search + CONTEXT and more():
                    pass
                if (at := first_record(data, header, search)) < search:
                    break
                at = 0
                if edge == search:
                    return
                # all that was searched is the end of one long record
                data, search, edge = data[search:], edge - search, edge - search
        while at < edge or (more() and at < edge):
            n = record_size(data, at, header)
            while (n < 0 or at + n > len(data)) and more():
                n = record_size(data, at, header)
            if n <= 0 or at + n > len(data):
                raise ValueError(f"a record of {part.path} ends early or makes no sense")
            if wanted is None or struct.unpack_from("<i", data, at + 4)[0] == wanted:
                yield parsed(data, at, header, columns)
            at += n


class BamReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.options = schema.names, options
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        self.schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])

    def partitions(self) -> list[Range]:
        step, out = int(self.options.get("split_bytes", SPLIT_BYTES)), []
        files = listed(self.options["path"])
        if not files:
            raise ValueError(f"no BAM file at {self.options['path']}")
        for path in files:
            file, size = opened(path)
            file.close()
            out += [Range(path, at, min(at + step, size)) for at in range(0, size, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = records(partition, self.columns, self.options.get("contig"))
        while some := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_pydict({c: [row[c] for row in some] for c in self.columns}, self.schema)


@dataclass
class Part(WriterCommitMessage):
    path: str | None


def values_of(column: pa.Array) -> list:
    """The values of a column, through numpy where it has the same: several times faster than to_pylist."""
    same = pa.types.is_string(column.type) or (pa.types.is_integer(column.type) and not column.null_count)
    return column.to_numpy(zero_copy_only=False).tolist() if same else column.to_pylist()


def block(data: bytes) -> bytes:
    """A BGZF block."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(row: dict, refs: dict[str, int]) -> bytes:
    """A record of a row with read_id, contig, seq, and as far as given flag, pos, mapq, cigar and qual."""
    seq, name, contig = row.get("seq") or "", (row.get("read_id") or "*").encode() + b"\0", row.get("contig")
    cigar = row.get("cigar") or (f"{len(seq)}M" if contig is not None and seq else "*")
    ops = [] if cigar == "*" else [int(n) << 4 | OPS.index(k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    packed = binascii.unhexlify(seq.encode("latin-1", "replace").translate(_TO_HEX) + b"0" * (len(seq) % 2))
    qual = row.get("qual")
    quality = qual.encode("latin-1").translate(_TO_QUALITY, _NO_QUALITY) if qual and qual != "*" else b"\xff" * len(seq)
    if qual and qual != "*" and len(quality) < len(qual):
        raise ValueError("a quality is below 0")
    pos, ref = row.get("pos"), -1 if contig is None else refs[contig]
    pos = -1 if ref < 0 else 0 if pos is None else pos - 1
    span = sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8)) or 1
    flag = row.get("flag")
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), row.get("mapq") or 0, _bin(pos, pos + span), len(ops), (4 if ref < 0 else 0) if flag is None else flag, len(seq), -1, -1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + quality
    return struct.pack("<i", len(body)) + body


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the UCSC scheme that holds a range."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


class BamWriter(DataSourceArrowWriter):
    """One file a task. Option contigs: the references, as name:length separated by commas; all contigs of rows have to be among them."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.columns, self.path, self.overwrite = schema.names, options["path"], overwrite
        self.refs = [(name, int(length)) for name, length in (x.rsplit(":", 1) for x in options.get("contigs", "").split(",") if x)]
        self.job = uuid.uuid4().hex[:12]
        self.old = listed(self.path) if overwrite else []

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = pa.fs.FileSystem.from_uri(self.path) if re.match(r"[a-z][a-z0-9+]*:", self.path) else (pa.fs.LocalFileSystem(), self.path)
        system.create_dir(folder, recursive=True)
        path = f"{folder.rstrip('/')}/part-{context.partitionId():05d}-{self.job}-{context.attemptNumber()}"
        text = "@HD\tVN:1.6\tSO:unsorted\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in self.refs)
        head = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(self.refs))
        head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in self.refs)
        refs = {n: k for k, (n, _) in enumerate(self.refs)}
        with system.open_output_stream(path) as out:
            texts, held, limit = [head], len(head), BLOCK - 1024
            for batch in batches:
                for values in zip(*map(values_of, batch.columns), strict=True):
                    texts.append(text := record(dict(zip(self.columns, values, strict=True)), refs))
                    held += len(text)
                    if held >= limit:
                        data = b"".join(texts)
                        whole = held - held % limit
                        for at in range(0, whole, limit):
                            out.write(block(data[at : at + limit]))
                        texts, held = [data[whole:]], held - whole
            data = b"".join(texts)
            for at in range(0, held, limit):
                out.write(block(data[at : at + limit]))
            out.write(END)
        return Part(path)

    def commit(self, messages: list[Part | None]) -> None:
        """Files get their names when all tasks are through; what tasks that were repeated have left never does."""
        system = pa.fs.FileSystem.from_uri(self.path)[0] if re.match(r"[a-z][a-z0-9+]*:", self.path) else pa.fs.LocalFileSystem()
        for m in messages:
            if m and m.path:
                system.move(m.path, m.path.rsplit("-", 1)[0] + ".bam")
        for path in self.old:
            system.delete_file(pa.fs.FileSystem.from_uri(path)[1] if re.match(r"[a-z][a-z0-9+]*:", path) else path)

    def abort(self, messages: list[Part | None]) -> None:
        system = pa.fs.FileSystem.from_uri(self.path)[0] if re.match(r"[a-z][a-z0-9+]*:", self.path) else pa.fs.LocalFileSystem()
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(schema, self.options, overwrite)


def register_bam(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, contig: str | None = None, split_bytes: int = SPLIT_BYTES, columns: list[str] | None = None):
    """The records of BAM files, of one contig if named; all columns or those that are named."""
    register_bam(spark)
    reader = spark.read.format("bam").option("split_bytes", split_bytes)
    if columns:
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return (reader if contig is None else reader.option("contig", contig)).load(path)


def write_bam(df, path: str, contigs: list[tuple[str, int]]) -> None:
    """df (read_id, contig, seq; flag, pos, mapq, cigar and qual if there are any) as BAM files under path."""
    register_bam(df.sparkSession)
    df.write.format("bam").mode("append").option("contigs", ",".join(f"{n}:{k}" for n, k in contigs)).save(path)
