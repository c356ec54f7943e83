"""The BAM source against records packed by hand and against SAM text, in ranges of all sizes."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from amplitract.sources import bam as B
from amplitract.sources.reads import read_sam

REFS = [("17_1_1_7_2", 200), ("42_1_1_10_2", 300)]


def by_hand():
    """A file of one block with two records, every byte written out, and their SAM lines."""
    text = b"@SQ\tSN:17_1_1_7_2\tLN:200\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 11) + b"17_1_1_7_2\0" + struct.pack("<i", 200)
    name = b"read/1\0"
    ops = struct.pack("<3I", 2 << 4 | 4, 3 << 4 | 0, 1 << 4 | 4)  # 2S3M1S
    seq = bytes([0x12, 0x48, 0xF1])  # ACGTNA
    qual = bytes([0, 10, 20, 30, 40, 93])
    one = struct.pack("<iiBBHHHiiii", 0, 4, len(name), 37, 4681, 3, 16, 6, -1, -1, 0) + name + ops + seq + qual
    two = struct.pack("<iiBBHHHiiii", -1, -1, 2, 0, 4680, 0, 4, 3, -1, -1, 0) + b"x\0" + bytes([0x88, 0x80]) + b"\xff\xff\xff"
    data = head + b"".join(struct.pack("<i", len(r)) + r for r in (one, two))
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    block = bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    sam = ["@SQ\tSN:17_1_1_7_2\tLN:200", "read/1\t16\t17_1_1_7_2\t5\t37\t2S3M1S\t*\t0\t0\tACGTNA\t!+5?I~"]
    return block + B.END, sam


def test_a_file_written_by_hand(spark, tmp_path):
    raw, sam = by_hand()
    (tmp_path / "one.bam").write_bytes(raw)
    (tmp_path / "one.sam").write_text("\n".join(sam) + "\n")
    rows = B.read_bam(spark, str(tmp_path / "one.bam")).orderBy("read_id").collect()
    assert [tuple(r) for r in rows] == [
        ("read/1", 16, "17_1_1_7_2", 5, 37, "2S3M1S", "ACGTNA", "!+5?I~", "GTN"),
        ("x", 4, None, 0, 0, "*", "TTT", "*", "TTT"),
    ]
    same = ["read_id", "contig", "mapq", "seq", "aligned"]
    assert B.read_bam(spark, str(tmp_path), "17_1_1_7_2").select(same).collect() == read_sam(spark, str(tmp_path / "one.sam")).select(same).collect()
    assert B.read_bam(spark, str(tmp_path), "no such").count() == 0
    assert gzip.decompress(raw)[:4] == b"BAM\1"


def made(rng, count, long=0):
    rows = []
    for k in range(count):
        seq = "".join(rng.choice("ACGTN") for _ in range(long if long and k % 7 == 0 else rng.randint(0, 160)))
        contig = rng.choice([None, "17_1_1_7_2", "42_1_1_10_2"])
        rows.append({"read_id": f"r{k}", "flag": None, "contig": contig, "pos": None if contig is None else rng.randint(1, 150), "mapq": rng.randint(0, 60), "cigar": None, "seq": seq, "qual": "".join(chr(rng.randint(33, 73)) for _ in seq)})
    return rows


def packed(rows, sizes):
    """A BAM file whose blocks have the sizes that are given in turn, however records lie in them."""
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(REFS)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in REFS)
    data = head + b"".join(B.record(r, {n: k for k, (n, _) in enumerate(REFS)}) for r in rows)
    out, at, k = b"", 0, 0
    while at < len(data):
        out += B.block(data[at : at + sizes[k % len(sizes)]])
        at, k = at + sizes[k % len(sizes)], k + 1
    return out + B.END


@pytest.mark.parametrize(("sizes", "long"), [([60000], 0), ([700, 33, 5, 2000], 0), ([900], 5000), ([64000, 1], 70000), ([37], 0)])
def test_ranges_hold_each_record_once(tmp_path, sizes, long):
    """However a file is cut, each record comes once and in order, also those that run over blocks and ranges."""
    rng = random.Random(len(sizes) + long)
    rows = made(rng, 150, long)
    raw = packed(rows, sizes)
    path = str(tmp_path / "x.bam")
    (tmp_path / "x.bam").write_bytes(raw)
    want = [(r["read_id"], r["contig"], r["mapq"], r["seq"]) for r in rows]
    for step in (len(raw) + 1, len(raw) // 3 + 1, 1500, 401):
        found = [x for at in range(0, len(raw), step) for x in B.records(B.Range(path, at, min(at + step, len(raw))), B.SCHEMA.replace(",", "").split()[::2])]
        assert [(x["read_id"], x["contig"], x["mapq"], x["seq"]) for x in found] == want
        assert [x["qual"] for x in found] == [r["qual"] for r in rows]


def test_round_trip_in_spark(spark, tmp_path):
    rows = [{**r, "pos": r["pos"] or 0, "flag": 0 if r["contig"] else 4, "cigar": f"{len(r['seq'])}M" if r["contig"] and r["seq"] else "*"} for r in made(random.Random(9), 900)]
    rows = [r for r in rows if r["seq"]]
    df = spark.createDataFrame(rows, "read_id string, flag int, contig string, pos int, mapq int, cigar string, seq string, qual string").repartition(3)
    B.write_bam(df, f"file://{tmp_path}/out", REFS)
    assert len(list((tmp_path / "out").glob("*.bam"))) == 3
    back = B.read_bam(spark, f"file://{tmp_path}/out", split_bytes=9_000)
    assert back.rdd.getNumPartitions() > 9
    assert sorted(map(repr, back.select(df.columns).collect())) == sorted(map(repr, df.collect()))
    assert back.where(F.col("contig") == REFS[0][0]).count() == B.read_bam(spark, str(tmp_path / "out"), REFS[0][0]).count() == sum(r["contig"] == REFS[0][0] for r in rows)


def test_batches_in_and_out(spark, tmp_path):
    """Rows go through as Arrow batches, only named columns are built, and all values come back, null or longer than a block."""
    import pyarrow as pa

    rows = [(f"r{k}", None if k % 3 else REFS[0][0], None if k % 5 else 7, "ACGTN" * (k if k != 9 else 40_000), "*" if k % 2 else None) for k in range(1, 40)]
    df = spark.createDataFrame(rows, "read_id string, contig string, mapq int, seq string, qual string").coalesce(1)
    B.write_bam(df, str(tmp_path), REFS)
    back = B.read_bam(spark, str(tmp_path), split_bytes=5_000, columns=["seq", "mapq", "read_id"])
    assert back.columns == ["seq", "mapq", "read_id"]
    assert sorted((r.read_id, r.mapq, r.seq) for r in back.collect()) == sorted((r[0], r[2] or 0, r[3]) for r in rows)
    reader = B.BamReader(back.schema, {"path": str(tmp_path)})
    found = [b for part in reader.partitions() for b in reader.read(part)]
    assert all(isinstance(b, pa.RecordBatch) and b.schema.names == back.columns for b in found) and sum(b.num_rows for b in found) == len(rows)
    row = {"read_id": "q", "seq": "acgtR=NM", "qual": "!~5?I#$%"}
    raw = B.record(row, {})
    assert {k: v for k, v in B.parsed(raw, 0, B.Header("", [], [], 0), ["seq", "qual"]).items() if k in row} == {"seq": "NNNNR=NM", "qual": row["qual"]}
    with pytest.raises(ValueError, match="below 0"):
        B.record({**row, "qual": " ~5?I#$%"}, {})


def test_files_that_are_none(spark, tmp_path):
    (tmp_path / "bad.bam").write_bytes(b"not at all")
    with pytest.raises(Exception, match="no BGZF block"):
        B.read_bam(spark, str(tmp_path / "bad.bam")).count()
    with pytest.raises(Exception, match="no BAM file"):
        B.read_bam(spark, str(tmp_path / "none")).count()
