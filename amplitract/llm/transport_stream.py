"""Media columns: MPEG transport streams.

``mux`` stores a payload losslessly as a transport stream: a program association and a program map table, then
packetized elementary packets (PES) of private data, each with a presentation timestamp, its first packet marked as a
random-access point and carrying a clock reference. ``demux`` reads any transport stream back: it finds the program
and its elementary streams from the tables (whose CRC it checks), checks continuity counters, reassembles the
elementary packets and lists timestamps and random-access points. Both work on arrays of packets inside Arrow batches;
a row never leaves its task and memory is bounded by a batch piece and the longest text.

Defined cases: a null text is stored as an empty one; an empty text pads to 192 spaces; a stream with no whole packet,
no sync bytes or no tables gives no elementary stream and no error; where bytes are missing or too many, reading goes on
at the next sync; lost packets count as continuity errors and the
packet they belong to is kept as far as it was read; scrambled and null packets are skipped; repeated packets (same
counter and content) are read once. Extra columns pass through, those with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import freeing, others, table

PACKET, SYNC, UNIT = 188, 0x47, 192
#: Payload bytes of an elementary packet: at one unit a tick of 1/100 s, each lasts a whole number of 90 kHz ticks.
PES_BYTES = 16 * UNIT
PES_TICKS = 16 * 900
PMT_PID, ES_PID, PRIVATE_DATA = 0x1000, 0x0100, 0x06
FIRST_PTS = 90_000


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 with the polynomial of ISO/IEC 13818-1, high bit first, without a final complement."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0, len(body) + 9]) + extension.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    """33 bits of a timestamp, with the marker bits of a PES header that has no decoding timestamp."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def pad(payload: bytes) -> bytes:
    """With spaces, to a positive multiple of 192 bytes."""
    return payload.ljust(max(1, -(-len(payload) // UNIT)) * UNIT, b" ")


def mux(payload: bytes) -> bytes:
    """A transport stream of one program with one stream of private data."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        piece, pts = payload[at : at + PES_BYTES], (FIRST_PTS + k * PES_TICKS) % (1 << 33)
        pes = b"\x00\x00\x01\xbd" + (len(piece) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + piece
        # the first packet: 8 bytes of adaptation field with a clock reference; the last is filled up by stuffing
        n = 1 + max(0, -(-(len(pes) - 176) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        body = np.frombuffer(pes, np.uint8)
        clock = (pts - FIRST_PTS // 2) % (1 << 33)
        fill = max(0, 176 - len(body))
        packets[0, 3] |= 0x20
        packets[0, 4], packets[0, 5] = 7 + fill, 0x50
        packets[0, 6:12] = np.frombuffer((clock << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        packets[0, 12 + fill :] = body[:176]
        if n > 1:
            whole = (len(body) - 176) // 184
            packets[1 : 1 + whole, 4:] = body[176 : 176 + 184 * whole].reshape(whole, 184)
            if rest := len(body) - 176 - 184 * whole:
                packets[-1, 3] |= 0x20
                packets[-1, 4] = 183 - rest
                packets[-1, 5:6] = 0 if rest < 183 else packets[-1, 5:6]
                packets[-1, PACKET - rest :] = body[-rest:]
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What was read from one elementary stream."""

    pid: int
    kind: int
    payload: bytes = b""
    packets: int = 0
    pes: int = 0
    lost: int = 0
    stamps: list[int] = field(default_factory=list)
    decode_stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)


def _packets(data: bytes) -> np.ndarray:
    """The packets: where a sync byte is followed by another a packet on, or by the end. Where one isn't, bytes are missing
    or too many, and reading goes on at the next place where it is; the packet that lacks them shows as lost by its counter."""
    raw = np.frombuffer(data, np.uint8)
    last = len(raw) - PACKET
    good = np.flatnonzero(raw == SYNC)
    good = good[good <= last]
    good = good[(good == last) | (raw[np.minimum(good + PACKET, len(raw) - 1)] == SYNC)]
    if not len(good):
        return np.empty((0, PACKET), np.uint8)
    starts, at = [], int(good[0])
    whole = np.arange(at, last + 1, PACKET)
    if np.isin(whole, good).all():
        starts = whole
    else:
        while at <= last:
            k = int(np.searchsorted(good, at))
            if k == len(good):
                break
            at = int(good[k])
            starts.append(at)
            at += PACKET
        starts = np.array(starts)
    found = raw[starts[:, None] + np.arange(PACKET)]
    return found[found[:, 1] & 0x80 == 0]


def _sections(packets: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    """Sections of table packets; those with a wrong CRC or that are cut off are skipped."""
    buffer = b""
    for packet, begin in zip(packets, at, strict=True):
        body = packet[begin:].tobytes()
        if packet[1] & 0x40 and body:
            buffer = body[1 + body[0] :]
        else:
            buffer += body
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
            if len(buffer) < size:
                break
            section, buffer = buffer[:size], buffer[size:]
            if size >= 12 and (section in _KNOWN or crc32_mpeg(section) == 0):
                yield section


_KNOWN = {TABLES[5 : 5 + 16], TABLES[PACKET + 5 : PACKET + 5 + 21]}


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(data: bytes) -> list[Stream]:
    """The elementary streams that the stream's program tables name, in order of their PIDs."""
    packets = _packets(data)
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + packets[:, 4].astype(np.int32), 4)
    usable = (packets[:, 3] & 0xC0 == 0) & (control & 1 == 1) & (begin <= PACKET)
    begin = np.minimum(begin, PACKET)

    maps, kinds = set(), {}
    for s in _sections(packets[usable & (pid == 0)], begin[usable & (pid == 0)]):
        if s[0] == 0:
            maps |= {(s[i + 2] & 0x1F) << 8 | s[i + 3] for i in range(8, len(s) - 7, 4) if s[i] << 8 | s[i + 1]}
    for table_pid in maps:
        mine = usable & (pid == table_pid)
        for s in _sections(packets[mine], begin[mine]):
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while s[0] == 2 and i + 5 <= len(s) - 4:
                kinds[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    return [_elementary(packets[m], begin[m], p, kinds[p]) for p in sorted(kinds) for m in [usable & (pid == p)]]


def _elementary(packets: np.ndarray, begin: np.ndarray, pid: int, kind: int) -> Stream:
    out = Stream(pid, kind)
    if len(packets):  # a packet may be sent twice
        again = np.zeros(len(packets), bool)
        again[1:] = (packets[1:, 3] & 15 == packets[:-1, 3] & 15) & (packets[1:, 4:] == packets[:-1, 4:]).all(axis=1)
        packets, begin = packets[~again], begin[~again]
    out.packets = len(packets)
    if not len(packets):
        return out
    counter = packets[:, 3].astype(np.int32) & 15
    field_there = (packets[:, 3] & 0x20 > 0) & (packets[:, 4] > 0)
    flags = np.where(field_there, packets[:, 5], 0)
    out.lost = int(np.count_nonzero(((counter[1:] - counter[:-1]) % 16 != 1) & (flags[1:] & 0x80 == 0)))
    out.clocks = [int.from_bytes(packets[i, 6:12].tobytes(), "big") >> 15 for i in np.flatnonzero((flags & 0x10 > 0) & (packets[:, 4] >= 7))]

    starts = np.flatnonzero(packets[:, 1] & 0x40)
    inside = np.arange(PACKET) >= begin[:, None]
    edges = np.concatenate([[0], np.cumsum(inside.sum(axis=1))])
    flat = packets[inside].tobytes()
    pieces = []
    for k, i in enumerate(starts):
        j = starts[k + 1] if k + 1 < len(starts) else len(packets)
        pes = flat[edges[i] : edges[j]]
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            continue
        size = pes[4] << 8 | pes[5]
        pieces.append(pes[9 + pes[8] : 6 + size if size else len(pes)])
        if pes[7] & 0x80 and len(pes) >= 14:
            out.stamps.append(_read_stamp(pes[9:14]))
            if pes[7] & 0x40 and len(pes) >= 19:
                out.decode_stamps.append(_read_stamp(pes[14:19]))
        if flags[i] & 0x40:
            out.random_access.append(out.pes)
        out.pes += 1
    out.payload = b"".join(pieces)
    return out


def feature(streams: list[Stream]) -> str:
    """One line for a media row: per stream its type, counts, continuity errors, time range and random-access points."""
    line = lambda s: f"pid={s.pid:#06x} type={s.kind:#04x} packets={s.packets} pes={s.pes} lost={s.lost} pts={min(s.stamps, default=-1)}..{max(s.stamps, default=-1)} rap={len(s.random_access)} pcr={len(s.clocks)}"
    return "; ".join(map(line, streams))


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<bigint>, random_access array<bigint>"
STREAM_FIELDS = ("pid", "type", "packets", "pes", "lost", "pts", "dts", "random_access", "pcr", "payload")
STREAMS = "array<struct<pid:int,type:int,packets:long,pes:long,lost:long,pts:array<bigint>,dts:array<bigint>,random_access:array<bigint>,pcr:array<bigint>,payload:binary>>"


def store_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column media (binary), the transport stream of each text's bytes."""

    def muxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                media = [mux(pad((t or "").encode())) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(media, pa.binary())], names=[*part.schema.names[:-1], "media"])

    mine = docs.select(*others(docs, "media", "_text"), docs[text].alias("_text"))
    kept = mine.drop("_text").schema
    return mine.mapInArrow(freeing(muxed), kept.add("media", "binary"))


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with a column streams: for each elementary stream its counts, timestamps, random-access points and payload."""

    kind = pa.list_(pa.struct([(n, pa.list_(pa.int64()) if n in ("pts", "dts", "random_access", "pcr") else pa.binary() if n == "payload" else pa.int32() if n in ("pid", "type") else pa.int64()) for n in STREAM_FIELDS]))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [[dict(zip(STREAM_FIELDS, (s.pid, s.kind, s.packets, s.pes, s.lost, s.stamps, s.decode_stamps, s.random_access, s.clocks, s.payload), strict=True)) for s in demux(data or b"")] for data in part.column("_media").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(found, kind)], names=[*part.schema.names[:-1], "streams"])

    mine = df.select(*others(df, "streams", "_media"), df[media].alias("_media"))
    return mine.mapInArrow(freeing(parsed), T.StructType([*mine.drop("_media").schema.fields, *T.StructType.fromDDL(f"streams {STREAMS}").fields]))


def digest(payload: bytes) -> tuple:
    """Stores the padded payload, reads it back, and gives the columns of RESULT."""
    media = mux(pad(payload))
    streams = demux(media)
    back = streams[0].payload
    return len(payload), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(streams), streams[0].stamps, streams[0].random_access


def media_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the columns of RESULT, from the stored bytes of each whole text."""
    schema = docs.select(key).schema
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest((b.column(1)[i].as_py() or "").encode()) for i in range(b.num_rows)]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *names])

    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(RESULT).fields])
    return docs.select(docs[key], docs[text].alias("_text")).mapInArrow(freeing(digested), schema)


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
