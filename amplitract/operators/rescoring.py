"""Alignment to a reference library by scores: banded, affine-gap alignment of each distinct read with the few entries near its sizes.

A library of 200 x 20 sizes (times the structures that stand between the tracts) needs no index, as an entry is known by its
sizes: those that a read seems to have are counted from it, and the entries around them are scored. All pairs of reads
and entries of an Arrow batch go through the dynamic programme at once, a row of the band at a time; a gap along the reference is a running
maximum over the row, so a row is a few numpy operations. Only the best entry of a read is traced back to a CIGAR string.

A read may be clipped at either end at a penalty, and the reference's ends are free. Of equal scores, the entry of least CCG,
then CAG, wins; margin is the distance to the next entry (0: ambiguous). A read whose best score is below `floor` is unmapped: its sizes are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amplitract.sources.reads import FIVE_PRIME, THREE_PRIME, TYPICAL

NEVER = -(1 << 20)
#: Pairs that go through the programme at once.
PAIRS = 4096
SPREAD = 16
_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


@dataclass(frozen=True)
class Scoring:
    """Match and penalties; gaps and clips as (insertion, deletion) and (front, back)."""

    match: int = 1
    mismatch: int = 4
    gap_open: tuple[int, int] = (6, 6)
    gap_extend: tuple[int, int] = (4, 4)
    clip: tuple[int, int] = (5, 5)
    band: int = 30
    floor: int = 30


def entry(cag: int, mid: str, ccg: int, cct: int, five: str = FIVE_PRIME) -> str:
    return five + "CAG" * cag + mid + "CCG" * ccg + "CCT" * cct + THREE_PRIME


def _codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of base codes (4: any other letter), filled up, and their lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), fill, np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = _CODE[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)]
    return out, size


def align(reads: list[str], entries: list[str], shift: np.ndarray, s: Scoring, trace: bool = False) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """The score of each read with its entry, within s.band of the diagonal on which the read begins at the entry's base shift;
    with trace also where on the entry it begins, and how, as a CIGAR string."""
    (r, n), (e, m) = _codes(reads, 5), _codes(entries, 6)
    count, width = len(reads), 2 * s.band + 1
    (open_i, open_d), (more_i, more_d) = s.gap_open, s.gap_extend
    k = np.arange(width)
    slope = (more_d * k).astype(np.int32)
    never = np.full((count, 1), NEVER, np.int32)
    column = shift[:, None] + k - s.band  # the bases of the entry that are used up before row 1
    h = np.where((column >= 0) & (column <= m[:, None]), 0, NEVER).astype(np.int32)
    ins = np.full((count, width), NEVER, np.int32)
    best, best_row, best_k = np.zeros(count, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    came, from_k, opened = [], [], []
    for i in range(r.shape[1]):
        column = column + 1
        there = (column >= 1) & (column <= m[:, None])
        letter = np.take_along_axis(e, np.clip(column - 1, 0, e.shape[1] - 1), axis=1)
        same = (letter == r[:, i : i + 1]) & (letter < 4)
        step = np.where(same, s.match, -s.mismatch).astype(np.int32)
        begin = 0 if i == 0 else -s.clip[0]
        diagonal = np.where(there, np.maximum(h, begin) + step, NEVER)
        by_open, by_more = np.concatenate([h[:, 1:], never], axis=1) - (open_i + more_i), np.concatenate([ins[:, 1:], never], axis=1) - more_i
        new_ins = np.maximum(by_open, by_more)
        straight = np.maximum(diagonal, new_ins)
        lifted = np.maximum.accumulate(straight + slope, axis=1)
        deletion = np.concatenate([never, lifted[:, :-1] - open_d - slope[1:]], axis=1)
        deletion = np.where(there, deletion, NEVER)
        new_h = np.maximum(straight, deletion)
        if trace:
            # 0: begins here, 1: diagonal, 2: insertion, 3: deletion
            how = np.where(deletion > straight, 3, np.where(new_ins > diagonal, 2, np.where(h >= begin, 1, 0)))
            if i == 0:
                how = np.where((how == 1), 0, how)
            came.append(how.astype(np.int8))
            opened.append(by_open >= by_more)
            last = np.maximum.accumulate(np.where(straight + slope == lifted, k, 0), axis=1)
            from_k.append(np.concatenate([np.zeros((count, 1), np.int64), last[:, :-1]], axis=1).astype(np.int16))
        h, ins = new_h, new_ins
        at = h.argmax(axis=1)
        top = h[np.arange(count), at] - np.where(n == i + 1, 0, s.clip[1])
        better = (top > best) & (i < n)
        best, best_row, best_k = np.where(better, top, best), np.where(better, i, best_row), np.where(better, at, best_k)
    if not trace:
        return best, []
    return best, _traced(best, best_row, best_k, n, shift, s, came, from_k, opened)


def _traced(best: np.ndarray, row: np.ndarray, k: np.ndarray, n: np.ndarray, shift: np.ndarray, s: Scoring, came: list, from_k: list, opened: list) -> list[tuple[int, str]]:
    """Goes all best paths back together; each turn takes one step of each path that isn't at its beginning."""
    count = len(best)
    came, from_k, opened = np.stack(came), np.stack(from_k), np.stack(opened)
    steps: list[np.ndarray] = []  # of the letters M, I and D, or 0
    active, inside = best > 0, np.zeros(count, bool)  # inside: of an insertion that isn't opened yet
    every = np.arange(count)
    row, k = row.copy(), k.copy()
    begin = row.copy()
    while active.any():
        how = np.where(inside, 2, came[row, every, k])
        letter = np.where(active, np.array([77, 77, 73, 68], np.uint8)[how], 0).astype(np.uint8)
        jump = active & (how == 3)
        if jump.any():
            length = np.where(jump, k - from_k[row, every, k], 0)
            for j in range(int(length.max())):
                steps.append(np.where(jump & (j < length), 68, 0).astype(np.uint8))
            k = k - length
            letter[jump] = 0
        steps.append(letter)
        insert = active & (how == 2)
        inside = insert & ~opened[row, every, k]
        ends = active & (how == 0)
        begin = np.where(active & ~jump, row, begin)
        moves = active & ~jump & ~ends
        k = np.where(insert, np.minimum(k + 1, 2 * s.band), k)
        row = np.where(moves, row - 1, row)
        active = active & ~ends & (row >= 0)
        row = np.maximum(row, 0)
    paths = np.stack(steps)[::-1].T if steps else np.zeros((count, 0), np.uint8)
    out = []
    for i in range(count):
        path = paths[i][paths[i] > 0]
        if not len(path):
            out.append((0, "*"))
            continue
        turn = np.flatnonzero(np.diff(path, prepend=0))
        runs = [(int(b - a), chr(path[a])) for a, b in zip(turn, [*turn[1:], len(path)], strict=True)]
        used = sum(x for x, c in runs if c in "MI")
        front, back = int(begin[i]), int(n[i] - begin[i] - used)
        start = int(begin[i] + shift[i] + k[i] - s.band)
        out.append((start, (f"{front}S" if front else "") + "".join(f"{x}{c}" for x, c in runs) + (f"{back}S" if back else "")))
    return out


def tracts_of(read: str) -> tuple[int, int]:
    """From where to where a read's tracts seem to go: between the flanks, or from the first two CAG on, or to the end."""
    flank = read.find(FIVE_PRIME[-10:])
    begin = flank + 10 if flank >= 0 else max(read.find("CAGCAG"), 0)
    end = read.rfind(THREE_PRIME[:9], begin)
    return begin, end if end >= 0 else len(read)


def candidates(read: str, mid: str, cct: int, reach: int, most: tuple[int, int]) -> list[tuple[int, int]]:
    """(ccg, cag) of the entries to score: those around the sizes that a read seems to have, and those of about its length."""
    begin, end = tracts_of(read)
    body = read[begin:end]
    cag = min(max(body.count("CAG") - mid.count("CAG"), 1), most[0])
    ccg = min(max(body.count("CCG") - mid.count("CCG"), 1), most[1])
    around = {(c, a) for c in range(ccg - reach, ccg + reach + 1) for a in range(cag - reach, cag + reach + 1)}
    both = round((end - begin - len(mid) - 3 * cct) / 3)
    around |= {(t - a, a) for t in (both - 1, both, both + 1) for a in range(cag - reach - 1, cag + reach + 2)}
    return sorted((c, a) for c, a in around if 1 <= c <= most[1] and 1 <= a <= most[0])


def best_entries(reads: list[str], structures: list[list[tuple[str, int]]], s: Scoring, reach: int, most: tuple[int, int]) -> list[tuple | None]:
    """For each read: (structure, cag, ccg, score, margin, start, cigar) of its best entry, or None."""
    pair_read, pair_entry = [], []
    for i, (read, known) in enumerate(zip(reads, structures, strict=True)):
        for j, (mid, cct) in enumerate(known):
            chosen = candidates(read, mid, cct, reach, most)
            pair_read += [i] * len(chosen)
            pair_entry += [(j, c, a) for c, a in chosen]
    shifts = np.array([len(FIVE_PRIME) - tracts_of(r)[0] for r in reads], np.int64)
    spell = lambda i, x: entry(x[2], structures[i][x[0]][0], x[1], structures[i][x[0]][1])
    found: list[tuple | None] = [None] * len(reads)
    scores = np.zeros(len(pair_read), np.int64)
    for at in range(0, len(pair_read), PAIRS):
        part = slice(at, at + PAIRS)
        scores[part], _ = align([reads[i] for i in pair_read[part]], [spell(i, x) for i, x in zip(pair_read[part], pair_entry[part], strict=True)], shifts[pair_read[part]], s)
    order = np.lexsort((np.arange(len(scores)), -scores, pair_read))
    first = np.flatnonzero(np.diff(np.array(pair_read)[order], prepend=-1)) if len(order) else []
    winners = []
    for a, b in zip(first, [*first[1:], len(order)], strict=True):
        top = int(scores[order[a]])
        if top >= s.floor:
            winners.append((pair_read[order[a]], pair_entry[order[a]], top, top - (int(scores[order[a + 1]]) if b - a > 1 else 0)))
    for at in range(0, len(winners), PAIRS // 8):
        part = winners[at : at + PAIRS // 8]
        _, paths = align([reads[w[0]] for w in part], [spell(w[0], w[1]) for w in part], shifts[[w[0] for w in part]], s, trace=True)
        for (i, (j, c, a), top, margin), (start, cigar) in zip(part, paths, strict=True):
            found[i] = (j, a, c, top, margin, start, cigar)
    return found


def rescore(rows: DataFrame, structures: Column | None = None, scoring: Scoring = Scoring(), reach: int = 2, most: tuple[int, int] = (200, 20)) -> DataFrame:
    """rows (with seq) and the library entry that fits each best: ref_mid, ref_cct, contig_cag, contig_ccg, score, margin, start
    (the entry's first aligned base, from 0) and cigar; all null if none does. structures is an array of (mid, cct) that are to be tried, the
    typical one if not given. Equal reads of a batch are aligned once."""
    typical = F.array(F.struct(F.lit(TYPICAL).alias("mid"), F.lit(2).alias("cct")))
    given = rows.withColumn("structures", structures if structures is not None else typical)
    kept = [c for c in given.columns if c != "structures"]
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "structures")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tries = [tuple((x["mid"] or "", x["cct"]) for x in row or []) for row in b.column("structures").to_pylist()]
            keys = list(zip((x or "" for x in b.column("seq").to_pylist()), tries, strict=True))
            once = list(dict.fromkeys(keys))
            best = dict(zip(once, best_entries([k[0] for k in once], [list(k[1]) for k in once], scoring, reach, most), strict=True))
            found = [best[k] for k in keys]
            pick = lambda f, kind: pa.array([None if x is None else f(x, k) for x, k in zip(found, keys, strict=True)], kind)
            new = [pick(lambda x, k: k[1][x[0]][0], pa.string()), pick(lambda x, k: k[1][x[0]][1], pa.int32())]
            new += [pick(lambda x, _, at=at: x[at], kind) for at, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()), (5, pa.int32()), (6, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=[*kept, *NEW])

    return given.mapInArrow(aligned, f"{kinds}, ref_mid string, ref_cct int, contig_cag int, contig_ccg int, score int, margin int, start int, cigar string")


NEW = ("ref_mid", "ref_cct", "contig_cag", "contig_ccg", "score", "margin", "start", "cigar")


def entry_label(rows_mid: Column, cag: Column, ccg: Column, cct: Column) -> Column:
    """The name of a library entry: CAG_CAACAG_CCGCCA_CCG_CCT."""
    first = F.regexp_count(rows_mid, F.lit("CAACAG"))
    second = F.regexp_count(F.replace(rows_mid, F.lit("CAACAG"), F.lit("")), F.lit("CCGCCA"))
    return F.concat_ws("_", *[c.cast("string") for c in (cag, first, second, ccg, cct)])


def entry_sequence(mid: Column, cag: Column, ccg: Column, cct: Column) -> Column:
    return F.concat(F.lit(FIVE_PRIME), F.repeat(F.lit("CAG"), cag), mid, F.repeat(F.lit("CCG"), ccg), F.repeat(F.lit("CCT"), cct), F.lit(THREE_PRIME))


def aligned_reads(reads: DataFrame, structures: DataFrame | None = None, more: tuple[str, ...] = (), scoring: Scoring = Scoring()) -> DataFrame:
    """The mapped reads summed by sequence (and columns named more), each with its library entry. structures: (sample_id, structures),
    the array of (mid, cct) that a sample's reads are tried with. Equal sequences go to the same few tasks, each of which aligns
    them once; where each read has qualities of its own (q), a frequent one is dealt to SPREAD tasks."""
    keys = ["sample_id", "mate", "seq", *more]
    same = reads.where("mapq >= 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if structures is not None:
        same = same.join(structures, "sample_id")
    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*keys), F.lit(SPREAD if "q" in more else 1))
    return rescore(same.repartition(tasks, F.col("seq"), spread), F.col("structures") if structures is not None else None, scoring)
