"""Rescoring and variant calls against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from amplitract.operators import rescoring as S
from amplitract.operators import variants as V
from amplitract.operators.tracts import assign_contigs, scan_tracts
from amplitract.sources.reads import FIVE_PRIME, TYPICAL

READS = "sample_id int, mate string, mapq int, seq string, quality int"
SCORINGS = [S.Scoring(band=150), S.Scoring(match=2, mismatch=3, gap_open=(3, 5), gap_extend=(1, 2), clip=(2, 7), band=150)]


def plain_score(r, e, s):
    """The whole table of the dynamic programme, cell by cell."""
    never = -(10**6)
    h = [[never] * (len(e) + 1) for _ in range(len(r) + 1)]
    ins, dele = ([[never] * (len(e) + 1) for _ in range(len(r) + 1)] for _ in range(2))
    h[0], best = [0] * (len(e) + 1), 0
    for i in range(1, len(r) + 1):
        for j in range(len(e) + 1):
            ins[i][j] = max(h[i - 1][j] - s.gap_open[0], ins[i - 1][j]) - s.gap_extend[0]
            diagonal = never
            if j:
                dele[i][j] = max(h[i][j - 1] - s.gap_open[1], dele[i][j - 1]) - s.gap_extend[1]
                diagonal = max(h[i - 1][j - 1], -s.clip[0] if i > 1 else 0) + (s.match if r[i - 1] == e[j - 1] != "N" else -s.mismatch)
            h[i][j] = max(diagonal, ins[i][j], dele[i][j])
            best = max(best, h[i][j] - (s.clip[1] if i < len(r) else 0))
    return best


def score_of(r, e, start, cigar, s):
    total, i, j = 0, 0, start
    for k, (n, op) in enumerate((int(n), op) for n, op in re.findall(r"(\d+)([MIDS])", cigar)):
        if op == "M":
            total += sum(s.match if a == b != "N" else -s.mismatch for a, b in zip(r[i : i + n], e[j : j + n], strict=True))
        elif op == "S":
            total -= s.clip[0 if k == 0 else 1]
        else:
            total -= s.gap_open[op == "D"] + n * s.gap_extend[op == "D"]
        i, j = i + (n if op != "D" else 0), j + (n if op in "MD" else 0)
    assert i == len(r)
    return total


@pytest.mark.parametrize("s", SCORINGS)
def test_scores_and_paths(s):
    rng = random.Random(1)
    reads, entries = [], []
    for k in range(60):
        e = S.entry(rng.randint(3, 9), TYPICAL, rng.randint(2, 5), 2)
        r = list(e[rng.randint(0, 10) : len(e) - rng.randint(0, 20)])
        for _ in range(rng.randint(0, 6)):
            p, x = rng.randrange(len(r)), rng.random()
            if x < 0.4:
                r[p] = rng.choice("ACGTN")
            elif x < 0.7:
                r[p : p + rng.randint(1, 5)] = []
            else:
                r[p:p] = [rng.choice("ACGT") for _ in range(rng.randint(1, 5))]
        reads.append("".join(r))
        entries.append(S.entry(rng.randint(3, 9), TYPICAL, rng.randint(2, 5), 2) if k % 3 == 0 else e)
    reads += ["", "N", "TTTTTTTTTTTTTTTTTTTTTTT"]
    entries += entries[:3]
    shift = np.array([rng.randint(-2, 5) for _ in reads])
    scores, paths = S.align(reads, entries, shift, s, trace=True)
    assert scores.tolist() == S.align(reads, entries, shift, s)[0].tolist() == [plain_score(r, e, s) for r, e in zip(reads, entries, strict=True)]
    for r, e, score, (start, cigar) in zip(reads, entries, scores, paths, strict=True):
        assert (cigar == "*" and score == 0) or score_of(r, e, start, cigar, s) == score


def test_best_entry_is_that_of_the_whole_library():
    """The entries that are scored hold the best of all (here of a small library), ties and margins included."""
    rng = random.Random(2)
    s, most = S.Scoring(band=60), (12, 6)
    entries = {(c, a): S.entry(a, TYPICAL, c, 2) for c in range(1, 7) for a in range(1, 13)}
    reads = []
    for _ in range(12):
        r = list(S.entry(rng.randint(3, 10), rng.choice([TYPICAL, "CAACAG", "CAACAGCAACAGCCGCCA", "CAACAGCTGCTA"]), rng.randint(2, 5), rng.choice([2, 2, 3])))
        for _ in range(rng.randint(0, 2)):
            r[rng.randrange(len(r))] = rng.choice("ACGT")
        reads.append("A" * rng.randint(0, 2) + "".join(r))
    found = S.best_entries(reads, [[(TYPICAL, 2)]] * len(reads), s, 2, most)
    for r, f in zip(reads, found, strict=True):
        scores = {k: plain_score(r, e, s) for k, e in entries.items()}
        best = max(scores.values())
        assert (f[3], f[2], f[1]) == (best, *min(k for k, v in scores.items() if v == best))


def test_planted_reads_come_to_their_bins(spark):
    """A base more or less in a tract, or one that is wrong, moves what a scan of triplets finds, and not the alignment."""
    e = S.entry(20, TYPICAL, 8, 2)
    tract = len(FIVE_PRIME)
    wrong = e[: tract + 31] + "T" + e[tract + 32 :]
    lost = e[: tract + 25] + e[tract + 26 :]
    more = e[: tract + 30] + "A" + e[tract + 30 :]
    planted = [e, wrong, lost, more, "AC" + e, e[30:], e[:-12], "".join(random.Random(0).choice("ACGT") for _ in range(150)), "", None]
    rows = spark.createDataFrame([(k, "R1", 60, x, 30) for k, x in enumerate(planted)], READS)
    got = {r.sample_id: r for r in S.aligned_reads(rows, more=("quality",)).collect()}
    assert all((got[k].contig_cag, got[k].contig_ccg) == (20, 8) for k in range(7))
    assert all(got[k].contig_cag is None and got[k].cigar is None for k in (7, 8, 9))
    n = len(e)
    assert [got[k].cigar for k in (0, 1, 4, 5)] == [f"{n}M", f"{n}M", f"2S{n}M", f"{n - 30}M"]
    assert {op for op in re.findall("[A-Z]", got[2].cigar)} == {"M", "D"} and {op for op in re.findall("[A-Z]", got[3].cigar)} == {"M", "I"}
    assert got[5].start == 30 and got[0].score == n and got[1].score == n - 5 and got[0].margin > 0
    scanned = {r.sample_id: (r.contig_cag, r.contig_ccg) for r in assign_contigs(scan_tracts(rows)).collect()}
    assert all(scanned.get(k) != (20, 8) for k in (2, 3))


def test_structures_of_a_sample(spark):
    mid = "CAACAGCAACAGCCGCCA"
    rows = spark.createDataFrame([(0, "R1", 60, S.entry(17, mid, 7, 2), 30), (1, "R1", 60, S.entry(17, mid, 7, 2), 30), (1, "R1", 0, S.entry(17, mid, 7, 2), 30)], READS)
    known = spark.createDataFrame([(0, [(TYPICAL, 2)]), (1, [(TYPICAL, 2), (mid, 2)])], "sample_id int, structures array<struct<mid:string,cct:int>>")
    got = {r.sample_id: r for r in S.aligned_reads(rows, known).withColumn("label", S.entry_label(F.col("ref_mid"), F.col("contig_cag"), F.col("contig_ccg"), F.col("ref_cct"))).collect()}
    assert (got[0].label, got[1].label) == ("19_1_1_7_2", "17_2_1_7_2") and got[1].n == 1
    assert got[1].score == len(S.entry(17, mid, 7, 2)) and got[0].score == got[1].score - 5


def test_runs_of_cigars(spark):
    cigars = [("10M", 3), ("2S5M1I4M", 0), ("3M2D3M1S", 7), ("4S", 0), ("*", 0)]
    rows = spark.createDataFrame(cigars, "cigar string, start int").select(V.aligned_runs(F.col("cigar"), F.col("start")).alias("runs")).collect()
    assert [[tuple(x) for x in r.runs] for r in rows] == [[(0, 3, 10)], [(2, 0, 5), (8, 5, 4)], [(0, 7, 3), (3, 12, 3)], [], []]


def plain_calls(counts, theta=0.001):
    """counts: {pos: (ref, [(base, quality, n)])}"""
    out = {}
    for pos, (ref, seen) in counts.items():
        others = {}
        for b, _, n in seen:
            if b != ref:
                others[b] = others.get(b, 0) + n
        if not others:
            continue
        alt = min(others, key=lambda b: (-others[b], b))
        if others[alt] < 2:
            continue
        g = [math.log10(1 - 1.5 * theta), math.log10(theta), math.log10(theta / 2)]
        for b, q, n in seen:
            e = min(0.75, 10 ** (-q / 10))
            p = {x: 1 - e if b == x else e / 3 for x in (ref, alt)}
            for k, x in enumerate((p[ref], (p[ref] + p[alt]) / 2, p[alt])):
                g[k] += n * math.log10(x)
        whole = max(g) + math.log10(sum(10 ** (x - max(g)) for x in g))
        if max(g) > g[0]:
            out[pos] = (alt, "1/1" if max(g) == g[2] else "0/1", -10 * (g[0] - whole), others[alt])
    return out


def test_calls_against_plain_likelihoods(spark):
    rng = random.Random(6)
    counts, rows = {}, []
    for pos in range(1, 120):
        ref, share = rng.choice("ACGT"), rng.choice([0, 0.02, 0.3, 0.5, 1])
        alt = rng.choice([b for b in "ACGT" if b != ref])
        seen = {}
        for _ in range(rng.choice([3, 12, 60])):
            key = (alt if rng.random() < share else rng.choice("ACGT") if rng.random() < 0.03 else ref, rng.choice([0, 2, 15, 30, 40]))
            seen[key] = seen.get(key, 0) + 1
        counts[pos] = (ref, [(b, q, n) for (b, q), n in seen.items()])
        rows += [("s", pos, ref, b, q, n) for (b, q), n in seen.items()]
    got = V.call_variants(spark.createDataFrame(rows, "k string, pos int, ref string, base string, q int, n long").repartition(5), ["k"]).collect()
    want = plain_calls(counts)
    assert {r.pos: (r.alt, r.gt, r.alt_depth) for r in got} == {p: (a, g, d) for p, (a, g, _, d) in want.items()} and len(want) > 20
    assert all(math.isclose(r.qual, want[r.pos][2], abs_tol=2e-3) for r in got)
    assert {g for _, g, _, _ in want.values()} == {"0/1", "1/1"}


def test_planted_variants(spark):
    """Half of the reads of one contig and all of another's have a variant, with a quality for each base; gaps don't shift it."""
    e = S.entry(18, TYPICAL, 7, 2)
    other = e[:20] + ("A" if e[20] != "A" else "C") + e[21:]
    gap = other[: len(FIVE_PRIME) + 10] + other[len(FIVE_PRIME) + 13 :]
    rows = [(0, "R1", 60, x, [35] * len(x)) for x in [e] * 30 + [other] * 25] + [(1, "R1", 60, x, [20] * len(x)) for x in [other] * 12 + [gap] * 9]
    reads = spark.createDataFrame(rows, "sample_id int, mate string, mapq int, seq string, q array<int>")
    aligned = S.aligned_reads(reads, more=("q",)).where("cigar IS NOT NULL")
    entry = [F.col(c) for c in ("ref_mid", "contig_cag", "contig_ccg", "ref_cct")]
    counts = V.base_counts(aligned.withColumn("chrom", S.entry_label(*entry)), ["sample_id", "chrom"], S.entry_sequence(*entry))
    assert counts.groupBy("sample_id", "chrom", "pos").agg(F.sum("n").alias("n")).where("n > 55").count() == 0
    calls = sorted((r.sample_id, r.chrom, r.pos, r.ref, r.alt, r.gt) for r in V.call_variants(counts, ["sample_id", "chrom"]).collect())
    assert calls == [(0, "18_1_1_7_2", 21, e[20], other[20], "0/1"), (1, "17_1_1_7_2", 21, e[20], other[20], "1/1"), (1, "18_1_1_7_2", 21, e[20], other[20], "1/1")]
