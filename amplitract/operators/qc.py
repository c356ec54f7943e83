"""Quality control of reads: profiles by position, trimming, demultiplexing and subsampling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_base(reads: DataFrame) -> DataFrame:
    """(mate, pos, base, q, n) from (mate, seq, quality): equal reads are summed before bases are exploded. quality may be one
    number a read or an array with one a base."""
    same = reads.groupBy("mate", "seq", "quality").agg(F.count(F.lit(1)).alias("n"))
    each = same.select("mate", "quality", "n", F.posexplode(F.split("seq", "")).alias("i", "base")).where("base <> ''")
    q = F.get("quality", F.col("i")) if dict(reads.dtypes)["quality"].startswith("array") else F.col("quality")
    return each.groupBy("mate", (F.col("i") + 1).alias("pos"), "base", q.alias("q")).agg(F.sum("n").alias("n"))


def base_quality(bases: DataFrame) -> DataFrame:
    """Mean, and the 10th, 25th, 50th, 75th and 90th percentile (least value that so many reach), of quality by position."""
    by = Window.partitionBy("mate", "pos").orderBy("q")
    sums = bases.groupBy("mate", "pos", "q").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy("mate", "pos")))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("q"))).alias(f"p{p}")
    mean = F.round(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 6).alias("mean")
    return sums.groupBy("mate", "pos").agg(mean, *[at(p) for p in (10, 25, 50, 75, 90)])


def base_content(bases: DataFrame) -> DataFrame:
    """The percentage of N, and of G and C, by position."""
    share = lambda *which: F.round(100.0 * F.sum(F.when(F.col("base").isin(*which), F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return bases.groupBy("mate", "pos").agg(share("N").alias("n_pcnt"), share("G", "C").alias("gc_pcnt"))


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy("mate", F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def basic_statistics(reads: DataFrame) -> DataFrame:
    """Reads, shortest and longest, percentage of G and C, and a status: fail below 100 reads, warn outside of 30 to 70 percent."""
    gc = F.length("seq") - F.length(F.translate("seq", "GC", ""))
    out = reads.groupBy("sample_id", "mate").agg(F.count(F.lit(1)).alias("total"), F.min(F.length("seq")).alias("shortest"), F.max(F.length("seq")).alias("longest"), F.round(100.0 * F.sum(gc) / F.sum(F.length("seq")), 6).alias("gc"))
    return out.withColumn("status", F.when(F.col("total") < 100, "fail").when(~F.col("gc").between(30, 70), "warn").otherwise("pass"))


def quality_cut(quality: Column, cutoff: int) -> Column:
    """How many bases stay if the 3' end is trimmed: from the end on, cutoff less quality is summed until the sum falls below
    zero; the cut is where the sum was largest."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"), F.size(quality).alias("cut"), F.size(quality).alias("i"), F.lit(False).alias("stop"))

    def step(s: Column, q: Column) -> Column:
        total = s["sum"] + cutoff - q
        stop = s["stop"] | (total < 0)
        better = ~stop & (total > s["most"])
        return F.struct(total.alias("sum"), F.when(better, total).otherwise(s["most"]).alias("most"), F.when(better, s["i"] - 1).otherwise(s["cut"]).alias("cut"), (s["i"] - 1).alias("i"), stop.alias("stop"))

    return F.aggregate(F.reverse(quality), start, step, lambda s: s["cut"])


def trim_adapter(reads: DataFrame, three: str = "", five: str = "", anchored: bool = False) -> DataFrame:
    """Exact trimming: what stands from the 3' adapter on, and up to the end of the 5' adapter, goes. Anchored adapters
    count at the very end and the very beginning only."""
    seq = F.col("seq")
    if three:
        at = F.when(F.endswith(seq, F.lit(three)), F.length(seq) - len(three) + 1).otherwise(0) if anchored else F.instr(seq, three)
        seq = F.when(at > 0, F.substring(seq, F.lit(1), at - 1)).otherwise(seq)
    if five:
        at = F.when(F.startswith(seq, F.lit(five)), 1).otherwise(0) if anchored else F.instr(seq, five)
        seq = F.when(at > 0, F.substring(seq, at + len(five), F.length(seq))).otherwise(seq)
    return reads.withColumn("trimmed", seq)


def trim_mates(reads: DataFrame, forward: str, reverse: str) -> DataFrame:
    """Exact 3' trimming with another adapter for each mate."""
    adapter = F.when(F.col("mate") == "R1", forward).otherwise(reverse)
    at = F.when(adapter != "", F.instr("seq", adapter)).otherwise(0)
    return reads.withColumn("trimmed", F.when(at > 0, F.substring("seq", F.lit(1), at - 1)).otherwise(F.col("seq")))


def trim_either(reads: DataFrame, adapter: str) -> DataFrame:
    """Exact trimming of an adapter that may be at either end: one with which a read begins goes, of any other all from it on."""
    at = F.instr("seq", adapter)
    cut = F.when(at == 1, F.substring("seq", len(adapter) + 1, 1 << 30)).when(at > 1, F.substring(F.col("seq"), F.lit(1), at - 1))
    return reads.withColumn("trimmed", F.when(F.lit(bool(adapter)), cut.otherwise(F.col("seq"))).otherwise(F.col("seq")))


def trim_by_flag(reads: DataFrame, flag: str, forward: str, reverse: str, error_rate: float = 0.0) -> DataFrame:
    """Adapters of both mates (trimmed), as a flag says: -a at the 3' end, -g at the 5' end, -a$ and -g^ anchored, -b at either.
    With an error_rate, -a and -g allow for edits; anchored ones and those of either end are exact."""

    def one(mate: DataFrame, adapter: str) -> DataFrame:
        if not adapter:
            return mate.withColumn("trimmed", F.col("seq"))
        if flag == "-b":
            return trim_either(mate, adapter)
        ends = {"three" if flag[1] == "a" else "five": adapter}
        if error_rate and len(flag) == 2:
            return trim_adapter_fuzzy(mate, error_rate=error_rate, **ends).drop("keep", "skip")
        return trim_adapter(mate, anchored=len(flag) > 2, **ends)

    first, second = one(reads.where("mate = 'R1'"), forward), one(reads.where("mate <> 'R1'"), reverse)
    return first.unionByName(second.select(first.columns))


def trim(reads: DataFrame, kind: str, cutoff: int = 5, three: str = "", five: str = "", reverse: str | None = None, flag: str = "-a", error_rate: float = 0.0) -> DataFrame:
    """reads (seq, q: array of qualities) with trimmed: by quality, by adapter, or both, quality first. With `reverse` that is
    the adapter of the second mate, and three that of the first, both where flag says and with errors if a rate is given."""
    if kind not in ("Quality", "Adapter", "Both"):
        raise ValueError("Quality, Adapter or Both is asked for")
    good = F.col("seq") if kind == "Adapter" else F.substring("seq", F.lit(1), quality_cut(F.col("q"), cutoff))
    whole = reads.withColumn("_whole", F.col("seq")).withColumn("seq", good)
    if kind == "Quality":
        done = whole.withColumn("trimmed", F.col("seq"))
    else:
        done = trim_adapter(whole, three, five) if reverse is None else trim_by_flag(whole, flag, three, reverse, error_rate)
    return done.withColumn("seq", F.col("_whole")).drop("_whole")


def trim_report(trimmed: DataFrame) -> DataFrame:
    lost = F.length("seq") - F.length("trimmed")
    return trimmed.groupBy("sample_id", "mate").agg(F.count_if(lost > 0).alias("reads_trimmed"), F.sum(lost).cast("long").alias("bases_removed"))


def trim_adapter_fuzzy(reads: DataFrame, three: str = "", error_rate: float = 0.1, least: int = 3, five: str = "") -> DataFrame:
    """As trim_adapter, with up to error_rate edits for each adapter base that is aligned; a part of the adapter, `least` bases
    at least, counts at the read's end or beginning. Distinct sequences are aligned once, in Arrow batches."""

    def aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            keep = [_adapter_start(s, three, error_rate, least) if three else len(s) for s in df["seq"]]
            skip = [len(s) - _adapter_start(s[::-1], five[::-1], error_rate, least) if five else 0 for s in df["seq"]]
            yield df.assign(keep=keep, skip=skip)

    cut = reads.select("seq").distinct().mapInPandas(aligned, "seq string, keep int, skip int")
    return reads.join(cut, "seq").withColumn("trimmed", F.expr("substring(seq, skip + 1, greatest(keep - skip, 0))"))


def _adapter_start(seq: str, adapter: str, error_rate: float, least: int) -> int:
    """Where the adapter, or a prefix of it at the end, begins; the length of seq if nowhere. Semi-global edit distance."""
    cost, origin = list(range(len(adapter) + 1)), [0] * (len(adapter) + 1)
    best = (0, 0, len(seq))
    for j, base in enumerate(seq):
        above, came = cost[0], origin[0]
        cost[0], origin[0] = 0, j + 1
        for i, wanted in enumerate(adapter, 1):
            old, old_origin = cost[i], origin[i]
            cost[i], origin[i] = min((above + (base != wanted), came), (old + 1, old_origin), (cost[i - 1] + 1, origin[i - 1]))
            above, came = old, old_origin
        if cost[-1] <= error_rate * len(adapter):
            best = max(best, (len(adapter) - cost[-1], -cost[-1], origin[-1]), key=lambda b: b[:2])
    for i in range(least, len(adapter)):
        if cost[i] <= error_rate * i:
            best = max(best, (i - cost[i], -cost[i], origin[i]), key=lambda b: b[:2])
    return best[2]


def demultiplex(reads: DataFrame, five: str, three: str, shortest: int, longest: int) -> DataFrame:
    """Reads that hold both adapters with a length between them, as that part."""
    after = F.instr("seq", five) + len(five)
    until = F.instr("seq", three)
    part = F.substring(F.col("seq"), after, until - after)
    held = reads.where((F.instr("seq", five) > 0) & (until > after))
    return held.withColumn("part", part).where(F.length("part").between(shortest, longest))


def demultiplex_fuzzy(reads: DataFrame, five: str, three: str, shortest: int, longest: int, error_rate: float = 0.1, overlap: int = 3) -> DataFrame:
    """As demultiplex, with errors: both adapters, or parts of `overlap` bases at least at the ends, must be found."""
    cut = trim_adapter_fuzzy(reads, three, error_rate, overlap, five).withColumnRenamed("trimmed", "part")
    return cut.where((F.col("skip") > 0) & (F.col("keep") < F.length("seq")) & F.length("part").between(shortest, longest)).drop("keep", "skip")


#: (reads from, share kept in thousandths), for files of reads and for their alignments; smaller ones are kept whole.
FILE_STEPS = [(100_000, 254), (50_000, 500), (25_000, 750)]
SCAN_STEPS = [(20_000, 350), (15_000, 450), (10_000, 550), (5_000, 650)]


def subsample(reads: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Keeps the share that a sample's number of reads asks for, by a hash of the read id, so that mates stay together."""
    sizes = reads.groupBy("sample_id").agg(F.count(F.lit(1)).alias("reads"))
    share = F.lit(1000)
    for least, kept in reversed(steps):
        share = F.when(F.col("reads") >= least, kept).otherwise(share)
    return reads.join(sizes.withColumn("share", share), "sample_id").where(F.conv(F.substring(F.md5(F.col("read_id").cast("string")), 1, 8), 16, 10).cast("long") % 1000 < F.col("share"))
