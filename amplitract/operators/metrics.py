"""Quality of an allele's peak, its confidence interval, and the rules of its confidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplitract.functions.exprs import t_quantile
from amplitract.operators.genotype import SLICE


def peak_metrics(bins: DataFrame) -> DataFrame:
    """For each allele at its call N: slippage (N-2 to N-1) and neighbour ratios on smoothed counts, mosaicism (N+1 to N+10) on
    raw counts, each over the count at N; vicinity, the share of N-5 to N+5; total reads of the slice."""
    w = Window.partitionBy(*SLICE).orderBy("cag")
    over = lambda c, lo, hi: F.coalesce(F.sum(c).over(w.rowsBetween(lo, hi)), F.lit(0))
    rows = bins.select(
        *SLICE, "call", "cag", "n", "smooth", over("smooth", -2, -1).alias("back"), over("n", 1, 10).alias("ahead"), over("smooth", -5, 5).alias("around"),
        F.coalesce(F.lag("smooth").over(w), F.lit(0)).alias("minus"), F.coalesce(F.lead("smooth").over(w), F.lit(0)).alias("plus"),
        F.sum("smooth").over(Window.partitionBy(*SLICE)).alias("all"), F.sum("n").over(Window.partitionBy(*SLICE)).alias("total"),
    ).where("cag = call")
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return rows.select(
        *SLICE, "call", share("back", "smooth").alias("slippage"), share("ahead", "n").alias("mosaicism"), share("minus", "smooth").alias("nminus"),
        share("plus", "smooth").alias("nplus"), share("around", "all").alias("vicinity"), "total",
    )


#: (ratio, tolerance, level): the drop-off warnings below and above the peak; past the last, level 6.
DROP_MINUS = [(0.25, 0.02, 1), (0.35, 0.04, 2), (0.45, 0.05, 3), (0.60, 0.05, 4), (0.75, 0.05, 5)]
DROP_PLUS = [(0.05, 0.02, 1), (0.15, 0.03, 2), (0.27, 0.03, 3), (0.37, 0.05, 4), (0.65, 0.05, 5)]


def drop_level(ratio: str, steps: list, most: float) -> str:
    """The highest warning level whose range holds the ratio, as SQL."""
    whens = " ".join(f"WHEN abs({ratio} - {x}) <= {t} + 0.00001 * {x} THEN {z}" for x, t, z in reversed(steps))
    return f"CASE WHEN {ratio} > {most} THEN 6 {whens} ELSE 0 END"


def confidence_interval(bins: DataFrame) -> DataFrame:
    """The 95 percent interval of the mean repeat size, from weighted sums: no row for each read is made."""
    weight = F.when(F.col("cag").between(F.col("call") - 10, F.col("call") + 10), F.col("n")).otherwise(F.expr("cast(n - n / 100 * 85.0D as bigint)"))
    w = bins.withColumn("w", weight).groupBy(*SLICE, "call").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("cag")).alias("sx"), F.sum(F.col("w") * F.col("cag") * F.col("cag")).alias("sxx"))
    w = w.where("n > 1").withColumn("m", F.col("sx").cast("double") / F.col("n"))
    spread = F.greatest(F.lit(0.0), (F.col("sxx") - F.col("n") * F.col("m") * F.col("m")) / (F.col("n") - 1))
    half = F.sqrt(spread / F.col("n")) * t_quantile((F.col("n") - 1).cast("double"))
    w = w.withColumn("lo", F.bround(F.col("m") - half).cast("int")).withColumn("hi", F.bround(F.col("m") + half).cast("int"))
    return w.select(*SLICE, "call", F.round("m", 6).alias("mean"), "lo", "hi", interval_text(F.col("lo"), F.col("hi"), F.col("call")).alias("interval"))


def interval_text(lo: Column, hi: Column, n: Column) -> Column:
    text = lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))
    same = F.when(F.abs(hi - n) > 1, text(lo, n)).when(F.abs(hi - n) == 1, text(n, n)).otherwise(text(lo, hi))
    return F.when(lo == hi, same).when(n > hi, text(lo, n)).otherwise(text(lo, hi))


#: (rule, delta as SQL, null if the rule has no event): bounds are open, so values right at a bound between bands give none.
PENALTIES = [
    ("recall count", "CASE WHEN recalls = 7 THEN -25 WHEN recalls IN (5, 6) THEN -15 WHEN recalls BETWEEN 1 AND 3 THEN -5 END"),
    ("zygosity", "CASE state WHEN 'homozygous' THEN -25 WHEN 'neighbouring' THEN -15 END"),
    ("diminished peak", "CASE WHEN diminished THEN -10 END"),
    ("overwritten genotype", "CASE WHEN fod_overwrite THEN -20 END"),
    ("missed expansion", "CASE WHEN fod_overwrite AND missed_expansion THEN -50 END"),
    ("atypical", "CASE WHEN status = 'Atypical' THEN -5 ELSE 1 END"),
    ("mixed structure", "CASE WHEN abs(CASE WHEN status = 'Atypical' THEN atypical_pcnt ELSE typical_pcnt END - 50) <= 5.0005 THEN -30 END"),
    ("clear structure", "CASE WHEN status = 'Atypical' AND abs(atypical_pcnt - 80) <= 20.0008 THEN 15 WHEN status = 'Typical' AND abs(typical_pcnt - 80) <= 15.0008 THEN 2 END"),
    ("total reads", "CASE WHEN total > 10000 THEN 5 WHEN total < 1000 THEN -15 ELSE 1 END"),
    ("vicinity", "CASE WHEN vicinity > 0.85 THEN 1 WHEN vicinity > 0.65 AND vicinity < 0.8499 THEN -10 WHEN vicinity > 0.45 AND vicinity < 0.6499 THEN -15 WHEN vicinity > 0 AND vicinity < 0.4499 THEN -20 END"),
    ("slippage", "CASE WHEN slippage > 0 AND slippage < 0.1 THEN 5 WHEN slippage > 0.1 AND slippage < 0.25 THEN 1 WHEN slippage > 0.25 THEN -1 END"),
    ("mosaicism", "CASE WHEN mosaicism > 0 AND mosaicism < 0.01 THEN 10 WHEN mosaicism > 0.01 AND mosaicism < 0.015 THEN 5 WHEN mosaicism > 0.015 THEN -1 END"),
    ("slippage overwrite", "CASE WHEN slippage_overwrite THEN -25 END"),
    ("CCG threshold", "CASE WHEN ccg_threshold = 0.5 THEN 1 WHEN ccg_threshold > 0.3 THEN -5 WHEN ccg_threshold < 0.3 THEN -10 END"),
    ("threshold", "CASE WHEN threshold = 0.5 THEN 1 WHEN threshold > 0.3 THEN -5 WHEN threshold < 0.3 THEN -10 END"),
    ("below the peak", "CASE minus_level WHEN 0 THEN 5 WHEN 1 THEN -5 WHEN 2 THEN -7 WHEN 5 THEN -10 WHEN 6 THEN -10 ELSE -15 END"),
    ("above the peak", "CASE plus_level WHEN 0 THEN 5 WHEN 1 THEN -5 WHEN 2 THEN -7 WHEN 5 THEN -10 WHEN 6 THEN -10 ELSE -15 END"),
]
#: Rules that come after the factor of subsampled reads.
LATE = [
    ("forward mapped", "CASE WHEN fw_mapped > 90 THEN 2 WHEN fw_mapped > 85 AND fw_mapped < 90 THEN 1 ELSE -2 END"),
    ("reverse mapped", "CASE WHEN rv_mapped > 90 THEN 2 WHEN rv_mapped > 85 AND rv_mapped < 90 THEN 1 ELSE -2 END"),
    ("peak inspection", "CASE WHEN inspection THEN -10 END"),
    ("uncertain CCG", "CASE WHEN ccg_uncertain THEN -15 END"),
    ("alignment warning", "CASE WHEN alignment_warning THEN -15 END"),
    ("atypical alignment warning", "CASE WHEN atypical_warning THEN -50 END"),
    ("fatally few reads", "CASE WHEN fatal_low THEN -25 END"),
    ("differential confusion", "CASE WHEN diff_confuse THEN -30 END"),
    ("no second allele", "CASE WHEN NOT heuristic_ok THEN -20 END"),
]


def penalty_events(rows: DataFrame) -> DataFrame:
    """(sample_id, allele, rule, delta) of each rule that has an event. rows has a column for each name the rules use."""
    events = F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(delta).cast("int").alias("delta")) for rule, delta in PENALTIES + LATE])
    return rows.select(*SLICE, F.explode(F.filter(events, lambda e: e["delta"].isNotNull())).alias("e")).select(*SLICE, "e.rule", "e.delta")


def subsample_factor(reads: Column, fraction: Column) -> Column:
    """The factor of a score for a fraction of so many reads; of two bands that share a bound of reads the later counts, of
    two that share a bound of the fraction the first."""
    band = lambda low, middle, high: F.when(fraction.between(0.1, 0.3), low).when(fraction.between(0.3, 0.6), middle).when(fraction.between(0.6, 0.9), high).otherwise(1.0)
    return F.when(reads < 2000, band(0.35, 0.40, 0.45)).when(reads < 5000, band(0.55, 0.65, 0.70)).when(reads <= 10000, band(0.75, 0.85, 0.95)).otherwise(1.0)


def ratio_context(ratio: Column) -> Column:
    """What a score loses for an allele's share of all reads."""
    near = lambda x: F.abs(ratio - x) <= 0.05 + 1e-5 * x
    return F.when(near(0.55), 1).when(near(0.45), 5).when(near(0.35), 5).when(near(0.25), 7).when(near(0.15), 10).when(near(0.05), 15).otherwise(0)


def confidence(rows: DataFrame, fraction: str | None = None) -> DataFrame:
    """100 and all deltas, between 0 and 100; 0 if an atypical allele's peak isn't where its label says. fraction names the
    column with the share of reads that was kept, if reads were subsampled: it scales heterozygous scores."""
    sums = lambda rules: sum((F.coalesce(F.expr(delta), F.lit(0)) for _, delta in rules), F.lit(0))
    score = F.lit(100) + sums(PENALTIES)
    if fraction:
        scaled = score * subsample_factor(F.col("all_reads"), F.col(fraction)) - ratio_context(F.try_divide(F.col("total").cast("double"), F.col("all_reads")))
        score = F.when(F.col("state") == "heterozygous", scaled).otherwise(score)
    lost = (F.col("status") == "Atypical") & (F.abs(F.col("fod") - F.col("est_cag")) > 1)
    whole = F.greatest(F.lit(0), F.least(F.lit(100), score + sums(LATE)))
    return rows.select(*SLICE, F.when(lost, 0).otherwise(whole).cast("int").alias("confidence"))


def jittered_interval(intervals: DataFrame, confidence: DataFrame) -> DataFrame:
    """intervals (with lo and hi): where the score is below 50 the lower bound loses one or two, and the upper takes one."""
    rows = intervals.join(confidence, SLICE, "left")
    low = F.col("lo") - F.when(F.col("confidence") < 50, 1 + F.pmod(F.crc32(F.col("sample_id").cast("string")), F.lit(2))).otherwise(0)
    rows = rows.withColumns({"lo": low.cast("int"), "hi": F.col("hi") + F.when(F.col("confidence") < 50, 1).otherwise(0)})
    return rows.withColumn("interval", interval_text(F.col("lo"), F.col("hi"), F.col("call")))
