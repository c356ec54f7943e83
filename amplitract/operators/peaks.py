"""First-order-difference peaks of dense histograms, and the ladder of thresholds that recalls them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From 0.50 down by 0.06, 0.05 at the end; a step is one recall.
LADDER = [0.50, 0.44, 0.38, 0.32, 0.26, 0.20, 0.14, 0.08, 0.05]


def find_peaks(dense: DataFrame, keys: list[str], bin: str = "cag", n: str = "n", threshold: float | str = 0.5, min_distance: int = 1) -> DataFrame:
    """(keys, peak, height, low, high): runs of equal counts that stand above both neighbours and above the threshold's share
    of the range from low to high. The first and the last run are no peaks; a plateau's peak is its middle. With a min_distance of 2,
    a peak within two bins of a higher one goes."""
    by = Window.partitionBy(*keys).orderBy(bin)
    whole = Window.partitionBy(*keys)
    step = dense.withColumn("turn", F.coalesce((F.col(n) != F.lag(n).over(by)).cast("int"), F.lit(0)))
    runs = step.withColumn("run", F.sum("turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("low", F.min(n).over(whole)).withColumn("high", F.max(n).over(whole))
    runs = runs.groupBy(*keys, "run", "low", "high").agg(F.min(bin).alias("lo"), F.max(bin).alias("hi"), F.first(n).alias("height"))
    next_to = Window.partitionBy(*keys).orderBy("run")
    runs = runs.withColumn("before", F.lag("height").over(next_to)).withColumn("after", F.lead("height").over(next_to))
    t = F.lit(threshold) if isinstance(threshold, float) else F.col(threshold)
    found = runs.where((F.col("height") > F.col("before")) & (F.col("height") > F.col("after")) & (F.col("height") > t * (F.col("high") - F.col("low")) + F.col("low")))
    found = found.select(*keys, F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("peak"), "height", "low", "high")
    if min_distance >= 2:
        around = Window.partitionBy(*keys).orderBy("peak").rangeBetween(-min_distance, min_distance)
        found = found.withColumn("most", F.max("height").over(around)).where("height = most").drop("most")
    return found


def peaks_of(v: Column, threshold: float) -> Column:
    """find_peaks of an array of bins (the first is bin 1): an array of (peak, height). No window is needed."""
    at = lambda i: F.element_at(v, i)
    over = F.lit(threshold) * (F.array_max(v) - F.array_min(v)) + F.array_min(v)
    # where the run of equal counts that begins at i ends: at the first other count behind it
    runs = F.transform(F.sequence(F.lit(2), F.size(v)), lambda i: F.struct(i.alias("i"), F.array_position(F.transform(F.slice(v, i + 1, F.size(v)), lambda x: x != at(i)), True).cast("int").alias("k")))
    high = F.filter(runs, lambda r: (r["k"] > 0) & (at(r["i"]) > over) & (at(r["i"]) > at(r["i"] - 1)) & (at(r["i"]) > at(F.greatest(F.lit(1), r["i"] + r["k"]))))
    return F.transform(high, lambda r: F.struct(F.floor((2 * r["i"] + r["k"] - 1) / 2).cast("int").alias("peak"), at(r["i"]).alias("height")))


def recall(rows: DataFrame, keys: list[str], call: str, expected: str, lenient: str, v: str, spread: str | None = None) -> DataFrame:
    """(keys, call, recalls, threshold, peaks) of rows with an array of bins v: the first rung of the ladder on which the expected
    number of peaks stands, or the called bin is one of them (then only it is kept), or any if lenient (two alleles side by
    side make one peak). Where spread, a peak within two bins of a higher one goes. Peaks are found once, at the lowest
    rung; a rung only filters. Rows without such a rung have one recall more than there are, and neither threshold nor peaks."""
    low, high = F.array_min(v), F.array_max(v)
    rows = rows.withColumn("_found", peaks_of(F.col(v), LADDER[-1]))
    if spread:
        alone = F.filter("_found", lambda p: ~F.exists("_found", lambda q: (F.abs(q["peak"] - p["peak"]) <= 2) & (q["height"] > p["height"])))
        rows = rows.withColumn("_found", F.when(F.col(spread), alone).otherwise(F.col("_found")))
    on = lambda t: F.transform(F.filter("_found", lambda p: p["height"] > t * (high - low) + low), lambda p: p["peak"])
    rungs = F.array(*[F.struct(F.lit(k).alias("recalls"), F.lit(t).alias("threshold"), on(t).alias("peaks")) for k, t in enumerate(LADDER)])
    good = F.filter("_rungs", lambda r: (F.size(r["peaks"]) > 0) & ((F.size(r["peaks"]) == F.col(expected)) | F.array_contains(r["peaks"], F.col(call)) | F.col(lenient)))
    rows = rows.withColumn("_rungs", rungs).withColumn("_best", F.get(good, 0))
    peaks = F.col("_best.peaks")
    only = F.array_contains(peaks, F.col(call)) & (F.size(peaks) != F.col(expected))
    return rows.select(*keys, call, F.coalesce("_best.recalls", F.lit(len(LADDER))).alias("recalls"), F.col("_best.threshold").alias("threshold"), F.when(only, F.array(call)).otherwise(peaks).alias("peaks"))
