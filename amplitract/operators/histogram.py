"""Repeat histograms in long form: one row for each (sample_id, mate, ccg, cag)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP = {"hom": 77.5, "cag": 85.0}


def histogram(assigned: DataFrame) -> DataFrame:
    """Reads of each contig."""
    mapped = assigned.where("contig_cag IS NOT NULL")
    return mapped.groupBy("sample_id", "mate", F.col("contig_ccg").alias("ccg"), F.col("contig_cag").alias("cag")).agg(F.sum("n").alias("n"))


def collapse_ccg(hist: DataFrame) -> DataFrame:
    """(sample_id, mate, ccg, n): CCG sums and, where ccg is null, the total."""
    sums = hist.rollup("sample_id", "mate", "ccg").agg(F.sum("n").alias("n"))
    return sums.where("mate IS NOT NULL")


def densify(hist: DataFrame, keys: list[str], bin: str, bins: int) -> DataFrame:
    """All bins 1 to bins for each key that occurs; those without rows count 0. The bins are generated in place."""
    whole = hist.select(*keys).distinct().withColumn(bin, F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return whole.join(hist, [*keys, bin], "left").select(*keys, bin, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cut(n: Column, percent: Column | float) -> Column:
    """n less a percentage, truncated to whole reads."""
    return (n - n / 100 * percent).cast("long")


def smooth_homozygous(dense: DataFrame, call: str = "call") -> DataFrame:
    """Bins within three of the called CCG lose 77.5 percent."""
    near = (F.col("ccg") != F.col(call)) & (F.abs(F.col("ccg") - F.col(call)) <= 3)
    return dense.withColumn("smooth", F.when(near, cut(F.col("n"), 77.5)).otherwise(F.col("n")))


def smooth_heterozygous(dense: DataFrame, call: str = "call") -> DataFrame:
    """All bins but the called one lose 75, 85 or 95 percent by the called count. If the called bin is the second
    largest and less than half of the largest, the largest loses 95 percent first; if it is second otherwise, each bin loses 5 reads more."""
    w = Window.partitionBy("sample_id")
    ranked = dense.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "ccg")))
    ranked = ranked.withColumn("top", F.max(F.when(F.col("r") == 1, F.col("n"))).over(w)).withColumn("second", F.max(F.when(F.col("r") == 2, F.col("n"))).over(w))
    ranked = ranked.withColumn("called", F.max(F.when(F.col("ccg") == F.col(call), F.col("n"))).over(w))
    ranked = ranked.withColumn("call_rank", F.max(F.when(F.col("ccg") == F.col(call), F.col("r"))).over(w))
    share = F.coalesce(F.try_divide(F.lit(100) * F.col("second"), F.col("top")), F.lit(0))
    rescue = (F.col("call_rank") == 2) & (share > 0) & (share < 50)
    first = F.when(rescue & (F.col("r") == 1), cut(F.col("n"), 95.0)).otherwise(F.col("n"))
    percent = F.when(F.col("called").between(1, 6000), 75.0).when(F.col("called").between(6001, 12000), 85.0).otherwise(95.0)
    extra = F.when((F.col("call_rank") == 2) & ~rescue, 5).otherwise(0)
    low = F.greatest(F.lit(0), cut(first, percent) - extra)
    return ranked.select("sample_id", "ccg", "n", F.col(call).alias("call"), F.when(F.col("ccg") == F.col(call), F.col("n")).otherwise(low).alias("smooth"))


def smooth_cag(dense: DataFrame, call: str = "call") -> DataFrame:
    """All bins but the called CAG lose 85 percent."""
    return dense.withColumn("smooth", F.when(F.col("cag") == F.col(call), F.col("n")).otherwise(cut(F.col("n"), 85.0)))


def smooth_interval(dense: DataFrame, call: str = "call") -> DataFrame:
    """Bins outside of ten around the call lose 85 percent."""
    inside = F.col("cag").between(F.col(call) - 10, F.col(call) + 10)
    return dense.withColumn("smooth", F.when(inside, F.col("n")).otherwise(cut(F.col("n"), 85.0)))


def align_to_call(hist: DataFrame, call: str = "call") -> DataFrame:
    """(sample_id, allele, off, n): the 200 counts of a slice by their distance from the call."""
    return hist.select("sample_id", "allele", (F.col("cag") - F.col(call)).alias("off"), "n")


def anchored_rows(bins: DataFrame, anchor: int = 203, width: int = 403) -> DataFrame:
    """(sample_id, allele, dist): the 200 counts as text, with five digits, padded by dashes on both sides so that the called
    bin stands in the same column of every row."""
    text = F.array_sort(F.collect_list(F.struct("cag", F.format_string("%.5f", F.col("n").cast("double")).alias("v"))))
    rows = bins.groupBy("sample_id", "allele", "call").agg(F.transform(text, lambda x: x["v"]).alias("v"))
    left = F.lit(anchor) - F.col("call")
    cells = F.concat(F.array_repeat(F.lit("-"), left), F.col("v"), F.array_repeat(F.lit("-"), F.lit(width - 200) - left))
    return rows.select("sample_id", "allele", F.array_join(cells, ",").alias("dist"))


def distinct_maxima(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The largest, and the two next different, counts."""
    top = F.slice(F.sort_array(F.collect_set("n"), asc=False), 1, 3)
    return hist.groupBy(*keys).agg(top.alias("m")).select(*keys, *[F.get("m", k).alias(f"max{k + 1}") for k in range(3)])


def fold_expanded(hist: DataFrame, limit: int = 31) -> DataFrame:
    """Bins from limit on are one bin."""
    return hist.groupBy("sample_id", "mate", "ccg", F.least("cag", F.lit(limit)).alias("cag")).agg(F.sum("n").alias("n"))
