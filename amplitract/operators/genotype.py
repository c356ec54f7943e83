"""Calls from histograms: peaks of each allele's CAG slice, their agreement with the scanned structure, and the final genotype."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amplitract.operators import histogram as H
from amplitract.operators.peaks import find_peaks, recall

SLICE = ["sample_id", "allele"]


def zygosity(dense_ccg: DataFrame) -> DataFrame:
    """HETERO if the CCG vector has a second peak of at least 15 percent of the range, else HOMO."""
    peaks = find_peaks(dense_ccg, ["sample_id"], "ccg", "n", 0.15).groupBy("sample_id").agg(F.count(F.lit(1)).alias("peaks"))
    out = dense_ccg.select("sample_id").distinct().join(peaks, "sample_id", "left").withColumn("peaks", F.coalesce("peaks", F.lit(0)))
    return out.withColumn("zygosity", F.when(F.col("peaks") >= 2, "HETERO").otherwise("HOMO"))


def in_own_library(alleles: DataFrame, realigned: bool = True) -> DataFrame:
    """Adds own_ccg and own_cag: the bin of an allele's call, of the typical library, or of one of its own structure if it is
    atypical and its reads are realigned."""
    odd = (F.col("status") == "Atypical") & F.lit(realigned)
    return alleles.withColumns({"own_ccg": F.when(odd, F.col("est_ccg")).otherwise(F.col("ccg")), "own_cag": F.when(odd, F.col("est_cag")).otherwise(F.col("cag"))})


def allele_counts(alleles: DataFrame, hist: DataFrame, realigned: DataFrame, keys: list[str]) -> DataFrame:
    """(sample_id, allele, keys, n): the sample's counts for typical alleles, those of the realigned reads for atypical ones."""
    typical = alleles.where("status <> 'Atypical'").select(*SLICE)
    return hist.join(typical, "sample_id").select(*SLICE, *keys, "n").unionByName(realigned.select(*SLICE, *keys, "n"))


def slices(alleles: DataFrame, hist: DataFrame, realigned: DataFrame, own: bool = True) -> DataFrame:
    """200 CAG bins of each allele's CCG, with the call (its CAG) and how many peaks its slice should have: two if both alleles
    share it, beside each other (at most one apart) or spread (more than five). Slices that hold one allele are smoothed
    around the call. The bins of an atypical allele are those of its reads realigned to a library of its own structure
    (realigned: sample_id, allele, ccg, cag, n), unless own is false; hist has the sample's."""
    w = Window.partitionBy("sample_id")
    shared = F.min("own_ccg").over(w) == F.max("own_ccg").over(w)
    gap = F.max("own_cag").over(w) - F.min("own_cag").over(w)
    asked = in_own_library(alleles, own).select(*SLICE, F.col("own_ccg").alias("ccg"), F.col("own_cag").alias("call"), F.when(shared, 2).otherwise(1).alias("expected"), (shared & (gap <= 1)).alias("beside"), (shared & (gap > 5)).alias("spread"))
    bins = asked.select("*", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("cag"))
    dense = bins.join(allele_counts(alleles, hist, realigned, ["ccg", "cag"]), [*SLICE, "ccg", "cag"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    smooth = F.when((F.col("expected") == 2) | (F.col("cag") == F.col("call")), F.col("n")).otherwise(H.cut(F.col("n"), 85.0))
    return dense.withColumn("smooth", smooth).select(*SLICE, "ccg", "call", "expected", "beside", "spread", "cag", "n", "smooth")


#: How often the peaks of both alleles of a sample may be looked for again, together.
MOST_RECALLS = 8


def recall_budget(bins: DataFrame, most: int = MOST_RECALLS) -> DataFrame:
    """(sample_id, allele, call, recalls, threshold, peaks, fod, spent, failed): the ladder's result for each allele; spent is
    what the sample has used up so far, the first allele's recalls before the second's, and failed says that they were
    too many. fod is the last peak within one of the call, else the first."""
    rows = bins.groupBy(*SLICE, "call", "expected", "beside", "spread").agg(F.transform(F.array_sort(F.collect_list(F.struct("cag", "smooth"))), lambda x: x["smooth"]).alias("v"))
    found = recall(rows, SLICE, "call", "expected", "beside", "v", "spread")
    near = F.filter("peaks", lambda p: F.abs(p - F.col("call")) <= 1)
    w = Window.partitionBy("sample_id").orderBy("allele")
    found = found.withColumn("fod", F.coalesce(F.try_element_at(near, F.lit(-1)), F.get("peaks", 0)))
    return found.withColumn("spent", F.sum("recalls").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("failed", F.col("spent") > most)


def cag_calls(budget: DataFrame) -> DataFrame:
    """(sample_id, allele, call, recalls, threshold, peaks, fod) of the samples whose recalls were enough."""
    lost = budget.where("failed").select("sample_id").distinct()
    return budget.join(lost, "sample_id", "left_anti").drop("spent", "failed")


def validate(calls: DataFrame, bins: DataFrame) -> DataFrame:
    """Adds per sample: dsp_agrees, state (heterozygous, neighbouring or homozygous) and at_call (reads at the call)."""
    at = bins.where("cag = call").select(*SLICE, "ccg", F.col("n").alias("at_call"))
    rows = calls.join(at, SLICE)
    w = Window.partitionBy("sample_id")
    one = lambda who, c: F.max(F.when(F.col("allele") == who, F.col(c))).over(w)
    apart = F.try_divide(F.abs(one("PRI", "at_call") - one("SEC", "at_call")), F.greatest(one("PRI", "at_call"), F.lit(1)))
    close_by = (one("PRI", "ccg") == one("SEC", "ccg")) & (F.abs(one("PRI", "call") - one("SEC", "call")) <= 1)
    state = F.when(~F.coalesce(close_by, F.lit(False)), "heterozygous").when((apart > 0) & (apart <= 0.30), "neighbouring").otherwise("homozygous")
    return rows.select(*SLICE, "ccg", "call", "recalls", "threshold", "peaks", "fod", (F.abs(F.col("fod") - F.col("call")) <= 1).alias("dsp_agrees"), state.alias("state"), "at_call", (F.col("at_call") < 250).alias("fatal_low"))


def final_genotype(valid: DataFrame, alleles: DataFrame) -> DataFrame:
    """Both alleles' labels; in a homozygous sample the second is the first."""
    labels = valid.join(alleles.select(*SLICE, "label"), SLICE)
    pick = lambda who, c: F.max(F.when(F.col("allele") == who, F.col(c)))
    both = labels.groupBy("sample_id", "state").agg(pick("PRI", "label").alias("pri"), pick("SEC", "label").alias("sec"), pick("PRI", "fod").alias("pri_fod"), pick("SEC", "fod").alias("sec_fod"))
    same = F.col("state") == "homozygous"
    return both.select("sample_id", "state", "pri", F.when(same, F.col("pri")).otherwise(F.col("sec")).alias("sec"), "pri_fod", F.when(same, F.col("pri_fod")).otherwise(F.col("sec_fod")).alias("sec_fod"))


def diminished_peaks(bins: DataFrame, reach: int = 5, share: float = 0.65, least: int = 100) -> DataFrame:
    """Peaks beyond the call that its slice hides: more than `reach` above it, where the call holds less than `share` of over `least` reads."""
    w = Window.partitionBy(*SLICE)
    total, at = F.sum("n").over(w), F.max(F.when(F.col("cag") == F.col("call"), F.col("n"))).over(w)
    open_ = bins.where("allele = 'PRI'").withColumn("total", total).withColumn("at", at).where((F.col("total") > least) & (F.col("at") < share * F.col("total")))
    return find_peaks(open_.where(F.col("cag") > F.col("call") + reach), SLICE, "cag", "n", 0.05).select(*SLICE, "peak", "height")


def hidden_expansions(bins: DataFrame, alleles: DataFrame, far: float = 0.175, share: float = 0.65, most: int = 750) -> DataFrame:
    """sample_id of samples with a diminished peak that is no called allele: both alleles are typical and of one CCG, their
    calls differ, hold less than `share` of the slice by more than `far`, and one of them has fewer than `most` reads."""
    at = lambda who: F.max(F.when((F.col("allele") == who) & (F.col("cag") == F.col("call")), F.col("n")))
    call = lambda who: F.max(F.when(F.col("allele") == who, F.col("call")))
    whole = bins.groupBy("sample_id").agg(at("PRI").alias("n1"), at("SEC").alias("n2"), call("PRI").alias("c1"), call("SEC").alias("c2"), F.sum(F.when(F.col("allele") == "PRI", F.col("n"))).alias("all"), F.count_distinct("ccg").alias("ccgs"))
    open_ = whole.where((F.col("ccgs") == 1) & (F.col("c1") != F.col("c2")) & (F.col("n1") + F.col("n2") < (share - far) * F.col("all")) & (F.least("n1", "n2") < most))
    odd = alleles.where("status = 'Atypical'").select("sample_id").distinct()
    found = diminished_peaks(bins).where("height > 100").join(open_, "sample_id").where(F.abs(F.col("peak") - F.col("c2")) > 1)
    return found.select("sample_id").distinct().join(odd, "sample_id", "left_anti")
