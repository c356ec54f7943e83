"""Second looks at calls: what the reverse reads say of each allele's CCG, and the shape of each allele's CAG peak. The bins
of a sample are one array, so that these rules are expressions on one row for each allele."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplitract.functions.exprs import close
from amplitract.operators.genotype import SLICE, in_own_library
from amplitract.operators.peaks import peaks_of


def vector(rows: DataFrame, keys: list[str], bin: str, value: str, name: str) -> DataFrame:
    """(keys, name): the values of all bins in their order, as an array."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(bin, value))), lambda x: x[value]).alias(name))


def _top(v: Column, k: int) -> Column:
    """The k-th largest different value of an array, 0 if there is none."""
    return F.coalesce(F.get(F.sort_array(F.array_distinct(v), asc=False), k), F.lit(0))


def _less(x: Column, percent: Column | float) -> Column:
    return (x - x / 100 * percent).cast("long")


def smoothed(v: Column, call: Column, hetero: Column) -> Column:
    """A CCG vector without what isn't the call's. Homozygous: bins within three of the call lose 77.5 percent. Heterozygous: if
    the call is second and under half of the first, the first loses 95 percent, else one that is second takes 5 reads more
    from each bin; then all others lose 75, 85 or 95 percent by the count at the call."""
    at, first, second = F.get(v, call - 1), _top(v, 0), _top(v, 1)
    share = F.coalesce(F.try_divide(100.0 * second, first), F.lit(0.0))
    rescue = (at == second) & (share > 0) & (share < 50)
    extra = F.when((at == second) & ~rescue, 5).otherwise(0)
    percent = F.when(at.between(1, 6000), 75.0).when(at.between(6001, 12000), 85.0).otherwise(95.0)
    start = F.transform(v, lambda x, i: F.when(rescue & (i + 1 == F.array_position(v, first)), _less(x, 95.0)).otherwise(x))
    two = F.transform(start, lambda x, i: F.when(i + 1 == call, x).otherwise(F.greatest(F.lit(0), _less(x, percent) - extra)))
    one = F.transform(v, lambda x, i: F.when((i + 1 != call) & (F.abs(i + 1 - call) <= 3), _less(x, 77.5)).otherwise(x))
    return F.when(hetero, two).otherwise(one)


def _clean(v: Column, bin: Column) -> Column:
    """Whether both neighbours of a bin hold something, but less than a fifth of it."""
    side = lambda k: F.try_divide(F.get(v, bin - 1 + k).cast("double"), F.get(v, bin - 1))
    return F.coalesce((side(-1) > 0) & (side(-1) < 0.2) & (side(1) > 0) & (side(1) < 0.2), F.lit(False))


def ccg_review(reverse: DataFrame, forward: DataFrame, alleles: DataFrame, zygosity: DataFrame, valid: DataFrame, realigned: bool = True) -> DataFrame:
    """One row for each allele: its CCG bin after review (ccg) and whether that overwrote the scanned one; whether the bin is
    uncertain, continuous (a maximum of both alleles lies within one of it) and matched by a peak; the peak's CCG (fod_ccg);
    the zygosity that peaks show, and whether it contradicts the classifier (svm_failure). reverse and forward are each
    allele's dense CCG bins, those of atypical alleles against a library of their own structure."""
    both = vector(reverse, SLICE, "ccg", "n", "rv").join(vector(forward, SLICE, "ccg", "n", "fw"), SLICE)
    rows = in_own_library(alleles, realigned).select(*SLICE, F.col("own_ccg").alias("scanned"), "est_ccg", "status", "neighbouring")
    rows = rows.join(both, SLICE).join(zygosity.select("sample_id", F.col("zygosity").alias("classified")), "sample_id").join(valid.select(*SLICE, "state"), SLICE)
    w = Window.partitionBy("sample_id")
    of = lambda who, c: F.max(F.when(F.col("allele") == who, c)).over(w)
    rv = F.col("rv")
    rows = rows.withColumns({"first": _top(rv, 0), "second": _top(rv, 1), "third": _top(rv, 2)})
    rows = rows.withColumns({"bin1": F.array_position(rv, F.col("first")).cast("int"), "bin2": F.array_position(rv, F.col("second")).cast("int"), "ratio": F.try_divide(F.col("second").cast("double"), F.col("first")), "pri": of("PRI", F.col("scanned")), "sec": of("SEC", F.col("scanned"))})
    crowded = (F.abs(F.col("bin1") - F.col("bin2")) == 1) & (F.abs(F.col("second") - F.col("third")) <= 0.8 * F.col("second") + 1e-5 * F.col("third"))
    rows = rows.withColumn("unsure", ~F.col("neighbouring") & (crowded | (F.col("second") == F.get(rv, F.col("scanned") - 1))))
    wrong = ~F.col("neighbouring") & ~F.col("unsure") & (F.col("ratio") >= 0.05) & ~F.col("scanned").isin(F.col("bin1"), F.col("bin2"))
    free = lambda held: F.coalesce(*[F.when(~F.col(b).isin(held, F.col("sec")), F.col(b)) for b in ("bin1", "bin2")], F.col("scanned"))
    rows = rows.withColumn("pri_new", of("PRI", F.when(wrong, free(F.col("pri"))).otherwise(F.col("scanned"))))
    rows = rows.withColumn("ccg", F.when(F.col("allele") == "PRI", F.col("pri_new")).when(wrong, free(F.col("pri_new"))).otherwise(F.col("scanned")))
    rows = rows.withColumn("smooth", smoothed(rv, F.col("ccg"), F.col("classified") == "HETERO"))
    # two clean peaks that the classifier took for one
    s = F.col("smooth")
    rows = rows.withColumns({"s1": _top(s, 0), "s2": _top(s, 1)})
    b1, b2 = F.array_position(s, F.col("s1")).cast("int"), F.array_position(s, F.col("s2")).cast("int")
    missed = (F.abs(b1 - b2) > 1) & (F.abs(b1 - b2) < 10) & (F.col("ratio") >= 0.05) & _clean(s, b1) & _clean(s, b2) & (F.try_divide(F.col("s2").cast("double"), F.col("s1")) >= 0.15)
    rows = rows.withColumn("seen", F.when((F.col("classified") != "HETERO") & F.coalesce(missed, F.lit(False)), "HETERO").otherwise(F.col("classified")))
    near = (F.abs(b1 - F.col("ccg")) <= 1) | ((F.col("seen") == "HETERO") & (F.abs(b2 - F.col("ccg")) <= 1))
    rows = rows.withColumn("continuous", F.min(near).over(w))
    rows = rows.withColumn("found", F.transform(peaks_of(s, 0.5), lambda p: p["peak"]))
    wanted, size, held = F.when(F.col("seen") == "HETERO", 2).otherwise(1), F.size("found"), F.array_contains("found", F.col("ccg"))
    crowd = (size != wanted) & ~held & (size > 2) & (F.col("seen") != "HETERO")
    rows = rows.withColumn("crowd", crowd).withColumn("peaks", F.when((size != wanted) & held, F.array("ccg")).when(crowd, F.array(b1)).otherwise(F.col("found")))
    rows = rows.withColumn("matched", F.array_contains("peaks", F.col("ccg")))
    one = F.when((F.size("peaks") > 1) & (F.col("allele") == "SEC"), F.get("peaks", 1)).otherwise(F.get("peaks", 0))
    rows = rows.withColumn("fod_ccg", one)
    kept = F.when(F.col("matched"), F.col("ccg"))
    local = F.when(of("PRI", kept).eqNullSafe(of("SEC", kept)), "HOMO").otherwise("HETERO")
    rows = rows.withColumn("local", local).withColumn("apart", F.abs(of("PRI", F.col("ccg")) - of("SEC", F.col("ccg"))))
    odd = F.max(F.col("status") == "Atypical").over(w)
    stated = F.when(of("PRI", F.col("est_ccg")) == of("SEC", F.col("est_ccg")), "HOMO").otherwise("HETERO")
    rows = rows.withColumn("reconciled", F.when(odd, stated).otherwise(F.col("local")))
    equal = of("PRI", F.col("fod_ccg")).eqNullSafe(of("SEC", F.col("fod_ccg")))
    rows = rows.withColumn("zygosity", F.when(equal, "HOMO").otherwise("HETERO"))
    # a homozygous sample whose mates show different numbers of peaks
    rows = rows.withColumns({"n_fw": of("PRI", F.size(peaks_of(F.col("fw"), 0.15))), "n_rv": of("PRI", F.size(peaks_of(s, 0.15)))})
    same_top = of("PRI", F.array_position("fw", F.array_max("fw"))) == of("PRI", F.array_position(s, F.col("s1")))
    disagree = (F.col("state") == "homozygous") & same_top & (F.col("n_fw") != F.col("n_rv"))
    return rows.select(
        *SLICE, "ccg", (F.col("ccg") != F.col("scanned")).alias("overwritten"), F.round("ratio", 6).alias("ratio"), (F.col("unsure") | disagree).alias("uncertain"), "continuous", "matched", "fod_ccg",
        "local", ((F.col("local") == F.when(F.col("apart") == 0, "HOMO").otherwise("HETERO")) | (F.col("apart") == 1)).alias("ccg_passes"), "zygosity",
        (F.max("crowd").over(w) | (F.col("zygosity") != F.col("reconciled"))).alias("svm_failure"),
    )


def peak_review(bins: DataFrame, valid: DataFrame, review: DataFrame) -> DataFrame:
    """One row for each allele: the peak's CAG (fod) after slippage has been allowed for, and whether that moved it; whether a
    second high peak stands where there should be one; the distance of the peak from the top of a parabola through the
    logarithms of its three bins (null where there is none)."""
    target = vector(bins, SLICE, "cag", "smooth", "target")
    rows = valid.select(*SLICE, "state", "fod").join(target, SLICE).join(review.select(*SLICE, "zygosity"), SLICE)
    at = lambda k: F.get("target", F.col("fod") - 1 + k).cast("double")
    rv, fw = F.try_divide(at(-1), at(0)), F.try_divide(at(1), at(0))
    alone = F.col("state") == "heterozygous"
    up = F.coalesce(alone & close(fw, 0.85, 0.075) & (rv > 0.65), F.lit(False))
    down = F.coalesce(alone & close(rv, 0.80, 0.150) & (fw > 0.65), F.lit(False))
    t = F.col("target")
    first, second = _top(t, 0), _top(t, 1)
    apart = F.abs(F.array_position(t, first) - F.array_position(t, second)) > 2
    unexpected = (F.col("zygosity") == "HETERO") & apart & (F.abs(first - second) <= 0.55 * first + 1e-5 * second)
    log = lambda k: F.ln(F.when(at(k) > 0, at(k)))
    top = F.try_divide(log(-1) - log(1), 2 * (log(-1) - 2 * log(0) + log(1)))
    moved = F.when(up, 1).otherwise(0) - F.when(down, 1).otherwise(0)
    return rows.select(*SLICE, (F.col("fod") + moved).alias("fod"), (up | down).alias("slippage_overwrite"), unexpected.alias("unexpected"), F.round(F.abs(top), 6).alias("interpolated"))


def final_labels(alleles: DataFrame, valid: DataFrame, review: DataFrame, peak: DataFrame) -> DataFrame:
    """One row for each allele: the genotype CAG_CAACAG_CCGCCA_CCG_CCT from peaks, whether it overwrites the scanned label, and
    whether the sample hides an expansion (one CCG, two genotypes, an overwritten label). In a homozygous sample the second
    allele is the first. alleles may have caacag and ccgcca with the stars of new sequences, else exact counts are used."""
    starred = "caacag" in alleles.columns
    count = F.regexp_count("intervening", F.lit("CAACAG")).cast("string"), F.regexp_count(F.replace("intervening", F.lit("CAACAG"), F.lit("")), F.lit("CCGCCA")).cast("string")
    first, second = (F.col("caacag"), F.col("ccgcca")) if starred else count
    rows = alleles.select(*SLICE, "status", "est_cag", "est_ccg", "est_cct", first.alias("m1"), second.alias("m2"), "cag", F.col("ccg").alias("bin"))
    rows = rows.join(valid.select(*SLICE, "state"), SLICE).join(review.select(*SLICE, "fod_ccg", "zygosity", "overwritten"), SLICE).join(peak.select(*SLICE, "fod", "slippage_overwrite"), SLICE)
    ccg = F.coalesce("fod_ccg", "est_ccg")
    rows = rows.withColumn("genotype", F.concat_ws("_", "fod", "m1", "m2", ccg.cast("string"), F.col("est_cct").cast("string")))
    rows = rows.withColumn("fod_overwrite", F.col("overwritten") | (F.col("fod") != F.col("est_cag")) | (ccg != F.col("est_ccg")))
    counts = [F.regexp_extract(m, r"^\d+", 0).cast("int") for m in ("m1", "m2")]
    novel = F.col("m1").contains("*") | F.col("m2").contains("*") | (counts[0] > 2) | (counts[1] > 2) | ~F.col("est_cct").between(0, 3)
    w = Window.partitionBy("sample_id")
    one = lambda who, c: F.max(F.when(F.col("allele") == who, F.col(c))).over(w)
    changed = (F.col("status") == "Atypical") & (F.col("bin") != F.col("est_ccg"))
    kept = (F.col("status") == "Atypical") & (F.col("bin") == F.col("est_ccg"))
    bins_differ, ccgs_differ = one("PRI", "bin") != one("SEC", "bin"), one("PRI", "est_ccg") != one("SEC", "est_ccg")
    moved = (F.max((F.col("bin") != F.col("est_ccg")).cast("int")).over(w) == 1) & ~bins_differ
    ccg_rewrite = F.max(changed.cast("int")).over(w) == 1
    zyg_rewrite = (F.max(kept.cast("int")).over(w) == 1) | (bins_differ & ~ccgs_differ & ccg_rewrite) | moved
    same = (F.col("state") == "homozygous") & (F.col("allele") == "SEC")
    missed = (F.col("zygosity") != "HETERO") & (F.col("state") != "homozygous") & (F.max(F.col("fod_overwrite").cast("int")).over(w) == 1)
    return rows.select(
        *SLICE, F.when(same, one("PRI", "genotype")).otherwise(F.col("genotype")).alias("genotype"), "fod_overwrite", "slippage_overwrite", missed.alias("missed_expansion"),
        F.coalesce((F.col("status") == "Atypical") & novel, F.lit(False)).alias("novel"), ccg_rewrite.alias("ccg_rewritten"), zyg_rewrite.alias("zygosity_rewritten"),
    )
