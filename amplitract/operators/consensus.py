"""Consensus of the reads of a contig, and the choice of two alleles from a sample's three largest contigs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amplitract.functions.exprs import joined_label
from amplitract.functions.fuzzy import similarity
from amplitract.operators.tracts import normalised_intervening
from amplitract.sources.reads import TYPICAL

KEYS = ["sample_id", "cag", "ccg"]


#: The tract sizes, the sequence between the tracts, and the flanks.
PARTS = ("a", "c", "t", "mid", "five", "three")
#: First triplets that are as much like CAG as two letters of three.
LIKE_CAG = [k for k in map("".join, product("ACGT", repeat=3)) if abs(similarity("CAG", k) - 0.66) <= 0.1]


def _ranked(rows: DataFrame) -> DataFrame:
    """For each contig: reads, typical reads, and of each part (tract sizes a, c and t, the sequence between) the most frequent
    value _1 and the runner-up _2 with their counts; the lower value first if equal. All parts are ranked in one pass."""
    value = lambda p: F.col(p) if p in ("mid", "five", "three") else F.lpad(F.col(p).cast("string"), 6, "0")
    each = rows.select(*KEYS, "n", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), value(p).alias("v")) for p in PARTS])).alias("e"))
    counts = each.groupBy(*KEYS, "e.part", "e.v").agg(F.sum("n").alias("k"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS, "part").orderBy(F.desc("k"), "v")))
    pick = lambda p, r, c: F.max(F.when((F.col("part") == p) & (F.col("r") == r), F.col(c)))
    sums = [F.sum(F.when(F.col("part") == "a", F.col("k"))).alias("total"), F.sum(F.when((F.col("part") == "mid") & (F.col("v") == TYPICAL), F.col("k")).otherwise(0)).alias("typical")]
    typed = lambda p, c: c if p in ("mid", "five", "three") else c.cast("int")
    tops = [x for p in PARTS for x in (typed(p, pick(p, 1, "v")).alias(f"{p}_1"), pick(p, 1, "k").alias(f"{p}_n1"), typed(p, pick(p, 2, "v")).alias(f"{p}_2"), pick(p, 2, "k").alias(f"{p}_n2"))]
    return ranked.groupBy(*KEYS).agg(*sums, *tops)


def contig_summary(assigned: DataFrame, contigs: DataFrame) -> DataFrame:
    """For each of the contigs (sample_id, cag, ccg, rank): read counts, typical and atypical shares, modal tract sizes and
    sequences, and the status. Reads are summed by structure first, so that everything after works on few rows."""
    rows = assigned.where("mate = 'R1' AND contig_cag IS NOT NULL").groupBy("sample_id", F.col("contig_cag").alias("cag"), F.col("contig_ccg").alias("ccg"), F.col("cag").alias("a"), F.col("ccg").alias("c"), F.col("cct").alias("t"), "intervening", "five", "three").agg(F.sum("n").alias("n"))
    rows = rows.join(contigs.select(*KEYS), KEYS, "left_semi").withColumn("mid", normalised_intervening(F.col("intervening")))
    out = _ranked(rows)
    ratio = F.try_divide(F.col("t_n1"), F.col("t_n2"))
    cct = F.when(F.abs(ratio - 2.0) <= 0.3 + 2e-5, 2).otherwise(F.col("t_1"))
    out = out.withColumn("atypical", F.col("total") - F.col("typical")).withColumn("est_cct", cct.cast("int"))
    failed = F.abs(F.col("typical") - F.col("atypical")) <= 0.05 * F.col("typical")
    status = F.when(F.col("atypical") > F.col("typical"), "Atypical").when(F.col("est_cct") != 2, "Atypical").otherwise("Typical")
    out = out.withColumn("status", status)
    # typical contigs have the typical sequence, or a longer runner-up; the most frequent one only if there is no other.
    # A 15-mer that begins almost like another CAG, with nearly as many reads second, is a misread typical sequence.
    typical = F.col("status") == "Typical"
    gap = (F.col("mid_n1") - F.col("mid_n2")) / F.col("mid_n1") * 100
    misread = (gap < 30) & (F.length("mid_1") == 15) & F.substring("mid_1", 1, 3).isin(LIKE_CAG)
    middle = F.when(F.coalesce(misread, F.lit(False)) | (typical & (F.col("mid_n1") == 1)), TYPICAL).when(~typical | F.col("mid_2").isNull(), F.col("mid_1"))
    middle = middle.when(F.length("mid_1") < F.length("mid_2"), F.col("mid_2")).otherwise(TYPICAL)
    return out.select(
        *KEYS, "total", "typical", "atypical",
        F.round(F.col("typical") * 100.0 / F.col("total"), 2).alias("typical_pcnt"), F.round(F.col("atypical") * 100.0 / F.col("total"), 2).alias("atypical_pcnt"),
        F.col("a_1").alias("est_cag"), F.col("c_1").alias("est_ccg"), "est_cct", middle.alias("intervening"), F.col("five_1").alias("five"), F.col("three_1").alias("three"),
        "status", failed.alias("balance_failed"), (F.col("t_n1") < 0.6 * F.col("total")).alias("cct_uncertain"),
    )


def ranks(contigs: DataFrame) -> DataFrame:
    """One row for each sample: a_, b_ and t_ (first, second, third contig) with _cag, _ccg and _n; null if there are fewer."""
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return contigs.groupBy("sample_id").agg(*[pick(r, c).alias(f"{name}_{c}") for r, name in ((1, "a"), (2, "b"), (3, "t")) for c in ("cag", "ccg", "n")])


def read_warnings(ranked: DataFrame) -> DataFrame:
    """few: one of the three contigs has under 20 reads; failed: under 200, 100 and 50 (the third is let off from 45 to 55)."""
    few = F.least("a_n", "b_n", "t_n") < 20
    failed = F.col("t_n").isNull() | (F.col("a_n") < 200) | (F.col("b_n") < 100) | ((F.col("t_n") < 50) & ~F.col("t_n").between(45, 55))
    return ranked.select("sample_id", "a_n", "b_n", "t_n", few.alias("few"), failed.alias("failed"))


def _near(a: str, b: float | str, tol: float) -> str:
    return f"(abs({a} - {b}) <= {tol} + 0.00001 * abs({b}))"


_U, _N = "a_ccg = b_ccg AND b_ccg = t_ccg", "NOT (a_ccg = b_ccg AND b_ccg = t_ccg)"
_N3 = f"{_N} AND b_ccg <> t_ccg AND a_ccg = b_ccg AND dab = 1"
#: (name, guard, contig chosen, guard of its neighbouring flag, guard of its confusion flag): later rules overrule earlier ones.
#: A is the first contig itself, "copy" a copy of it. Guards of one branch exclude those above them in the branch.
RULES = [
    ("u1a", f"{_U} AND dab = 1 AND dbt <> 1 AND dat = 1 AND {_near('pbt', 0.75, 0.1)}", "b", "true", "false"),
    ("u1b", f"{_U} AND dab = 1 AND dbt <> 1 AND dat = 1 AND NOT {_near('pbt', 0.75, 0.1)} AND pbt > 0 AND pbt <= 0.64", "copy", "false", f"NOT {_near('pab', 0.3, 0.1)}"),
    ("u1c", f"{_U} AND dab = 1 AND dbt <> 1 AND dat <> 1", "t", "false", "false"),
    ("u2a", f"{_U} AND dbt = 1 AND dab <> 1 AND ((pbt >= 0.55 AND pbt < 1) OR {_near('pbt', 0.45, 0.1)})", "b", "false", "false"),
    ("u2b", f"{_U} AND dbt = 1 AND dab <> 1 AND pbt <= 0.15", "b", "false", "true"),
    ("u3a", f"{_U} AND dbt = 1 AND dab = 1 AND pab >= 0.55 AND pab < 1", "copy", "false", "false"),
    ("u3b", f"{_U} AND dbt = 1 AND dab = 1 AND pab < 0.55 AND ({_near('pab', 0.45, 0.1)} OR pab <= 0.35)", "b", "false", f"NOT {_near('pab', 0.45, 0.1)} AND pab < 0.20 AND pbt <= 0.50"),
    ("u4", f"{_U} AND dat = 1", "b", "false", "NOT pbt > 0.4"),
    ("u5", f"{_U} AND dab > 1 AND {_near('b_cag', 't_cag', 5)}", "b", "false", "NOT (pbt > 0.4 OR dbt = 1)"),
    ("n1", f"{_N} AND b_ccg = t_ccg AND dbt = 1", "b", "false", _near("pbt", 0.15, 0.1)),
    ("n2", f"{_N} AND b_ccg = t_ccg AND {_near('dbt', 1, 5)}", "b", "false", "NOT (dbt = 1 OR pbt > 0.4)"),
    ("n3a", f"{_N3} AND {_near('pab', 0.75, 0.25)} AND {_near('pbt', 0.15, 0.15)}", "t", "false", "false"),
    ("n3b", f"{_N3} AND {_near('pab', 0.75, 0.25)} AND NOT {_near('pbt', 0.15, 0.15)}", "copy", "false", "pab < 0.4"),
    ("n4", f"{_N3} AND NOT {_near('pab', 0.75, 0.25)} AND pab >= 0.25 AND pab <= 0.49", "t", "false", "false"),
    ("n5", f"{_N3} AND NOT {_near('pab', 0.75, 0.25)} AND NOT (pab >= 0.25 AND pab <= 0.49)", "b", "false", "true"),
    ("n6", "a_ccg <> b_ccg AND a_ccg = t_ccg AND dat = 1", "b", "false", "false"),
    ("n7", f"a_ccg <> b_ccg AND b_ccg <> t_ccg AND a_ccg <> t_ccg AND {_near('t_cag', 'a_cag', 5)} AND {_near('a_ccg', 't_ccg', 2)}", "b", "false", "false"),
]


def choose_pair(ranked: DataFrame) -> DataFrame:
    """The second allele's contig (b, t, or the first again), by the last rule that fires; its flags are those of all fired
    rules that name the same contig. If none fires the first contig is taken twice and heuristic_ok is false."""
    df = ranked.where("t_n IS NOT NULL").selectExpr(
        "*", "abs(a_cag - b_cag) AS dab", "abs(b_cag - t_cag) AS dbt", "abs(a_cag - t_cag) AS dat",
        "try_divide(abs(a_n - b_n), a_n) AS pab", "try_divide(abs(b_n - t_n), b_n) AS pbt",
    )
    fired = F.array(*[F.when(F.expr(guard), F.struct(F.lit(name).alias("rule"), F.lit(target).alias("target"), F.expr(near).alias("near"), F.expr(mixed).alias("mixed"))) for name, guard, target, near, mixed in RULES])
    df = df.withColumn("fired", F.filter(fired, lambda r: r.isNotNull())).withColumn("last", F.try_element_at("fired", F.lit(-1)))
    same = F.filter("fired", lambda r: (r["target"] == F.col("last.target")) & ((r["target"] != "copy") | (r["rule"] == F.col("last.rule"))))
    target = F.coalesce("last.target", F.lit("a"))
    of = lambda c: F.when(target == "b", F.col(f"b_{c}")).when(target == "t", F.col(f"t_{c}")).otherwise(F.col(f"a_{c}"))
    return df.select(
        "sample_id", "a_cag", "a_ccg", F.coalesce("last.rule", F.lit("none")).alias("rule"), of("cag").alias("s_cag"), of("ccg").alias("s_ccg"),
        F.coalesce(F.exists(same, lambda r: r["near"]), F.lit(False)).alias("neighbouring"), F.coalesce(F.exists(same, lambda r: r["mixed"]), F.lit(False)).alias("diff_confuse"), F.col("last").isNotNull().alias("heuristic_ok"),
    )


def alleles(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Two rows for each sample (allele PRI and SEC) with the consensus of their contigs and the label CAG_CAACAG_CCGCCA_CCG_CCT.
    Typical alleles have the typical sequence."""
    two = pairs.select("sample_id", "neighbouring", "diff_confuse", "heuristic_ok", F.explode(F.array(F.struct(F.lit("PRI").alias("allele"), F.col("a_cag").alias("cag"), F.col("a_ccg").alias("ccg")), F.struct(F.lit("SEC").alias("allele"), F.col("s_cag").alias("cag"), F.col("s_ccg").alias("ccg")))).alias("x"))
    two = two.select("sample_id", "x.*", "neighbouring", "diff_confuse", "heuristic_ok")
    two = two.join(summary, KEYS).withColumn("intervening", F.when(F.col("status") == "Typical", TYPICAL).otherwise(F.col("intervening")))
    return two.withColumn("label", native_label(F.col("est_cag"), F.col("intervening"), F.col("est_ccg"), F.col("est_cct")))


def native_label(cag: Column, middle: Column, ccg: Column, cct: Column) -> Column:
    """The label from exact motif counts; novel sequences get their stars from functions.fuzzy."""
    return joined_label(cag, F.regexp_count(middle, F.lit("CAACAG")), F.regexp_count(F.replace(middle, F.lit("CAACAG"), F.lit("")), F.lit("CCGCCA")), ccg, cct)
