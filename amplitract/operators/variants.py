"""Variants: a pileup of mismatches, and the filters of variant records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["sample_id", "allele"]
#: Expected share of sites at which the two copies of a sample differ.
HETEROZYGOSITY = 0.001


def aligned_runs(cigar: Column, start: Column) -> Column:
    """The runs of matched bases of a CIGAR string as (read, ref, n): where a run begins on each, from 0, and its length."""
    sizes, kinds = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDS]"), 1), F.regexp_extract_all(cigar, F.lit(r"\d+([MIDS])"), 1)
    steps = F.arrays_zip(F.transform(sizes, lambda x: x.cast("int")).alias("n"), kinds.alias("k"))
    none = F.array().cast("array<struct<read:int,ref:int,n:int>>")

    def step(s: Column, x: Column) -> Column:
        n, kind = x["n"], x["k"]
        run = F.array(F.struct(s["read"].alias("read"), s["ref"].alias("ref"), n.alias("n")))
        on_read, on_ref = F.when(kind == "D", 0).otherwise(n), F.when(kind.isin("M", "D"), n).otherwise(0)
        return F.struct((s["read"] + on_read).alias("read"), (s["ref"] + on_ref).alias("ref"), F.when(kind == "M", F.concat(s["runs"], run)).otherwise(s["runs"]).alias("runs"))

    first = F.struct(F.lit(0).alias("read"), start.cast("int").alias("ref"), none.alias("runs"))
    return F.aggregate(steps, first, step, lambda s: s["runs"])


def base_counts(aligned: DataFrame, keys: list[str], reference: Column, quality: Column | None = None) -> DataFrame:
    """(keys, pos, ref, base, q, n): how many reads show a base with a quality at each position (from 1) of what they are aligned
    to. aligned: seq, start, cigar, n (of equal reads) and either quality, one for all bases of a read, or q, one for each."""
    q = quality if quality is not None else (F.get("q", F.col("read_at")) if "q" in aligned.columns else F.col("quality"))
    runs = aligned.where("cigar IS NOT NULL").withColumn("reference", reference).select("*", F.explode(aligned_runs(F.col("cigar"), F.col("start"))).alias("run"))
    bases = runs.select("*", F.explode(F.sequence(F.lit(0), F.col("run.n") - 1)).alias("i")).withColumn("read_at", F.col("run.read") + F.col("i"))
    at = F.col("run.ref") + F.col("i") + 1
    bases = bases.select(*keys, at.alias("pos"), F.substring("reference", at, F.lit(1)).alias("ref"), F.substring("seq", F.col("read_at") + 1, F.lit(1)).alias("base"), q.alias("q"), "n")
    return bases.where("base IN ('A', 'C', 'G', 'T')").groupBy(*keys, "pos", "ref", "base", "q").agg(F.sum("n").alias("n"))


def call_variants(counts: DataFrame, keys: list[str], least: int = 2, theta: float = HETEROZYGOSITY) -> DataFrame:
    """(keys, pos, ref, alt, gt, qual, gq, depth, alt_depth) of the positions at which a diploid sample most probably isn't the reference.

    Each base is wrong with the probability that its quality tells, and then any of the three others. The likelihoods of
    the genotypes without, with one and with two copies of the commonest other base are summed over reads as logarithms; with priors
    of 1 - 1.5 theta, theta and theta / 2 they give the posterior. qual is the probability of no variant and gq that of another
    genotype, both on the scale of base qualities. Sites whose alt has fewer than `least` reads aren't called."""
    site = [*keys, "pos", "ref"]
    alts = counts.where("base <> ref").groupBy(*site, "base").agg(F.sum("n").alias("alt_depth"))
    alt = alts.groupBy(*site).agg(F.max(F.struct("alt_depth", F.negate(F.ascii("base")).alias("order"), "base")).alias("m")).select(*site, F.col("m.base").alias("alt"), F.col("m.alt_depth").alias("alt_depth"))
    wrong = F.least(F.lit(0.75), F.pow(F.lit(10.0), -F.col("q") / 10.0))
    shown = lambda allele: F.when(F.col("base") == F.col(allele), 1 - wrong).otherwise(wrong / 3)
    total = lambda p: F.sum(F.col("n") * F.log10(p))
    rows = counts.join(alt.where(F.col("alt_depth") >= least), site)
    sums = rows.groupBy(*site, "alt", "alt_depth").agg(F.sum("n").alias("depth"), (total(shown("ref")) + math.log10(1 - 1.5 * theta)).alias("g0"), (total((shown("ref") + shown("alt")) / 2) + math.log10(theta)).alias("g1"), (total(shown("alt")) + math.log10(theta / 2)).alias("g2"))
    most = F.greatest("g0", "g1", "g2")
    power = lambda g: F.pow(F.lit(10.0), F.col(g) - most)
    whole = power("g0") + power("g1") + power("g2")
    log_whole = most + F.log10(whole)
    scale = lambda p: F.round(-10 * p, 3)
    # the other genotypes' share, so that no difference of nearly equal numbers is taken
    others = F.when(most == F.col("g2"), power("g0") + power("g1")).otherwise(power("g0") + power("g2"))
    called = sums.where("g1 > g0 OR g2 > g0")
    return called.select(*site, "alt", F.when(most == F.col("g2"), "1/1").otherwise("0/1").alias("gt"), scale(F.col("g0") - log_whole).alias("qual"), scale(F.log10(F.greatest(others / whole, F.lit(1e-300)))).alias("gq"), "depth", "alt_depth")


def of_alleles(calls: DataFrame, alleles: DataFrame) -> DataFrame:
    """The records (sample_id, chrom, pos, ref, alt, qual, ...) of each sample for both of its alleles: adds allele, atypical and label."""
    two = alleles.select(*KEYS, (F.col("status") == "Atypical").alias("atypical"), "label")
    return calls.join(two, "sample_id")


def pileup(reads: DataFrame, consensus: DataFrame, least: int = 2) -> DataFrame:
    """(contig, pos, ref, alt, n): bases that differ from the contig's consensus in at least `least` reads of its length.
    Equal reads are compared once; reads that have a count k already stand for so many."""
    same = reads if "k" in reads.columns else reads.groupBy("contig", "seq").agg(F.count(F.lit(1)).alias("k"))
    pairs = same.join(consensus.select("contig", F.col("seq").alias("ref_seq")), "contig").where("length(seq) = length(ref_seq) AND seq <> ref_seq")
    at = pairs.select("contig", "seq", "ref_seq", "k", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("pos"))
    at = at.withColumn("alt", F.expr("substring(seq, pos, 1)")).withColumn("ref", F.expr("substring(ref_seq, pos, 1)")).where("alt <> ref")
    return at.groupBy("contig", "pos", "ref", "alt").agg(F.sum("k").alias("n")).where(F.col("n") >= least)


def on_target(variants: DataFrame) -> DataFrame:
    """Adds target: the record's contig is the allele's, or its structure's name before CAG is."""
    chrom = F.when(F.col("atypical"), F.regexp_replace("chrom", "_?CAG.*$", "")).otherwise(F.col("chrom"))
    return variants.withColumn("target", chrom == F.col("label"))


def surviving(variants: DataFrame, cutoff: float, edge: int = 5) -> DataFrame:
    """Records on target above the quality cutoff, without those within `edge` of the first or the last such position."""
    good = on_target(variants).where(F.col("target") & (F.col("qual") > cutoff))
    w = Window.partitionBy(*KEYS)
    good = good.withColumn("first", F.min("pos").over(w)).withColumn("last", F.max("pos").over(w))
    return good.where((F.abs(F.col("pos") - F.col("first")) > edge) & (F.abs(F.col("pos") - F.col("last")) > edge)).drop("first", "last")


def variant_text(kept: DataFrame) -> DataFrame:
    """One line for each allele, the best first, and its best quality."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("qual")).alias("q"), "pos", "ref", "alt")))
    out = kept.groupBy(*KEYS).agg(order.alias("v"), F.max("qual").alias("score"))
    one = lambda v: F.concat(v["ref"], F.lit("->"), v["alt"], F.lit("@"), v["pos"].cast("string"))
    return out.select(*KEYS, F.array_join(F.transform("v", one), "   ").alias("text"), "score")
