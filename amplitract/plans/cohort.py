"""Plans from reads to tables, composed of operators. Each takes (spark, sf_dir) and gives a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amplitract.functions.fuzzy import label_parts
from amplitract.operators import consensus as K
from amplitract.operators import evidence as E
from amplitract.operators import genotype as G
from amplitract.operators import histogram as H
from amplitract.operators import metrics as M
from amplitract.operators import reference as R
from amplitract.operators import rescoring as S
from amplitract.operators import variants as V
from amplitract.operators.tracts import assign_contigs, scan_tracts
from amplitract.operators.zygosity import OutputCode, classified
from amplitract.sources.reads import synth_reads


def _shared(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share. Only local mode falls back to /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share, and read back: plans behind it stay short, and lost executors cost
    no more than their tasks. The tables of a cohort have a few hundred rows a sample."""
    path = _shared(df.sparkSession, "cohort")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A path in the shared folder that is deleted at the end."""
    path = _shared(spark, label)
    try:
        yield path
    finally:
        deleted(spark, path)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_contigs(scan_tracts(synth_reads(spark, sf_dir)))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.histogram(assigned(spark, sf_dir))


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark, sf_dir).where("mate = 'R1'").drop("mate")


def called_ccg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense forward CCG bins of each sample, with the fullest bin as the call."""
    sums = forward(spark, sf_dir).groupBy("sample_id", "ccg").agg(F.sum("n").alias("n"))
    call = sums.groupBy("sample_id").agg(F.max(F.struct("n", (-F.col("ccg")).alias("k"))).alias("m")).select("sample_id", (-F.col("m.k")).alias("call"))
    return H.densify(sums, ["sample_id"], "ccg", 20).join(call, "sample_id")


def modal_genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest bin of each sample's forward histogram."""
    hist = forward(spark, sf_dir)
    best = hist.groupBy("sample_id").agg(F.max(F.struct("n", (-F.col("ccg")).alias("c"), (-F.col("cag")).alias("a"))).alias("m"), F.sum("n").alias("total"))
    return best.select("sample_id", (-F.col("m.a")).alias("cag"), (-F.col("m.c")).alias("ccg"), F.col("m.n").alias("n"), "total")


def top_contigs(hist: DataFrame, k: int = 3) -> DataFrame:
    """The k contigs of most reads, ranked; the lower label first if equal."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("n"), "cag", "ccg")
    return hist.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ranks(top_contigs(forward(spark, sf_dir)))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assigned(spark, sf_dir)
    return K.contig_summary(rows, top_contigs(_forward(H.histogram(rows))))


def _forward(hist: DataFrame) -> DataFrame:
    return hist.where("mate = 'R1'").drop("mate")


@dataclass
class Cohort:
    """The tables of one run, from the sums of reads by structure on: a few hundred rows a sample, written once."""

    hist: DataFrame
    top: DataFrame
    summary: DataFrame
    alleles: DataFrame
    bins: DataFrame
    calls: DataFrame
    valid: DataFrame
    reads: DataFrame
    #: The CCG bins of each sample and mate, and of each atypical allele's realigned reads.
    ccgs: DataFrame
    own_ccgs: DataFrame
    #: Each allele's recalls, and whether its sample had too many.
    budget: DataFrame
    #: Tells a sample's zygosity from its reverse CCG bins; without one, a second peak of 15 percent does.
    code: OutputCode | None = None
    #: Whether atypical alleles are called in a library of their own.
    realigned: bool = True


def genotyped(spark: SparkSession, sf_dir: str) -> Cohort:
    return genotype_reads(synth_reads(spark, sf_dir))


def structured(reads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sums of reads by structure (written, as all else is made from them), the histogram, and each sample's top contigs and
    their summaries."""
    rows = assign_contigs(scan_tracts(reads))
    keys = [c for c in rows.columns if c != "n"]
    rows = kept(rows.groupBy(*keys).agg(F.sum("n").alias("n")))
    both = H.histogram(rows)
    top = top_contigs(_forward(both))
    return rows, both, top, K.contig_summary(rows, top)


def genotype_reads(reads: DataFrame, code: OutputCode | None = None, realign: bool = True) -> Cohort:
    """reads: sample_id, mate, mapq, seq. Atypical alleles are called in a library of their own structure, or without realign in
    the typical one."""
    rows, both, top, summary = structured(reads)
    hist, summary = _forward(both), kept(summary)
    alleles = kept(K.alleles(K.choose_pair(K.ranks(top)), summary))
    realigned = kept(R.realign(rows, alleles) if realign else R.unaligned(both, alleles))
    bins = kept(G.slices(alleles, hist, realigned.where("mate = 'R1'"), realign))
    budget = kept(G.recall_budget(bins))
    calls = G.cag_calls(budget)
    by_ccg = lambda counts, keys: counts.groupBy(*keys, "mate", "ccg").agg(F.sum("n").alias("n"))
    return Cohort(hist, top, summary, alleles, bins, calls, kept(G.validate(calls, bins)), reads, by_ccg(both, ["sample_id"]), by_ccg(realigned, G.SLICE), budget, code, realign)


def ccg_review(c: Cohort) -> DataFrame:
    of = lambda ccgs, mate: ccgs.where(F.col("mate") == mate).drop("mate")
    dense = lambda mate: H.densify(G.allele_counts(c.alleles, of(c.ccgs, mate), of(c.own_ccgs, mate), ["ccg"]), G.SLICE, "ccg", 20)
    whole = H.densify(of(c.ccgs, "R2"), ["sample_id"], "ccg", 20)
    zygosity = classified(whole, c.code) if c.code else G.zygosity(whole)
    return E.ccg_review(dense("R2"), dense("R1"), c.alleles, zygosity, c.valid, c.realigned)


def ccg_vectors(reads: DataFrame) -> DataFrame:
    """(sample_id, mate, features): the 20 CCG bins of each sample and mate."""
    ccgs = H.histogram(assign_contigs(scan_tracts(reads))).groupBy("sample_id", "mate", "ccg").agg(F.sum("n").alias("n"))
    return E.vector(H.densify(ccgs, ["sample_id", "mate"], "ccg", 20), ["sample_id", "mate"], "ccg", "n", "features")


@dataclass
class Evidence:
    """What the second looks found, one row for each allele."""

    review: DataFrame
    peak: DataFrame
    labels: DataFrame


def evidence(c: Cohort, starred: bool = True) -> Evidence:
    """starred: new sequences between the tracts are labelled by likeness, with a star, which needs Python; else by exact counts."""
    review = kept(ccg_review(c))
    peak = kept(E.peak_review(c.bins, c.valid, review))
    return Evidence(review, peak, E.final_labels(label_parts(c.alleles) if starred else c.alleles, c.valid, review, peak))


def scored(c: Cohort, e: Evidence) -> DataFrame:
    """One row for each allele with all that the confidence rules use."""
    share = lambda mate: F.try_divide(100.0 * F.count_if((F.col("mapq") >= 1) & (F.col("mate") == mate)), F.count_if(F.col("mate") == mate))
    count = lambda mate, good: F.count_if((F.col("mapq") >= 1) & (F.col("mate") == mate) if good else (F.col("mapq") < 1) & (F.col("mate") == mate))
    mapped = c.reads.groupBy("sample_id").agg(
        share("R1").alias("fw_mapped"), share("R2").alias("rv_mapped"), count("R1", True).alias("fw_count"), count("R2", True).alias("rv_count"),
        count("R1", False).alias("fw_purged"), count("R2", False).alias("rv_purged"), F.count(F.lit(1)).alias("all_reads"),
    )
    rows = c.valid.drop("fod", "ccg").join(M.peak_metrics(c.bins).drop("call"), G.SLICE).join(c.alleles.drop("ccg", "cag").withColumnRenamed("total", "contig_reads"), G.SLICE).join(mapped, "sample_id")
    level = lambda ratio, steps, most: F.when(F.col("state") != "heterozygous", 2).otherwise(F.expr(M.drop_level(ratio, steps, most)))
    hidden = G.hidden_expansions(c.bins, c.alleles).withColumn("hidden", F.lit(True))
    few = K.read_warnings(K.ranks(c.top)).select("sample_id", F.col("few").alias("alignment_warning"))
    rows = rows.join(hidden, "sample_id", "left").join(few, "sample_id")
    rows = rows.join(e.review.select(*G.SLICE, F.col("uncertain").alias("ccg_uncertain"), "svm_failure", "zygosity", "fod_ccg"), G.SLICE)
    rows = rows.join(e.peak.select(*G.SLICE, "fod", "unexpected", "interpolated"), G.SLICE).join(e.labels, G.SLICE)
    # both alleles' recalls are counted together
    rows = rows.withColumn("recalls", F.sum("recalls").over(Window.partitionBy("sample_id")).cast("int"))
    rows = rows.withColumns({
        "diminished": F.coalesce("hidden", F.lit(False)) | F.col("missed_expansion"), "ccg_threshold": F.lit(0.5).cast("double"),
        "minus_level": level("nminus", M.DROP_MINUS, 0.75), "plus_level": level("nplus", M.DROP_PLUS, 0.65),
        "atypical_warning": (F.col("status") == "Atypical") & (F.coalesce("at_call", F.lit(0)) == 0), "low_reads": F.col("contig_reads") < 750,
    })
    return rows.withColumn("inspection", (F.col("minus_level") == 6) | (F.col("plus_level") == 6) | F.col("unexpected")).drop("hidden")


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two alleles of each sample, and nothing that is called from them."""
    _, _, top, summary = structured(synth_reads(spark, sf_dir))
    return K.alleles(K.choose_pair(K.ranks(top)), summary)


def structures(reads: DataFrame, alleles: DataFrame) -> DataFrame:
    """(sample_id, structures): the (mid, cct) that a sample's reads are aligned to: the typical ones and those of its alleles."""
    typical = reads.select("sample_id").distinct().select("sample_id", F.lit(K.TYPICAL).alias("mid"), F.lit(2).alias("cct"))
    own = alleles.select("sample_id", F.col("intervening").alias("mid"), F.col("est_cct").alias("cct"))
    return typical.unionByName(own).groupBy("sample_id").agg(F.array_sort(F.collect_set(F.struct("mid", "cct"))).alias("structures"))


def variant_calls(reads: DataFrame, alleles: DataFrame, least: int = 2, scoring: S.Scoring = S.Scoring()) -> DataFrame:
    """Variants of each sample on the library entries that its reads align to (chrom). reads: with quality or q."""
    given = "q" if "q" in reads.columns else "quality"
    aligned = S.aligned_reads(reads, structures(reads, alleles), (given,), scoring)
    entry = [F.col(c) for c in ("ref_mid", "contig_cag", "contig_ccg", "ref_cct")]
    rows = aligned.where("cigar IS NOT NULL").withColumn("chrom", S.entry_label(*entry))
    counts = V.base_counts(rows, ["sample_id", "chrom"], S.entry_sequence(*entry))
    return V.call_variants(kept(counts), ["sample_id", "chrom"], least)


def allele_variants(c: Cohort, cutoff: float, least: int = 2, scoring: S.Scoring = S.Scoring()) -> DataFrame:
    """The variants of each allele's own entry that are good enough."""
    return V.surviving(V.of_alleles(variant_calls(c.reads, c.alleles, least, scoring), c.alleles), cutoff)


def outcomes(c: Cohort) -> DataFrame:
    """(sample_id, stage, reason) of every sample that has reads: the stage at which it fails, and why; nulls if it is genotyped."""
    ranked = K.read_warnings(K.ranks(c.top)).withColumn("known", F.lit(True))
    even = c.summary.groupBy("sample_id").agg(F.max("balance_failed").alias("even"))
    spent = c.budget.groupBy("sample_id").agg(F.max("failed").alias("spent"))
    rows = c.reads.select("sample_id").distinct().join(ranked, "sample_id", "left").join(even, "sample_id", "left").join(spent, "sample_id", "left")
    reason = F.when(F.col("known").isNull(), "no read of a known size").when(F.col("t_n").isNull(), "fewer than three contigs").when(F.col("failed"), "too few reads in a contig")
    reason = reason.when(F.col("even"), "typical and atypical reads are even").when(F.col("spent"), "recalls are used up")
    rows = rows.withColumn("reason", reason)
    stage = F.when(F.col("reason") == "recalls are used up", "Genotype").when(F.col("reason").isNotNull(), "DSP")
    return rows.select("sample_id", stage.alias("stage"), "reason")
