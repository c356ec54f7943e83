"""Queries on what is learnt from labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplitract.operators.zygosity import OutputCode, classified, train_output_code
from amplitract.operators import histogram as H
from amplitract.oracles import READS, query
from amplitract.plans import cohort as C
from amplitract.registry import register
from amplitract.sources.reads import ODD, SAMPLES, TYPICAL, synth_reads

#: Into how many smaller samples the reads of each are dealt, for training.
SHARDS = 8


def planted_zygosity(spark: SparkSession) -> DataFrame:
    """(sample_id, mate, label) of the synthetic samples: whether both alleles' reads fall into one CCG bin."""
    bin = lambda allele: allele[2] + (len(allele[1]) - len(TYPICAL)) // 3
    rows = []
    for k, (a, b, *_) in enumerate(SAMPLES):
        for mate, (more_a, more_b) in (("R1", (0, 0)), ("R2", ODD.get(k, (0, 0, 0, 0, 0))[3:])):
            rows.append((k, mate, "HOMO" if bin(a) + more_a == bin(b) + more_b else "HETERO"))
    return spark.createDataFrame(rows, "sample_id int, mate string, label string")


def training_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(shard, features, label): the CCG bins of both mates of each eighth of a sample's reads."""
    shard = F.col("sample_id") * SHARDS + (F.expr("read_id div 10") % SHARDS).cast("int")
    vectors = C.ccg_vectors(synth_reads(spark, sf).withColumn("sample_id", shard))
    known = planted_zygosity(spark)
    return vectors.withColumn("of", F.expr(f"sample_id div {SHARDS}").cast("int")).join(F.broadcast(known.withColumnRenamed("sample_id", "of")), ["of", "mate"]).select(F.col("sample_id").alias("shard"), "features", "label")


def learned_code(spark: SparkSession, sf: str) -> OutputCode:
    return train_output_code(C.kept(training_vectors(spark, sf)))


@register("zygosity_learned", query(f"SELECT DISTINCT sample_id, CASE WHEN ccg1 + rv1 + (length(mid1) - {len(TYPICAL)}) // 3 = ccg2 + rv2 + (length(mid2) - {len(TYPICAL)}) // 3 THEN 'HOMO' ELSE 'HETERO' END AS zygosity FROM reads JOIN truth USING (sample_id)", READS))
def zygosity_learned(spark: SparkSession, sf: str) -> DataFrame:
    """Of each whole sample's reverse reads, by machines that learnt from eighths of samples. The SQL is what was planted."""
    ccgs = C.histogram(spark, sf).where("mate = 'R2'").groupBy("sample_id", "ccg").agg(F.sum("n").alias("n"))
    return classified(H.densify(ccgs, ["sample_id"], "ccg", 20), learned_code(spark, sf))
