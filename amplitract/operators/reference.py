"""Reference libraries, generated rather than read, and the realignment of atypical alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplitract.functions.exprs import joined_label
from amplitract.sources.reads import FIVE_PRIME, THREE_PRIME, TYPICAL


def library(structures: DataFrame, cags: tuple[int, int], ccgs: tuple[int, int] = (1, 20), five: str = FIVE_PRIME) -> DataFrame:
    """(structure columns, cag, ccg, label, seq): every size for each structure (intervening, cct)."""
    rows = structures.select("*", F.explode(F.sequence(F.lit(cags[0]), F.lit(cags[1]))).alias("cag"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(ccgs[0]), F.lit(ccgs[1]))).alias("ccg"))
    first, second = F.regexp_count("intervening", F.lit("CAACAG")), F.regexp_count(F.replace("intervening", F.lit("CAACAG"), F.lit("")), F.lit("CCGCCA"))
    seq = F.concat(F.lit(five), F.repeat(F.lit("CAG"), F.col("cag")), "intervening", F.repeat(F.lit("CCG"), F.col("ccg")), F.repeat(F.lit("CCT"), F.col("cct")), F.lit(THREE_PRIME))
    return rows.withColumn("label", joined_label(F.col("cag"), first, second, F.col("ccg"), F.col("cct"))).withColumn("seq", seq)


def typical_library(spark: SparkSession, mate: str = "R1") -> DataFrame:
    """4000 forward entries (CAG 1 to 200), or 20 reverse ones (CAG 100), which begin with the tract."""
    typical = spark.createDataFrame([(TYPICAL, 2)], "intervening string, cct int")
    return library(typical, (1, 200)) if mate == "R1" else library(typical, (100, 100), five="")


def custom_library(alleles: DataFrame, mate: str = "R1") -> DataFrame:
    """The library of each atypical structure (intervening, cct) that the alleles have, in the sizes of the typical one."""
    odd = alleles.where("status = 'Atypical'").select("intervening", F.col("est_cct").alias("cct")).distinct()
    return library(odd, (1, 200)) if mate == "R1" else library(odd, (100, 100), five="")


def whole_library(spark: SparkSession, alleles: DataFrame) -> DataFrame:
    """The typical forward library and those of atypical alleles, by origin."""
    return typical_library(spark).withColumn("origin", F.lit("typical")).unionByName(custom_library(alleles).withColumn("origin", F.lit("custom")))


def realign(assigned: DataFrame, alleles: DataFrame) -> DataFrame:
    """(sample_id, allele, mate, ccg, cag, n): histograms of atypical alleles against a library of their own structure. A read's CCG
    bin is right if what stands between its tracts is what the allele has; its CAG is what it is."""
    odd = alleles.where("status = 'Atypical'").select("sample_id", "allele", F.length("intervening").alias("length"))
    rows = assigned.join(odd, "sample_id")
    rows = rows.withColumn("bin", F.col("ccg") + F.floor((F.length("intervening") - F.col("length")) / 3).cast("int")).where("cag BETWEEN 1 AND 200 AND bin BETWEEN 1 AND 20")
    return rows.groupBy("sample_id", "allele", "mate", F.col("bin").alias("ccg"), "cag").agg(F.sum("n").alias("n"))


def unaligned(hist: DataFrame, alleles: DataFrame) -> DataFrame:
    """What realign gives if nothing is realigned: the sample's bins for each of its atypical alleles."""
    return hist.join(alleles.where("status = 'Atypical'").select("sample_id", "allele"), "sample_id").select("sample_id", "allele", "mate", "ccg", "cag", "n")
