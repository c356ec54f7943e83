"""Queries on reads that are aligned base by base: rescored bins, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplitract.operators import rescoring as S
from amplitract.operators import variants as V
from amplitract.oracles import RESCORED, VARIANTS, query
from amplitract.plans import cohort as C
from amplitract.registry import register
from amplitract.sources.bam import read_bam, write_bam
from amplitract.sources.reads import synth_reads


@register("rescored_histogram", query("SELECT sample_id, mate, ccg::INT AS ccg, cag::INT AS cag, sum(n)::BIGINT AS n FROM useq JOIN entries USING (sample_id, seq) GROUP BY ALL", RESCORED))
def rescored_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of each library entry, by the best score rather than by the length of what stands between the tracts."""
    return C.H.histogram(S.aligned_reads(synth_reads(spark, sf)))


@register("variant_calls", query("SELECT * FROM records", VARIANTS))
def variant_calls(spark: SparkSession, sf: str) -> DataFrame:
    reads = synth_reads(spark, sf)
    return C.variant_calls(reads, C.genotype_reads(reads).alleles)


@register("variant_filter", query("SELECT sample_id, allele, pos, qual FROM k", VARIANTS))
def variant_filter(spark: SparkSession, sf: str) -> DataFrame:
    return C.allele_variants(C.genotyped(spark, sf), 20.0).select("sample_id", "allele", "pos", "qual")


@register("variant_text", query("SELECT sample_id, allele, string_agg(ref || '->' || alt || '@' || pos, '   ' ORDER BY qual DESC, pos) AS text, max(qual) AS score FROM k GROUP BY ALL", VARIANTS))
def variant_text(spark: SparkSession, sf: str) -> DataFrame:
    return V.variant_text(C.allele_variants(C.genotyped(spark, sf), 20.0))


@register("variants_off_target", query("SELECT sample_id, allele, chrom, count(*) AS n FROM t WHERE NOT target GROUP BY ALL", VARIANTS))
def variants_off_target(spark: SparkSession, sf: str) -> DataFrame:
    c = C.genotyped(spark, sf)
    records = V.of_alleles(C.variant_calls(c.reads, c.alleles), c.alleles)
    return V.on_target(records).where("NOT target").groupBy("sample_id", "allele", "chrom").agg(F.count(F.lit(1)).alias("n"))


@register("bam_histogram", query("SELECT * FROM hist"))
def bam_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The reads as unaligned BAM files in the shared folder, and the histogram of what is read from them."""
    reads = synth_reads(spark, sf)
    rows = reads.select(F.concat_ws(":", "sample_id", "mate", "read_id").alias("read_id"), F.lit(None).cast("string").alias("contig"), "mapq", "seq", F.repeat(F.char(F.col("quality") + 33), F.length("seq")).alias("qual"))
    with C.scratch(spark, "reads-bam") as folder:
        write_bam(rows, folder, [])
        part = lambda k: F.split_part("read_id", F.lit(":"), F.lit(k))
        back = read_bam(spark, folder, columns=["read_id", "mapq", "seq"]).select(part(1).cast("int").alias("sample_id"), part(2).alias("mate"), "mapq", "seq")
        return C.kept(C.H.histogram(C.assign_contigs(C.scan_tracts(back))))
