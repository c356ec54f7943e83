"""A run as its configuration asks for: each stage can be left out, and takes what the stages before it give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amplitract.operators import consensus as K
from amplitract.operators import metrics as M
from amplitract.operators import qc as Q
from amplitract.operators import report as T
from amplitract.operators import variants as V
from amplitract.operators.histogram import histogram
from amplitract.operators.tracts import assign_contigs, scan_tracts
from amplitract.plans import cohort as C
from amplitract.operators.rescoring import aligned_reads
from amplitract.operators.zygosity import train_output_code
from amplitract.sources.config import Config
from amplitract.sources.reads import read_training


def reads_of_files(records: DataFrame) -> DataFrame:
    """FASTQ records (label, mate, read_id, seq, qual) as reads: sample_id, read_id, mate, mapq (60: nothing maps them yet), seq
    and q, an array with the quality of each base."""
    q = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return records.select(F.col("label").alias("sample_id"), "read_id", "mate", F.lit(60).alias("mapq"), "seq", q.alias("q"))


def run(reads: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The tables of each stage that config asks for, by name. reads: sample_id, mate, mapq, seq, and q if they are to be trimmed
    by quality (or quality, one for a read). Variants above the cutoff are those of the alleles if there are any, else a pileup's."""
    out: dict[str, DataFrame] = {}
    if config.demultiplex:
        five, three = config.ends()
        cut = (five, three, config.demultiplex_min_length, config.demultiplex_max_length)
        rate = config.demultiplex_error_rate
        parts = Q.demultiplex_fuzzy(reads, *cut, rate, config.demultiplex_min_overlap) if rate else Q.demultiplex(reads, *cut)
        out["demultiplexed"] = parts.groupBy("sample_id", "mate").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("part")).alias("length"))
        begin = F.instr("seq", F.col("part"))
        if "q" in reads.columns:
            parts = parts.withColumn("q", F.slice("q", begin, F.greatest(F.length("part"), F.lit(1))))
        reads = parts.withColumn("seq", F.col("part")).drop("part")
    if config.quality_control:
        trimmed = Q.trim(reads, config.trim_type, config.quality_threshold, config.forward_adapter, reverse=config.reverse_adapter, flag=config.adapter_flag, error_rate=config.error_tolerance)
        out["basic_statistics"] = Q.basic_statistics(trimmed)
        out["trimming"] = Q.trim_report(trimmed)
        if "q" in reads.columns:  # the qualities of what is left, which begins where it is first found in the read
            trimmed = trimmed.withColumn("q", F.when(F.col("trimmed") == "", F.array().cast("array<int>")).otherwise(F.slice("q", F.expr("instr(seq, trimmed)"), F.greatest(F.length("trimmed"), F.lit(1)))))
        reads = trimmed.withColumn("seq", F.col("trimmed")).drop("trimmed")
    assigned = assign_contigs(scan_tracts(reads, keep_seq=True))
    if config.alignment:
        out["histogram"] = histogram(aligned_reads(reads, scoring=config.scoring()) if config.rescoring else assigned)
    c = None
    if config.genotyping:
        code = train_output_code(read_training(reads.sparkSession, config.training_data, 20)) if config.training_data else None
        c = C.genotype_reads(reads, code, config.atypical_realignment)
        e = C.evidence(c)
        scored = C.scored(c, e)
        confidence, outcomes = M.confidence(scored), C.outcomes(c)
        out |= {"labels": e.labels, "penalty_events": M.penalty_events(scored), "confidence": confidence, "outcomes": outcomes, "warnings": K.read_warnings(K.ranks(c.top))}
    quality = {"q", "quality"} & set(reads.columns)
    if config.snp_calling and c and quality:
        out["variants"] = C.allele_variants(c, config.snp_cutoff, config.snp_observations, config.scoring())
    elif config.snp_calling:
        same = assigned.where("contig_cag IS NOT NULL").groupBy(F.concat_ws("_", "sample_id", "contig_cag", "contig_ccg").alias("contig"), "seq").agg(F.sum("n").alias("k"))
        modal = same.groupBy("contig").agg(F.min(F.struct(-F.col("k"), "seq"))["seq"].alias("seq"))
        out["variants"] = V.pileup(same, modal, config.snp_observations)
    if c:
        texts = V.variant_text(out["variants"]) if config.snp_calling and quality else None
        out["instance_report"] = T.instance_report(scored, confidence, texts, outcomes)
    return out
