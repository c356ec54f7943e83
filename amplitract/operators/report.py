"""Cohort reports. Values are typed and null inside; FAIL and other tokens appear only at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: (column of the report, column of the scores) for each allele, and for each sample, in the report's order.
ALLELE_COLUMNS = [
    ("genotype", "genotype"), ("status", "status"), ("map_fw", "fw_count"), ("map_fw_pcnt", "fw_mapped"), ("purged_fw", "fw_purged"), ("map_rv", "rv_count"), ("map_rv_pcnt", "rv_mapped"), ("purged_rv", "rv_purged"),
    ("slippage", "slippage"), ("mosaicism", "mosaicism"), ("variant_call", "variant_call"), ("variant_score", "variant_score"), ("intervening", "intervening"), ("confidence", "confidence"),
]
SAMPLE_COLUMNS = [
    ("exception", "exception"), ("homozygous_haplotype", "homozygous"), ("neighbouring_peaks", "beside"), ("diminished_peaks", "diminished"), ("novel_atypical", "novel"), ("alignment_warning", "alignment_warning"),
    ("atypical_alignment_warning", "atypical_warning"), ("ccg_rewritten", "ccg_rewritten"), ("ccg_zygosity_rewritten", "zygosity_rewritten"), ("ccg_uncertainty", "ccg_uncertain"), ("cct_uncertainty", "cct_uncertain"),
    ("svm_failure", "svm_failure"), ("differential_confusion", "diff_confuse"), ("missed_expansion", "missed_expansion"), ("heuristic_success", "heuristic_ok"), ("peak_inspection", "inspection"),
    ("low_distribution_reads", "low_reads"), ("low_peak_reads", "fatal_low"),
]


def instance_report(scored: DataFrame, confidence: DataFrame, variants: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """One row for each sample: its label, for both alleles genotype, status, mapped and purged reads, metrics, variants
    (sample_id, allele, text, score), sequence between the tracts and confidence; then the sample's flags, which hold if
    they do for one allele. Values that there are none of are FAIL, flags True or False. exception is the
    stage at which a sample failed (outcomes: sample_id, stage; all samples), else N/A; all other values of such a sample are FAIL.
    Without outcomes it tells whether an allele is missing."""
    rows = scored.join(confidence, ["sample_id", "allele"], "left")
    if variants is not None:
        rows = rows.join(variants.select("sample_id", "allele", F.col("text").alias("variant_call"), F.col("score").alias("variant_score")), ["sample_id", "allele"], "left")
    else:
        rows = rows.withColumn("variant_call", F.lit(None)).withColumn("variant_score", F.lit(None))
    rows = rows.withColumns({"homozygous": F.col("state") == "homozygous", "beside": F.col("state") == "neighbouring"})
    pick = lambda who, name, c: F.coalesce(F.max(F.when(F.col("allele") == who, F.col(c).cast("string"))), F.lit("FAIL")).alias(f"{who.lower()}_{name}")
    flag = lambda name, c: F.initcap(F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).cast("boolean").cast("string")).alias(name)
    missing = F.initcap((F.count_distinct("allele") < 2).cast("string")).alias("exception")
    if outcomes is not None:
        rows = rows.join(outcomes.where("stage IS NULL").select("sample_id"), "sample_id", "left_semi")
    report = rows.groupBy("sample_id").agg(*[pick(who, *c) for who in ("PRI", "SEC") for c in ALLELE_COLUMNS], missing, *[flag(*c) for c in SAMPLE_COLUMNS[1:]])
    if outcomes is None:
        return report
    whole = outcomes.select("sample_id", "stage").join(report, "sample_id", "left")
    filled = [F.coalesce("stage", F.lit("N/A")).alias(c) if c == "exception" else F.coalesce(c, F.lit("FAIL")).alias(c) for c in report.columns if c != "sample_id"]
    return whole.select("sample_id", *filled)


def with_sample_values(alleles: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """alleles, whose nulls in the columns take the sample's values."""
    theirs = samples.select("sample_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = alleles.join(theirs, "sample_id", "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else c for c in alleles.columns])


def simplified_report(labels: DataFrame, intervals: DataFrame) -> DataFrame:
    """(sample_id, allele1, allele1_ci, allele2, allele2_ci)"""
    rows = labels.join(intervals.select("sample_id", "allele", "interval"), ["sample_id", "allele"], "left")
    pick = lambda who, c: F.coalesce(F.max(F.when(F.col("allele") == who, F.col(c))), F.lit("FAIL"))
    return rows.groupBy("sample_id").agg(pick("PRI", "genotype").alias("allele1"), pick("PRI", "interval").alias("allele1_ci"), pick("SEC", "genotype").alias("allele2"), pick("SEC", "interval").alias("allele2_ci"))


#: Title and column of each line of an allele's text report, by section.
ALLELE_REPORT = [
    ("Summary Information>>", [("Genotype", "genotype"), ("Confidence", "confidence"), ("CCG Uncertain", "ccg_uncertain"), ("Structure Status", "status"), ("Typical Pcnt", "typical_pcnt"), ("Atypical Pcnt", "atypical_pcnt"), ("Total Reads", "contig_reads")]),
    ("Flags>>", [
        ("Recall Count", "recalls"), ("Homozygous Haplotype", "homozygous"), ("Neighbouring Peaks", "beside"), ("Diminished Peaks", "diminished"), ("Backwards Slippage", "slippage"), ("Somatic Mosaicism", "mosaicism"), ("Slippage Overwritten", "slippage_overwrite"),
        ("Peak Interpolation Warning", "interpolation_warning"), ("Peak Interpolation Distance", "interpolated"), ("Peak DSP Overwritten", "fod_overwrite"), ("Low read-count alignment", "alignment_warning"), ("Fatal low read-count", "fatal_low"),
    ]),
    ("Data Quality>>", [("Reads (%) surrounding peak", "vicinity"), ("Immediate Dropoffs", "dropoffs"), ("N-1 Warning Level", "minus_level"), ("N+1 Warning Level", "plus_level"), ("CCG Threshold", "ccg_threshold"), ("CAG Threshold", "threshold")]),
]
INSPECTION_LOG = [
    ("Investigating CCG", "fod_ccg"), ("Interpolation warning", "interpolation_warning"), ("Interpolation distance", "interpolated"), ("Reads (%) surrounding peak", "vicinity"), ("Peak dropoff", "dropoffs"), ("NMinus ratio", "nminus"),
    ("NMinus warning", "minus_level"), ("NPlus ratio", "nplus"), ("NPlus warning", "plus_level"), ("Unexpected Peaks", "unexpected"),
]


def _told(rows: DataFrame) -> DataFrame:
    dropoffs = F.format_string("[%s, %s]", F.coalesce(F.col("nminus").cast("string"), F.lit("FAIL")), F.coalesce(F.col("nplus").cast("string"), F.lit("FAIL")))
    return rows.withColumns({"homozygous": F.col("state") == "homozygous", "beside": F.col("state") == "neighbouring", "interpolation_warning": F.col("interpolated").isNull(), "dropoffs": dropoffs})


def _line(title: str, c: str, kind: str) -> Column:
    text = F.initcap(F.col(c).cast("string")) if kind == "boolean" else F.col(c).cast("string")
    return F.concat(F.lit(f"{title}: "), F.coalesce(text, F.lit("FAIL")))


def allele_reports(scored: DataFrame, confidence: DataFrame) -> DataFrame:
    """(sample_id, allele, report): the text report of each allele."""
    rows = _told(scored.join(confidence, ["sample_id", "allele"], "left"))
    kinds = dict(rows.dtypes)
    sections = [F.concat_ws("\n", F.lit(head), *[_line(t, c, kinds[c]) for t, c in lines]) for head, lines in ALLELE_REPORT]
    head = F.concat(F.lit("Allele Report>> "), F.col("sample_id").cast("string"))
    return rows.select("sample_id", "allele", F.concat_ws("\n\n", head, *sections).alias("report"))


def inspection_logs(scored: DataFrame) -> DataFrame:
    """(sample_id, allele, log) of the alleles whose peak failed inspection."""
    rows = _told(scored.where("inspection"))
    kinds = dict(rows.dtypes)
    head = F.lit(">> Peak Inspection Failure  Intermediate results log")
    return rows.select("sample_id", "allele", F.concat_ws("\n", head, *[_line(t, c, kinds[c]) for t, c in INSPECTION_LOG]).alias("log"))


def cohort_sizes(alleles: DataFrame) -> DataFrame:
    """How many alleles have each CAG size from 1 to 200 and each CCG size from 1 to 20."""

    def of(what: str, most: int) -> DataFrame:
        found = alleles.groupBy(F.col(f"est_{what}").alias("size")).agg(F.count(F.lit(1)).alias("n"))
        all_sizes = alleles.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("size"))
        return all_sizes.join(found, "size", "left").select(F.lit(what).alias("tract"), "size", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    return of("cag", 200).unionByName(of("ccg", 20))


def sample_documents(alleles: DataFrame) -> DataFrame:
    """One JSON document for each sample, for a page template."""
    body = F.to_json(F.sort_array(F.collect_list(F.struct("allele", "label", "status"))))
    return alleles.groupBy("sample_id").agg(body.alias("document"))


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header; reports have a row for each sample or allele."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str) -> None:
    """A table with a folder for each sample."""
    df.write.mode("overwrite").partitionBy("sample_id").parquet(path)
