"""Reads: from FASTQ, FASTA and VCF files, and synthesised from a table of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The flanks of the amplicon and the typical sequence between its two tracts.
FIVE_PRIME = "GCGACCCTGGAAAAGCTGATGAAGGCCTTCGAGTCCCTCAAGTCCTTC"
#: What the synthetic reads of some fragments have for the first: one base differs.
FIVE_PRIME_VARIANT = FIVE_PRIME[:9] + "A" + FIVE_PRIME[10:]
THREE_PRIME = "CAGCTTCCTCAGCCGCCGCCGCAGGCACAGCCGCTGCT"
TYPICAL = "CAACAGCCGCCA"

#: Flanks with three planted variants: all reads of sample 4's first allele have them, and half of those of sample 17's.
FIVE_PRIME_SNPS = FIVE_PRIME[:14] + "T" + FIVE_PRIME[15:25] + "A" + FIVE_PRIME[26:]
THREE_PRIME_SNP = THREE_PRIME[:28] + "T" + THREE_PRIME[29:]
#: How a read's CAG differs from its allele's: (upto, shift) of 100 equal shares of the reads.
SLIPS = [
    [(7, -2), (18, -1), (91, 0), (96, 1), (99, 2), (100, 3)],  # 0: as usual
    [(100, 0)],  # 1: not at all
    [(2, -2), (35, -1), (69, 0), (98, 1), (100, 2)],  # 2: flat, the next bin almost as high
    [(4, -2), (34, -1), (71, 0), (96, 1), (100, 2)],  # 3: flat, the bin before almost as high
    [(50, 0), (100, 6)],  # 4: two alleles in one
    [(1, -1), (99, 0), (100, 1)],  # 5: hardly
]
#: What each synthetic sample holds: two alleles (CAG, sequence between, CCG, CCT) and the percentage of the first.
SAMPLES = [
    ((17, TYPICAL, 7, 2), (23, TYPICAL, 10, 2), 60),
    ((17, TYPICAL, 7, 2), (42, TYPICAL, 7, 2), 60),
    ((17, TYPICAL, 7, 2), (18, TYPICAL, 7, 2), 55),
    ((17, TYPICAL, 7, 2), (17, TYPICAL, 7, 2), 60),
    ((20, TYPICAL, 10, 2), (44, TYPICAL, 7, 2), 60),
    ((19, TYPICAL, 7, 2), (25, TYPICAL, 10, 2), 60),
    ((15, TYPICAL, 9, 2), (40, TYPICAL, 9, 2), 60),
    ((21, TYPICAL, 7, 2), (22, TYPICAL, 7, 2), 55),
    ((18, TYPICAL, 10, 2), (18, TYPICAL, 10, 2), 60),
    ((22, TYPICAL, 7, 2), (48, TYPICAL, 10, 2), 60),
    ((17, "CAACAGCAACAGCCGCCA", 7, 2), (23, TYPICAL, 10, 2), 60),
    ((20, "CAACAG", 7, 2), (17, TYPICAL, 10, 2), 60),
    ((19, "", 7, 2), (25, TYPICAL, 10, 2), 60),
    ((18, "CAACAGCCGCCACCGCCA", 7, 2), (24, TYPICAL, 10, 2), 60),
    ((21, "CAACAGCTGCTA", 7, 2), (17, TYPICAL, 10, 2), 60),
    ((17, TYPICAL, 7, 3), (26, TYPICAL, 10, 2), 60),
    ((16, "CAACAGCAACAGCCGCCA", 7, 2), (22, "CAACAGCAACAGCCGCCA", 5, 2), 60),
    ((17, TYPICAL, 7, 2), (60, TYPICAL, 10, 2), 60),
    ((18, TYPICAL, 7, 2), (24, TYPICAL, 9, 2), 60),
    ((16, TYPICAL, 6, 2), (30, TYPICAL, 9, 2), 60),
    ((17, TYPICAL, 7, 2), (42, TYPICAL, 7, 2), 60),
    ((19, TYPICAL, 7, 2), (19, TYPICAL, 7, 2), 60),
    ((17, "CAACAGCAACAGCCGCCA", 7, 2), (17, TYPICAL, 9, 2), 50),
    ((17, TYPICAL, 7, 2), (40, TYPICAL, 7, 2), 76),
    ((17, TYPICAL, 7, 2), (40, TYPICAL, 7, 2), 50),
    ((17, TYPICAL, 7, 2), (40, TYPICAL, 7, 2), 50),
    ((17, TYPICAL, 7, 2), (24, TYPICAL, 10, 2), 60),
    ((17, TYPICAL, 7, 2), (40, TYPICAL, 7, 2), 55),
    ((17, TYPICAL, 7, 2), (40, TYPICAL, 7, 2), 60),
    ((17, TYPICAL, 7, 2), (200, TYPICAL, 7, 2), 40),
    ((21, TYPICAL, 7, 2), (21, TYPICAL, 7, 2), 60),
    ((17, TYPICAL, 7, 2), (42, TYPICAL, 7, 2), 60),
    ((17, "CAACAGCAACAGCCGCCA", 7, 2), (24, TYPICAL, 7, 2), 55),
    ((17, TYPICAL, 7, 2), (40, TYPICAL, 7, 2), 60),
    ((17, TYPICAL, 7, 2), (24, TYPICAL, 10, 2), 60),
]
#: What is odd about some: the percentage of reads that are there, both alleles' slips, and what their reverse reads have of CCG more.
ODD = {20: (4, 0, 0, 0, 0), 21: (100, 1, 1, 0, 0), 24: (100, 0, 2, 0, 0), 25: (100, 0, 3, 0, 0), 26: (100, 0, 0, 3, 4), 27: (100, 0, 0, 0, 3), 28: (100, 1, 4, 0, 0), 29: (100, 0, 1, 0, 0), 30: (100, 5, 5, 0, 0), 31: (45, 0, 0, 0, 0), 32: (100, 0, 4, 0, 3), 33: (100, 0, 0, 5, 5), 34: (100, 0, 0, 7, 4)}

_FIRST = "l_orderkey % 100 < split"
_SNPS = f"{_FIRST} AND (l_suppkey % {len(SAMPLES)} = 4 OR (l_suppkey % {len(SAMPLES)} = 17 AND l_orderkey % 2 = 0))"


def slip_case(slip: str, p: str) -> str:
    """SQL of a read's shift by the number of its slips and a number below 100."""
    one = lambda steps: "CASE " + " ".join(f"WHEN {p} < {upto} THEN {shift}" for upto, shift in steps) + " END"
    return f"CASE {slip} " + " ".join(f"WHEN {k} THEN {one(steps)}" for k, steps in enumerate(SLIPS)) + " END"


def sample_values() -> str:
    rows = [(k, a[0], f"'{a[1]}'", a[2], a[3], b[0], f"'{b[1]}'", b[2], b[3], split, *ODD.get(k, (100, 0, 0, 0, 0))) for k, (a, b, split) in enumerate(SAMPLES)]
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


SAMPLE_COLUMNS = "sample_id, cag1, mid1, ccg1, cct1, cag2, mid2, ccg2, cct2, split, present, slip1, slip2, rv1, rv2"


def synth_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, read_id, mate, mapq, seq, qual): one read for each line item (of samples that are thinned, some), with slippage, and one base changed in a fiftieth of them; sample 18 has reads in all three frames,
    samples 4 and 17 have variants in the flanks."""
    truth = spark.sql(f"SELECT * FROM VALUES {sample_values()} AS t({SAMPLE_COLUMNS})")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    rows = items.withColumn("sample_id", (F.col("l_suppkey") % len(SAMPLES)).cast("int")).join(F.broadcast(truth), "sample_id")
    rows = rows.where((F.col("l_partkey") * 31 + F.col("l_orderkey")) % 100 < F.col("present"))
    pick = lambda name: F.expr(f"CASE WHEN {_FIRST} THEN {name}1 ELSE {name}2 END")
    mate = F.when(F.col("l_linenumber") % 4 == 0, "R2").otherwise("R1")
    slip = F.expr(f"CASE WHEN {_FIRST} THEN {slip_case('slip1', 'l_partkey % 100')} ELSE {slip_case('slip2', 'l_partkey % 100')} END")
    cag, ccg = (pick("cag") + slip).cast("int"), (pick("ccg") + F.when(mate == "R2", pick("rv")).otherwise(0)).cast("int")
    body = F.concat(
        F.when(F.col("sample_id") == 18, F.repeat(F.lit("A"), (F.col("l_linenumber") % 3).cast("int"))).otherwise(F.lit("")),
        F.when(F.expr(_SNPS), FIVE_PRIME_SNPS).when(F.col("l_partkey") % 50 == 3, FIVE_PRIME_VARIANT).otherwise(FIVE_PRIME), F.repeat(F.lit("CAG"), cag), pick("mid"), F.repeat(F.lit("CCG"), ccg), F.repeat(F.lit("CCT"), pick("cct")),
        F.when(F.expr(_SNPS), THREE_PRIME_SNP).otherwise(THREE_PRIME),
    )
    return rows.select(
        "sample_id",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("read_id"),
        mate.alias("mate"),
        F.when(F.col("l_partkey") % 50 == 7, 0).otherwise(60).alias("mapq"),
        body.alias("seq"),
        F.col("l_quantity").cast("int").alias("quality"),
    )


FASTQ_NAME = r"([^/]+)_(R[12])\.f(?:ast)?q(?:\.gz)?$"


def fastq_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(run_dir, label, r1, r2, error): the FASTQ files under path, paired by their label; files that are alone, misnamed or one
    of two with the same label and mate have an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = files.select("path", F.regexp_extract("path", FASTQ_NAME, 1).alias("label"), F.regexp_extract("path", FASTQ_NAME, 2).alias("mate"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("run_dir"))
    of = lambda mate: F.collect_list(F.when(F.col("mate") == mate, F.col("path")))
    good = named.where("label <> ''").groupBy("run_dir", "label").agg(F.sort_array(of("R1")).alias("one"), F.sort_array(of("R2")).alias("two"))
    error = F.when((F.size("one") > 1) | (F.size("two") > 1), "two files of one mate").when(F.size("one") == 0, "no R1").when(F.size("two") == 0, "no R2")
    good = good.select("run_dir", "label", F.get("one", 0).alias("r1"), F.get("two", 0).alias("r2"), error.alias("error"))
    bad = named.where("label = ''").select("run_dir", F.col("path").alias("label"), F.lit(None).cast("string").alias("r1"), F.lit(None).cast("string").alias("r2"), F.lit("not a FASTQ name").alias("error"))
    return good.unionByName(bad)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 0, value) of text files of any size: each split counts its own lines, and begins at what the
    splits of the file before it hold (gzip files are one split)."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(blocks, ["path", "block"]).select("path", (F.col("id") + F.col("shift")).alias("line_no"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, mate, read_id, seq, qual): records of four lines."""
    rows = numbered_lines(spark, path).withColumn("record", F.expr("line_no div 4")).withColumn("part", F.col("line_no") % 4)
    records = rows.groupBy("path", "record").agg(*[F.max(F.when(F.col("part") == k, F.col("value"))).alias(n) for k, n in ((0, "head"), (1, "seq"), (3, "qual"))]).where("head LIKE '@%' AND seq IS NOT NULL")
    return records.select("path", F.regexp_extract("path", FASTQ_NAME, 1).alias("label"), F.regexp_extract("path", FASTQ_NAME, 2).alias("mate"), F.regexp_extract("head", r"^@(\S+)", 1).alias("read_id"), "seq", "qual")


def read_training(spark: SparkSession, path: str, features: int) -> DataFrame:
    """(features array of double, label) of a table for a classifier: a line of counts, one of names, then one row a sample."""
    rows = numbered_lines(spark, path).where("line_no > 1 AND value <> ''").select(F.split("value", ",").alias("f"))
    return rows.where(F.size("f") == features + 1).select(F.slice("f", 1, features).cast("array<double>").alias("features"), F.trim(F.get("f", features)).alias("label"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(label, seq) of each entry; a sequence may run over several lines."""
    text = spark.read.text(path, lineSep=">").where("value <> ''")
    return text.select(F.trim(F.substring_index("value", "\n", 1)).alias("label"), F.regexp_replace(F.expr("substring(value, instr(value, '\n'))"), r"\s", "").alias("seq"))


VCF = "chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string, format string, call string"


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt array, qual) of the records of VCF files."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=VCF)
    return rows.select("chrom", "pos", "ref", F.split("alt", ",").alias("alt"), "qual")


def read_sam(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    """(read_id, contig, mapq, seq, aligned) of the aligned records of SAM text, of one contig if named; aligned is the sequence
    without what the CIGAR string clips softly at either end."""
    rows = spark.read.text(path).where("value NOT LIKE '@%'").select(F.split("value", "\t").alias("f"))
    rows = rows.select(F.get("f", 0).alias("read_id"), F.get("f", 2).alias("contig"), F.get("f", 4).cast("int").alias("mapq"), F.get("f", 5).alias("cigar"), F.get("f", 9).alias("seq")).where("contig <> '*'")
    clip = lambda pattern: F.coalesce(F.regexp_extract("cigar", pattern, 1).try_cast("int"), F.lit(0))
    front, back = clip(r"^(?:\d+H)?(\d+)S"), clip(r"(\d+)S(?:\d+H)?$")
    rows = rows.select("read_id", "contig", "mapq", "seq", F.substring(F.col("seq"), front + 1, F.greatest(F.lit(0), F.length("seq") - front - back)).alias("aligned"))
    return rows.where(F.col("contig") == contig) if contig is not None else rows
