"""Queries on reads by other ways in: a stream, a table function in SQL, many pairs of adapters."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amplitract.functions.scan import register_scan
from amplitract.operators.adapters import demultiplex_pairs
from amplitract.operators.tracts import distinct_reads
from amplitract.oracles import READS, query, scan_of
from amplitract.plans import cohort as C
from amplitract.registry import register
from amplitract.sources.reads import FIVE_PRIME, FIVE_PRIME_SNPS, THREE_PRIME, THREE_PRIME_SNP, synth_reads
from amplitract.streaming.histogram import add_batches, once, total


@register("streamed_histogram", query("SELECT * FROM hist", scan_of("(SELECT DISTINCT * FROM reads)")))
def streamed_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The reads as a stream of files, a third of them sent twice, in four batches at most; a read that is sent again counts once."""
    # reads of one id that differ in anything are several
    version = F.xxhash64("mapq", "quality", "seq")
    reads = synth_reads(spark, sf).select("sample_id", "mate", "mapq", "seq", "read_id", version.alias("version"), F.timestamp_seconds(F.col("read_id") % 600).alias("ts"), (F.col("read_id") % 3).alias("part"))
    with C.scratch(spark, "stream") as folder:
        for sent in ("part < 2", "part > 0"):
            reads.where(sent).drop("part").write.mode("append").parquet(f"{folder}/in")
        # all reads come within the delay, so each batch goes through the keys of all that came before
        some = -(-len(spark.read.parquet(f"{folder}/in").inputFiles()) // 4)
        files = spark.readStream.schema(reads.drop("part").schema).option("maxFilesPerTrigger", some).parquet(f"{folder}/in")
        add_batches(once(files, key=("sample_id", "mate", "read_id", "version")), f"{folder}/out", f"{folder}/state").awaitTermination()
        return C.kept(total(spark, f"{folder}/out"))


@register("scan_sql", query("SELECT sample_id, mate, cag, ccg, cct, intervening, five, three, sum(n)::BIGINT AS n FROM scanned GROUP BY ALL"))
def scan_sql(spark: SparkSession, sf: str) -> DataFrame:
    """As tract_scan, in SQL."""
    register_scan(spark)
    return spark.sql("SELECT sample_id, mate, cag, ccg, cct, intervening, five, three, sum(n) AS n FROM {reads} r, LATERAL scan_tracts(r.seq) GROUP BY ALL", reads=distinct_reads(synth_reads(spark, sf)))


#: Both forms of the flanks, each known by 20 bases, among pairs that no read has.
PLANTED_PAIRS = [("plain", FIVE_PRIME[10:30], THREE_PRIME[12:32]), ("variants", FIVE_PRIME_SNPS[10:30], THREE_PRIME_SNP[12:32])]


def adapter_pairs(count: int = 50) -> list[tuple[str, str, str]]:
    rng = random.Random(3)
    any_of = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    return PLANTED_PAIRS + [(f"other{k}", any_of(20), any_of(20)) for k in range(count - len(PLANTED_PAIRS))]


def _between(five: str, three: str) -> str:
    return f"instr(seq, '{three}') - instr(seq, '{five}') - {len(five)}"


@register("demultiplex_pairs", query("SELECT sample_id, pair, length::INT AS length, edits, count(*) AS n FROM (SELECT sample_id, 0 AS edits, " + f"CASE WHEN instr(seq, '{PLANTED_PAIRS[1][1]}') > 0 THEN 'variants' ELSE 'plain' END AS pair, CASE WHEN instr(seq, '{PLANTED_PAIRS[1][1]}') > 0 THEN {_between(*PLANTED_PAIRS[1][1:])} ELSE {_between(*PLANTED_PAIRS[0][1:])} END AS length FROM reads) GROUP BY ALL", READS))
def many_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty pairs of adapters at a tenth of errors."""
    parts = demultiplex_pairs(synth_reads(spark, sf), adapter_pairs())
    return parts.groupBy("sample_id", "pair", F.length("part").alias("length"), "edits").agg(F.count(F.lit(1)).alias("n"))
