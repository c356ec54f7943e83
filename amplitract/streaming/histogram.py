"""Histograms of reads that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from amplitract.operators.histogram import histogram
from amplitract.operators.tracts import assign_contigs, scan_tracts, with_structure

STATE = "spark.sql.streaming.stateStore."
#: State on the executors' disks, with bounded memory for all its partitions; rows aren't looked up once more to be counted.
ON_DISK = {
    f"{STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}rocksdb.boundedMemoryUsage": "true",
    f"{STATE}rocksdb.trackTotalNumberOfRows": "false",
    f"{STATE}rocksdb.changelogCheckpointing.enabled": "true",
}
READ = "sample_id int, read_id long, mate string, mapq int, seq string, quality int"


def arriving_reads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the read tables that are put into a folder."""
    return spark.readStream.schema(READ).parquet(path)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started meanwhile keep their state on disk: ids of all reads that may come again don't fit into memory.
    A stream has its own copy of the session's settings from its start on."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    try:
        for k, v in ON_DISK.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def add_batches(reads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Scans each batch and adds its histogram to the table at out. A batch that is run again replaces its own part."""
    def add(batch: DataFrame, number: int) -> None:
        found = histogram(assign_contigs(scan_tracts(batch)))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state_on_disk(reads.sparkSession):
        return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("sample_id", "mate", "ccg", "cag").agg(F.sum("n").alias("n"))


def once(reads: DataFrame, delay: str = "1 hour", key: tuple[str, ...] = ("sample_id", "mate", "read_id")) -> DataFrame:
    """A stream of reads with their time of arrival (ts), without those that are sent again (the same key). A key is remembered until the watermark, `delay` behind the latest time, has passed it. Each batch goes through
    all keys that are remembered, so a batch should be a good part of what arrives within the delay."""
    return reads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key))


def counted(reads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The running histogram (sample_id, mate, ccg, cag, n) of a stream of reads; a read that is sent again counts once. Use it
    with outputMode("update"): each batch tells the bins that changed. A stream can't group twice, so each read is scanned;
    add_batches(once(reads)) scans each distinct sequence of a batch."""
    found = assign_contigs(with_structure(once(reads, delay).where("mapq >= 1"), ["sample_id", "mate"])).where("contig_cag IS NOT NULL")
    return found.groupBy("sample_id", "mate", F.col("contig_ccg").alias("ccg"), F.col("contig_cag").alias("cag")).agg(F.count(F.lit(1)).alias("n"))


def keep_counts(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the bins that change with each batch to the table at out. A batch that is run again replaces its own part."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state_on_disk(counts.sparkSession):
        return counts.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The histogram as the last batch that changed each bin has it."""
    return spark.read.parquet(out).groupBy("sample_id", "mate", "ccg", "cag").agg(F.max_by("n", "batch").alias("n"))
