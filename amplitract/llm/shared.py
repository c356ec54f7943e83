"""What several corpus operators share: tables in the cluster's shared folder, white space, safe column picking."""

from __future__ import annotations

import ctypes
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line contracts: space, and tab to carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without one may use /tmp, but only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote; nothing that still has to run may read them. Other tables are left alone."""
    for df in tables:
        if path := _paths.pop(df, None):
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives memory that it no longer uses back to the machine when its task ends: Python workers live on."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return freed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def content_key(*cols: Column) -> list[Column]:
    """Two columns that identify a row's content; a 64-bit hash alone would collide at 10**10 rows."""
    return [F.xxhash64(*cols).alias("key_a"), F.xxhash64(F.lit("amplitract"), *cols).alias("key_b")]


def others(df: DataFrame, *new: str) -> list[Column]:
    """The columns of df besides those that a result of these names replaces (as withColumn would)."""
    taken = {n.lower() for n in new}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, stem: str) -> str:
    """A name for a helper column that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
