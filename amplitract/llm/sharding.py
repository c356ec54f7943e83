"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: slot ``(offset + j * skip) mod size`` for
j = 0, 1, ..., with offset and skip taken from the MD5 of the shard's name. Shards take turns, and each claims the
first free slot of its order until the table is full. A row goes to the slot of its key's hash and so to the shard
that holds the slot; every shard holds as many slots as any other, give or take one, and a changed list of shards
moves few rows besides those of the shard that came or went.

The table has ``size`` rows of two integers, whatever the corpus holds: that bounds what is broadcast (1 MB for 65,537
slots), and a placement is one hash and one probe. No row moves until it is written.

Defined cases: a null key is placed by the rest of the row (the whole row's content), so that null keys don't meet in
one shard; equal keys share a shard; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import others, table

#: A prime; at least a hundred slots for each shard keep shards within a hundredth of each other.
TABLE_SIZE = 65_537


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that holds each slot."""
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names, one at least and no more than slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the size of the table must be prime")
    digest = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digest]
    owner, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            owner[at[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The key's slot: the first 48 bits of the MD5 of its text, modulo the size."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("long") % size


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with slot (long) and shard (string); columns of these names are replaced."""
    spark = df.sparkSession
    owner = spark.createDataFrame([(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, size))], "slot long, shard string")
    rest = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c, kind in df.dtypes if c != key and not kind.startswith(("array", "map", "struct", "binary", "variant"))])
    placed = df.select(*others(df, "slot", "shard"), slot_of(F.coalesce(df[key].cast("string"), rest), size).alias("slot"))
    return placed.join(F.broadcast(owner), "slot", "left").select(*[placed[f"`{c}`"] for c in placed.columns], owner["shard"])


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, parts_per_shard: int = 1, size: int = TABLE_SIZE) -> None:
    """One folder for each shard under path; rows of a shard are dealt by their slots to parts_per_shard files."""
    placed = assign_shards(df, key, shards, size)
    placed = placed.repartition(len(shards) * parts_per_shard, "shard", F.col("slot") % parts_per_shard)
    placed.drop("slot").write.partitionBy("shard").parquet(path)


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard", F.length("text").cast("long").alias("n_chars"))


def op4_sql() -> str:
    """The placement in SQL. The table comes from a second, plainer filling, in which each shard walks a listed order."""
    orders = []
    for name in SHARDS:
        h = hashlib.md5(name.encode()).hexdigest()
        first, step = int(h[:16], 16) % TABLE_SIZE, int(h[16:], 16) % (TABLE_SIZE - 1) + 1
        orders.append(iter([(first + j * step) % TABLE_SIZE for j in range(TABLE_SIZE)]))
    owner: dict[int, str] = {}
    turn = 0
    while len(owner) < TABLE_SIZE:
        slot = next(s for s in orders[turn % len(SHARDS)] if s not in owner)
        owner[slot] = SHARDS[turn % len(SHARDS)]
        turn += 1
    index = ",".join(owner[s][-3:].lstrip("0") or "0" for s in range(TABLE_SIZE))
    return f"""
WITH t AS (SELECT [{index}] AS owner),
d AS (SELECT doc_id, length(text)::BIGINT AS n_chars,
             ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1]::VARCHAR, 3, '0') AS shard, n_chars FROM d, t
"""
