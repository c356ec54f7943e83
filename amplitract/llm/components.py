"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node, written to the shared folder so that lineage stays short. A step
only ever points nodes at smaller ones; it ends when nothing changes, when each node points at its component's least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has a link and isn't itself the least of its component."""
    ends = links.where(F.col(a) != F.col(b))
    edges = materialize(ends.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct(), "links")
    known = _sum(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = materialize(both.where("root > node").join(least.hint("merge"), "node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct(), "large-star")
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least.hint("merge"), "node").where("root > m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        known_edges, edges = edges, materialize(small.unionByName(least.select("node", F.col("m").alias("root"))).distinct(), "small-star")
        discard(known_edges, large)
        now = _sum(edges)
        if now == known:
            break
        known = now
    return edges
