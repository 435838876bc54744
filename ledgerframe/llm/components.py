"""Connected components of an edge table by alternating star contraction, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), where root is the least node of its component.

    Each round points every edge's upper node at the least node next to its lower one (large star; the lower
    nodes' least neighbours are few, written, and joined by both sides' own exchanges, so a hub's edges can be
    split), then every node's lower neighbours at the least of them (small star).  Edges never get more, and
    rounds grow with the logarithm of a path's length.  Rounds are written to the shared folder, so a lost
    executor costs a round at most.  Loops and repeated edges don't matter; an empty table gives an empty result.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    while not _settled(now):
        least = kept(now.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), "m"), name)
        large = now.join(least, now.lo == least.u, "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lower, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = kept(small.unionAll(lower.select("hi", F.col("m").alias("lo"))).distinct(), name)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no lower node has a lower one itself, and no upper node has two."""
    chained = edges.select("lo").distinct().join(edges.select(F.col("hi").alias("h")), F.col("lo") == F.col("h"), "left_semi")
    return chained.isEmpty() and edges.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
