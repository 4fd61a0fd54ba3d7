"""Connected components by alternating large-star and small-star steps over an edge table.

Edges never reach the driver. Every step is an aggregation with map-side combine and an equality join, whose
skewed keys adaptive execution splits; its result is written to the shared folder, and the one before it deleted. A graph's smallest node names
its component. Self-loops and repeated or reversed edges do no harm; an empty edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """edges(a, b) -> (node, component) for every node that has an edge; component is the smallest node reached."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was, is_ = None, mark(now)
    while is_ != was and is_[0]:
        was, old = is_, now
        now = materialize(_small_star(_large_star(now)), tag)
        is_ = mark(now)
        discard(old)
    # Now every edge leads from a node to its component's smallest.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
