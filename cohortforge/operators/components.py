"""Connected components of an edge table in Spark: alternating large-star and small-star steps until nothing changes.

The number of rounds grows with the logarithm of the longest path; edges are checkpointed in the shared folder after every
round, and nothing but a count reaches the driver. Each round keeps at most one edge per (node, neighbour).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b; long) -> (node, component): for every node on an edge, the smallest node it can reach.

    Null ends are not allowed; loops and repeated edges do not matter; an empty edge table gives an empty result.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(e):
        # large star: the node's larger neighbours go to the smallest of the node and its neighbours
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small star: the node and its smaller neighbours go to the smallest of them
        large = cut_lineage(large)
        least = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        e = cut_lineage(large.join(least, "a").select("b", "m").where("b <> m")
                        .select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _is_stars(e: DataFrame) -> bool:
    """Whether every larger end has one edge and no smaller end is also a larger one: then each component is one star."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select(F.col("b"), F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return ends.where("up > 1 or (up > 0 and down > 0)").isEmpty()
