"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v), and the least node m among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or none and only edges from larger ones: then nothing changes any more."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e"))
    return ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.root").alias("root")).where("up > 1 OR (up = 1 AND root = 1)").isEmpty()


def components(links: DataFrame, a: str, b: str, files: int = 16) -> DataFrame:
    """(node, root): the least node of the component, for each node of the links. Each node has an edge to its root when no step changes anything.

    Both steps are a partial aggregation and an equality join, so that the many edges of one node are split by the
    adaptive skew join; every round is checkpointed. The number of rounds grows with the logarithm of the longest path. files: into how
    many files each round is written; it follows the number of nodes.
    """
    edges = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().coalesce(files))
    while not _are_stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _least(large)  # every edge leads to a smaller node already
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = checkpointed(small.coalesce(files))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
