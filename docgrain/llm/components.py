"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, low): the smallest id among each node and its neighbours; combined map-side."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest id next to that node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.join(_lowest(both), "u").filter("v > u")
    return hung.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges point downwards."""
    low = _lowest(edges)
    near = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = low.select("u", F.col("low").alias("v"))
    return near.union(own).filter("u > v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node id that can be reached, for each node with an edge.

    ``edges`` has two long columns ``a`` and ``b``; self loops, repeats and either direction are
    allowed, rows with a null are left out. The two star steps alternate until nothing changes;
    their number grows with the logarithm of the longest chain. Each round is written to the shared folder, so a
    lost executor costs one round at most and plans stay short. A node with very many edges is
    the skewed side of a join whose other side has one row per node, which AQE splits.
    """
    e = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = stage(e.distinct(), "edges")
    seen = None
    while True:
        e = stage(_small_star(_large_star(e)).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
