"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import forget, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour above a node is linked to the least of the node and its neighbours. Small: every
    neighbour below it, and the node itself, are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    out = both.join(least, F.col("u") == F.col("c"))
    if large:
        return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (the least node reachable) for every node of some edge.

    Each round is written to the shared folder, and the one before removed; the number of rounds grows with the logarithm
    of the longest path. Minima are taken before rows are dealt, but the rows of one node meet them in one task.
    Self-loops count as nodes; null ends are dropped; repeated edges are one edge; no edges give no rows.
    """
    edges = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null").distinct())
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    now, before = edges.filter("u <> v"), None
    while True:
        last, now = now, materialize(_star(_star(now, True), False))
        forget(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
