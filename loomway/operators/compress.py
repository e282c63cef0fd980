"""Chains of vertices that offer no choice become single edges, by pointer doubling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialize
from ..model import RoadGraph
from .components import connected_components
from .numbering import numbered


def degrees(edges: DataFrame) -> DataFrame:
    """``v, n_out, n_in, outs, ins``; the last two are the sorted distinct neighbours."""
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n_out"), F.sort_array(F.collect_set("dst")).alias("outs"))
    into = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n_in"), F.sort_array(F.collect_set("src")).alias("ins"))
    return out.join(into, "v", "full").fillna(0, ["n_out", "n_in"])


def pinned(graph: RoadGraph) -> DataFrame:
    """Vertices that must stay: split junctions, their copies, and those with a conditional exit."""
    v = graph.vertices
    return (
        v.filter("split_parent is not null").select(F.explode(F.array("v", "split_parent")).alias("v"))
        .unionByName(graph.edges.filter("condition is not null").select(F.col("src").alias("v"))).distinct()
    )


def kept_components(graph: RoadGraph, min_size: int = 2, largest_only: bool = False) -> DataFrame:
    """``v`` of the weak components that are large enough; a split copy belongs with its junction."""
    ties = graph.vertices.filter("split_parent is not null").select(F.col("v").alias("src"), F.col("split_parent").alias("dst"))
    comp = materialize(connected_components(graph.edges.select("src", "dst").unionByName(ties)))
    size = comp.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    if largest_only:
        size = size.orderBy(F.desc("n"), "component").limit(1)
    return comp.join(size, "component", "left_semi").select(F.col("node").alias("v"))


def contractible(graph: RoadGraph) -> DataFrame:
    """``v`` of the vertices a traveller passes without a choice, in one direction or in both."""
    d = degrees(graph.edges)
    two = (F.col("n_out") == 2) & (F.col("n_in") == 2) & (F.size("outs") == 2) & (F.col("outs") == F.col("ins"))
    one = (F.col("n_out") == 1) & (F.col("n_in") == 1) & (F.get("outs", F.lit(0)) != F.get("ins", F.lit(0)))
    return d.filter((two | one) & ~F.array_contains("outs", F.col("v"))).select("v").join(pinned(graph), "v", "left_anti")


def compress(graph: RoadGraph, min_size: int = 2, largest_only: bool = False) -> tuple[RoadGraph, DataFrame]:
    """The compressed graph, and one row of counts before and after with the share removed (0 if empty).

    Sums run along a chain, access-only if any part is, the condition is the first edge's, passed vertices join the
    geometry. Loops and chains that never reach a vertex with a choice are dropped."""
    kept = kept_components(graph, min_size, largest_only)
    edges = graph.edges.join(kept.withColumnRenamed("v", "src"), "src", "left_semi")
    inner = materialize(contractible(RoadGraph(graph.vertices, edges)).withColumn("inner", F.lit(True)))
    ends = edges.join(inner.select(F.col("v").alias("src"), F.col("inner").alias("from_inner")), "src", "left")
    ends = materialize(ends.join(inner.select(F.col("v").alias("dst"), F.col("inner").alias("to_inner")), "dst", "left"))
    place = graph.vertices.select(F.col("v").alias("dst"), F.struct("lat", "lon").alias("passed"))
    nxt = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("edge_id").alias("next"))
    steps = ends.filter("to_inner").join(nxt, (F.col("dst") == F.col("at")) & (F.col("to") != F.col("src"))).select("edge_id", "next").join(ends.select("edge_id", "dst"), "edge_id").join(place, "dst").select("edge_id", "next", "passed")
    walk = materialize(ends.drop("to_inner").join(steps, "edge_id", "left"))
    for _ in range(math.ceil(math.log2(max(2, edges.count()))) + 1):
        if not walk.filter("next is not null").take(1):
            break
        tail = walk.select(F.col("edge_id").alias("_id"), *(F.col(c).alias(f"t_{c}") for c in ("dst", "time_s", "dist_m", "tolls", "signals", "access_only", "geom", "next", "passed")))
        j = walk.join(tail, F.col("next") == F.col("_id"), "left")
        on = F.col("_id").isNotNull()
        add = lambda c: (F.col(c) + F.when(on, F.col(f"t_{c}")).otherwise(0)).alias(c)
        pick = lambda c: F.when(on, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c)
        walk = materialize(j.select(
            "edge_id", "src", pick("dst"), add("time_s"), add("dist_m"), add("tolls"), add("signals"), F.when(on, F.col("access_only") | F.col("t_access_only")).otherwise(F.col("access_only")).alias("access_only"),
            "condition", F.when(on, F.concat("geom", F.array("passed"), "t_geom")).otherwise(F.col("geom")).alias("geom"), "from_inner", pick("next"), pick("passed"),
        ))
    merged = walk.filter("from_inner is null and next is null and src <> dst")
    alive = merged.select(F.col("src").alias("v")).unionByName(merged.select(F.col("dst").alias("v"))).distinct()
    # what a copy stands for stays known even where the junction itself has no edge left
    alive = alive.unionByName(graph.vertices.join(alive, "v", "left_semi").filter("split_parent is not null").select(F.col("split_parent").alias("v"))).distinct()
    vertices = materialize(numbered(graph.vertices.join(alive, "v", "left_semi").withColumnRenamed("v", "_was"), "v", "original_id", "_was"))
    new = vertices.select(F.col("_was"), "v")
    named = lambda df, c: df.withColumnRenamed(c, "_was").join(new.withColumnRenamed("v", c), "_was").drop("_was")
    out = named(named(merged.drop("edge_id", "from_inner", "next", "passed"), "src"), "dst")
    out = numbered(out, "edge_id", "src", "dst", "dist_m", "time_s", "condition", "access_only", F.size("geom"))
    parents = new.select(F.col("_was").alias("split_parent"), F.col("v").alias("parent"))
    vertices = vertices.drop("_was").join(parents, "split_parent", "left").select("v", "original_id", "lat", "lon", F.col("parent").alias("split_parent"))
    result = RoadGraph(materialize(vertices), materialize(out.select(*graph.edges.columns)))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    stats = n(graph.vertices, "vertices_before").crossJoin(n(result.vertices, "vertices_after")).crossJoin(n(graph.edges, "edges_before")).crossJoin(n(result.edges, "edges_after"))  # one row each
    share = lambda k: F.when(F.col(f"{k}_before") > 0, 1 - F.col(f"{k}_after") / F.col(f"{k}_before")).otherwise(0.0)
    return result, stats.withColumns({"vertex_reduction": share("vertices"), "edge_reduction": share("edges")})
