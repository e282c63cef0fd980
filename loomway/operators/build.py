"""From a source's graph to directed edges with travel times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SIGNAL_DELAY_S
from ..core import materialize
from ..functions.geo import travel_time_s
from ..model import POINTS, GeoGraph, RoadGraph
from .numbering import numbered


def shape_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``_e, geom`` of the edges that have interior points; points without a node are left out."""
    points = edges.filter(F.size("shape") > 0).select("_e", F.posexplode("shape").alias("pos", "id")).join(nodes, "id")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "lat", "lon")))
    return points.groupBy("_e").agg(F.transform(ordered, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("geom"))


def build(graph: GeoGraph, signal_delay_s: float = SIGNAL_DELAY_S) -> RoadGraph:
    """Vertices are the ends of edges; an edge whose end is no node is dropped. A two-way edge becomes two. The
    direction that arrives at a signal is charged its delay. Order: source, target, distance, then input order.

    A node id given twice counts once, with the larger coordinates. Speeds of 0 or less give edges of infinite time."""
    nodes = graph.nodes.groupBy("id").agg(F.max(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon")
    given = materialize(graph.edges.select("*", F.monotonically_increasing_id().alias("_e")))
    ends = given.select(F.col("source_id").alias("id")).unionByName(given.select(F.col("target_id").alias("id"))).distinct()
    vertices = materialize(numbered(nodes.join(ends, "id", "left_semi"), "v", "id").select("v", F.col("id").alias("original_id"), "lat", "lon", F.lit(None).cast("long").alias("split_parent")))
    lights = vertices.join(graph.signals.select(F.col("id").alias("original_id")).distinct().withColumn("lit", F.lit(1)), "original_id", "left").select("original_id", "v", F.coalesce("lit", F.lit(0)).alias("lit"))
    end = lambda c, v, lit: lights.select(F.col("original_id").alias(c), F.col("v").alias(v), F.col("lit").alias(lit))
    both = given.join(end("source_id", "a", "lit_a"), "source_id").join(end("target_id", "b", "lit_b"), "target_id").join(shape_points(given, nodes), "_e", "left")
    both = both.withColumn("geom", F.coalesce("geom", F.array().cast(POINTS))).withColumn("run_s", travel_time_s(F.col("distance_m"), F.col("speed_kmh")))

    def way(src: str, dst: str, lit: str, geom, back: int) -> DataFrame:
        return both.select(
            F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("run_s") + F.col(lit) * signal_delay_s).alias("time_s"), F.col("distance_m").alias("dist_m"), "tolls",
            F.col(lit).alias("signals"), "access_only", F.lit(None).cast("string").alias("condition"), geom.alias("geom"), "_e", F.lit(back).alias("_back"), "one_way",
        )

    directed = way("a", "b", "lit_b", F.col("geom"), 0).unionByName(way("b", "a", "lit_a", F.reverse("geom"), 1).filter("not one_way")).drop("one_way")
    edges = numbered(directed, "edge_id", "src", "dst", "dist_m", "_e", "_back").drop("_e", "_back")
    return RoadGraph(vertices, materialize(edges.select("edge_id", *[c for c in edges.columns if c != "edge_id"])))
