"""Turn restrictions compiled into the graph: a junction gets a copy for every restricted approach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialize
from ..model import RoadGraph
from .numbering import numbered


def located(graph: RoadGraph, restrictions: DataFrame) -> DataFrame:
    """Restrictions with their vertices and the approach edge, the shortest from ``from`` to ``via``; nulls where there is none."""
    v = graph.vertices.filter("split_parent is null").select("original_id", "v")
    r = numbered(restrictions, "rid", "via_id", "from_id", "to_id", "is_only", "condition")
    for end in ("from", "via", "to"):
        r = r.join(v.select(F.col("original_id").alias(f"{end}_id"), F.col("v").alias(end)), f"{end}_id", "left")
    approach = graph.edges.groupBy(F.col("src").alias("from"), F.col("dst").alias("via")).agg(F.min(F.struct("dist_m", "edge_id"))["edge_id"].alias("approach"))
    return materialize(r.join(approach, ["from", "via"], "left"))


def judged(graph: RoadGraph, found: DataFrame) -> DataFrame:
    """Every exit of every restricted approach: ``via, approach, exit, dst, banned, cond``. A restriction that names no
    exit says nothing; the first condition of an exit is the one kept."""
    exits = graph.edges.select(F.col("src").alias("via"), F.col("edge_id").alias("exit"), "dst")
    r = found.filter("approach is not null and to is not null")
    named = r.join(exits.select("via", F.col("dst").alias("to")).distinct(), ["via", "to"], "left_semi")
    pairs = named.select("rid", "via", "approach", "to", "is_only", "condition").join(exits, "via")
    hits = F.when(F.col("is_only"), F.col("dst") != F.col("to")).otherwise(F.col("dst") == F.col("to"))
    rule = pairs.groupBy("via", "approach", "exit", "dst").agg(
        F.max(hits & F.col("condition").isNull()).alias("banned"),
        F.min(F.when(hits & F.col("condition").isNotNull(), F.struct("rid", "condition")))["condition"].alias("cond"),
    )
    return rule


def split(graph: RoadGraph, restrictions: DataFrame) -> tuple[RoadGraph, DataFrame]:
    """The graph with copies, and one row ``applied, unresolved, contradictory, inert, copies``; all but the last count restrictions.

    An approach left without an exit is contradictory and nothing of it holds; one that loses and times nothing is inert."""
    found = located(graph, restrictions)
    rule = materialize(judged(graph, found))
    per = rule.groupBy("via", "approach").agg(F.count_if(~F.col("banned")).alias("open"), F.count_if(F.col("banned") | F.col("cond").isNotNull()).alias("changed"))
    kind = F.when(F.col("approach").isNull() | F.col("to").isNull(), "unresolved").when(F.col("open") == 0, "contradictory").when(F.coalesce("changed", F.lit(0)) == 0, "inert").otherwise("applied")
    told = found.join(per, ["via", "approach"], "left").select(kind.alias("kind"))
    first = graph.vertices.agg(F.coalesce(F.max("v"), F.lit(-1))).first()[0] + 1
    copies = materialize(numbered(per.filter("open > 0 and changed > 0").select("via", "approach"), "copy", "via", "approach", start=first))
    stats = told.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("applied", "unresolved", "contradictory", "inert"))).crossJoin(copies.agg(F.count("*").alias("copies")))  # one row each
    parents = graph.vertices.select(F.col("v").alias("via"), "original_id", "lat", "lon")
    vertices = graph.vertices.unionByName(copies.join(parents, "via").select(F.col("copy").alias("v"), "original_id", "lat", "lon", F.col("via").alias("split_parent")))
    # exits of the copies; they too may be approaches of restrictions at the next junction
    own = rule.filter("not banned").join(copies, ["via", "approach"]).select(F.col("exit").alias("edge_id"), "copy", "cond")
    more = graph.edges.join(own, "edge_id").withColumn("src", F.col("copy")).withColumn("condition", F.coalesce("condition", "cond")).drop("copy", "cond")
    moved = copies.select(F.col("approach").alias("edge_id"), F.col("copy"))
    edges = graph.edges.unionByName(more).join(moved, "edge_id", "left").withColumn("dst", F.coalesce("copy", "dst")).drop("copy")
    edges = numbered(edges.withColumnRenamed("edge_id", "_was"), "edge_id", "src", "dst", "dist_m", "_was").select(*graph.edges.columns)
    return RoadGraph(materialize(vertices), materialize(edges)), stats


def orphaned_exits(graph: RoadGraph, restrictions: DataFrame) -> DataFrame:
    """``via, dst``: exits that no approach may take, of junctions all of whose approaches are restricted."""
    rule = judged(graph, located(graph, restrictions)).filter("cond is null or banned")
    rule = materialize(rule)
    some = rule.groupBy("via", "approach").agg(F.count_if(~F.col("banned")).alias("open")).filter("open > 0").drop("open")
    live = rule.join(some, ["via", "approach"], "left_semi")
    full = live.groupBy("via").agg(F.count_distinct("approach").alias("n")).join(graph.edges.groupBy(F.col("dst").alias("via")).agg(F.count("*").alias("ways")), "via").filter("n >= ways").select("via")
    at = live.join(full, "via", "left_semi")
    return at.filter("banned").select("via", "dst").distinct().join(at.filter("not banned").select("via", "dst"), ["via", "dst"], "left_anti").orderBy("via", "dst")
