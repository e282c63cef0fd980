"""From tables of tagged ways, nodes and relations to a graph for one vehicle profile.

ways(id, node_ids, tags), nodes(id, lat, lon, tags), relations(id, members(type, ref, role), tags); member types: 0 node, 1 way.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CAR, SIGNAL_DELAY_S, VehicleProfile
from ..core import materialize
from ..functions import tags as T
from ..functions.geo import haversine_m
from ..model import GeoGraph, RoadGraph
from ..operators.build import build
from ..operators.compress import compress
from ..operators.numbering import numbered
from ..operators.split import split

NODE, WAY = 0, 1


class GraphSource(Protocol):
    """Anything that delivers a graph."""

    def load_graph(self) -> GeoGraph: ...


def kept_ways(ways: DataFrame, profile: VehicleProfile) -> DataFrame:
    """Ways the profile uses, with what their tags say: ``id, node_ids, highway, kmh, dir, tolls, access_only``."""
    t = F.col("tags")
    return ways.filter(T.routable(t, F.col("node_ids"), profile)).select(
        "id", "node_ids", T.tag(t, "highway").alias("highway"), T.speed_kmh(t, profile).alias("kmh"), T.oneway(t, profile).alias("dir"), T.tolls(t).alias("tolls"), (T.way_access(t, profile) == T.ACCESS_ONLY).alias("access_only")
    )


def severed(ways: DataFrame, nodes: DataFrame, profile: VehicleProfile, read_barriers: bool = True) -> tuple[DataFrame, DataFrame]:
    """Steps of the ways, ``way, pos, a, b``, and the twins ``id, lat, lon``. Where a node blocks, the way behind it starts
    at a twin: a node of its own with a negative id at the same place."""
    at = ways.select(F.col("id").alias("way"), "highway", F.posexplode("node_ids").alias("pos", "node"))
    stops = nodes.filter(T.tag(F.col("tags"), "barrier").isNotNull()).select(F.col("id").alias("node"), "tags", "lat", "lon")
    blocked = at.join(stops, "node").filter(~T.barrier_passes(F.col("tags"), profile, F.col("highway"))) if read_barriers else at.join(stops, "node").limit(0)
    twins = materialize(numbered(blocked.select("way", "pos", "lat", "lon"), "n", "way", "pos", start=1).withColumn("twin", -F.col("n")))
    steps = ways.select(F.col("id").alias("way"), "node_ids", F.explode(F.sequence(F.lit(0), F.size("node_ids") - 2)).alias("pos"))
    steps = steps.select("way", "pos", F.get("node_ids", F.col("pos")).alias("a"), F.get("node_ids", F.col("pos") + 1).alias("b"))
    steps = steps.join(twins.select("way", "pos", "twin"), ["way", "pos"], "left").select("way", "pos", F.coalesce("twin", "a").alias("a"), "b")
    return steps, twins.select(F.col("twin").alias("id"), "lat", "lon")


def _across(role: str, members: DataFrame, ways: DataFrame) -> DataFrame:
    """``rel, <role>_id, <role>_is``: the node next to ``via`` on the first member way that has it; else unresolved or ambiguous."""
    m = members.filter((F.col("role") == role) & (F.col("type") == WAY)).join(ways.select(F.col("id").alias("ref"), "node_ids"), "ref").filter(F.array_contains("node_ids", F.col("via")))
    first = m.groupBy("rel", "via").agg(F.min(F.struct("pos", "node_ids"))["node_ids"].alias("ids"))
    at, n = F.array_position("ids", F.col("via")).cast("int"), F.size("ids")
    twice = F.size(F.filter("ids", lambda x: x == F.col("via"))) > 1
    state = F.when(twice | ((at > 1) & (at < n)), "ambiguous").when(n < 2, "unresolved").otherwise("ok")
    return first.select("rel", F.when(state == "ok", F.when(at == 1, F.get("ids", F.lit(1))).otherwise(F.get("ids", at - 2))).alias(f"{role}_id"), state.alias(f"{role}_is"))


def resolved(relations: DataFrame, ways: DataFrame, nodes: DataFrame, profile: VehicleProfile) -> tuple[DataFrame, DataFrame]:
    """Restrictions, and one row of counts: accepted (restrictions), skipped_via_way, unresolved, ambiguous, excepted, conditions."""
    t = F.col("tags")
    r = relations.filter(T.tag(t, "type").startswith("restriction")).select(
        F.col("id").alias("rel"), "members", T.excepted(T.tag(t, "except"), profile).alias("excepted"),
        T.ban_kind(T.tag(t, "restriction")).alias("kind"), T.ban_kind(T.tag(t, "restriction:conditional")).alias("timed"), T.tag(t, "restriction:conditional").alias("condition"),
        F.filter("members", lambda m: m["role"] == "via").alias("vias"),
    )
    r = r.withColumn("via", F.when((F.size("vias") == 1) & (F.get("vias", F.lit(0))["type"] == NODE), F.get("vias", F.lit(0))["ref"]))
    r = materialize(r.join(nodes.select(F.col("id").alias("via"), F.lit(True).alias("placed")).distinct(), "via", "left"))
    members = r.select("rel", "via", F.posexplode("members").alias("pos", "m")).select("rel", "via", "pos", "m.type", "m.ref", "m.role")
    for role in ("from", "to"):
        r = r.join(_across(role, members, ways), "rel", "left")
    states = F.array(F.coalesce("from_is", F.lit("unresolved")), F.coalesce("to_is", F.lit("unresolved")))
    outcome = (
        F.when(F.col("excepted"), "excepted").when(F.col("kind").isNull() & F.col("timed").isNull(), "unresolved").when(F.exists("vias", lambda v: v["type"] == WAY), "skipped_via_way")
        .when(F.col("placed").isNull() | F.array_contains(states, "unresolved"), "unresolved").when(F.array_contains(states, "ambiguous"), "ambiguous").otherwise("ok")
    )
    r = materialize(r.withColumn("outcome", outcome))
    sign = lambda kind, cond: F.struct((F.col(kind) == "only").alias("is_only"), cond.alias("condition"), F.col(kind).isNotNull().alias("there"))
    signs = F.array(sign("kind", F.lit(None).cast("string")), sign("timed", F.col("condition")))
    out = r.filter("outcome = 'ok'").select("from_id", F.col("via").alias("via_id"), "to_id", F.explode(F.filter(signs, lambda s: s["there"])).alias("s")).select("from_id", "via_id", "to_id", "s.is_only", "s.condition")
    kinds = r.agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in ("skipped_via_way", "unresolved", "ambiguous", "excepted")))
    stats = out.agg(F.count("*").alias("accepted"), F.count_distinct("condition").alias("conditions")).crossJoin(kinds)  # one row each
    return out, stats


def to_geo_graph(ways: DataFrame, nodes: DataFrame, relations: DataFrame | None = None, profile: VehicleProfile = CAR, read_signals: bool = True, read_barriers: bool = True, read_turn_restrictions: bool = True) -> tuple[GeoGraph, DataFrame | None]:
    """The graph, and the counts of restrictions read (None without relations). Steps without both coordinates, or of no
    length, are left out."""
    ways = materialize(kept_ways(ways, profile))
    used = ways.select(F.explode("node_ids").alias("id")).distinct()
    nodes = materialize(nodes.join(used, "id", "left_semi"))
    steps, twins = severed(ways, nodes, profile, read_barriers)
    place = nodes.select("id", "lat", "lon").unionByName(twins)
    end = lambda c: place.select(F.col("id").alias(c), F.col("lat").alias(f"lat_{c}"), F.col("lon").alias(f"lon_{c}"))
    dist = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    run = steps.join(end("a"), "a").join(end("b"), "b").withColumn("distance_m", dist).filter("distance_m > 0").join(ways.drop("node_ids").withColumnRenamed("id", "way"), "way")
    back = F.col("dir") < 0
    turned = lambda x, y: F.when(back, F.col(y)).otherwise(F.col(x))
    edges = run.select(turned("a", "b").alias("source_id"), turned("b", "a").alias("target_id"), "distance_m", F.col("kmh").alias("speed_kmh"), (F.col("dir") != 0).alias("one_way"), "tolls", "access_only", F.array().cast("array<long>").alias("shape"))
    signals = nodes.filter(T.is_signal(F.col("tags")) & F.lit(read_signals)).select("id")
    empty = nodes.sparkSession.createDataFrame([], "from_id long, via_id long, to_id long, is_only boolean, condition string")
    found, stats = resolved(relations, ways, nodes, profile) if relations is not None and read_turn_restrictions else (empty, None)
    return GeoGraph(place, materialize(edges), signals, found), stats


def compile_graph(graph: GeoGraph, compressed: bool = True, signal_delay_s: float = SIGNAL_DELAY_S) -> RoadGraph:
    """Build, split, compress, in the order that matters."""
    return compile_with_counts(graph, None, compressed, signal_delay_s)[0]


def compile_with_counts(graph: GeoGraph, read: DataFrame | None = None, compressed: bool = True, signal_delay_s: float = SIGNAL_DELAY_S) -> tuple[RoadGraph, DataFrame]:
    """The compiled graph, and one row of what became of its restrictions: the counts from reading them (``read``, as
    ``to_geo_graph`` gives them), from splitting, and of vertices and edges before and after compression."""
    road, counts = split(build(graph, signal_delay_s), graph.restrictions)
    if read is not None:
        counts = read.crossJoin(counts)  # one row each
    if not compressed:
        return road, counts
    road, reduced = compress(road)
    return road, counts.crossJoin(reduced)  # one row each
