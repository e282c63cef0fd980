"""Routes for batches of queries: snap, aliases, access zones, search, alternatives, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALTERNATIVE_PENALTY
from ..core import materialize
from ..model import POINTS, RoadGraph
from ..operators.held import hold, search_held
from ..operators.hierarchy import contract, meet, unpacked
from ..operators.search import access_zones, aliases, reached, search, totals
from ..operators.spatial import nearest

QUERIES = (
    "query_id long, start_lat double, start_lon double, end_lat double, end_lon double, at timestamp_ntz, avoid_tolls boolean, "
    "max_routes int, max_extra_ratio double, max_extra_m double, max_sharing double"
)
DEFAULTS = {"at": None, "avoid_tolls": False, "max_routes": 1, "max_extra_ratio": 0.3, "max_extra_m": None, "max_sharing": 0.8}
ROUTES = f"query_id long, rank int, found boolean, distance_m double, duration_us long, toll_count int, signal_count int, geometry {POINTS}"


def query_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple((DEFAULTS | r)[f.split()[0]] for f in QUERIES.split(", ")) for r in rows], QUERIES)


@dataclass
class Router:
    """``strategy``: ``held`` (every task holds the graph and answers whole queries with A*), ``frontier`` (rounds of joins)
    or ``hierarchy``; all give the same routes. By default graphs are held if they are small enough. What the hierarchy
    leaves out (clocked, toll-avoiding and alternative searches, and those whose ends lie in private areas) is searched
    as by default."""

    graph: RoadGraph
    strategy: str | None = None
    max_snap_m: float | None = None

    def __post_init__(self):
        self._held = hold(self.graph.edges, self.graph.vertices) if self.strategy != "frontier" else None
        if self.strategy == "held" and self._held is None:
            raise ValueError("the graph has too many edges to be held by every task")
        self._hierarchy = contract(self.graph.edges) if self.strategy == "hierarchy" else None
        self._aliases = materialize(aliases(self.graph.vertices))

    def snapped(self, queries: DataFrame) -> DataFrame:
        at = lambda end: nearest(queries, self.graph.vertices, "query_id", f"{end}_lat", f"{end}_lon", self.max_snap_m)
        ends = at("start").select(F.col("key").alias("query_id"), F.col("v").alias("src")).join(at("end").select(F.col("key").alias("query_id"), F.col("v").alias("dst")), "query_id")
        return materialize(queries.join(ends, "query_id"))

    def _paths(self, q: DataFrame, factors: DataFrame | None = None) -> DataFrame:
        """Best path of each query ``query_id, src, dst, at, avoid_tolls``."""
        e = self.graph.edges
        sources = q.select("query_id", F.col("src").alias("v"))
        also = lambda end: q.select("query_id", F.col(end).alias("v")).join(self._aliases, "v").select("query_id", F.col("alias").alias("v"))
        targets, out = materialize(also("dst")), []
        zones = None
        if e.filter("access_only").take(1):
            zones = materialize(access_zones(e, also("src"), targets))
        avoid = q.filter("avoid_tolls").select("query_id")
        avoid = materialize(avoid) if avoid.take(1) else None
        clocked = e.filter("condition is not null").take(1) and q.filter("at is not null").take(1)
        parts = [(q.filter("at is null"), None), (q.filter("at is not null"), q.select("query_id", "at"))] if clocked else [(q, None)]
        for part, clocks in parts:
            plain = part
            if self._hierarchy is not None and clocks is None and factors is None:
                busy = part.filter("avoid_tolls").select("query_id")
                if zones is not None:
                    busy = busy.unionByName(zones.select("query_id")).distinct()
                fast = part.join(busy, "query_id", "left_anti")
                keep = lambda df: df.join(fast.select("query_id"), "query_id", "left_semi")  # noqa: B023, E731
                lines = unpacked(self._hierarchy, materialize(meet(self._hierarchy, keep(sources), keep(targets))))
                dist = lines.select("query_id", "target", F.explode("path").alias("edge_id")).join(e.select("edge_id", "dist_m"), "edge_id").groupBy("query_id", "target").agg(F.sum("dist_m").alias("dist_m"))
                out.append(lines.join(dist, ["query_id", "target"], "left").groupBy("query_id").agg(F.min(F.struct(F.col("time_s").alias("cost"), "time_s", F.col("target").alias("v"), F.coalesce("dist_m", F.lit(0.0)).alias("dist_m"), "path")).alias("b")).select("query_id", "b.*"))
                plain = part.join(busy, "query_id", "left_semi")
            mine = lambda df, p=plain: df.join(p.select("query_id"), "query_id", "left_semi")
            if self._held is not None:
                labels = search_held(self._held, mine(sources), mine(targets), zones, avoid, factors, clocks)
            else:
                labels = search(e, mine(sources), mine(targets), zones, avoid, factors, clocks)
            out.append(reached(labels, mine(targets)))
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
        return materialize(found)

    def _alternatives(self, q: DataFrame, best: DataFrame) -> DataFrame:
        """``query_id, rank, path``; more routes by making the edges of those found dearer, until too long or too many tries."""
        caps = best.filter("size(path) > 0").join(q, "query_id").filter("max_routes > 1")
        most = F.col("dist_m") * (1 + F.col("max_extra_ratio"))
        caps = caps.withColumn("most", F.least(most, F.coalesce(F.col("dist_m") + F.col("max_extra_m"), most)))
        live = materialize(caps.select("query_id", "src", "dst", "at", "avoid_tolls", "max_routes", "max_sharing", "most", F.col("path").alias("used"), F.lit(1).alias("have")))
        times = materialize(live.select("query_id", F.explode("used").alias("edge_id")).groupBy("query_id", "edge_id").agg(F.count("*").alias("n")))
        lengths, taken, tries = self.graph.edges.select("edge_id", F.col("dist_m").alias("m")), [], 0
        top = live.agg(F.max("max_routes")).first()[0]
        while top and tries < 8 * top + 8:
            now = live.filter((F.col("have") < F.col("max_routes")) & (F.lit(tries) < F.col("max_routes") * 8 + 8))
            if not now.take(1):
                break
            tries += 1
            cand = self._paths(now, times.select("query_id", "edge_id", F.pow(F.lit(ALTERNATIVE_PENALTY), F.col("n")).alias("factor")))
            got = cand.select("query_id", "dist_m", "path").join(now, "query_id").filter("dist_m <= most")
            share = got.select("query_id", "used", F.explode("path").alias("edge_id")).join(lengths, "edge_id").groupBy("query_id").agg(F.sum(F.when(F.array_contains("used", F.col("edge_id")), F.col("m")).otherwise(0.0)).alias("shared"))
            got = materialize(got.join(share, "query_id").withColumn("good", F.when(F.col("dist_m") > 0, F.col("shared") / F.col("dist_m")).otherwise(1.0) <= F.col("max_sharing")))
            taken.append(got.filter("good").select("query_id", "dist_m", "path"))
            times = materialize(times.unionByName(got.select("query_id", F.explode("path").alias("edge_id"), F.lit(1).alias("n"))).groupBy("query_id", "edge_id").agg(F.sum("n").alias("n")))
            new = got.select("query_id", "path", "good")
            live = materialize(live.join(new, "query_id").select(*[c for c in live.columns if c not in ("used", "have")], F.when(F.col("good"), F.array_distinct(F.concat("used", "path"))).otherwise(F.col("used")).alias("used"), (F.col("have") + F.col("good").cast("int")).alias("have")))
        first = best.select("query_id", F.lit(1).alias("rank"), "path")
        if not taken:
            return first
        more = taken[0]
        for t in taken[1:]:
            more = more.unionByName(t)
        per = more.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("dist_m", "path"))).alias("all"))  # at most max_routes
        return first.unionByName(per.select("query_id", F.posexplode("all").alias("i", "x")).select("query_id", (F.col("i") + 2).alias("rank"), "x.path"))

    def find_routes(self, queries: DataFrame) -> DataFrame:
        """``ROUTES``: for each query its best route (rank 1) and alternatives by length; one row with ``found`` false if none.
        Ends at the same vertex give a route of length 0 that stays where it is."""
        q = self.snapped(queries)
        same = q.filter("src = dst").join(self.graph.vertices.select(F.col("v").alias("src"), F.struct("lat", "lon").alias("p")), "src")
        zero = same.select("query_id", F.lit(1).alias("rank"), F.lit(0.0).alias("distance_m"), F.lit(0).cast("long").alias("duration_us"), F.lit(0).alias("toll_count"), F.lit(0).alias("signal_count"), F.array("p", "p").alias("geometry"))
        moving = materialize(q.filter("src <> dst"))
        best = self._paths(moving)
        paths = materialize(self._alternatives(moving, best))
        found = totals(paths, self.graph, "query_id", "rank").unionByName(zero).withColumn("found", F.lit(True))
        none = queries.select("query_id", F.coalesce("max_routes", F.lit(1)).alias("m")).join(found.select("query_id").distinct(), "query_id", "left_anti")
        none = none.select("query_id", F.lit(1).alias("rank"), F.lit(None).cast("double").alias("distance_m"), F.lit(0).cast("long").alias("duration_us"), F.lit(0).alias("toll_count"), F.lit(0).alias("signal_count"), F.array().cast(POINTS).alias("geometry"), F.lit(False).alias("found"))
        return found.unionByName(none).select(*(f.split()[0] for f in ROUTES.split(f" {POINTS}")[0].split(", ")))

    def find_route(self, start: tuple[float, float], end: tuple[float, float], **options):
        """The best route of one query as a row."""
        return self.find_all(start, end, **options)[0]

    def find_all(self, start: tuple[float, float], end: tuple[float, float], **options) -> list:
        spark = self.graph.edges.sparkSession
        row = {"query_id": 0, "start_lat": start[0], "start_lon": start[1], "end_lat": end[0], "end_lon": end[1]} | options
        return self.find_routes(query_rows(spark, [row])).orderBy("rank").collect()
