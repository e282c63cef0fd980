"""Named queries over the derived network and tag tables, with equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BICYCLE, CAR
from ..core import table
from ..functions import conditions, tags
from ..model import RoadGraph
from ..operators.build import build
from ..operators.components import connected_components
from ..operators.compress import compress, contractible, degrees
from ..operators.held import hold, search_held
from ..operators.hierarchy import contract, meet
from ..operators.labels import hold_labels, trips
from ..operators.search import aliases, private_vertices, search
from ..operators.spatial import nearest, within
from ..operators.split import orphaned_exits, split
from ..sources.derived import CONDITION, EDGES_SQL, directed, network, places, turns
from .router import Router

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _from_zero(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0)], "query_id long, v long")


def _sssp_sql(where: str = "true", weight: str = "e.ms") -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, d(v, t) USING KEY (v) AS (
    SELECT 0::BIGINT, 0::BIGINT UNION
    (SELECT e.dst::BIGINT, min(d.t + {weight})::BIGINT FROM d JOIN e ON e.src = d.v LEFT JOIN recurring.d r ON r.v = e.dst
     WHERE {where} AND (r.t IS NULL OR d.t + {weight} < r.t) GROUP BY e.dst))
SELECT v, t AS time_ms FROM d"""


def _ms(c: Column) -> Column:
    return F.round(c * 1000).cast("long").alias("time_ms")


def _in_ms(edges: DataFrame) -> DataFrame:
    """Whole milliseconds as weights: their sums are exact, penalties included, up to 2**53."""
    return edges.withColumn("time_s", F.col("ms").cast("double"))


def _whole(c: Column) -> Column:
    return c.cast("long").alias("time_ms")


def _times_from_zero(edges: DataFrame, avoid_tolls: bool = False) -> DataFrame:
    """``v, time_ms``; in one task that holds the graph, or in rounds of joins if it is too large for that."""
    start, edges = _from_zero(edges.sparkSession), _in_ms(edges)
    avoid, held = start.select("query_id") if avoid_tolls else None, hold(edges)
    labels = search_held(held, start, avoid_tolls=avoid, paths=False) if held is not None else search(edges, start, avoid_tolls=avoid, paths=False)
    return labels.select("v", _whole(F.col("cost")))


@query(_sssp_sql())
def sssp(spark, sf_dir):
    """Fastest time from place 0 to every place that can be reached."""
    return _times_from_zero(directed(spark, sf_dir))


@query(_sssp_sql(weight="(e.ms::BIGINT * CASE WHEN e.tolls > 0 THEN 1000000 ELSE 1 END)"))
def sssp_tolls(spark, sf_dir):
    """The same with tolls avoided where possible: penalised cost."""
    return _times_from_zero(directed(spark, sf_dir), avoid_tolls=True)


@query(_sssp_sql("NOT e.acc"))
def sssp_access(spark, sf_dir):
    """The same on roads open to all."""
    return _times_from_zero(directed(spark, sf_dir).filter("not access_only"))


@query(_sssp_sql("e.dist_m % 4 <> 0"))
def sssp_conditional_no_clock(spark, sf_dir):
    """Conditional roads without a clock are closed."""
    return _times_from_zero(directed(spark, sf_dir).withColumn("condition", F.when(F.col("dist_m") % 4 == 0, CONDITION)))


@query(_sssp_sql("NOT e.acc"))
def ch_routes(spark, sf_dir):
    """The hierarchy's times from place 0, on roads open to all."""
    e = _in_ms(directed(spark, sf_dir)).filter("not access_only")
    held = hold_labels(e)
    if held is not None:
        to = e.select(F.explode(F.array("src", "dst")).alias("v")).unionByName(_from_zero(spark).select("v")).distinct()
        return trips(held, to.withColumn("start", F.lit(0).cast("long")), "start", "v").filter("cost is not null").select("v", _whole(F.col("cost")))
    h = contract(e, 4)
    to = h.ranks.select(F.lit(0).cast("long").alias("query_id"), "v").unionByName(_from_zero(spark)).distinct()
    return meet(h, _from_zero(spark), to, paths=False).select(F.col("target").alias("v"), _whole(F.col("time_s")))


@query(f"""WITH RECURSIVE {EDGES_SQL}, q AS (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM supplier) a, o_orderkey % (SELECT count(*) FROM supplier) b FROM orders),
d(s, v, t) USING KEY (s, v) AS (SELECT DISTINCT a::BIGINT, a::BIGINT, 0::BIGINT FROM q UNION
    (SELECT d.s, e.dst::BIGINT, min(d.t + e.ms)::BIGINT FROM d JOIN e ON e.src = d.v LEFT JOIN recurring.d r ON r.s = d.s AND r.v = e.dst WHERE r.t IS NULL OR d.t + e.ms < r.t GROUP BY d.s, e.dst))
SELECT o_orderkey, a, b, t AS time_ms FROM q LEFT JOIN d ON d.s = q.a AND d.v = q.b""")
def point_routes(spark, sf_dir):
    """A trip for every order, by the hierarchy's labels; where these are too large, trips from one place share a search."""
    n = table(spark, sf_dir, "supplier").count()
    q = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % n).cast("long").alias("a"), (F.col("o_orderkey") % n).cast("long").alias("b"))
    e = _in_ms(directed(spark, sf_dir))
    labels = hold_labels(e)
    if labels is not None:
        return trips(labels, q, "a", "b").select("o_orderkey", "a", "b", _whole(F.col("cost")))
    sources, held = q.select(F.col("a").alias("query_id"), F.col("a").alias("v")).distinct(), hold(e)
    if held is not None:
        ends = search_held(held, sources, q.select(F.col("a").alias("query_id"), F.col("b").alias("v")).distinct(), paths=False, every=True)
    else:
        ends = search(e, sources, paths=False)
    return q.join(ends.select(F.col("query_id").alias("a"), F.col("v").alias("b"), "cost"), ["a", "b"], "left").select("o_orderkey", "a", "b", _whole(F.col("cost")))


@query(f"""WITH {EDGES_SQL}, l AS (SELECT s_suppkey v FROM supplier WHERE s_nationkey % 5 = 0)
SELECT src, dst, dist_m::DOUBLE AS dist_m, tolls, acc AS access_only, (dst IN (SELECT v FROM l))::int AS signals,
    round((dist_m * 3600.0 / kmh) + CASE WHEN dst IN (SELECT v FROM l) THEN 20000 ELSE 0 END)::BIGINT AS time_ms FROM e""")
def build_edges(spark, sf_dir):
    """Directed edges with signal delays."""
    g = build(network(spark, sf_dir))
    at = lambda end: g.vertices.select(F.col("v").alias(end), F.col("original_id").alias(f"{end}_id"))
    e = g.edges.join(at("src"), "src").join(at("dst"), "dst")
    return e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "dist_m", "tolls", "access_only", "signals", _ms(F.col("time_s")))


@query(f"WITH {EDGES_SQL}, o AS (SELECT src v, count(*) n FROM e GROUP BY 1), i AS (SELECT dst v, count(*) n FROM e GROUP BY 1) SELECT coalesce(o.v, i.v) AS v, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM o FULL JOIN i ON o.v = i.v")
def degree_stats(spark, sf_dir):
    return degrees(directed(spark, sf_dir)).select("v", "n_out", "n_in")


@query(f"WITH {EDGES_SQL} SELECT src AS v FROM e GROUP BY src HAVING bool_and(dist_m % 4 <> 0)")
def private_places(spark, sf_dir):
    """With three of four roads access-only."""
    return private_vertices(directed(spark, sf_dir).withColumn("access_only", F.col("dist_m") % 4 != 0))


@query(f"WITH {EDGES_SQL}, v AS (SELECT src v FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM v) AS vertices, 0::BIGINT AS split_copies, count(*) AS edges, count(*) FILTER (tolls > 0) AS toll_edges, count(*) FILTER (dst IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 = 0)) AS signal_edges, count(*) FILTER (acc) AS access_only_edges, 0::BIGINT AS conditional_edges FROM e")
def graph_counts(spark, sf_dir):
    return build(network(spark, sf_dir)).describe()


@query(f"""WITH RECURSIVE {EDGES_SQL}, u AS (SELECT src a, dst b FROM e UNION SELECT dst, src FROM e),
r(v, m) USING KEY (v) AS (SELECT DISTINCT a::BIGINT, a::BIGINT FROM u UNION
    (SELECT u.b::BIGINT, min(r.m)::BIGINT FROM r JOIN u ON u.a = r.v LEFT JOIN recurring.r k ON k.v = u.b WHERE k.m IS NULL OR r.m < k.m GROUP BY u.b))
SELECT v AS node, m AS component FROM r""")
def components(spark, sf_dir):
    """Weak components of the whole network."""
    return connected_components(directed(spark, sf_dir))


_INNER = f"""{EDGES_SQL}, s AS (SELECT * FROM e),
dg AS (SELECT v, sum(o) n_out, sum(i) n_in, list_sort(list_distinct(list(w) FILTER (o = 1))) outs, list_sort(list_distinct(list(w) FILTER (i = 1))) ins
    FROM (SELECT src v, dst w, 1 o, 0 i FROM s UNION ALL SELECT dst, src, 0, 1 FROM s) GROUP BY v),
inner_ AS (SELECT v FROM dg WHERE NOT list_contains(outs, v) AND ((n_out = 2 AND n_in = 2 AND len(outs) = 2 AND outs = ins) OR (n_out = 1 AND n_in = 1 AND outs[1] <> ins[1])))"""


_CHAINS = f"""WITH RECURSIVE {_INNER}, w(src, prev, cur, dist_m, ms, tolls, acc, n) AS (
    SELECT src, src, dst, dist_m, ms, tolls, acc, 0 FROM s WHERE src NOT IN (SELECT v FROM inner_)
    UNION ALL SELECT w.src, w.cur, s.dst, w.dist_m + s.dist_m, w.ms + s.ms, w.tolls + s.tolls, w.acc OR s.acc, w.n + 1 FROM w JOIN s ON s.src = w.cur AND s.dst <> w.prev WHERE w.cur IN (SELECT v FROM inner_))
SELECT src, cur AS dst, dist_m::DOUBLE AS dist_m, ms::BIGINT AS time_ms, tolls, acc AS access_only, n::INT AS n_passed FROM w WHERE cur NOT IN (SELECT v FROM inner_) AND src <> cur"""


def _roads(spark, sf_dir) -> RoadGraph:
    e = directed(spark, sf_dir).drop("ms").withColumn("geom", F.array().cast("array<struct<lat:double,lon:double>>"))
    v = places(spark, sf_dir).select(F.col("id").alias("v"), F.col("id").alias("original_id"), "lat", "lon", F.lit(None).cast("long").alias("split_parent"))
    return RoadGraph(v, e)


def _chains(graph: RoadGraph) -> DataFrame:
    g, _ = compress(graph)
    at = lambda end: g.vertices.select(F.col("v").alias(end), F.col("original_id").alias(f"{end}_id"))
    e = g.edges.join(at("src"), "src").join(at("dst"), "dst")
    return e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "dist_m", _ms(F.col("time_s")), "tolls", "access_only", F.size("geom").alias("n_passed"))


@query(f"WITH {_INNER} SELECT v FROM inner_")
def contractible_places(spark, sf_dir):
    """The whole network."""
    return contractible(_roads(spark, sf_dir))


@query(_CHAINS)
def compress_chains(spark, sf_dir):
    """The whole network, compressed."""
    return _chains(_roads(spark, sf_dir))


_LAT, _LON = "(-23.5 + (s_suppkey // 10) * 0.01)", "(-46.7 + (s_suppkey % 10) * 0.01)"
_M = "(6371000.0 * pi() / 180)"
_NEAR = f"""WITH s AS (SELECT s_suppkey v, {_LAT} lat, {_LON} lon FROM supplier), c AS (SELECT cos(radians(avg(lat))) k FROM s),
p AS (SELECT c_custkey id, -23.5 + (c_custkey % 97) * 0.0010007 lat, -46.7 + (c_custkey % 89) * 0.0010013 lon FROM customer),
d AS (SELECT p.id, s.v, sqrt(pow((p.lat - s.lat) * {_M}, 2) + pow((p.lon - s.lon) * {_M} * k, 2)) m FROM p, s, c)"""


def _customers(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(-23.5) + (k % 97) * 0.0010007).alias("lat"), (F.lit(-46.7) + (k % 89) * 0.0010013).alias("lon"))


@query(f"{_NEAR} SELECT id AS key, arg_min(v, m)::BIGINT AS v FROM d GROUP BY id")
def nearest_vertex(spark, sf_dir):
    """The place nearest to each customer."""
    return nearest(_customers(spark, sf_dir), places(spark, sf_dir).withColumnRenamed("id", "v")).select("key", "v")


@query(f"{_NEAR} SELECT id AS key, v, round(m, 3) AS planar_m FROM d WHERE m <= 1500")
def within_radius(spark, sf_dir):
    return within(_customers(spark, sf_dir), places(spark, sf_dir).withColumnRenamed("id", "v"), 1500.0).select("key", "v", F.round("planar_m", 3).alias("planar_m"))


_HIGHWAY = ("motorway", "primary", "primary_link", "service", "track", "footway", "residential", "cycleway", "construction")
_ACCESS = (None, "yes", "no", "destination", "forestry", "unheard", "Private")
_SERVICE = (None, "driveway", "alley", "bus")
_SPEED = (None, "50", "30 mph", "walk", "200", " 45.5 ")
_ONEWAY = (None, "yes", "-1", "no", "sometimes")
_BARRIER = (None, "gate", "bollard", "wall", "toll_booth", "odd", "stile")
_BAN = ("no_left_turn", "only_straight_on", "No-Right Turn", "no_left_turn;only_right_turn", "no_flying", "no_u_turn @ (Mo-Fr)")


def _pick(values: tuple, by: str) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (F.expr(by) % len(values)).cast("int"))


def _pick_sql(values: tuple, by: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({by}) % {len(values)} + 1]"


def _tags(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    parts = {"highway": _pick(_HIGHWAY, "p_partkey"), "access": _pick(_ACCESS, "p_partkey div 9"), "service": _pick(_SERVICE, "p_size"), "maxspeed": _pick(_SPEED, "p_partkey div 2"), "oneway": _pick(_ONEWAY, "p_size div 3"), "barrier": _pick(_BARRIER, "p_partkey div 5")}
    made = F.map_filter(F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return p.select("p_partkey", made.alias("tags"), _pick(_BAN, "p_partkey").alias("ban"))


_TAGS = f"""WITH t AS (SELECT p_partkey, {_pick_sql(_HIGHWAY, "p_partkey")} h, lower({_pick_sql(_ACCESS, "p_partkey // 9")}) a, {_pick_sql(_SERVICE, "p_size")} s, {_pick_sql(_SPEED, "p_partkey // 2")} m, {_pick_sql(_ONEWAY, "p_size // 3")} o, {_pick_sql(_BARRIER, "p_partkey // 5")} b, {_pick_sql(_BAN, "p_partkey")} ban FROM part),
x AS (SELECT *, CASE WHEN a IN ('no', 'private', 'forestry') THEN 2 WHEN a = 'destination' THEN 1 WHEN a = 'yes' THEN 0 END said,
    CASE WHEN a IN ('no', 'private') THEN 2 WHEN a = 'destination' THEN 1 WHEN a = 'yes' THEN 0 END bike_said FROM t),
y AS (SELECT *, CASE WHEN h = 'service' AND s = 'bus' THEN 2 WHEN said = 2 THEN 2 WHEN said = 0 THEN 0
        ELSE greatest(CASE WHEN h = 'track' OR (h = 'service' AND s = 'driveway') THEN 1 ELSE 0 END, coalesce(said, 0)) END car,
    CASE WHEN h = 'service' AND s = 'bus' THEN 2 WHEN bike_said = 2 THEN 2 WHEN h = 'footway' THEN 2 WHEN bike_said = 0 THEN 0
        ELSE greatest(CASE WHEN h = 'service' AND s = 'driveway' THEN 1 ELSE 0 END, coalesce(bike_said, 0)) END bike FROM x)"""


@query(f"{_TAGS} SELECT p_partkey, car, bike FROM y")
def tag_access(spark, sf_dir):
    return _tags(spark, sf_dir).select("p_partkey", tags.way_access(F.col("tags"), CAR).alias("car"), tags.way_access(F.col("tags"), BICYCLE).alias("bike"))


@query(f"""{_TAGS}, z AS (SELECT *, try_cast(nullif(regexp_extract(trim(lower(m)), '^(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) * CASE WHEN m LIKE '%mph%' THEN 1.609344 ELSE 1 END ms FROM y)
SELECT p_partkey, round(least(coalesce(CASE WHEN h = 'service' THEN CASE s WHEN 'driveway' THEN 10 WHEN 'alley' THEN 15 END WHEN h = 'track' THEN 10 END, ms,
    CASE replace(h, '_link', '') WHEN 'motorway' THEN 110 WHEN 'primary' THEN 80 WHEN 'service' THEN 20 WHEN 'track' THEN 10 WHEN 'residential' THEN 40 END, 40), 130), 6) AS kmh, round(ms, 6) AS signed FROM z""")
def tag_speed(spark, sf_dir):
    return _tags(spark, sf_dir).select("p_partkey", F.round(tags.speed_kmh(F.col("tags"), CAR), 6).alias("kmh"), F.round(tags.parse_maxspeed(F.col("tags")["maxspeed"]), 6).alias("signed"))


@query(f"{_TAGS} SELECT p_partkey, CASE WHEN o = 'yes' THEN 1 WHEN o = '-1' THEN -1 WHEN o = 'no' THEN 0 WHEN h = 'motorway' THEN 1 ELSE 0 END AS car, 0 AS bike FROM y")
def tag_oneway(spark, sf_dir):
    return _tags(spark, sf_dir).select("p_partkey", tags.oneway(F.col("tags"), CAR).alias("car"), tags.oneway(F.col("tags"), BICYCLE).alias("bike"))


@query(f"{_TAGS} SELECT p_partkey, replace(h, '_link', '') IN ('motorway', 'primary', 'service', 'track', 'residential') AND car < 2 AS car, replace(h, '_link', '') IN ('primary', 'service', 'track', 'footway', 'residential', 'cycleway') AND bike < 2 AS bike FROM y")
def routable_ways(spark, sf_dir):
    two = F.array(F.lit(1), F.lit(2))
    return _tags(spark, sf_dir).select("p_partkey", tags.routable(F.col("tags"), two, CAR).alias("car"), tags.routable(F.col("tags"), two, BICYCLE).alias("bike"))


@query(f"""{_TAGS} SELECT p_partkey, CASE WHEN b IS NULL THEN true WHEN car = 2 THEN false WHEN a IS NOT NULL THEN true WHEN b = 'toll_booth' THEN true WHEN b IN ('wall', 'stile') THEN false
    WHEN b = 'bollard' THEN false WHEN b = 'gate' THEN h NOT IN ('service', 'track') ELSE false END AS car FROM y""")
def barrier_pass(spark, sf_dir):
    return _tags(spark, sf_dir).select("p_partkey", tags.barrier_passes(F.col("tags"), CAR, F.col("tags")["highway"]).alias("car"))


@query(f"{_TAGS} SELECT p_partkey, CASE ban WHEN 'no_left_turn' THEN 'no' WHEN 'only_straight_on' THEN 'only' WHEN 'No-Right Turn' THEN 'no' WHEN 'no_u_turn @ (Mo-Fr)' THEN 'no' END AS kind FROM y")
def ban_kind(spark, sf_dir):
    return _tags(spark, sf_dir).select("p_partkey", tags.ban_kind(F.col("ban")).alias("kind"))


@query("SELECT event_id, isodow(ts) <= 5 AND hour(ts) >= 7 AND hour(ts) < 9 AS rush, hour(ts) >= 22 OR hour(ts) * 60 + minute(ts) < 390 AS night, isodow(ts) >= 6 OR isodow(ts) = 1 AS weekend, true AS unreadable FROM events")
def cond_in_force(spark, sf_dir):
    """Four conditions at the time of every event."""
    said = {"rush": "no @ (Mo-Fr 07:00-09:00)", "night": "no @ (22:00-06:30)", "weekend": "no @ (Sa-Mo)", "unreadable": "no @ (sunset-sunrise)"}
    ts, events = F.col("ts").cast("timestamp_ntz"), table(spark, sf_dir, "events")
    plans = conditions.schedules(spark.createDataFrame([(e,) for e in said.values()], "e string"))
    plans = plans.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("condition", "closed"))).alias("plans"))  # one row of four
    # one row for the week's minutes, each with what holds then
    week = plans.select(F.posexplode(F.arrays_zip(*(F.col("plans")[F.lit(e)].alias(n) for n, e in said.items()))).alias("minute", "x")).select("minute", "x.*")
    minute = F.weekday(ts) * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return events.withColumn("m", minute).join(F.broadcast(week), F.col("m") == F.col("minute")).select("event_id", *said)


@query(f"""WITH {EDGES_SQL}, p AS (SELECT s_suppkey v FROM supplier), r AS (SELECT v - 1 f, v via, v + 10 t, v % 2 = 1 is_only, v % 3 = 0 timed FROM p WHERE v % 10 BETWEEN 1 AND 9 AND v - 1 IN (FROM p) AND v + 10 IN (FROM p)),
vs AS (SELECT src v FROM e UNION SELECT dst FROM e), u AS (SELECT r.*, EXISTS (FROM e WHERE e.src = f AND e.dst = via) ok, EXISTS (FROM e WHERE e.src = via AND e.dst = t) named FROM r),
x AS (SELECT u.*, (SELECT count(*) FROM e WHERE e.src = via) n, (SELECT count(*) FROM e WHERE e.src = via AND CASE WHEN is_only THEN e.dst <> t ELSE e.dst = t END) hit FROM u),
y AS (SELECT CASE WHEN NOT ok OR t NOT IN (FROM vs) THEN 'unresolved' WHEN NOT named OR hit = 0 THEN 'inert' WHEN NOT timed AND hit = n THEN 'contradictory' ELSE 'applied' END k FROM x)
SELECT count(*) FILTER (k = 'applied') AS applied, count(*) FILTER (k = 'unresolved') AS unresolved, count(*) FILTER (k = 'contradictory') AS contradictory, count(*) FILTER (k = 'inert') AS inert, count(*) FILTER (k = 'applied') AS copies FROM y""")
def split_stats(spark, sf_dir):
    g = build(network(spark, sf_dir))
    return split(g, turns(spark, sf_dir))[1]


@query()
def split_edges(spark, sf_dir):
    """Edges after turn restrictions, by original places."""
    g, _ = split(build(network(spark, sf_dir)), turns(spark, sf_dir))
    at = lambda end: g.vertices.select(F.col("v").alias(end), F.col("original_id").alias(f"{end}_id"), F.col("split_parent").isNotNull().alias(f"{end}_copy"))
    return g.edges.join(at("src"), "src").join(at("dst"), "dst").groupBy("src_id", "dst_id", "src_copy", "dst_copy", "condition").agg(F.count("*").alias("n"))


@query()
def orphans(spark, sf_dir):
    g = build(network(spark, sf_dir))
    return orphaned_exits(g, turns(spark, sf_dir).withColumn("condition", F.lit(None).cast("string")))


@query("""WITH p AS (SELECT s_suppkey::BIGINT v, v // 20 lat, v % 10 lon FROM supplier) SELECT v, v AS alias FROM p UNION SELECT v - 3, v FROM p WHERE v % 7 = 3
UNION SELECT a.v, b.v FROM p a JOIN p b ON a.lat = b.lat AND a.lon = b.lon AND a.v <> b.v""")
def place_aliases(spark, sf_dir):
    """Every other row of the grid falls on the one before; some places are copies of others."""
    v = F.col("id")
    return aliases(places(spark, sf_dir).select(v.alias("v"), F.floor(v / 20).cast("double").alias("lat"), (v % 10).cast("double").alias("lon"), F.when(v % 7 == 3, v - 3).alias("split_parent")))


def _trips(spark, sf_dir, **options) -> DataFrame:
    """A query for every nation: from its first supplier's place to its last."""
    p = places(spark, sf_dir)
    ends = p.groupBy("nation").agg(F.min(F.struct("id", "lat", "lon")).alias("a"), F.max(F.struct("id", "lat", "lon")).alias("b"))
    q = {"at": F.lit(None).cast("timestamp_ntz"), "avoid_tolls": F.lit(False), "max_routes": F.lit(1), "max_extra_ratio": F.lit(0.5), "max_extra_m": F.lit(None).cast("double"), "max_sharing": F.lit(0.8)} | options
    return ends.select(F.col("nation").alias("query_id"), F.col("a.lat").alias("start_lat"), F.col("a.lon").alias("start_lon"), F.col("b.lat").alias("end_lat"), F.col("b.lon").alias("end_lon"), *(v.alias(k) for k, v in q.items()))


@query()
def alternative_routes(spark, sf_dir):
    """Up to three routes for each nation's trip, tolls avoided."""
    return Router(build(network(spark, sf_dir))).find_routes(_trips(spark, sf_dir, max_routes=F.lit(3), avoid_tolls=F.lit(True))).drop("geometry")


@query()
def clocked_routes(spark, sf_dir):
    """The same trips on a Monday morning, with timed turn restrictions."""
    g, _ = split(build(network(spark, sf_dir)), turns(spark, sf_dir))
    return Router(g).find_routes(_trips(spark, sf_dir, at=F.lit("2026-09-14 08:00:00").cast("timestamp_ntz"))).drop("geometry")
