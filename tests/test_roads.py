"""Hand-made road networks: building, splitting, compressing, snapping and routing."""

import math
import os
import random
from datetime import datetime
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomway.core import shared_dir
from loomway.functions import conditions
from loomway.model import GeoGraph
from loomway.operators import held, hierarchy, labels
from loomway.operators.build import build
from loomway.operators.compress import compress, kept_components
from loomway.operators.components import connected_components
from loomway.operators.spatial import nearest, within
from loomway.operators.split import orphaned_exits, split
from loomway.plans import queries
from loomway.plans.router import Router, query_rows
from loomway.sources.derived import directed
from loomway.streaming import answer_stream


def edge(a, b, m=111.0, kmh=50.0, **more):
    return {"source_id": a, "target_id": b, "distance_m": m, "speed_kmh": kmh} | more


def chain(spark, n, **more):
    return GeoGraph.of(spark, [(i, 0.0, i * 0.001) for i in range(1, n + 1)], [edge(i, i + 1, **more) for i in range(1, n)])


def grid(spark, n, step=0.01):
    nodes = [(r * n + c, -23.5 + r * step, -46.7 + c * step) for r in range(n) for c in range(n)]
    edges = [edge(r * n + c, r * n + c + 1, 1000.0 + r) for r in range(n) for c in range(n - 1)] + [edge(r * n + c, r * n + c + n, 1000.0 + c) for r in range(n - 1) for c in range(n)]
    return GeoGraph.of(spark, nodes, edges)


def place(graph, i):
    r = graph.nodes.filter(F.col("id") == i).first()
    return r["lat"], r["lon"]


def routes(graph, road, pairs, strategy="frontier", **options):
    rows = [{"query_id": k, "start_lat": place(graph, a)[0], "start_lon": place(graph, a)[1], "end_lat": place(graph, b)[0], "end_lon": place(graph, b)[1]} | options for k, (a, b) in enumerate(pairs)]
    found = Router(road, strategy).find_routes(query_rows(road.edges.sparkSession, rows)).orderBy("query_id", "rank").collect()
    return found


@pytest.fixture(params=["frontier", "held"])
def each_way(request, monkeypatch):
    """Routes are searched in rounds of joins, and in tasks that hold the graph."""
    monkeypatch.setattr(routes, "__defaults__", (request.param,))


def metres(graph, road, pairs, **options):
    return [r["distance_m"] for r in routes(graph, road, pairs, **options)]


def test_grid_is_built(spark):
    g = build(grid(spark, 3))
    assert g.vertices.count() == 9
    assert g.edges.count() == 24
    assert [r["edge_id"] for r in g.edges.orderBy("src", "dst").collect()] == list(range(24))


def test_signals_and_speed(spark):
    g = build(GeoGraph.of(spark, [(1, 0.0, 0.0), (2, 0.0, 0.01), (3, 0.0, 0.02)], [edge(1, 2, 1000.0, 36.0), edge(2, 3, 10.0, 0.0), edge(3, 9)], [2, 99]))
    got = {(r["src"], r["dst"]): (r["time_s"], r["signals"]) for r in g.edges.collect()}
    assert got[0, 1] == pytest.approx((120.0, 1))
    assert got[1, 0] == pytest.approx((100.0, 0))
    assert got[1, 2][0] == float("inf")
    assert len(got) == 4


def test_chain_is_compressed(spark):
    g, stats = compress(build(chain(spark, 5)))
    assert (g.vertices.count(), g.edges.count()) == (2, 2)
    e = g.edges.orderBy("src").first()
    assert e["dist_m"] == pytest.approx(444.0)
    assert [p["lon"] for p in e["geom"]] == pytest.approx([0.002, 0.003, 0.004])
    assert stats.first()["vertex_reduction"] == pytest.approx(0.6)


def test_compression_sums_and_strictest(spark):
    nodes = [(i, 0.0, i * 0.001) for i in range(1, 6)]
    edges = [edge(1, 2, tolls=1), edge(2, 3), edge(3, 4, tolls=1, access_only=True), edge(4, 5, shape=[])]
    g, _ = compress(build(GeoGraph.of(spark, nodes, edges, [3])))
    assert [(r["tolls"], r["signals"], r["access_only"]) for r in g.edges.collect()] == [(2, 1, True)] * 2


def test_cycle_without_an_end_is_dropped(spark):
    nodes = [(i, 0.0, i * 0.001) for i in range(1, 7)]
    edges = [edge(1, 2), edge(2, 3), edge(3, 1), edge(4, 5), edge(5, 6)]
    g, _ = compress(build(GeoGraph.of(spark, nodes, edges)))
    assert sorted(r["original_id"] for r in g.vertices.collect()) == [4, 6]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), (None, 1)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4, 7: 7}
    assert connected_components(e.limit(0)).count() == 0


def derived(spark, tmp_path, places, parts):
    """The folder of a small derived network."""
    spark.createDataFrame([(i, i % 5) for i in places], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k % 50) for k in parts], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_components_of_the_whole_network(spark, tmp_path):
    d = derived(spark, tmp_path, range(40), [k for k in range(80) if k % 10 not in (1, 3, 4, 6)])
    roads = [(r["src"], r["dst"]) for r in directed(spark, d).collect()]
    least = {v: v for e in roads for v in e}
    for _ in least:
        for a, b in roads:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in queries.Q["components"](spark, d).collect()}
    assert got == least and len(set(got.values())) > 1


def test_chains_of_the_whole_network(spark, tmp_path):
    d = derived(spark, tmp_path, range(40), [k for k in range(80) if k % 10 not in (1, 3, 4, 6)])
    outs, ins = {}, {}
    for r in directed(spark, d).collect():
        outs.setdefault(r["src"], []).append((r["dst"], r["dist_m"]))
        ins.setdefault(r["dst"], []).append(r["src"])
    inner = set()
    for v in outs.keys() & ins.keys():
        to, back = sorted(w for w, _ in outs[v]), sorted(ins[v])
        if (len(to) == 2 and to == back) or (len(to) == len(back) == 1 and to != back):
            inner.add(v)
    chains = []
    for v in outs.keys() - inner:
        for w, m in outs[v]:
            before, at, n = v, w, 0
            while at in inner:
                (nxt, more), *_ = [x for x in outs[at] if x[0] != before]
                before, at, m, n = at, nxt, m + more, n + 1
            if at != v:
                chains.append((v, at, m, n))
    assert inner and {r["v"] for r in queries.Q["contractible_places"](spark, d).collect()} == inner
    got = queries.Q["compress_chains"](spark, d).select("src", "dst", "dist_m", "n_passed").collect()
    assert sorted(map(tuple, got)) == sorted(chains)


def test_snapping_equals_a_scan(spark):
    g = build(grid(spark, 6))
    probes = [(i, -23.52 + (i * 37 % 100) * 0.0010007, -46.73 + (i * 53 % 100) * 0.0012) for i in range(80)] + [(80, -20.0, -40.0), (81, None, 1.0)]
    p = spark.createDataFrame(probes, "id long, lat double, lon double")
    verts = g.vertices.collect()
    import math

    cos = math.cos(math.radians(sum(v["lat"] for v in verts) / len(verts)))
    d2 = lambda p, v: ((p[1] - v["lat"]) ** 2 + ((p[2] - v["lon"]) * cos) ** 2, v["v"])
    want = {x[0]: min(verts, key=lambda v: d2(x, v))["v"] for x in probes if x[1] is not None}
    assert {r["key"]: r["v"] for r in nearest(p, g.vertices).collect()} == want
    assert nearest(p, g.vertices, max_m=10.0).count() < len(want)
    per = 6371000.0 * math.pi / 180
    near = {(x[0], v["v"]) for x, v in product(probes, verts) if x[1] is not None and d2(x, v)[0] ** 0.5 * per <= 1500}
    assert {(r["key"], r["v"]) for r in within(p, g.vertices, 1500.0).collect()} == near
    assert nearest(p, g.vertices.limit(0)).count() == 0


def test_strategies_agree(spark):
    src = grid(spark, 5)
    road = build(src)
    pairs = [(0, 24), (6, 18), (3, 20), (7, 7)]
    a, b, h = (routes(src, road, pairs, s) for s in ("frontier", "hierarchy", "held"))
    assert [(r["duration_us"], r["distance_m"], r["geometry"]) for r in a] == [(r["duration_us"], r["distance_m"], r["geometry"]) for r in h]
    small, _ = compress(road)
    c = routes(src, small, pairs[1:2])  # the corners offer no choice and are gone
    assert [r["duration_us"] for r in a] == [r["duration_us"] for r in b]
    assert c[0]["duration_us"] == a[1]["duration_us"]
    assert a[3]["distance_m"] == 0.0 and len(a[3]["geometry"]) == 2
    assert all(r["found"] for r in a)


@pytest.mark.usefixtures("each_way")
def test_tolls_are_avoided_if_possible(spark):
    nodes = [(i, 0.0, i * 0.01) for i in range(4)]
    d = GeoGraph.of(spark, nodes, [edge(0, 3, 200.0, 100.0, tolls=1), edge(0, 1, 150.0), edge(1, 2, 150.0), edge(2, 3, 150.0)])
    road = build(d)
    assert [(r["distance_m"], r["toll_count"]) for r in routes(d, road, [(0, 3)])] == [(200.0, 1)]
    assert [(r["distance_m"], r["toll_count"]) for r in routes(d, road, [(0, 3)], avoid_tolls=True)] == [(450.0, 0)]
    only = GeoGraph.of(spark, nodes[:2], [edge(0, 1, 200.0, tolls=1)])
    assert metres(only, build(only), [(0, 1)], avoid_tolls=True) == [200.0]


@pytest.mark.usefixtures("each_way")
def test_unreachable_and_one_way(spark):
    g = GeoGraph.of(spark, [(i, 0.0, i * 0.01) for i in range(1, 6)], [edge(1, 2, 100.0, one_way=True), edge(2, 3, 100.0, one_way=True), edge(4, 5)])
    found = routes(g, build(g), [(1, 3), (3, 1), (1, 4)])
    assert [(r["found"], r["distance_m"]) for r in found] == [(True, 200.0), (False, None), (False, None)]


def car_park(spark, flagged=True):
    # a street 1-2-3 the long way round, a short cut through the car park 2-4-5-3, and a bay 6 in it
    nodes = [(i, 0.0, i * 0.01) for i in range(1, 9)]
    inner = {"access_only": flagged}
    edges = [edge(1, 2, 100.0), edge(2, 7, 400.0), edge(7, 3, 400.0), edge(3, 8, 100.0), edge(2, 4, 20.0, **inner), edge(4, 5, 10.0, **inner), edge(5, 3, 20.0, **inner), edge(4, 6, 30.0, **inner)]
    return GeoGraph.of(spark, nodes, edges)


@pytest.mark.parametrize("strategy", ["frontier", "hierarchy", "held"])
def test_access_zones(spark, strategy):
    g = car_park(spark)
    assert metres(g, build(g), [(1, 8), (1, 6), (6, 8), (4, 6)], strategy=strategy) == [1000.0, 150.0, 160.0, 30.0]
    g = car_park(spark, False)
    assert metres(g, build(g), [(1, 8)]) == [250.0]


def crossroads(spark, kind, to=4, condition=None):
    # 1 -> 2 -> 3 with exits 4 (straight), 5, 6; a longer way from 1 to 4
    nodes = [(i, 0.0, i * 0.01) for i in range(1, 8)]
    edges = [edge(1, 2, 500.0, one_way=True), edge(2, 3, 500.0), edge(3, 4, 500.0), edge(3, 5, 500.0), edge(3, 6, 500.0), edge(1, 7, 1000.0, one_way=True), edge(7, 4, 1500.0, one_way=True)]
    return GeoGraph.of(spark, nodes, edges, restrictions=[{"from_id": 2, "via_id": 3, "to_id": to, "is_only": kind == "only", "condition": condition}])


def exits_from(road, a, b):
    id_of = {r["v"]: r["original_id"] for r in road.vertices.collect()}
    edges = road.edges.collect()
    heads = {e["dst"] for e in edges if (id_of[e["src"]], id_of[e["dst"]]) == (a, b)}
    return sorted(id_of[e["dst"]] for e in edges if e["src"] in heads)


def test_splitting(spark):
    g = crossroads(spark, "no")
    road, stats = split(build(g), g.restrictions)
    assert exits_from(road, 2, 3) == [2, 5, 6]
    assert stats.first().asDict() == {"applied": 1, "unresolved": 0, "contradictory": 0, "inert": 0, "copies": 1}
    g = crossroads(spark, "only")
    road, _ = split(build(g), g.restrictions)
    assert exits_from(road, 2, 3) == [4]
    small, _ = compress(road)
    for r in (road, small):
        assert metres(g, r, [(1, 4), (1, 3)]) == [1500.0, 1000.0]


def test_junction_is_reached_through_its_copies(spark):
    g = crossroads(spark, "no")
    road, _ = split(build(g), g.restrictions)
    assert metres(g, road, [(1, 3), (1, 4), (2, 4)]) == [1000.0, 2500.0, 2000.0]  # the last turns round at 5


@pytest.mark.usefixtures("each_way")
def test_conditional_turns_and_the_clock(spark):
    g = crossroads(spark, "no", condition="no_straight_on @ (Mo-Fr 07:00-09:00)")
    road, _ = split(build(g), g.restrictions)
    small, _ = compress(road)
    for r in (road, small):
        assert metres(g, r, [(1, 4)]) == [2500.0]
        assert metres(g, r, [(1, 4)], at=datetime(2026, 9, 14, 8, 0)) == [2500.0]
        assert metres(g, r, [(1, 4)], at=datetime(2026, 9, 13, 8, 0)) == [1500.0]


def test_restrictions_in_series(spark):
    nodes = [(i, 0.0, i * 0.01) for i in (1, 2, 3, 5, 6)]
    g = GeoGraph.of(
        spark, nodes, [edge(1, 2), edge(2, 3), edge(3, 6), edge(2, 5)],
        restrictions=[{"from_id": 1, "via_id": 2, "to_id": 5}, {"from_id": 2, "via_id": 3, "to_id": 6}],
    )
    road, _ = split(build(g), g.restrictions)
    assert [r["found"] for r in routes(g, road, [(1, 6), (1, 5), (1, 3)])] == [False, True, True]  # 5 is reached by turning at 3


def test_split_statistics_and_orphans(spark):
    nodes = [(i, 0.0, i * 0.01) for i in range(1, 6)]
    ways = [edge(1, 2, one_way=True), edge(2, 3, one_way=True), edge(3, 4, one_way=True), edge(3, 5, one_way=True)]
    g = GeoGraph.of(spark, nodes, ways, restrictions=[{"from_id": 2, "via_id": 3, "to_id": 4, "is_only": True}])
    road = build(g)
    ids = {r["v"]: r["original_id"] for r in road.vertices.collect()}
    assert [(ids[r["via"]], ids[r["dst"]]) for r in orphaned_exits(road, g.restrictions).collect()] == [(3, 5)]
    both = [{"from_id": 2, "via_id": 3, "to_id": 4}, {"from_id": 2, "via_id": 3, "to_id": 5}, {"from_id": 9, "via_id": 3, "to_id": 4}, {"from_id": 1, "via_id": 2, "to_id": 5}]
    g = GeoGraph.of(spark, nodes, ways, restrictions=both)
    _, stats = split(build(g), g.restrictions)
    assert stats.first().asDict() == {"applied": 0, "unresolved": 1, "contradictory": 2, "inert": 1, "copies": 0}


@pytest.mark.usefixtures("each_way")
def test_alternatives(spark):
    nodes = [(i, 0.0, i * 0.01) for i in range(6)]
    g = GeoGraph.of(spark, nodes, [edge(0, 1, 500.0), edge(1, 5, 500.0), edge(0, 2, 600.0), edge(2, 5, 600.0), edge(0, 3, 650.0), edge(3, 5, 600.0), edge(0, 4, 900.0), edge(4, 5, 900.0)])
    road = build(g)
    assert metres(g, road, [(0, 5)], max_routes=4) == [1000.0, 1200.0, 1250.0]
    assert metres(g, road, [(0, 5)], max_routes=2) == [1000.0, 1200.0]
    assert metres(g, road, [(0, 5)], max_routes=4, max_extra_m=220.0) == [1000.0, 1200.0]
    assert metres(g, road, [(0, 5)], max_routes=0) == [1000.0]


@pytest.mark.usefixtures("each_way")
def test_clock_needs_final_labels(spark):
    # s->u takes 600 s directly and 200 s by a; u->v is closed to arrivals before 300 s
    nodes = [(i, 0.0, i * 0.01) for i in range(1, 5)]
    g = GeoGraph.of(spark, nodes, [edge(1, 2, 6000.0, 36.0, one_way=True), edge(1, 3, 1000.0, 36.0, one_way=True), edge(3, 2, 1000.0, 36.0, one_way=True), edge(2, 4, 10.0, 36.0, one_way=True)])
    road = build(g)
    closed = road.edges.withColumn("condition", F.when((F.col("src") == 1) & (F.col("dst") == 3), "no @ (08:00-08:05)"))
    road = type(road)(road.vertices, closed)
    assert [r["found"] for r in routes(g, road, [(1, 4)], at=datetime(2026, 9, 14, 8, 0))] == [False]
    assert [r["found"] for r in routes(g, road, [(1, 4)], at=datetime(2026, 9, 14, 9, 0))] == [True]


def test_held_search_by_hand(spark):
    """A* against plain relaxation on random roads, and how far it looks."""
    r = random.Random(5)
    places = {v: (-23.5 + (v // 8) * 0.01, -46.7 + (v % 8) * 0.01) for v in range(64)}
    roads = []
    for v in range(64):
        for w in (v + 1, v + 8):
            if w < 64 and (w != v + 1 or w % 8):
                for a, b in ((v, w), (w, v)):
                    if r.random() < 0.9:
                        roads.append((len(roads), a, b, r.uniform(1.0, 3.0) * held.straight_m(*places[a], *places[b]) / 20, r.uniform(1000, 3000), r.random() < 0.2, r.random() < 0.1))
    cols = [np.array(x) for x in zip(*sorted(roads, key=lambda x: (x[1], x[0])))]
    g = held.HeldGraph(*cols, np.full(len(roads), -1), [], places)
    assert 0 < g.max_speed <= 20 + 1e-6
    for source, goal, avoid in [(0, 63, False), (5, 40, True), (63, 0, True), (9, 9, False)]:
        best = {source: 0.0}
        for _ in range(64):
            for _, a, b, t, _, toll, _ in roads:
                best[b] = min(best.get(b, math.inf), best.get(a, math.inf) + t * (1e6 if toll and avoid else 1))
        final, by, settled = held.find(g, [source], {goal}, None, None, avoid, {}, None, False)
        assert final[goal][0] == pytest.approx(best[goal])
        by_id = {x[0]: x for x in roads}
        assert sum(by_id[e][3] for e in held.way(by, goal)) == pytest.approx(final[goal][2])
        whole, _, all_ = held.find(g, [source], None, None, None, avoid, {}, None, True)
        assert {v: x[0] for v, x in whole.items()} == pytest.approx({v: t for v, t in best.items() if t < math.inf})
        assert settled <= all_ == len(whole)
    assert held.find(g, [27], {28}, None, None, False, {}, None, False)[2] < 40
    edges = spark.createDataFrame([(0, 0, 1, 1.0, 1.0, 0, False, None)], "edge_id long, src long, dst long, time_s double, dist_m double, tolls int, access_only boolean, condition string")
    assert held.hold(edges, most=0) is None and held.hold(edges).max_speed == math.inf


def test_schedules_are_conditions(spark):
    said = ["no @ (Mo-Fr 07:00-09:00)", "no @ (22:00-06:30)", "no @ (Sa-Mo)", "no @ (sunset-sunrise)", "no", "no @ (24/7)", "no @ (Mo 10:00-12:00; We)"]
    e = spark.createDataFrame([(x,) for x in [*said, None, said[0]]], "c string")
    plans = conditions.schedules(e)
    assert plans.count() == len(said)
    times = spark.range(0, 7 * 24 * 60, 37).select(F.expr("timestamp_ntz'2026-09-14 00:00:30' + make_interval(0, 0, 0, 0, 0, cast(id as int), 0)").alias("at"))
    both = plans.crossJoin(times).select(conditions.closed_at(F.col("closed"), F.col("at")).alias("a"), conditions.in_force(F.col("condition"), F.col("at")).alias("b"))
    assert both.filter("a <> b or a is null").count() == 0 and both.filter("a").count() > 0 and both.filter("not a").count() > 0


def test_a_stream_of_queries(spark, tmp_path):
    g = grid(spark, 3)
    router = Router(build(g), max_snap_m=2000.0)
    (lat_a, lon_a), (lat_b, lon_b) = place(g, 0), place(g, 8)
    rows = [{"query_id": 1, "start_lat": lat_a, "start_lon": lon_a, "end_lat": lat_b, "end_lon": lon_b}, {"query_id": 2, "start_lat": lat_a, "start_lon": lon_a, "end_lat": 10.0, "end_lon": 10.0}]
    asked = query_rows(spark, rows)
    asked.write.parquet(str(tmp_path / "in"))
    written = f"{shared_dir(spark)}/loomway"
    before = sum(len(d) for _, d, _ in os.walk(written))
    answer_stream(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in")), router, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["query_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1]["found"] and got[1]["distance_m"] == 4004.0
    assert not got.get(2, {"found": False})["found"]  # nothing is near enough to its end
    assert sum(len(d) for _, d, _ in os.walk(written)) == before


def test_components_that_are_kept(spark):
    nodes = [(i, 0.0, i * 0.01) for i in range(9)]
    road = build(GeoGraph.of(spark, nodes, [edge(0, 1), edge(1, 2), edge(2, 3), edge(4, 5), edge(6, 7), edge(7, 8)]))
    ids = {r["v"]: r["original_id"] for r in road.vertices.collect()}
    kept = lambda **o: sorted(ids[r["v"]] for r in kept_components(road, **o).collect())
    assert kept() == list(range(9))
    assert kept(min_size=3) == [0, 1, 2, 3, 6, 7, 8]
    assert kept(largest_only=True) == [0, 1, 2, 3]


def least_times(roads, start):
    """Plain relaxation over ``(src, dst, weight)``."""
    best, more = {start: 0}, True
    while more:
        more = False
        for a, b, t in roads:
            if a in best and best[a] + t < best.get(b, math.inf):
                best[b], more = best[a] + t, True
    return best


def mixed(spark, tmp_path, n):
    """The folder of a derived network in which every column has roads open to all."""
    spark.createDataFrame([(i, i % 5) for i in range(n)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, (k * 7 + 3) % 50 + 1) for k in range(2 * n)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_labels_by_hand():
    """Labels against plain relaxation: one-way, parallel, looping and unconnected roads."""
    r = random.Random(7)
    roads = [(v, w, float(r.randrange(1, 50))) for v in range(60) for w in (v + 1, v + 6) if w < 60 and v != 29 for v, w in ((v, w), (w, v)) if r.random() < 0.8]
    roads += [(3, 3, 1.0), (5, 6, 99.0), (5, 6, 2.0), (100, 101, 4.0)]
    g = labels.contracted(*zip(*roads))
    ends = [*range(60), 100, 101, 500]
    for a in ends:
        best = least_times(roads, a)
        assert g.costs(np.full(len(ends), a), np.array(ends)).tolist() == [best.get(b, math.inf) for b in ends]
    assert labels.contracted(*zip(*roads), cells=60) is None and labels.contracted(*zip(*roads), linked=60) is None
    assert labels.contracted([], [], []).costs(np.array([1, 1]), np.array([1, 2])).tolist() == [0.0, math.inf]


def test_hierarchy_from_one_place(spark, tmp_path, monkeypatch):
    """Times from place 0 need no search in rounds, and are the same where the labels are too large to be held."""
    d = mixed(spark, tmp_path, 20)
    want = least_times([(r["src"], r["dst"], r["ms"]) for r in directed(spark, d).filter("not access_only").collect()], 0)
    got = lambda: {r["v"]: r["time_ms"] for r in queries.Q["ch_routes"](spark, d).collect()}
    with monkeypatch.context() as m:
        m.setattr(queries, "meet", None)
        assert got() == want and len(want) > 5
    monkeypatch.setattr(queries, "hold_labels", lambda e: None)
    assert got() == want


def test_targets_stay_out_of_the_core(spark, monkeypatch):
    """The search from the targets climbs to the core and no further: it would reach all of it from each of them."""
    h = hierarchy.contract(build(grid(spark, 4)).edges, 1)
    ranks, seen = {r["v"]: r["rank"] for r in h.ranks.collect()}, []
    upward = hierarchy._upward
    monkeypatch.setattr(hierarchy, "_upward", lambda *a: seen.append(upward(*a)) or seen[-1])
    ends = spark.createDataFrame([(0, v) for v in ranks], "query_id long, v long")
    assert hierarchy.meet(h, ends.limit(1), ends, paths=False).count() == 16
    core = [v for v, r in ranks.items() if r == hierarchy.CORE_RANK]
    assert len(core) > 2 and seen[1].filter(F.col("query_id").isin(core) & (F.col("query_id") != F.col("v"))).count() == 0


def from_zero(spark, d, name, monkeypatch, weight, keep=lambda r: True):
    """A query's times from place 0, without rounds of joins, against plain relaxation."""
    want = least_times([(r["src"], r["dst"], weight(r)) for r in directed(spark, d).collect() if keep(r)], 0)
    got = lambda: {r["v"]: r["time_ms"] for r in queries.Q[name](spark, d).collect()}
    monkeypatch.setattr(queries, "search", None)
    assert got() == want and len(want) > 10


def test_times_from_one_place(spark, tmp_path, monkeypatch):
    from_zero(spark, mixed(spark, tmp_path, 40), "sssp", monkeypatch, lambda r: r["ms"])


def test_times_from_one_place_on_open_roads(spark, tmp_path, monkeypatch):
    from_zero(spark, mixed(spark, tmp_path, 40), "sssp_access", monkeypatch, lambda r: r["ms"], lambda r: not r["access_only"])


def test_times_from_one_place_without_tolls(spark, tmp_path, monkeypatch):
    from_zero(spark, mixed(spark, tmp_path, 40), "sssp_tolls", monkeypatch, lambda r: r["ms"] * (10**6 if r["tolls"] else 1))


def test_trips_by_labels(spark, tmp_path, monkeypatch):
    """A trip for every order without a search from each place; the searches give the same."""
    d = derived(spark, tmp_path, range(40), [k for k in range(80) if k % 10 not in (1, 3, 4, 6)])
    orders = [(k, k * 7 % 53 if k % 11 else None) for k in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    roads = [(r["src"], r["dst"], r["ms"]) for r in directed(spark, d).collect()]
    best = {a: least_times(roads, a) for a in range(40)}
    want = sorted((k, c if c is None else c % 40, k % 40, None if c is None else best[c % 40].get(k % 40)) for k, c in orders)
    got = lambda: sorted(map(tuple, queries.Q["point_routes"](spark, d).collect()))
    with monkeypatch.context() as m:
        m.setattr(queries, "search", None)
        m.setattr(queries, "search_held", None)
        assert got() == want and 0 < sum(x[3] is None and x[1] is not None for x in want) < 180
    monkeypatch.setattr(queries, "hold_labels", lambda e: None)
    assert got() == want


def test_times_from_one_place_with_conditions(spark, tmp_path, monkeypatch):
    from_zero(spark, mixed(spark, tmp_path, 40), "sssp_conditional_no_clock", monkeypatch, lambda r: r["ms"], lambda r: r["dist_m"] % 4 != 0)
