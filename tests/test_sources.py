"""Reading tagged elements and PBF files, and storing graphs."""

import lzma
import struct
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from loomway.config import BICYCLE
from loomway.model import GeoGraph
from loomway.operators.build import build
from loomway.operators.split import split
from loomway.sources import osm, pbf
from loomway.sources.store import GraphFormatError, GraphStore, SplitGraphError

NODE_KIND, WAY_KIND = "id long, lat double, lon double, tags map<string,string>", "id long, node_ids array<long>, tags map<string,string>"
RELATION_KIND = "id long, members array<struct<type:int,ref:long,role:string>>, tags map<string,string>"


def read(spark, ways, node_tags=None, relations=(), n=4, **options):
    nodes = [(i, -23.5, -46.7 + i * 0.001, (node_tags or {}).get(i, {})) for i in range(1, n + 1)]
    return osm.to_geo_graph(
        spark.createDataFrame([(i, list(ids), tags) for i, (ids, tags) in enumerate(ways, 10)], WAY_KIND), spark.createDataFrame(nodes, NODE_KIND),
        spark.createDataFrame([(i, m, {"type": "restriction"} | t) for i, (m, t) in enumerate(relations, 100)], RELATION_KIND), **options,
    )


def steps(graph):
    return sorted((r["source_id"], r["target_id"], r["one_way"]) for r in graph.edges.collect())


def test_ways(spark):
    g, _ = read(spark, [((1, 2, 3), {"highway": "residential", "oneway": "-1"}), ((3, 4), {"highway": "footway"}), ((3, 4), {"highway": "primary", "area": "yes"}), ((4, 9), {"highway": "primary"}), ((4, 4), {"highway": "primary"})])
    assert steps(g) == [(2, 1, True), (3, 2, True)]


def test_barriers(spark):
    g, _ = read(spark, [((1, 2, 3, 4), {"highway": "residential"})], {3: {"barrier": "bollard"}})
    assert steps(g) == [(-1, 4, False), (1, 2, False), (2, 3, False)]
    places = {r["id"]: (r["lat"], r["lon"]) for r in g.nodes.collect()}
    assert places[-1] == places[3]
    assert steps(read(spark, [((1, 2, 3, 4), {"highway": "residential"})], {3: {"barrier": "bollard"}}, profile=BICYCLE)[0]) == [(1, 2, False), (2, 3, False), (3, 4, False)]
    assert len(steps(read(spark, [((1, 2, 3, 4), {"highway": "residential"})], {3: {"barrier": "bollard"}}, read_barriers=False)[0])) == 3


def test_restrictions(spark):
    m = lambda via=3, kind=0: [(1, 10, "from"), (kind, via, "via"), (1, 11, "to")]
    ways = [((1, 2, 3), {"highway": "residential"}), ((3, 4), {"highway": "residential"})]
    rel = [
        (m(), {"restriction": "no_left_turn"}), (m(), {"restriction": "no_u_turn", "restriction:conditional": "only_right_turn @ (Mo)"}), (m(), {"restriction": "no_flying"}), (m(11, 1), {"restriction": "no_left_turn"}),
        (m(2), {"restriction": "no_left_turn"}), (m(), {"restriction": "no_left_turn", "except": "bicycle"}), (m(), {}), (m(77), {"restriction": "no_left_turn"}),
    ]
    g, stats = read(spark, ways, relations=rel)
    got = sorted((r["from_id"], r["via_id"], r["to_id"], r["is_only"], r["condition"] or "") for r in g.restrictions.collect())
    assert got == [(2, 3, 4, False, ""), (2, 3, 4, False, ""), (2, 3, 4, False, ""), (2, 3, 4, True, "only_right_turn @ (Mo)")]
    assert stats.first().asDict() == {"accepted": 4, "conditions": 1, "skipped_via_way": 1, "unresolved": 4, "ambiguous": 0, "excepted": 0}
    assert read(spark, ways, relations=rel, profile=BICYCLE)[1].first()["excepted"] == 1
    inner = [((1, 2, 3, 4), {"highway": "residential"}), ((3, 4), {"highway": "residential"})]
    assert read(spark, inner, relations=rel[:1])[1].first()["ambiguous"] == 1


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return varint(n << 1 if n >= 0 else (-n << 1) - 1)


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def deltas(xs):
    return b"".join(zig(b - a) for a, b in zip([0, *xs], xs))


@pytest.mark.parametrize("packed", ["raw", "zlib", "lzma", "zstd"])
def test_pbf(spark, tmp_path, packed):
    text = [b"", b"highway", b"residential", b"via", b"barrier", b"gate"]
    at = [(-23.5, -46.7), (-23.49, -46.7), (-23.49, -46.69)]
    dense = field(1, deltas([1, 2, 3])) + field(8, deltas([round(a * 1e7) for a, _ in at])) + field(9, deltas([round(b * 1e7) for _, b in at])) + field(10, varint(0) + varint(4) + varint(5) + varint(0) + varint(0))
    way = field(1, 10) + field(2, varint(1)) + field(3, varint(2)) + field(8, deltas([1, 2, 3]))
    relation = field(1, 100) + field(8, varint(3)) + field(9, deltas([2])) + field(10, varint(0))
    one = lambda n: (n << 1) ^ (n >> 63)
    plain = field(1, one(-7)) + field(2, varint(4)) + field(3, varint(5)) + field(8, one(round(-23.4 * 1e7))) + field(9, one(round(-46.6 * 1e7)))
    blocks = [field(1, b"".join(field(1, s) for s in text)) + x for x in (field(2, field(2, dense)) + field(2, field(1, plain)), field(2, field(3, way) + field(4, relation)))]
    store = {"raw": lambda b: field(1, b), "zlib": lambda b: field(2, len(b)) + field(3, zlib.compress(b)), "lzma": lambda b: field(2, len(b)) + field(4, lzma.compress(b)), "zstd": lambda b: field(2, len(b)) + field(7, zstandard.compress(b))}
    data = b""
    for blob in (field(1, b""), *map(store[packed], blocks)):
        head = field(1, b"OSMData" if data else b"OSMHeader") + field(3, len(blob))
        data += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.osm.pbf").write_bytes(data)
    with pytest.raises(ValueError, match="compression"):
        pbf.unpacked(field(6, b"x"))
    got = {(r["kind"], r["id"]): r for r in pbf.read_pbf(spark, str(tmp_path)).collect()}
    assert got["node", 3]["lon"] == pytest.approx(-46.69) and got["node", 2]["tags"] == {"barrier": "gate"}
    assert got["node", -7]["lat"] == pytest.approx(-23.4) and got["node", -7]["tags"] == {"barrier": "gate"}
    assert got["way", 10]["node_ids"] == [1, 2, 3] and got["way", 10]["tags"] == {"highway": "residential"}
    assert [tuple(m) for m in got["relation", 100]["members"]] == [(0, 2, "via")]
    assert pbf.PbfSource(spark, str(tmp_path)).load_graph().edges.count() == 2


def graph(spark, **more):
    edges = [{"source_id": a, "target_id": a + 1, "distance_m": 100.0, "speed_kmh": 36.0} for a in (1, 2, 3)]
    return GeoGraph.of(spark, [(i, 0.0, i * 0.001) for i in range(1, 5)], edges, **more)


def test_store(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path))
    assert s.load("a/b") is None and not s.exists("a/b")
    s.delete("a/b")
    s.save_graph("a/b", graph(spark))
    s.save_graph("a/b", graph(spark), "bicycle")
    assert s.exists("a/b") and s.load("a/b").edges.count() == 6
    back = s.load_graph("a/b")
    assert back.edges.filter("abs(speed_kmh - 36) < 1e-9 and one_way").count() == 6
    s.delete("a/b")
    assert not s.exists("a/b") and s.exists("a/b", "bicycle")
    made = []
    make = lambda: made.append(1) or graph(spark)
    assert [s.load_or_compile("e", make, compressed=False).edges.count() for _ in range(2)] == [6, 6] and len(made) == 1
    road, _ = split(build(graph(spark)), graph(spark, restrictions=[{"from_id": 1, "via_id": 2, "to_id": 3}]).restrictions)
    s.save("c", road)
    with pytest.raises(SplitGraphError):
        s.load_graph("c")
    meta = spark.read.parquet(s.path("c", "car") + "/meta").collect()
    df = spark.createDataFrame(meta).withColumn("format_version", F.lit(4))
    df.write.mode("overwrite").parquet(s.path("c", "car") + "/meta")
    with pytest.raises(GraphFormatError):
        s.load("c")
    s.save("d", road)
    road.edges.limit(1).write.mode("overwrite").parquet(s.path("d", "car") + "/edges")
    with pytest.raises(GraphFormatError):
        s.load("d")


def test_counts_of_all_steps(spark):
    g = graph(spark, restrictions=[{"from_id": 1, "via_id": 2, "to_id": 3}, {"from_id": 9, "via_id": 2, "to_id": 3}])
    read = spark.createDataFrame([(2, 0)], "accepted long, ambiguous long")
    road, counts = osm.compile_with_counts(g, read, compressed=False)
    c = counts.first().asDict()
    assert (c["accepted"], c["unresolved"], c["applied"] + c["contradictory"]) == (2, 1, 1)
    assert {"vertex_reduction", "edges_after", "copies"} <= set(osm.compile_with_counts(g)[1].columns)
