"""Compiled graphs as Parquet, by graph id and profile, with a version and checksums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..config import FORMAT_VERSION
from ..model import GeoGraph, RoadGraph
from .osm import compile_graph


class GraphFormatError(ValueError):
    """A stored graph that is of another version, damaged or inconsistent."""


class SplitGraphError(RuntimeError):
    """A graph with split junctions cannot be turned back into its source."""


def checksum(df: DataFrame) -> int:
    """Sum of the rows' CRCs: the same whatever the order and the partitions."""
    return int(df.agg(F.coalesce(F.sum(F.crc32(F.to_json(F.struct("*")).cast("binary")).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()[0]) & ((1 << 63) - 1)


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, graph_id: str, profile: str) -> str:
        return f"{self.root}/{graph_id.replace('/', '_').replace(chr(92), '_')}/profile={profile}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, graph_id: str, profile: str = "car") -> bool:
        fs, p = self._fs(self.path(graph_id, profile) + "/meta")
        return fs.exists(p)

    def delete(self, graph_id: str, profile: str = "car") -> None:
        fs, p = self._fs(self.path(graph_id, profile))
        fs.delete(p, True)

    def save(self, graph_id: str, graph: RoadGraph, profile: str = "car") -> None:
        """Writes vertices and edges, and the meta row last: without it the graph does not exist."""
        self.delete(graph_id, profile)
        at = self.path(graph_id, profile)
        graph.vertices.write.parquet(f"{at}/vertices")
        graph.edges.write.parquet(f"{at}/edges")
        v, e = self.spark.read.parquet(f"{at}/vertices"), self.spark.read.parquet(f"{at}/edges")
        meta = [(FORMAT_VERSION, __version__, profile, v.count(), e.count(), checksum(v), checksum(e))]
        kind = "format_version int, engine_version string, profile_name string, node_count long, edge_count long, vertex_checksum long, edge_checksum long"
        self.spark.createDataFrame(meta, kind).withColumn("created_at", F.current_timestamp()).coalesce(1).write.parquet(f"{at}/meta")

    def load(self, graph_id: str, profile: str = "car") -> RoadGraph | None:
        """The graph, or None if there is none. Refuses other versions, damaged files, and edges without a vertex."""
        if not self.exists(graph_id, profile):
            return None
        at = self.path(graph_id, profile)
        meta = self.spark.read.parquet(f"{at}/meta").first()
        if meta["format_version"] != FORMAT_VERSION:
            raise GraphFormatError(f"{graph_id}: format {meta['format_version']}, expected {FORMAT_VERSION}")
        try:
            g = RoadGraph(self.spark.read.parquet(f"{at}/vertices"), self.spark.read.parquet(f"{at}/edges"))
            sums = checksum(g.vertices), checksum(g.edges)
        except Exception as e:
            raise GraphFormatError(f"{graph_id}: unreadable") from e
        if sums != (meta["vertex_checksum"], meta["edge_checksum"]):
            raise GraphFormatError(f"{graph_id}: checksum")
        ends = g.edges.select(F.explode(F.array("src", "dst")).alias("v"))
        if ends.join(g.vertices, "v", "left_anti").take(1):
            raise GraphFormatError(f"{graph_id}: an edge ends at no vertex")
        return g

    def save_graph(self, graph_id: str, graph: GeoGraph, profile: str = "car") -> None:
        """Compiles a source's graph, uncompressed, and saves it."""
        self.save(graph_id, compile_graph(graph, compressed=False), profile)

    def load_or_compile(self, graph_id: str, make: Callable[[], GeoGraph], profile: str = "car", compressed: bool = True) -> RoadGraph:
        """The stored graph; where there is none, or none that can be read, ``make``'s is compiled and stored first."""
        try:
            found = self.load(graph_id, profile)
        except GraphFormatError:
            found = None
        if found is None:
            self.save(graph_id, compile_graph(make(), compressed), profile)
            found = self.load(graph_id, profile)
        return found

    def load_graph(self, graph_id: str, profile: str = "car") -> GeoGraph | None:
        """Back to a source's graph, as far as that goes: every edge one-way, signal delays part of the speed, geometry,
        signals and conditions lost. Not for graphs with split junctions."""
        g = self.load(graph_id, profile)
        if g is None:
            return None
        if g.vertices.filter("split_parent is not null").take(1):
            raise SplitGraphError(f"{graph_id}: turn restrictions have split junctions")
        at = lambda end, name: g.vertices.select(F.col("v").alias(end), F.col("original_id").alias(name))
        e = g.edges.join(at("src", "source_id"), "src").join(at("dst", "target_id"), "dst")
        speed = F.when(F.col("time_s") > 0, F.when(F.col("time_s") < float("inf"), F.col("dist_m") / F.col("time_s") * 3.6).otherwise(0.0)).otherwise(0.0)
        edges = e.select("source_id", "target_id", F.col("dist_m").alias("distance_m"), speed.alias("speed_kmh"), F.lit(True).alias("one_way"), "tolls", "access_only", F.array().cast("array<long>").alias("shape"))
        none = self.spark.createDataFrame([], "id long")
        bans = self.spark.createDataFrame([], "from_id long, via_id long, to_id long, is_only boolean, condition string")
        return GeoGraph(g.vertices.select(F.col("original_id").alias("id"), "lat", "lon"), edges, none, bans)
