"""The two levels of the data model, as bundles of DataFrames.

``GeoGraph`` is what a source delivers:
    nodes(id, lat, lon), edges(source_id, target_id, distance_m, speed_kmh, one_way, tolls, access_only, shape),
    signals(id), restrictions(from_id, via_id, to_id, is_only, condition)
``RoadGraph`` is what searches run on:
    vertices(v, original_id, lat, lon, split_parent),
    edges(edge_id, src, dst, time_s, dist_m, tolls, signals, access_only, condition, geom)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<struct<lat:double,lon:double>>"
NODES = "id long, lat double, lon double"
GEO_EDGES = "source_id long, target_id long, distance_m double, speed_kmh double, one_way boolean, tolls int, access_only boolean, shape array<long>"
RESTRICTIONS = "from_id long, via_id long, to_id long, is_only boolean, condition string"
VERTICES = "v long, original_id long, lat double, lon double, split_parent long"
EDGES = f"edge_id long, src long, dst long, time_s double, dist_m double, tolls int, signals int, access_only boolean, condition string, geom {POINTS}"
DEFAULTS = {"one_way": False, "tolls": 0, "access_only": False}


@dataclass(frozen=True)
class GeoGraph:
    nodes: DataFrame
    edges: DataFrame
    signals: DataFrame
    restrictions: DataFrame

    @staticmethod
    def of(spark: SparkSession, nodes, edges, signals=(), restrictions=()) -> GeoGraph:
        """From Python rows: nodes ``(id, lat, lon)``; edges and restrictions as dicts, with defaults for what is absent."""
        empty = {"one_way": False, "tolls": 0, "access_only": False, "shape": []}
        return GeoGraph(
            spark.createDataFrame([tuple(n) for n in nodes], NODES),
            spark.createDataFrame([tuple((empty | e)[f.split()[0]] for f in GEO_EDGES.split(", ")) for e in edges], GEO_EDGES),
            spark.createDataFrame([(s,) for s in signals], "id long"),
            spark.createDataFrame([tuple(({"is_only": False, "condition": None} | r)[f.split()[0]] for f in RESTRICTIONS.split(", ")) for r in restrictions], RESTRICTIONS),
        )


@dataclass(frozen=True)
class RoadGraph:
    vertices: DataFrame
    edges: DataFrame

    def describe(self) -> DataFrame:
        """Counts in one row."""
        v = self.vertices.agg(F.count("*").alias("vertices"), F.count("split_parent").alias("split_copies"))
        e = self.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("tolls") > 0).alias("toll_edges"), F.count_if(F.col("signals") > 0).alias("signal_edges"), F.count_if("access_only").alias("access_only_edges"), F.count("condition").alias("conditional_edges"))
        return v.crossJoin(e)  # one row each
