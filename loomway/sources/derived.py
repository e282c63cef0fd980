"""A road network made from the star-schema tables: suppliers are places on a grid ten wide, parts give the roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table
from ..model import GeoGraph

SPEEDS = (110, 90, 80, 60, 50, 40, 20, 10, 40)
CONDITION = "no_straight_on @ (Mo-Fr 07:00-09:00)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").cast("long").alias("nation"))
    return s.select("id", (F.lit(-23.5) + F.floor(F.col("id") / 10) * 0.01).alias("lat"), (F.lit(-46.7) + (F.col("id") % 10) * 0.01).alias("lon"), "nation")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``u, v, k, dist_m, kmh, oneway, tolls, acc``, one row per road."""
    s = places(spark, sf_dir).select("id")
    east = s.filter(F.col("id") % 10 < 9).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), (F.col("id") * 2).alias("k"))
    south = s.select(F.col("id").alias("u"), (F.col("id") + 10).alias("v"), (F.col("id") * 2 + 1).alias("k"))
    both = east.unionByName(south).join(s.withColumnRenamed("id", "v"), "v", "left_semi")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("size"))
    kmh = F.element_at(F.array(*(F.lit(x) for x in SPEEDS)), (F.col("size") % 9 + 1).cast("int"))
    return both.join(p, "k").select("u", "v", "k", (F.col("size") + 1000).alias("dist_m"), kmh.alias("kmh"), (F.col("k") % 7 == 0).alias("oneway"), (F.col("k") % 11 == 0).cast("int").alias("tolls"), (F.col("size") % 10 == 0).alias("acc"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn restrictions: from the place to the west, by every place, to the one south; every other one is an ``only``."""
    s = places(spark, sf_dir).select("id")
    r = s.filter((F.col("id") % 10).between(1, 9)).select((F.col("id") - 1).alias("from_id"), F.col("id").alias("via_id"), (F.col("id") + 10).alias("to_id"))
    for end in ("from_id", "to_id"):
        r = r.join(s.withColumnRenamed("id", end), end, "left_semi")
    return r.select("from_id", "via_id", "to_id", (F.col("via_id") % 2 == 1).alias("is_only"), F.when(F.col("via_id") % 3 == 0, CONDITION).alias("condition"))


def network(spark: SparkSession, sf_dir: str) -> GeoGraph:
    """The whole as a source's graph; signals stand where the nation's key is a multiple of 5."""
    p = places(spark, sf_dir)
    edges = roads(spark, sf_dir).select(
        F.col("u").alias("source_id"), F.col("v").alias("target_id"), F.col("dist_m").cast("double").alias("distance_m"), F.col("kmh").cast("double").alias("speed_kmh"), F.col("oneway").alias("one_way"), "tolls", F.col("acc").alias("access_only"),
        F.array().cast("array<long>").alias("shape"),
    )
    return GeoGraph(p.drop("nation"), edges, p.filter(F.col("nation") % 5 == 0).select("id"), turns(spark, sf_dir))


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges as searches take them, in whole milliseconds; ``src`` and ``dst`` are the suppliers' keys."""
    r = roads(spark, sf_dir).withColumn("ms", F.floor(F.col("dist_m") * 3600 / F.col("kmh")))
    one = lambda a, b, back: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("k") * 2 + back).alias("edge_id"))
    ways = F.when(F.col("oneway"), F.array(one("u", "v", 0))).otherwise(F.array(one("u", "v", 0), one("v", "u", 1)))
    return r.withColumn("w", F.explode(ways)).select("w.edge_id", "w.src", "w.dst", (F.col("ms") / 1000).alias("time_s"), F.col("dist_m").cast("double").alias("dist_m"), "tolls", F.lit(0).alias("signals"), F.col("acc").alias("access_only"), F.lit(None).cast("string").alias("condition"), F.col("ms").cast("long").alias("ms"))


#: The same in SQL: ``e(src, dst, k, dist_m, ms, tolls, acc)``.
EDGES_SQL = """
c AS (SELECT s_suppkey u, s_suppkey+1 v, 2*s_suppkey k FROM supplier WHERE s_suppkey % 10 < 9 AND s_suppkey+1 IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT s_suppkey, s_suppkey+10, 2*s_suppkey+1 FROM supplier WHERE s_suppkey+10 IN (SELECT s_suppkey FROM supplier)),
a AS (SELECT u, v, k, 1000+p_size dist_m, [110,90,80,60,50,40,20,10,40][(p_size % 9)+1] kmh, k % 7 = 0 oneway, (k % 11 = 0)::int tolls, p_size % 10 = 0 acc FROM c JOIN part ON p_partkey = k),
e AS (SELECT u src, v dst, k, dist_m, (dist_m*3600)//kmh ms, kmh, tolls, acc FROM a UNION ALL SELECT v, u, k, dist_m, (dist_m*3600)//kmh, kmh, tolls, acc FROM a WHERE NOT oneway)
"""
