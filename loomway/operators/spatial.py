"""Nearest and radius joins of points with vertices, by grid cells and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import materialize
from ..functions.geo import METRES_PER_DEGREE, haversine_m

#: A cell has about this many vertices at first.
PER_CELL = 2.0


def _indexed(vertices: DataFrame) -> tuple[DataFrame, float, tuple]:
    """Vertices with projected places (split copies stay out), the cosine used, and the extent."""
    own = vertices.filter("split_parent is null") if "split_parent" in vertices.columns else vertices
    s = own.agg(F.avg("lat"), F.count("*"), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    cos = math.cos(math.radians(s[0] or 0.0))
    return own.select("v", "lat", "lon", (F.col("lon") * METRES_PER_DEGREE * cos).alias("x"), (F.col("lat") * METRES_PER_DEGREE).alias("y")), cos, s


def _meet(points: DataFrame, index: DataFrame, cos: float, size: float) -> DataFrame:
    """Pairs in the same or neighbouring cells, with the squared planar distance ``d2``."""
    cell = lambda c: F.floor(F.col(c) / size)
    p = points.withColumn("px", F.col("p_lon") * METRES_PER_DEGREE * cos).withColumn("py", F.col("p_lat") * METRES_PER_DEGREE)
    p = p.withColumn("cx", F.explode(F.sequence(cell("px") - 1, cell("px") + 1))).withColumn("cy", F.explode(F.sequence(cell("py") - 1, cell("py") + 1)))
    near = p.join(index.withColumn("cx", cell("x")).withColumn("cy", cell("y")), ["cx", "cy"])
    return near.withColumn("d2", F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))


def _points(points: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    return points.select(F.col(key).alias("key"), F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon")).filter("p_lat is not null and p_lon is not null")


def nearest(points: DataFrame, vertices: DataFrame, key: str = "id", lat: str = "lat", lon: str = "lon", max_m: float | None = None) -> DataFrame:
    """``key, v, dist_m``: the nearest vertex in the plane (ties: the lower), its haversine distance; no row beyond ``max_m``.

    Points whose nearest lies within a cell's width are done; the others look again with cells four times as wide."""
    index, cos, (_, n, lat0, lat1, lon0, lon1) = _indexed(vertices)
    left = _points(points, key, lat, lon)
    if not n:
        return left.select("key", F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("dist_m")).filter("v is not null")
    high, wide = ((b - a) * METRES_PER_DEGREE + 1 for a, b in ((lat0, lat1), (lon0, lon1)))
    size, found = math.sqrt(high * wide * PER_CELL / n), None
    ends = left.agg(F.min("p_lat"), F.max("p_lat"), F.min("p_lon"), F.max("p_lon")).first()
    if ends[0] is None:
        return left.select("key", F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("dist_m"))
    reach = METRES_PER_DEGREE * (max(lat1, ends[1]) - min(lat0, ends[0]) + max(lon1, ends[3]) - min(lon0, ends[2])) + 1
    while True:
        best = _meet(left, index, cos, size).groupBy("key", "p_lat", "p_lon").agg(F.min(F.struct("d2", "v", "lat", "lon")).alias("b"))
        best = materialize(best.filter(F.col("b.d2") <= size * size))
        found = best if found is None else found.unionByName(best)
        if size > reach:
            break
        left = materialize(left.join(best, "key", "left_anti"))
        if not left.take(1):
            break
        size *= 4
    out = found.select("key", F.col("b.v").alias("v"), haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("b.lat"), F.col("b.lon")).alias("dist_m"))
    return out if max_m is None else out.filter(F.col("dist_m") <= max_m)


def within(points: DataFrame, vertices: DataFrame, radius_m: float, key: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``key, v, planar_m``: all vertices within the radius in the plane, the rim included; nearest first per key."""
    index, cos, _ = _indexed(vertices)
    near = _meet(_points(points, key, lat, lon), index, cos, max(radius_m, 1e-3)).filter(F.col("d2") <= radius_m * radius_m)
    return near.select("key", "v", F.sqrt("d2").alias("planar_m")).sort("key", "planar_m", "v")
