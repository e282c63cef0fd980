"""Distances, travel times and the planar projection, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def travel_time_s(dist_m: Column, speed_kmh: Column) -> Column:
    """Seconds; infinite where the speed is not above 0."""
    return F.when(speed_kmh > 0, dist_m / (speed_kmh / 3.6)).otherwise(F.lit(float("inf")))


def projected(lat: Column, lon: Column, cos_ref: Column) -> tuple[Column, Column]:
    """Metres east and north; ``cos_ref``: cosine of the mean latitude of what is indexed."""
    return lon * METRES_PER_DEGREE * cos_ref, lat * METRES_PER_DEGREE


def duration_us(time_s: Column) -> Column:
    return F.round(time_s * 1e6).cast("long")
