"""What road tags mean for a vehicle profile, as column expressions over a map of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..config import VehicleProfile

#: Access, ordered by strictness; the stricter of two is their ``greatest``.
OPEN, ACCESS_ONLY, BLOCKED = 0, 1, 2
MILE_KM = 1.609344


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def low(tags: Column, key: str) -> Column:
    return F.lower(tag(tags, key))


def looked_up(key: Column, values: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def strictest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def normalize_highway(highway: Column, profile: VehicleProfile) -> Column:
    """The class without ``_link``, or null if the profile does not use it. Case matters."""
    base = F.regexp_replace(highway, "_link$", "")
    return F.when(base.isin(*profile.highways), base)


def parse_maxspeed(value: Column) -> Column:
    text = F.lower(F.trim(value))
    number = F.regexp_extract(text, r"^(\d+(\.\d+)?)", 1).try_cast("double")
    return F.when(text.contains("mph"), number * MILE_KM).otherwise(number)


def special_speed(tags: Column, profile: VehicleProfile) -> Column:
    """Speed of service roads and, for motor vehicles, tracks; null for all else."""
    highway = low(tags, "highway")
    speed = F.when(highway == "service", looked_up(low(tags, "service"), C.SERVICE_SPEED_KMH))
    if profile.is_motor:
        speed = speed.when(highway == "track", F.coalesce(looked_up(low(tags, "tracktype"), C.TRACK_SPEED_KMH), F.lit(C.UNTAGGED_TRACK_KMH)))
    return speed


def speed_kmh(tags: Column, profile: VehicleProfile) -> Column:
    by_class = looked_up(F.regexp_replace(tag(tags, "highway"), "_link$", ""), profile.speeds_kmh)
    signed = [] if profile.ignore_maxspeed else [parse_maxspeed(tag(tags, "maxspeed"))]
    return F.least(F.coalesce(special_speed(tags, profile), *signed, by_class, F.lit(profile.default_speed_kmh)), F.lit(profile.max_speed_kmh))


def oneway(tags: Column, profile: VehicleProfile) -> Column:
    """1 along the way, -1 against it, 0 both."""

    def said(value: Column) -> Column:
        return F.when(value.isin("yes", "true", "1"), 1).when(value.isin("-1", "reverse"), -1).when(value.isin("no", "false", "0"), 0)

    implied = F.when(tag(tags, "highway").isin("motorway", "motorway_link") | tag(tags, "junction").isin("roundabout", "circular"), 1)
    general = F.coalesce(said(tag(tags, "oneway")), implied, F.lit(0)) if profile.honor_oneway else F.lit(0)
    if profile.is_motor and not profile.legacy_oneway_bicycle:
        return general
    return F.coalesce(said(tag(tags, "oneway:bicycle")), general)


def tolls(tags: Column) -> Column:
    return F.coalesce(tag(tags, "toll").isin("yes", "true", "1"), F.lit(False)).cast("int")


def access_value(tags: Column, profile: VehicleProfile) -> Column:
    """What the first access key present says; null if none is, or its value is unknown."""
    value = F.lower(F.coalesce(*(tag(tags, k) for k in profile.access_keys)))
    blocked = C.BLOCKED_VALUES + (C.MOTOR_BLOCKED_VALUES if profile.is_motor else ())
    return F.when(value.isin(*blocked), BLOCKED).when(value.isin(*C.ACCESS_ONLY_VALUES), ACCESS_ONLY).when(value.isin(*C.OPEN_VALUES), OPEN)


def way_access(tags: Column, profile: VehicleProfile) -> Column:
    highway, service, said = low(tags, "highway"), low(tags, "service"), access_value(tags, profile)
    by_class = F.when((highway == "service") & service.isin(*C.ACCESS_ONLY_SERVICES), ACCESS_ONLY)
    rule = F.when(highway.isNull() | ((highway == "service") & service.isin(*C.EXCLUDED_SERVICES)), BLOCKED).when(said == BLOCKED, BLOCKED)
    if profile.is_motor:
        by_class = by_class.when(highway == "track", ACCESS_ONLY)
    else:
        invited = F.coalesce(low(tags, "bicycle").isin(*C.BICYCLE_INVITED), F.lit(False))
        rule = rule.when(highway.isin(*C.NEEDS_BICYCLE_PERMISSION) & ~invited, BLOCKED)
    return rule.when(said == OPEN, OPEN).otherwise(strictest(by_class.otherwise(OPEN), F.coalesce(said, F.lit(OPEN))))


def barrier_passes(tags: Column, profile: VehicleProfile, highway: Column) -> Column:
    """Whether a node with these tags, on a way of this class, lets the profile through."""
    barrier = low(tags, "barrier")
    way = F.map_from_arrays(F.array(F.lit("highway")), F.array(highway))
    own = F.coalesce(tags, F.create_map().cast("map<string,string>"))
    joined = F.map_concat(F.map_filter(way, lambda k, v: ~F.map_contains_key(own, k)), own)
    named = F.coalesce(*(tag(tags, k) for k in profile.access_keys)).isNotNull()
    return (
        F.when(barrier.isNull(), True)
        .when(low(tags, "locked") == "yes", False)
        .when(way_access(joined, profile) == BLOCKED, False)
        .when(named, True)
        .when(barrier.isin(*C.PASSABLE_BARRIERS), True)
        .when(barrier.isin(*C.FULL_BARRIERS), False)
        .when(barrier.isin(*C.MOTOR_BARRIERS), not profile.is_motor)
        .when(barrier.isin(*C.GATES), ~highway.isin(*C.PRIVATE_CLASSES))
        .otherwise(False)
    )


def is_signal(tags: Column) -> Column:
    crossing = (tag(tags, "highway") == "crossing") & ((tag(tags, "crossing") == "traffic_signals") | (tag(tags, "crossing:signals") == "yes"))
    return F.coalesce((tag(tags, "highway") == "traffic_signals") | crossing, F.lit(False))


def ban_kind(value: Column) -> Column:
    """``no`` or ``only``, whichever the readable parts before any ``@`` all say; null if none or both."""
    parts = F.transform(F.split(F.split(value, "@")[0], ";"), lambda p: F.regexp_replace(F.lower(F.trim(p)), r"[\s\-]+", "_"))
    kinds = F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_extract(p, f"^(no|only)_({'|'.join(C.MOVEMENTS)})$", 1)), lambda k: k != ""))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))


def excepted(value: Column, profile: VehicleProfile) -> Column:
    listed = F.transform(F.split(value, ";"), lambda p: F.lower(F.trim(p)))
    return F.coalesce(F.arrays_overlap(listed, F.array(*(F.lit(e) for e in profile.exceptions or ("",)))), F.lit(False)) & F.lit(bool(profile.exceptions))


def routable(tags: Column, node_ids: Column, profile: VehicleProfile) -> Column:
    return (
        F.coalesce(normalize_highway(tag(tags, "highway"), profile).isNotNull(), F.lit(False))
        & ~F.coalesce(tag(tags, "area") == "yes", F.lit(False))
        & (way_access(tags, profile) != BLOCKED)
        & (F.size(node_ids) >= 2)
    )
