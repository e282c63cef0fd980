"""Tag rules and conditions on tables of cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomway.config import BICYCLE, CAR
from loomway.functions import conditions, tags


def told(spark, cases, make, kind="map<string,string>"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, t {kind}")
    return [r[0] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_access(spark):
    cases = [
        ({}, 2), ({"highway": "residential"}, 0), ({"highway": "service", "service": "driveway"}, 1), ({"highway": "service", "service": "bus"}, 2), ({"highway": "track"}, 1),
        ({"highway": "primary", "access": "private"}, 2), ({"highway": "service", "service": "driveway", "access": "yes"}, 0), ({"highway": "primary", "access": "destination"}, 1),
        ({"highway": "primary", "motorcar": "unheard", "access": "no"}, 0), ({"highway": "primary", "access": "forestry"}, 2), ({"highway": "primary", "access": "no", "motor_vehicle": "yes"}, 0),
    ]
    assert told(spark, [c for c, _ in cases], lambda t: tags.way_access(t, CAR)) == [x for _, x in cases]
    bike = [({"highway": "footway"}, 2), ({"highway": "footway", "bicycle": "yes"}, 0), ({"highway": "track"}, 0), ({"highway": "primary", "access": "forestry"}, 0)]
    assert told(spark, [c for c, _ in bike], lambda t: tags.way_access(t, BICYCLE)) == [x for _, x in bike]


def test_speed(spark):
    cases = [
        ({"highway": "primary"}, 80), ({"highway": "primary_link"}, 80), ({"highway": "primary", "maxspeed": "50"}, 50), ({"highway": "primary", "maxspeed": "30 mph"}, 30 * 1.609344), ({"highway": "motorway", "maxspeed": "200"}, 130),
        ({"highway": "service", "service": "alley"}, 15), ({"highway": "track", "tracktype": "grade1"}, 25), ({"highway": "track"}, 10), ({"highway": "primary", "maxspeed": "walk"}, 80), ({"highway": "service", "service": "driveway", "maxspeed": "50"}, 10),
    ]
    assert told(spark, [c for c, _ in cases], lambda t: tags.speed_kmh(t, CAR)) == pytest.approx([x for _, x in cases])
    assert told(spark, [{"highway": "cycleway", "maxspeed": "50"}, {"highway": "track"}], lambda t: tags.speed_kmh(t, BICYCLE)) == [16, 12]


def test_oneway(spark):
    cases = [({"oneway": "yes"}, 1), ({"oneway": "-1"}, -1), ({"highway": "motorway"}, 1), ({"highway": "motorway", "oneway": "no"}, 0), ({"junction": "roundabout"}, 1), ({}, 0), ({"oneway": "yes", "oneway:bicycle": "no"}, 1)]
    assert told(spark, [c for c, _ in cases], lambda t: tags.oneway(t, CAR)) == [x for _, x in cases]
    bike = [({"oneway": "yes"}, 0), ({"oneway:bicycle": "yes"}, 1), ({"oneway:bicycle": "reverse"}, -1)]
    assert told(spark, [c for c, _ in bike], lambda t: tags.oneway(t, BICYCLE)) == [x for _, x in bike]


def test_barriers(spark):
    cases = [
        ({}, True), ({"barrier": "bollard"}, False), ({"barrier": "bollard", "motor_vehicle": "yes"}, True), ({"barrier": "gate", "locked": "yes", "access": "yes"}, False), ({"barrier": "gate"}, True), ({"barrier": "toll_booth"}, True),
        ({"barrier": "wall"}, False), ({"barrier": "strange"}, False), ({"barrier": "gate", "access": "private"}, False), ({"barrier": "gate", "access": "odd"}, True),
    ]
    assert told(spark, [c for c, _ in cases], lambda t: tags.barrier_passes(t, CAR, F.lit("residential"))) == [x for _, x in cases]
    assert told(spark, [{"barrier": "gate"}], lambda t: tags.barrier_passes(t, CAR, F.lit("service"))) == [False]
    assert told(spark, [{"barrier": "bollard"}, {"barrier": "stile"}], lambda t: tags.barrier_passes(t, BICYCLE, F.lit("residential"))) == [True, False]


def test_bans_and_signals(spark):
    cases = [("no_left_turn", "no"), ("only_straight_on", "only"), ("No-Left Turn", "no"), ("no_left_turn;only_right_turn", None), ("no_left_turn @ (Mo-Fr)", "no"), ("no_flying", None), ("no_left_turn;foo", "no")]
    assert told(spark, [c for c, _ in cases], tags.ban_kind, "string") == [x for _, x in cases]
    assert told(spark, [{"highway": "traffic_signals"}, {"highway": "crossing", "crossing": "traffic_signals"}, {"highway": "crossing"}, {}], tags.is_signal) == [True, True, False, False]
    assert told(spark, ["psv;Bicycle", "psv", None], lambda t: tags.excepted(t, BICYCLE), "string") == [True, False, False]
    assert told(spark, ["psv;bicycle"], lambda t: tags.excepted(t, CAR), "string") == [False]


MONDAY, SUNDAY, SATURDAY = (2026, 9, 14), (2026, 9, 13), (2026, 9, 12)
IN_FORCE = [
    ("no_left_turn @ (Mo-Fr 07:00-09:00)", (*MONDAY, 8, 0), True), ("no_left_turn @ (Mo-Fr 07:00-09:00)", (*MONDAY, 9, 0), False), ("no_left_turn @ (Mo-Fr 07:00-09:00)", (*SUNDAY, 8, 0), False),
    ("x @ (24/7)", (*SUNDAY, 3, 0), True), ("x @ (22:00-06:00)", (*SUNDAY, 23, 0), True), ("x @ (22:00-06:00)", (*SUNDAY, 12, 0), False), ("x @ (Sa-Mo)", (*SUNDAY, 12, 0), True), ("x @ (Mo,We)", (*SUNDAY, 12, 0), False),
    ("x @ (Mo-Fr 07:00-09:00; Sa 10:00-12:00)", (*SATURDAY, 11, 0), True), ("x @ (sunset-sunrise)", (*SUNDAY, 12, 0), True), ("x", (*SUNDAY, 12, 0), True), ("x @ (Mo 07:00-09:00)", None, True),
    ("x @ (07:00-09:00,16:00-18:00)", (*SUNDAY, 17, 0), True), ("x @ (07:00-09:00, 16:00-18:00)", (*SUNDAY, 12, 0), True), ("x @ (25:00-26:00)", (*SUNDAY, 12, 0), True), ("x @ Mo 08:00-08:00", (*MONDAY, 8, 0), False),
    ("x @ ()", (*MONDAY, 8, 0), True), ("x @ (Mo 22:00-06:00)", (*MONDAY, 3, 0), True), ("x @ (wet)", (*MONDAY, 3, 0), True), ("x @ (Tu)", (*MONDAY, 3, 0), False),
]


def test_conditions(spark):
    df = spark.createDataFrame([(i, e, datetime(*at) if at else None) for i, (e, at, _) in enumerate(IN_FORCE)], "i int, e string, at timestamp_ntz")
    got = [r[0] for r in df.select("i", conditions.in_force(F.col("e"), F.col("at")).alias("x")).orderBy("i").select("x").collect()]
    assert got == [x for _, _, x in IN_FORCE]
