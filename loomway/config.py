"""Vehicle profiles and the fixed values of tag interpretation."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Assumed; results are compared within a tolerance.
EARTH_RADIUS_M = 6371000.0
SIGNAL_DELAY_S = 20.0
TOLL_PENALTY = 1e6
ALTERNATIVE_PENALTY = 1.6
FORMAT_VERSION = 5

# Tags and their meaning, as road data has them.
MOTOR_SPEED_KMH = {
    "motorway": 110.0, "trunk": 90.0, "primary": 80.0, "secondary": 60.0, "tertiary": 50.0,
    "residential": 40.0, "service": 20.0, "living_street": 10.0, "unclassified": 40.0, "track": 10.0,
}
BICYCLE_SPEED_KMH = {
    "primary": 15.0, "secondary": 15.0, "tertiary": 15.0, "residential": 15.0, "unclassified": 15.0, "service": 12.0, "living_street": 10.0,
    "cycleway": 16.0, "path": 12.0, "track": 12.0, "footway": 8.0, "bridleway": 8.0, "pedestrian": 8.0,
}
EXCLUDED_SERVICES = ("drive-through", "drive_through", "emergency_access", "bus", "slipway")
ACCESS_ONLY_SERVICES = ("driveway", "parking_aisle")
SERVICE_SPEED_KMH = {"driveway": 10.0, "parking_aisle": 10.0, "alley": 15.0}
ACCESS_ONLY_VALUES = ("destination", "customers", "delivery", "permit", "discouraged")
BLOCKED_VALUES = ("no", "private", "military", "emergency")
MOTOR_BLOCKED_VALUES = ("agricultural", "forestry")
OPEN_VALUES = ("yes", "permissive", "designated", "official")
NEEDS_BICYCLE_PERMISSION = ("footway", "pedestrian", "bridleway")
BICYCLE_INVITED = ("yes", "designated", "permissive")
TRACK_SPEED_KMH = {"grade1": 25.0, "grade2": 18.0, "grade3": 10.0, "grade4": 7.0, "grade5": 5.0}
UNTAGGED_TRACK_KMH = 10.0
MOTOR_BARRIERS = ("bollard", "block", "chain", "jersey_barrier", "planter", "debris", "bus_trap", "sump_buster", "height_restrictor", "motorcycle_barrier")
FULL_BARRIERS = ("cycle_barrier", "stile", "kissing_gate", "turnstile", "full-height_turnstile", "wall", "fence", "hedge", "ditch")
PASSABLE_BARRIERS = ("toll_booth", "border_control", "checkpoint", "sally_port", "cattle_grid", "entrance", "arch", "gateway", "no")
GATES = ("gate", "lift_gate", "swing_gate")
PRIVATE_CLASSES = ("service", "track")
MOVEMENTS = ("left_turn", "right_turn", "straight_on", "u_turn", "entry", "exit")
# End of the fixed values.


@dataclass(frozen=True)
class VehicleProfile:
    name: str
    speeds_kmh: dict[str, float] = field(hash=False)
    access_keys: tuple[str, ...]
    max_speed_kmh: float = 130.0
    default_speed_kmh: float = 40.0
    ignore_maxspeed: bool = False
    honor_oneway: bool = True
    exceptions: tuple[str, ...] = ()
    #: Reads the one-way tag meant for bicycles for motor vehicles too.
    legacy_oneway_bicycle: bool = False

    @property
    def highways(self) -> tuple[str, ...]:
        return tuple(self.speeds_kmh)

    @property
    def is_motor(self) -> bool:
        return "motor_vehicle" in self.access_keys


CAR = VehicleProfile("car", MOTOR_SPEED_KMH, ("motorcar", "motor_vehicle", "vehicle", "access"))
MOTORCYCLE = VehicleProfile("motorcycle", MOTOR_SPEED_KMH, ("motorcycle", "motor_vehicle", "vehicle", "access"))
BICYCLE = VehicleProfile("bicycle", BICYCLE_SPEED_KMH, ("bicycle", "vehicle", "access"), 25.0, ignore_maxspeed=True, honor_oneway=False, exceptions=("bicycle", "cycle"))
PROFILES = {p.name: p for p in (CAR, MOTORCYCLE, BICYCLE)}
