"""Speeds, layers and congestion of roads and railways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetloom.functions.geo import js_round
from streetloom.functions.tags import eq, first_number, has, is_in

# ---- Fixed values ---------------------------------------------------------------------------------
RAIL_SPEED = {"rail": 100, "light_rail": 60, "subway": 60, "tram": 40, "narrow_gauge": 40, "monorail": 60,
              "funicular": 30, "preserved": 40}
ROAD_SPEED = {"motorway": 100, "motorway_link": 45, "trunk": 70, "trunk_link": 40, "primary": 55, "primary_link": 30,
              "secondary": 40, "secondary_link": 25, "tertiary": 30, "tertiary_link": 20, "unclassified": 25,
              "residential": 20, "living_street": 10, "service": 15, "track": 10, "busway": 45, "bus_guideway": 45,
              "road": 25, "pedestrian": 5}
ROAD_SPEED_OTHER = 25
BASE_CONGESTION = {"motorway": 0.9, "motorway_link": 0.85, "trunk": 0.8, "trunk_link": 0.8, "primary": 0.7,
                   "primary_link": 0.75, "secondary": 0.75, "secondary_link": 0.8, "tertiary": 0.8,
                   "tertiary_link": 0.85, "unclassified": 0.85, "residential": 0.8, "living_street": 0.9,
                   "service": 0.85, "track": 0.9, "busway": 0.9, "bus_guideway": 0.9, "road": 0.85, "pedestrian": 0.9}
BASE_CONGESTION_OTHER = 0.85
SPEED_CAP = {"residential": 40, "tertiary": 40, "tertiary_link": 40, "service": 40, "living_street": 20, "track": 20,
             "pedestrian": 10}
NO_DRIVING = ["footway", "path", "steps", "cycleway", "bridleway", "corridor", "construction", "proposed", "raceway",
              "platform", "elevator"]
ROAD_SPEED_MIN, ROAD_SPEED_MAX = 5, 110
JUNCTION_SCALE, JUNCTION_PRIOR_KM, CONGESTION_MIN = 12.0, 0.15, 0.25
# ----------------------------------------------------------------------------------------------------


def lookup(key: Column, table: dict, other=None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[key]
    return found if other is None else F.coalesce(found, F.lit(other))


def parse_maxspeed(text: Column, fallback: Column) -> Column:
    s = F.lower(F.trim(text))
    n = first_number(s)
    kmh = F.when(s.contains("mph"), n * 1.60934).otherwise(n)
    clamped = F.greatest(F.lit(5), F.least(F.lit(400), js_round(kmh)))
    return (F.when(s.isin("none", "signals"), F.lit(160)).when(n > 0, clamped)
            .otherwise(fallback)).cast("double")


def effective_layer(tags: Column) -> Column:
    n = first_number(tags["layer"], keep="0-9.\\-")
    return F.when(tags.isNull(), 0).when(n.isNotNull(), js_round(n)) \
        .when(is_in(tags, "bridge", ["yes", "viaduct", "boardwalk"]), 1) \
        .when(is_in(tags, "tunnel", ["yes", "building_passage"]) | eq(tags, "covered", "yes"), -1) \
        .otherwise(0).cast("int")


def rail_speed(tags: Column) -> Column:
    """km/h of a railway that passenger trains may use, NULL otherwise (yards and spurs are left out)."""
    kind = tags["railway"]
    speed = parse_maxspeed(tags["maxspeed"], lookup(kind, RAIL_SPEED).cast("double"))
    speed = speed * F.when(eq(tags, "tunnel", "yes"), 0.9).otherwise(1.0)
    return F.when(kind.isin(*RAIL_SPEED) & ~is_in(tags, "service", ["yard", "spur"]),
                  F.greatest(F.lit(15), js_round(speed))).cast("int")


def drivable(tags: Column) -> Column:
    kind = F.trim(tags["highway"])
    return F.coalesce(has(tags, "highway") & (kind != "") & ~kind.isin(*NO_DRIVING)
                      & ~eq(tags, "area", "yes") & ~has(tags, "construction"), F.lit(False))


def road_limit(tags: Column) -> Column:
    kind = F.trim(tags["highway"])
    limit = parse_maxspeed(tags["maxspeed"], lookup(kind, ROAD_SPEED, ROAD_SPEED_OTHER).cast("double"))
    return js_round(F.least(limit, F.coalesce(lookup(kind, SPEED_CAP), F.lit(400)).cast("double"))).cast("int")


def dedicated_lane(tags: Column) -> Column:
    return eq(tags, "bus", "yes") | eq(tags, "psv", "yes") | F.coalesce(
        F.trim(tags["highway"]).isin("busway", "bus_guideway"), F.lit(False))


def base_congestion(tags: Column) -> Column:
    return lookup(F.trim(tags["highway"]), BASE_CONGESTION, BASE_CONGESTION_OTHER)


def junction_congestion(base: Column, density: Column) -> Column:
    f = base / (F.greatest(F.lit(0.0), density) / JUNCTION_SCALE + 1)
    return F.greatest(F.lit(CONGESTION_MIN), F.least(F.lit(1.0), f))


def service_speed(limit: Column, congestion: Column) -> Column:
    return F.greatest(F.lit(ROAD_SPEED_MIN), F.least(F.lit(ROAD_SPEED_MAX), js_round(limit * congestion))).cast("int")


def congestion_level(congestion: Column) -> Column:
    return F.when(congestion >= 0.75, "free").when(congestion >= 0.5, "busy").otherwise("jam")
