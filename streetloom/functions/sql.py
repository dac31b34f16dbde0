"""The scalar rules as temporary SQL functions, for people who write SQL.

    register(spark)
    spark.sql("SELECT way_road_class(tags), way_lod_zoom(tags) FROM ways")
    spark.sql("SELECT tile FROM tiles_of_box(39.7, 39.9, 116.1, 116.4, 6, 39.75, 39.8, 116.2, 116.3)")
    spark.sql("SELECT cell_y, cell_x, w FROM points, LATERAL cells_of_radius(lat, lon, 900, 500)")

Each rule is written once, as a Column. Its SQL body is what the analyser makes of that Column over the function's arguments, so Catalyst inlines it and both
give the same values. Rules with lambdas (line and area classes with their three-key names) have no SQL text and are Columns only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from streetloom.functions import demand as D, geo as G, roads as R, tags as T

TAGS = "tags MAP<STRING, STRING>"


@dataclass(frozen=True)
class Rule:
    """``arguments``: names and types as in DDL; ``column`` builds the rule from their columns, in that order."""

    name: str
    arguments: str
    column: Callable[..., Column]

    def names(self) -> list[str]:
        return [a.split(" ", 1)[0] for a in self.arguments.replace("MAP<STRING, STRING>", "MAP").split(", ")]

    def over(self, *args: Column) -> Column:
        return self.column(*args)


def _withheld(tags: Column, zoom: Column, area_m2: Column, closed: Column) -> Column:
    return T.lod_withhold(tags, zoom, area_m2, closed)


RULES = [
    Rule("way_road_class", TAGS, lambda t: T.lod_keys(t)[0]),
    Rule("way_lod_zoom", TAGS, lambda t: T.lod_keys(t)[1]),
    Rule("line_min_zoom", TAGS, T.min_zoom_line),
    Rule("point_min_zoom", TAGS, T.min_zoom_point),
    Rule("line_visible", f"{TAGS}, zoom INT", lambda t, z: T.lod_visible(t, z)),
    Rule("point_visible", f"{TAGS}, zoom INT", lambda t, z: T.lod_visible(t, z, "point")),
    Rule("withheld_class", f"{TAGS}, zoom INT, area_m2 DOUBLE, closed BOOLEAN", _withheld),
    Rule("never_send_class", TAGS, T.never_send_class),
    Rule("road_send_rank", "zoom INT", T.road_send_rank),
    Rule("landuse_min_area", "zoom INT", T.landuse_min_area),
    Rule("feature_category", TAGS, T.category_of),
    Rule("label_priority", TAGS, T.label_priority),
    Rule("line_family", "cls STRING", T.line_family),
    Rule("line_always", "cls STRING", T.line_always),
    Rule("area_family", "cls STRING", T.area_family),
    Rule("station_kind", TAGS, T.station_kind),
    Rule("station_name", f"{TAGS}, kind STRING, ident BIGINT", T.station_name),
    Rule("effective_floors", TAGS, T.effective_floors),
    Rule("building_value", TAGS, T.building_value),
    Rule("effective_layer", TAGS, R.effective_layer),
    Rule("drivable", TAGS, R.drivable),
    Rule("road_limit", TAGS, R.road_limit),
    Rule("rail_speed", TAGS, R.rail_speed),
    Rule("base_congestion", TAGS, R.base_congestion),
    Rule("service_speed", "limit_kmh INT, congestion DOUBLE", R.service_speed),
    Rule("congestion_level", "congestion DOUBLE", R.congestion_level),
    Rule("band_of", "meters DOUBLE", D.band_of),
    Rule("distance_weight", "meters DOUBLE", D.distance_weight),
    Rule("destination_weight", "coverage DOUBLE, lines BIGINT, meters DOUBLE", D.destination_weight),
    Rule("sec_of_day", "clock STRING", D.sec_of_day),
    Rule("hhmm", "sec BIGINT", D.hhmm),
    Rule("meters_between", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", G.meters_between),
    Rule("meters_per_pixel", "zoom DOUBLE, lat DOUBLE", G.meters_per_pixel),
    Rule("valid_coord", "lat DOUBLE, lon DOUBLE", G.valid_coord),
    Rule("bbox_area_m2", "min_lat DOUBLE, max_lat DOUBLE, min_lon DOUBLE, max_lon DOUBLE", G.bbox_area_m2),
]


def scalar_definition(spark: SparkSession, rule: Rule) -> str:
    df = spark.createDataFrame([], rule.arguments.replace(", ", ",").replace("STRING,STRING", "STRING, STRING")).select(rule.over(*map(F.col, rule.names())).alias("value"))
    body = df._jdf.queryExecution().analyzed().expressions().head().child().sql()
    return f"{rule.name}({rule.arguments}) RETURNS {df.schema['value'].dataType.simpleString()} RETURN {body}"


def table_definitions() -> list[str]:
    span = "greatest(0, least(n - 1, CAST(floor(({v} - {lo}) / (({hi} - {lo}) / n)) AS INT)))"
    row = lambda v: span.format(v=v, lo="min_lat", hi="max_lat")
    col = lambda v: span.format(v=v, lo="min_lon", hi="max_lon")
    y, x = f"lat * {G.M_PER_DEG_LAT}D / cell_m", f"lon * {G.M_PER_DEG_LON_EQUATOR}D * cos(radians(lat)) / cell_m"
    reach = "CAST(ceil(greatest(1D, radius_m) / cell_m) AS BIGINT)"
    d = f"sqrt(pow((r.v + 0.5D - {y}) * cell_m, 2) + pow((c.v + 0.5D - {x}) * cell_m, 2))"
    return [
        "tiles_of_box(min_lat DOUBLE, max_lat DOUBLE, min_lon DOUBLE, max_lon DOUBLE, n INT, y1 DOUBLE, y2 DOUBLE, x1 DOUBLE, x2 DOUBLE) RETURNS TABLE (tile INT) RETURN "
        f"SELECT r.v * n + c.v + 1 FROM explode(sequence({row('greatest(y1, min_lat)')}, {row('least(y2, max_lat)')})) AS r(v), "
        f"explode(sequence({col('greatest(x1, min_lon)')}, {col('least(x2, max_lon)')})) AS c(v)",
        # Cells of a grid whose centres lie within a radius of a point, on the plane of the point, with the weight that falls to a quarter at the rim.
        "cells_of_radius(lat DOUBLE, lon DOUBLE, radius_m DOUBLE, cell_m DOUBLE) RETURNS TABLE (cell_y BIGINT, cell_x BIGINT, d DOUBLE, w DOUBLE) RETURN "
        f"SELECT r.v, c.v, {d}, greatest(0.25D, 1 - {d} / greatest(1D, radius_m) * 0.75D) FROM explode(sequence(CAST(floor({y}) AS BIGINT) - {reach}, CAST(floor({y}) AS BIGINT) + {reach})) AS r(v), "
        f"explode(sequence(CAST(floor({x}) AS BIGINT) - {reach}, CAST(floor({x}) AS BIGINT) + {reach})) AS c(v) WHERE {d} <= greatest(1D, radius_m)",
    ]


def definitions(spark: SparkSession) -> list[str]:
    return [scalar_definition(spark, r) for r in RULES] + table_definitions()


def register(spark: SparkSession) -> None:
    for d in definitions(spark):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {d}")
