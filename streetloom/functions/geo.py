"""Distances, areas and planar helpers as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values ---------------------------------------------------------------------------------
EARTH_RADIUS_M = 6378137.0
RAD = math.pi / 180
M_PER_DEG_LAT = 110574.0
M_PER_DEG_LON_EQUATOR = 111320.0
PIXEL_M_AT_ZOOM_0 = 156543.03392804097
# ----------------------------------------------------------------------------------------------------


def js_round(x: Column, digits: int = 0) -> Column:
    """Round halves up, also below zero (``round`` would move them away from zero)."""
    if digits == 0:
        return F.floor(x + 0.5)
    p = float(10 ** digits)
    return F.floor(x * p + 0.5).cast("double") / p


def meters_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s_lat = F.sin((lat2 - lat1) * RAD / 2)
    s_lon = F.sin((lon2 - lon1) * RAD / 2)
    h = s_lat * s_lat + F.cos(lat1 * RAD) * F.cos(lat2 * RAD) * s_lon * s_lon
    # ``least`` skips NULL, so the upper clamp must not be the one that sees a missing coordinate.
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def meters_per_pixel(zoom: Column, lat: Column) -> Column:
    return F.lit(PIXEL_M_AT_ZOOM_0) * F.cos(F.coalesce(lat, F.lit(0.0)) * RAD) / F.pow(F.lit(2.0), zoom)


def valid_coord(lat: Column, lon: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def ring_area_m2(ring: Column) -> Column:
    """Area of ``ARRAY<STRUCT<lat,lon>>`` on a local plane. The mean latitude counts every listed point, a repeated
    closing point included; coordinates are taken from the first point so that large terms cancel exactly."""
    n = F.size(ring)
    k = F.cos(F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["lat"]) / n * RAD)
    origin = ring[0]

    def cross(p: Column, q: Column) -> Column:
        return ((p["lon"] - origin["lon"]) * (q["lat"] - origin["lat"])
                - (q["lon"] - origin["lon"]) * (p["lat"] - origin["lat"]))
    turned = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    total = F.aggregate(F.zip_with(ring, turned, cross), F.lit(0.0), lambda a, x: a + x)
    return F.when(n >= 3, F.abs(total) / 2 * k * (RAD * EARTH_RADIUS_M) ** 2).otherwise(0.0)


def bbox_area_m2(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    return F.abs((max_lat - min_lat) * M_PER_DEG_LAT * (max_lon - min_lon) * M_PER_DEG_LON_EQUATOR)


def centroid(points: Column) -> Column:
    n = F.size(points)
    return F.when(n > 0, F.struct(
        (F.aggregate(points, F.lit(0.0), lambda a, p: a + p["lat"]) / n).alias("lat"),
        (F.aggregate(points, F.lit(0.0), lambda a, p: a + p["lon"]) / n).alias("lon")))


def offset_lat(lat: Column, north_m: Column | float) -> Column:
    return lat + north_m / F.lit(EARTH_RADIUS_M) / RAD


def offset_lon(lat: Column, lon: Column, east_m: Column | float) -> Column:
    return lon + east_m / (F.lit(EARTH_RADIUS_M) * F.cos(lat * RAD)) / RAD


def in_box(lat: Column, lon: Column, box: dict) -> Column:
    return lat.between(box["min_lat"], box["max_lat"]) & lon.between(box["min_lon"], box["max_lon"])


def boxes_touch(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, box: dict) -> Column:
    """Closed intersection of a feature's extent with a box."""
    return ((max_lon >= box["min_lon"]) & (min_lon <= box["max_lon"])
            & (max_lat >= box["min_lat"]) & (min_lat <= box["max_lat"]))


# ---- point and segment on a plane around the point ----------------------------------------------------

def _plane(lat: Column, lon: Column, p_lat: Column, p_lon: Column) -> tuple[Column, Column]:
    k = F.cos(p_lat * RAD)
    return (lon - p_lon) * RAD * EARTH_RADIUS_M * k, (lat - p_lat) * RAD * EARTH_RADIUS_M


def segment_t(p_lat: Column, p_lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Position 0..1 on a-b of the point nearest to p."""
    x1, y1 = _plane(a_lat, a_lon, p_lat, p_lon)
    x2, y2 = _plane(b_lat, b_lon, p_lat, p_lon)
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, 0.0).otherwise(-(x1 * dx + y1 * dy) / F.nullif(len2, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def segment_distance_m(p_lat: Column, p_lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column,
                       t: Column | None = None) -> Column:
    t = segment_t(p_lat, p_lon, a_lat, a_lon, b_lat, b_lon) if t is None else t
    x1, y1 = _plane(a_lat, a_lon, p_lat, p_lon)
    x2, y2 = _plane(b_lat, b_lon, p_lat, p_lon)
    cx, cy = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
    return F.sqrt(cx * cx + cy * cy)
