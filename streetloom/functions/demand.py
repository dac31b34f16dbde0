"""Passenger demand over distance and time, and clock helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetloom.functions.geo import js_round

# ---- Fixed values ---------------------------------------------------------------------------------
DAY_SEC = 86400
BANDS = ["local", "regional", "long"]
BAND_MAX_M = {"local": 15000.0, "regional": 100000.0}
BAND_MIX = {"local": 0.76, "regional": 0.20, "long": 0.04}
DECAY_M, DECAY_EXPONENT = 4000.0, 0.85
COVERAGE_EXPONENT, COVERAGE_FLOOR, LINE_WEIGHT = 0.75, 300.0, 1.0
NIGHT_SHAPE = 0.15
SERVICE_HOURS = 18
HOURLY = {
    "local": [1.00, 0.90, 0.85, 0.85, 0.90, 1.00, 1.15, 1.35, 1.40, 1.20, 1.05, 0.95, 0.90, 0.95, 1.05, 1.15, 1.15, 1.10],
    "regional": [0.95, 0.90, 0.85, 0.85, 0.90, 1.00, 1.10, 1.20, 1.20, 1.10, 1.05, 1.00, 0.95, 1.00, 1.05, 1.10, 1.10, 1.05],
    "long": [0.90, 0.90, 0.90, 0.90, 0.95, 1.00, 1.05, 1.10, 1.10, 1.05, 1.05, 1.00, 1.00, 1.05, 1.05, 1.05, 1.05, 1.00],
}
WEEKEND = {"local": 0.42, "regional": 0.75, "long": 1.15}
DAY_HASH = 2654435761
TRIP_RATE_PER_DAY = 0.22
# ----------------------------------------------------------------------------------------------------


def band_of(meters: Column) -> Column:
    m = F.coalesce(meters, F.lit(0.0))
    return F.when(m <= BAND_MAX_M["local"], "local").when(m <= BAND_MAX_M["regional"], "regional").otherwise("long")


def band_range(band: Column) -> Column:
    """``STRUCT<min_m, max_m>`` of a band; the last one has no upper end."""
    lo = F.when(band == "regional", BAND_MAX_M["local"]).when(band == "long", BAND_MAX_M["regional"]).otherwise(0.0)
    hi = F.when(band == "local", BAND_MAX_M["local"]).when(band == "regional", BAND_MAX_M["regional"])
    return F.struct(lo.alias("min_m"), hi.alias("max_m"))


def band_share(band: Column, available: Column) -> Column:
    """Share of a band once the mix is scaled to the bands in the array ``available`` (0 for the others)."""
    def mix(b: str) -> Column:
        return F.when(F.array_contains(available, b), BAND_MIX[b]).otherwise(0.0)
    total = mix("local") + mix("regional") + mix("long")
    own = F.lit(0.0)
    for b in BANDS:
        own = F.when(band == b, mix(b)).otherwise(own)
    return F.when(total > 0, own / total).otherwise(0.0)


def distance_weight(meters: Column) -> Column:
    return F.lit(1.0) / F.pow(F.greatest(F.lit(0.0), meters) / DECAY_M + 1, F.lit(DECAY_EXPONENT))


def destination_weight(coverage: Column, lines: Column, meters: Column) -> Column:
    pull = F.pow(coverage.cast("double"), F.lit(COVERAGE_EXPONENT)) + COVERAGE_FLOOR ** COVERAGE_EXPONENT
    return F.when(coverage > 0, pull * (lines * LINE_WEIGHT + 1) * distance_weight(meters)).otherwise(0.0)


def hourly_shape(band: Column, hour: Column) -> Column:
    h = F.pmod(F.floor(hour), F.lit(24)).cast("int")
    out = F.lit(None).cast("double")
    for b in BANDS:
        mean = sum(HOURLY[b]) / len(HOURLY[b])
        row = F.array(*[F.lit(v) for v in HOURLY[b]])
        out = F.when(band == b, F.when(h < SERVICE_HOURS, F.get(row, h) / mean).otherwise(NIGHT_SHAPE)).otherwise(out)
    return out


def is_weekend(day: Column) -> Column:
    return F.pmod(F.greatest(F.lit(1), day), F.lit(7)).isin(0, 6)


def weekend_factor(day: Column, band: Column) -> Column:
    out = F.lit(1.0)
    for b in BANDS:
        out = F.when(band == b, WEEKEND[b]).otherwise(out)
    return F.when(is_weekend(day), out).otherwise(1.0)


def daily_factor(day: Column, band: Column) -> Column:
    """Weekend factor times a fixed jitter from the low 32 bits of day times a constant."""
    d = F.greatest(F.lit(1), day).cast("long")
    # Split the multiplier so that the product stays within 64 bits for any 32-bit day.
    low32 = F.lit((1 << 32) - 1)
    product = ((d.bitwiseAND(low32)) * (DAY_HASH >> 16)).bitwiseAND(F.lit((1 << 16) - 1)) * (1 << 16) \
        + d.bitwiseAND(low32) * (DAY_HASH & 0xFFFF)
    return weekend_factor(day, band) * (F.lit(0.92) + (product.bitwiseAND(low32) % 160) / 1000.0)


def rate_factor(band: Column, hour: Column, day: Column, service_hours: int = SERVICE_HOURS) -> Column:
    return hourly_shape(band, hour) * weekend_factor(day, band) / (max(1, service_hours) * 3600.0)


def sec_of_day(text: Column) -> Column:
    """Seconds from ``H:MM``, ``H:MM:SS`` or a number; NULL when it is neither or out of range."""
    s = F.trim(text)
    clock = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$"
    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(s, clock, i), F.lit("")), F.lit("0")).cast("int")
    h, m, sec = part(1), part(2), part(3)
    valid = (h <= 24) & (m <= 59) & (sec <= 59)
    number = js_round(s.try_cast("double"))
    return F.when(s.rlike(clock), F.when(valid, F.least(F.lit(DAY_SEC), h * 3600 + m * 60 + sec))) \
        .when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(DAY_SEC), number))).cast("int")


def hhmm(sec: Column) -> Column:
    s = F.pmod(js_round(F.coalesce(sec.cast("double"), F.lit(0.0))), F.lit(DAY_SEC))
    return F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), 2, "0"))
