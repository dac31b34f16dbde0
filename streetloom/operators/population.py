"""Population and activity on a 250 m grid, and what lies within reach of a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.functions import tags as TG
from streetloom.functions.demand import TRIP_RATE_PER_DAY
from streetloom.functions.geo import M_PER_DEG_LAT, js_round, ring_area_m2
from streetloom.functions.roads import lookup
from streetloom.operators.spatial import radius_join

# ---- Fixed values ------------------------------------------------------------------------------------------
CELL_M = 250.0
REF_LAT = 39.9042
PEOPLE_PER_M2, JOBS_PER_M2 = 0.03, 0.02
MIN_RING_M2 = 20.0
JOB_BUILDINGS = ["commercial", "office", "industrial", "retail", "warehouse", "supermarket", "kiosk", "hotel", "hospital", "school",
                 "university", "college", "kindergarten", "factory", "hangar", "stadium", "train_station", "transportation", "mall",
                 "civic", "government"]
NOT_LIVED_IN = ["roof", "ruins", "construction", "bridge", "wall", "garage", "garages", "shed", "farm_auxiliary", "stable", "barn",
                "cowshed", "sty", "greenhouse", "boathouse", "digester", "slurry_tank", "silo", "storage_tank", "transformer_tower",
                "water_tower", "bunker", "carport", "tent", "tower", "grandstand", "service", "temporary"]
JOB_AMENITIES = ["school", "kindergarten", "college", "university", "hospital", "clinic", "doctors", "restaurant", "fast_food", "cafe",
                 "bar", "pub", "food_court", "cinema", "theatre", "nightclub", "marketplace", "bank", "bus_station", "ferry_terminal",
                 "townhall", "library", "community_centre", "arts_centre", "police", "fire_station", "post_office"]
UNKNOWN_BUILDINGS = ["yes", "building", "unclassified"]
ACTIVITY_BASE, ACTIVITY_LEAST, NEAR_M, NEAR_SHARE, MIN_AREA_M2 = 1.0, 1.05, 200.0, 0.5, 25.0
ACTIVITY = {
    "landuse": {"commercial": 1.6, "retail": 1.6, "office": 1.6, "education": 1.5, "hospital": 1.5, "railway": 1.5, "port": 1.5,
                "industrial": 1.2, "quarry": 1.2, "landfill": 1.2, "residential": 1.05, "village": 1.05, "recreation_ground": 1.05,
                "religious": 1.1, "garages": 1.1, "fairground": 1.3, "construction": 1.05, "brownfield": 1.05, "military": 1.05,
                "plant_nursery": 0.8, "farmland": 0.8, "farmyard": 0.8, "forest": 0.8, "meadow": 0.8, "grass": 0.8, "orchard": 0.8,
                "vineyard": 0.8, "allotments": 0.8, "cemetery": 0.8, "basin": 0.8, "reservoir": 0.8, "salt_pond": 0.8,
                "aquaculture": 0.8, "greenfield": 0.8, "village_green": 0.8, "greenhouse_horticulture": 0.8},
    "amenity": {"marketplace": 1.6, "restaurant": 1.6, "fast_food": 1.6, "cafe": 1.6, "bar": 1.6, "pub": 1.6, "bank": 1.6,
                "food_court": 1.6, "cinema": 1.6, "theatre": 1.6, "nightclub": 1.6, "ice_cream": 1.6, "school": 1.5,
                "kindergarten": 1.5, "college": 1.5, "university": 1.5, "hospital": 1.5, "clinic": 1.5, "doctors": 1.5,
                "bus_station": 1.5, "ferry_terminal": 1.5, "taxi": 1.5, "library": 1.3, "townhall": 1.3, "community_centre": 1.3,
                "arts_centre": 1.3, "place_of_worship": 1.2, "fuel": 1.2, "parking": 1.2},
    "place": {"city": 1.6, "town": 1.5, "quarter": 1.4, "suburb": 1.3, "borough": 1.3, "neighbourhood": 1.3, "village": 1.05,
              "hamlet": 1.05, "locality": 1.05, "isolated_dwelling": 0.9},
    "leisure": {"park": 0.8, "garden": 0.9, "nature_reserve": 0.8, "golf_course": 0.8, "playground": 1.05, "sports_centre": 1.3,
                "stadium": 1.4, "marina": 1.2},
    "natural": {"water": 0.8, "bay": 0.8, "wetland": 0.8, "wood": 0.8, "scrub": 0.8, "grassland": 0.8, "heath": 0.8, "sand": 0.8,
                "beach": 0.8, "bare_rock": 0.8, "fell": 0.8, "moor": 0.8, "glacier": 0.8},
}
# --------------------------------------------------------------------------------------------------------------


def m_per_deg_lon(ref_lat: float = REF_LAT) -> float:
    return 111320.0 * math.cos(ref_lat * math.pi / 180)


def cell_x(lon: Column, ref_lat: float = REF_LAT) -> Column:
    return F.floor(lon * m_per_deg_lon(ref_lat) / CELL_M)


def cell_y(lat: Column) -> Column:
    return F.floor(lat * M_PER_DEG_LAT / CELL_M)


def building_contribution(ways: DataFrame, geometry: DataFrame, compute_jobs: bool = False, jobs_as_pop: bool = False,
                          conserve: bool = False, ref_lat: float = REF_LAT) -> DataFrame:
    """People and jobs of each closed building, spread over at most 3 x 3 cells from its lower-left one:
    (way_id, cell_x, cell_y, pop, jobs). ``ways``: id, tags; ``geometry``: way_id, coords.

    Shares follow the extent's number of cells (at most 9); cells beyond the third in a direction get nothing and their
    share is lost, unless ``conserve``.
    """
    t = F.col("tags")
    kind = TG.building_value(t)
    # Only buildings travel to the join with geometry.
    b = ways.where(kind.isNotNull()).select(F.col("id").alias("way_id"), kind.alias("kind"), TG.effective_floors(t).alias("floors"),
                                            (t["shop"].isNotNull() | t["office"].isNotNull() | t["industrial"].isNotNull()
                                             | TG.is_in(t, "amenity", JOB_AMENITIES)).alias("job_tags"))
    g = geometry.join(b, "way_id").where(F.size("coords") >= 3)
    first, last = F.get("coords", 0), F.element_at("coords", -1)
    g = g.where((F.abs(first["lat"] - last["lat"]) < 1e-9) & (F.abs(first["lon"] - last["lon"]) < 1e-9))
    g = g.withColumn("area", ring_area_m2(F.col("coords"))).where(F.col("area") >= MIN_RING_M2)
    is_job = F.col("kind").isin(*JOB_BUILDINGS) | (F.col("kind").isin(*UNKNOWN_BUILDINGS) & F.col("job_tags"))
    living = ~is_job & ~F.col("kind").isin(*NOT_LIVED_IN)
    floor_area = F.col("area") * F.col("floors")
    pop = F.when(living, floor_area * PEOPLE_PER_M2)
    jobs = F.lit(0.0)
    if compute_jobs:
        jobs = F.when(is_job, floor_area * JOBS_PER_M2).when(living & F.col("job_tags"), F.least("area", F.lit(400.0)) * JOBS_PER_M2).otherwise(0.0)
    elif jobs_as_pop:
        pop = pop.when(is_job, floor_area * PEOPLE_PER_M2)
    lat, lon = F.transform("coords", lambda p: p["lat"]), F.transform("coords", lambda p: p["lon"])
    s = g.select("way_id", pop.otherwise(0.0).alias("pop"), jobs.alias("jobs"),
                 cell_x(F.array_min(lon), ref_lat).alias("x1"), cell_x(F.array_max(lon), ref_lat).alias("x2"),
                 cell_y(F.array_min(lat)).alias("y1"), cell_y(F.array_max(lat)).alias("y2")).where("pop > 0 OR jobs > 0")
    width, height = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    share = F.least(width, F.lit(3)) * F.least(height, F.lit(3)) if conserve else F.least(width * height, F.lit(9))
    return (s.withColumn("_share", share)
            .withColumn("cell_x", F.explode(F.sequence(F.col("x1"), F.least("x2", F.col("x1") + 2))))
            .withColumn("cell_y", F.explode(F.sequence(F.col("y1"), F.least("y2", F.col("y1") + 2))))
            .select("way_id", "cell_x", "cell_y", (F.col("pop") / F.col("_share")).alias("pop"), (F.col("jobs") / F.col("_share")).alias("jobs")))


def population_grid(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("cell_x", "cell_y").agg(F.sum("pop").alias("pop"), F.sum("jobs").alias("jobs"))


def grid_for_box(contributions: DataFrame, box: dict, ref_lat: float = REF_LAT) -> DataFrame:
    """The grid in the cells of a box only; the cell filter is applied before the aggregation."""
    k = m_per_deg_lon(ref_lat) / CELL_M
    x1, x2 = math.floor(box["min_lon"] * k), math.floor(box["max_lon"] * k)
    y1, y2 = math.floor(box["min_lat"] * M_PER_DEG_LAT / CELL_M), math.floor(box["max_lat"] * M_PER_DEG_LAT / CELL_M)
    return population_grid(contributions.where(F.col("cell_x").between(x1, x2) & F.col("cell_y").between(y1, y2)))


def update_grid(grid: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Take the old contributions of changed ways out of the grid and put the new ones in. Cells that end up empty go."""
    cols = ["cell_x", "cell_y", "pop", "jobs"]
    minus = old.select("cell_x", "cell_y", (-F.col("pop")).alias("pop"), (-F.col("jobs")).alias("jobs"))
    delta = minus.unionByName(new.select(*cols))
    out = grid.select(*cols).unionByName(delta).groupBy("cell_x", "cell_y").agg(F.sum("pop").alias("pop"), F.sum("jobs").alias("jobs"))
    return out.where((F.abs("pop") > 1e-9) | (F.abs("jobs") > 1e-9))


def activity_factor(tags: Column) -> Column:
    """Strongest factor of a tag set, NULL when none applies."""
    parts = [lookup(tags[k], table) for k, table in ACTIVITY.items()]
    parts += [F.when(TG.any_of(tags, "shop", "office"), 1.6),
              F.when(TG.is_in(tags, "tourism", ["hotel", "museum"]) | TG.is_in(tags, "railway", ["station", "halt"])
                     | TG.eq(tags, "public_transport", "station"), 1.5)]
    return F.greatest(*parts)  # skips NULLs


def is_area(tags: Column) -> Column:
    return F.when(TG.eq(tags, "area", "no"), False).when(TG.eq(tags, "area", "yes"), True).otherwise(
        ~TG.any_of(tags, "highway", "railway", "waterway", "barrier", "route"))


def activity_grid(ways: DataFrame, ref_lat: float = REF_LAT) -> DataFrame:
    """Strongest activity per cell: closed areas act on the cells of their extent, and half as much on the ring of cells
    around it. ``ways``: tags, closed, min_lat..max_lon."""
    t = F.col("tags")
    f = activity_factor(t)
    factor = F.when(f.isNull() | (f == ACTIVITY_BASE) | (f <= 0), ACTIVITY_LEAST).otherwise(f)
    w_m = (F.col("max_lon") - F.col("min_lon")) * m_per_deg_lon(ref_lat)
    h_m = (F.col("max_lat") - F.col("min_lat")) * M_PER_DEG_LAT
    ring = max(1, math.ceil(NEAR_M / CELL_M))
    a = ways.where(t.isNotNull() & F.col("closed") & is_area(t)).where((w_m > 0) & (h_m > 0) & (w_m * h_m >= MIN_AREA_M2)).select(
        factor.alias("f"), cell_x(F.col("min_lon"), ref_lat).alias("x1"), cell_x(F.col("max_lon"), ref_lat).alias("x2"),
        cell_y(F.col("min_lat")).alias("y1"), cell_y(F.col("max_lat")).alias("y2"))
    a = a.withColumn("cell_x", F.explode(F.sequence(F.col("x1") - ring, F.col("x2") + ring))).withColumn(
        "cell_y", F.explode(F.sequence(F.col("y1") - ring, F.col("y2") + ring)))
    inside = F.col("cell_x").between(F.col("x1"), F.col("x2")) & F.col("cell_y").between(F.col("y1"), F.col("y2"))
    value = F.when(inside, F.col("f")).otherwise((F.col("f") - ACTIVITY_BASE) * NEAR_SHARE + ACTIVITY_BASE)
    return a.groupBy("cell_x", "cell_y").agg(F.max(value).alias("activity"))


def catchment(points: DataFrame, grid: DataFrame, activity: DataFrame, radius: str = "catchment_m", ref_lat: float = REF_LAT) -> DataFrame:
    """People, jobs, activity, density, coverage and demand around each point (id, lat, lon, radius)."""
    cells = grid.join(activity, ["cell_x", "cell_y"], "left").select("cell_x", "cell_y", "pop", "jobs", F.coalesce("activity", F.lit(ACTIVITY_BASE)).alias("act"))
    near = radius_join(points.select("id", "lat", "lon", radius), cells, radius, CELL_M, M_PER_DEG_LAT, m_per_deg_lon(ref_lat))
    pw = F.col("pop") * F.col("w")
    sums = near.groupBy("id").agg(F.sum(pw).alias("_pop"), F.sum(F.col("jobs") * F.col("w")).alias("_jobs"), F.sum(pw * F.col("act")).alias("_weighted"))
    own = points.withColumn("cell_x", cell_x(F.col("lon"), ref_lat)).withColumn("cell_y", cell_y(F.col("lat"))).join(
        activity.withColumnRenamed("activity", "_own"), ["cell_x", "cell_y"], "left").drop("cell_x", "cell_y")
    j = own.join(sums, "id", "left").na.fill(0.0, ["_pop", "_jobs", "_weighted"])
    r = F.greatest(F.lit(1.0), F.col(radius).cast("double"))
    act = js_round(F.when(F.col("_pop") > 0, F.col("_weighted") / F.nullif(F.col("_pop"), F.lit(0.0))).otherwise(F.coalesce("_own", F.lit(ACTIVITY_BASE))), 2)
    out = j.select(*points.columns, js_round(F.col("_pop")).alias("pop"), js_round(F.col("_jobs")).alias("jobs"),
                   js_round(F.col("_weighted")).alias("coverage"), act.alias("activity"),
                   js_round(F.col("_pop") / (r * r * math.pi / 1e6)).alias("density"))
    return out.withColumn("demand", js_round(F.col("pop") * F.col("activity")))


def station_demand(stations: DataFrame, grid: DataFrame, activity: DataFrame, trip_rate: float = TRIP_RATE_PER_DAY) -> DataFrame:
    c = catchment(stations, grid, activity)
    return c.withColumn("coverage", F.when(F.col("coverage") > 0, F.col("coverage")).otherwise(F.col("demand"))).withColumn(
        "daily_trips", js_round(F.col("demand") * trip_rate))


def grid_totals(grid: DataFrame, activity: DataFrame) -> DataFrame:
    g = grid.agg(js_round(F.coalesce(F.sum("pop"), F.lit(0.0))).alias("population"), js_round(F.coalesce(F.sum("jobs"), F.lit(0.0))).alias("jobs"), F.count("*").alias("cells"))
    a = activity.agg(F.count("*").alias("activity_cells"), js_round(F.coalesce(F.avg("activity"), F.lit(ACTIVITY_BASE)), 3).alias("avg_activity"),
                     F.count_if(F.col("activity") >= 1.5).alias("high"), F.count_if(F.col("activity") <= 0.9).alias("low"))
    return g.join(a, F.lit(True))  # one row each


def heatmap(grid: DataFrame, activity: DataFrame, box: dict, min_pop: float = 20, ref_lat: float = REF_LAT) -> DataFrame:
    """Cells of a box with enough people or jobs. With ``min_pop`` 0, cells that only have activity are listed too."""
    k = m_per_deg_lon(ref_lat) / CELL_M
    x1, x2 = math.floor(box["min_lon"] * k), math.floor(box["max_lon"] * k)
    y1, y2 = math.floor(box["min_lat"] * M_PER_DEG_LAT / CELL_M), math.floor(box["max_lat"] * M_PER_DEG_LAT / CELL_M)
    inside = F.col("cell_x").between(x1, x2) & F.col("cell_y").between(y1, y2)
    g, a = grid.where(inside), activity.where(inside)
    j = g.join(a, ["cell_x", "cell_y"], "full_outer" if min_pop <= 0 else "left")
    enough = (F.col("pop") >= min_pop) | (F.col("jobs") >= min_pop)
    if min_pop <= 0:
        enough = F.coalesce(enough, F.lit(False)) | (F.col("pop").isNull() & (F.col("activity") != ACTIVITY_BASE))
    return j.where(enough).select("cell_x", "cell_y", ((F.col("cell_y") + 0.5) * CELL_M / M_PER_DEG_LAT).alias("lat"),
                                  ((F.col("cell_x") + 0.5) * CELL_M / m_per_deg_lon(ref_lat)).alias("lon"),
                                  js_round(F.coalesce("pop", F.lit(0.0))).alias("pop"), js_round(F.coalesce("jobs", F.lit(0.0))).alias("jobs"),
                                  js_round(F.coalesce("activity", F.lit(ACTIVITY_BASE)), 2).alias("activity"))
