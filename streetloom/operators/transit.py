"""Lines, itineraries, demand between stations, timetables, delays, queues and daily statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions import demand as D, journeys as J, tags as TG
from streetloom.functions.geo import in_box, js_round, meters_between
from streetloom.model import OsmDataset
from streetloom.operators.geometry import located_refs
from streetloom.operators.network import keep_apart
from streetloom.operators.ordered import last_known, numbered
from streetloom.operators.spatial import nearest_rank, neighbour_pairs, point_box_join, snap_to_node, snap_to_segment
from streetloom.session import cut_lineage, drop_cut, ship_package

# ---- Fixed values -------------------------------------------------------------------------------------------
MAX_RIDES, MAX_WALKS, MAX_JOURNEY_MS = 4, 2, 8 * 3600 * 1000
BOARD_SEC, WALK_SEC, WALK_MPS, RIDE_KMH, MIDDLE_STOP_SEC = 300.0, 60.0, 1.0, 45.0, 20.0
OD_LEAST_PEOPLE = 0.02
ON_TIME_SEC, TREND_SEC = 60, 15
PATIENCE_SEC = 900
FARE_BASE, FARE_PER_KM, FARE_SHARE = 3.0, 0.5, 0.6
IMPORT_RULES = [("railway", "station"), ("railway", "halt"), ("amenity", "bus_station"), ("public_transport", "station"),
                ("railway", "tram_stop"), ("railway", "subway_entrance"), ("highway", "bus_stop"),
                ("public_transport", "platform"), ("public_transport", "stop_position")]
IMPORT_APART_M = 25.0
IMPORT_SNAP_RAIL_M, IMPORT_SNAP_BUS_M = 200.0, 80.0
# ----------------------------------------------------------------------------------------------------------------


# ---- lines and itineraries ---------------------------------------------------------------------------------------

def cumulative_stops(line_stops: DataFrame, stations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Metres from the first stop for every stop of every line: the difference of known path distances where there is
    one, else the straight distance. ``known``: line_id, station_id, path_m. A line's stops fit one small window."""
    w = Window.partitionBy("line_id").orderBy("idx")
    s = line_stops.join(stations.select(F.col("id").alias("station_id"), "lat", "lon"), "station_id")
    s = s.join(known, ["line_id", "station_id"], "left") if known is not None else s.withColumn("path_m", F.lit(None).cast("double"))
    straight = meters_between(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    by_path = F.nullif(F.abs(F.col("path_m") - F.lag("path_m").over(w)), F.lit(0.0))
    s = s.withColumn("_m", F.coalesce(by_path, straight, F.lit(0.0)))
    return s.select("line_id", "idx", "station_id", F.sum("_m").over(w).alias("cum_m"))


def ride_edges(cum: DataFrame) -> DataFrame:
    """Every ordered pair of stops of a line with distance and time in whole milliseconds (boarding included). Whole
    numbers make equal ways of travel compare equal whatever order they are added in."""
    a = cum.select("line_id", F.col("idx").alias("i"), F.col("station_id").alias("src"), F.col("cum_m").alias("x"))
    b = cum.select("line_id", F.col("idx").alias("j"), F.col("station_id").alias("dst"), F.col("cum_m").alias("y"))
    m = F.abs(F.col("y") - F.col("x"))
    sec = m / (RIDE_KMH / 3.6) + F.greatest(F.lit(0), F.abs(F.col("j") - F.col("i")) - 1) * MIDDLE_STOP_SEC
    return a.join(b, "line_id").where("i <> j").select("line_id", "src", "dst", js_round(m).alias("meters"), js_round((sec + BOARD_SEC) * 1000).alias("ms"))


def walk_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), js_round(F.col("meters")).alias("meters"),
                        js_round((F.col("meters") / WALK_MPS + WALK_SEC) * 1000).alias("ms"))


LABEL_KEY = ["origin", "station", "rides", "walks"]
LABEL = J.LABEL
PART_DEG, PART_ORIGINS = 0.1, 64


def journey_parts(stations: DataFrame, rides: DataFrame, walks: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Hops dealt to parts of at most ``PART_ORIGINS`` origins that lie together: (part, own, src, dst, line_id, meters, ms), ``own`` where src is an origin of the part, line_id -1 for walks.

    A part has the hops of every station that its origins can reach with the rides and walks of a journey, so it is searched by itself. Six rounds of joins find those stations: each row holds the
    fewest rides to a station without, with one and with two walks at most. Each round is a statement of its own, since a plan holds the tables it has sent to all
    executors in the driver until its end. Neighbours reach the same stations, so a hop has far fewer copies than there are journeys over it."""
    hop = cut_lineage(rides.select("src", "dst", F.col("line_id").cast("long"), "meters", "ms").unionByName(walks.select("src", "dst", F.lit(-1).cast("long").alias("line_id"), "meters", "ms")))
    start = (stations if origins is None else origins).select("id").distinct()
    if {"lat", "lon"} <= set(stations.columns):
        start = start.join(stations.select("id", *[F.coalesce(F.floor(F.nanvl(c, F.lit(0.0)) / PART_DEG), F.lit(0)).alias(f"_{c}") for c in ("lat", "lon")]).dropDuplicates(["id"]), "id", "left").na.fill(0, ["_lat", "_lon"])
    else:
        start = start.select("id", F.floor(F.col("id") / PART_ORIGINS).alias("_lat"), F.lit(0).alias("_lon"))
    dealt = numbered(start, ["_lat", "_lon"], F.floor(F.col("id") / PART_ORIGINS), [F.col("id")], "_n")
    none = MAX_RIDES + 1
    reach = dealt.select(F.xxhash64("_lat", "_lon", F.floor((F.col("_n") - 1) / PART_ORIGINS)).alias("part"), F.col("id").alias("station"), *[F.lit(0).alias(f"r{w}") for w in range(MAX_WALKS + 1)])
    reach = cut_lineage(reach)
    step = hop.select("src", "dst", (F.col("line_id") >= 0).alias("ride")).distinct()
    step = cut_lineage(step.unionByName(step.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(None).cast("boolean").alias("ride"))))  # NULL: stays
    for _ in range(MAX_RIDES + MAX_WALKS):
        by_walk = [F.lit(none), *[F.col(f"r{w}") for w in range(MAX_WALKS)]]
        moved = [F.when(F.col("ride").isNull(), F.col(f"r{w}")).when(F.col("ride"), F.col(f"r{w}") + 1).otherwise(by_walk[w]).alias(f"r{w}") for w in range(MAX_WALKS + 1)]
        before, reach = reach, cut_lineage(reach.join(step, F.col("station") == F.col("src")).select("part", F.col("dst").alias("station"), *moved).where(F.col(f"r{MAX_WALKS}") < none).groupBy("part", "station").agg(
            *[F.min(f"r{w}").alias(f"r{w}") for w in range(MAX_WALKS + 1)]))
        drop_cut(before)
    goes = F.when(F.col("line_id") >= 0, F.col(f"r{MAX_WALKS}") < MAX_RIDES).otherwise(F.col(f"r{MAX_WALKS - 1}") < none)
    return hop.join(reach, F.col("src") == F.col("station")).where(goes).select("part", (F.col("r0") == 0).alias("own"), "src", "dst", "line_id", "meters", "ms")


def _searched(parts: DataFrame, work, kind: str) -> DataFrame:
    ship_package(parts.sparkSession)
    return parts.groupBy("part").applyInPandas(work, kind)


def journey_labels(stations: DataFrame, rides: DataFrame, walks: DataFrame, origins: DataFrame | None = None, best_only: bool = False) -> DataFrame:
    """Labels of the best journeys: LABEL_KEY, LABEL, and ``best`` for the best one of its pair. No walk comes first where the origin has a line. ``origins`` (id) limits where journeys start; all
    stations by default. ``best_only`` returns those alone, if they ride.

    A label can only come from one with one leg less, so six steps with a minimum per label are exact, and the number of steps
    does not grow with the network. A label carries the station and line it came by and its first ride, no list of legs. One that another label of its station, with no more rides, walks
    and time, has reached before goes no further: whatever it led to is reached as well from there. Ties: no walk first, then line and stop of the first ride, of the last leg.
    Labels never leave the part of their origin (``journey_parts``)."""
    most = (MAX_RIDES, MAX_WALKS, MAX_JOURNEY_MS, best_only)
    kind = "origin long, station long, rides int, walks int, ms long, walk_first int, first_line long, first_stop long, by_line long, prev long, leg_m long, leg_ms long, best boolean"
    found = _searched(journey_parts(stations, rides, walks, origins), lambda hops: J.journey_rows(hops, *most), kind)
    return found.withColumn("by_line", F.when(F.col("by_line") >= 0, F.col("by_line")))


def best_journeys(labels: DataFrame) -> DataFrame:
    """(origin, dest, ms, rides, walks, first_line, first_stop, walk_first) of the best label of each pair, fastest, then with the fewest rides, then
    walks. A pair whose best way is walking only is left out."""
    return labels.where("best AND rides > 0").select("origin", F.col("station").alias("dest"), "ms", "rides", "walks", "first_line", "first_stop", "walk_first")


def itineraries(stations: DataFrame, rides: DataFrame, walks: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Best journey from every station (or those of ``origins``) to every other within 4 rides, 2 walks and 8 hours, as in ``best_journeys``."""
    return best_journeys(journey_labels(stations, rides, walks, origins, best_only=True))


def itinerary_legs(stations: DataFrame, rides: DataFrame, walks: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Legs of all ``itineraries``, as in ``journey_legs``, taken from the labels in the part where they were found."""
    most = (MAX_RIDES, MAX_WALKS, MAX_JOURNEY_MS)
    found = _searched(journey_parts(stations, rides, walks, origins), lambda hops: J.leg_rows(hops, *most), "origin long, dest long, leg int, line_id long, src long, dst long, meters long, ms long")
    ride = F.col("line_id") >= 0
    return found.select("origin", "dest", "leg", F.when(ride, "ride").otherwise("walk").alias("kind"), F.when(ride, F.col("line_id")).alias("line_id"), "src", "dst", "meters", "ms")


def journey_legs(labels: DataFrame, journeys: DataFrame) -> DataFrame:
    """Legs of journeys, one row each: (origin, dest, leg, kind, line_id, src, dst, meters, ms), ``leg`` from 1. Each round goes one leg back, by a join with the label that a
    journey has come from; a leg takes off one ride or one walk. ``journeys``: origin, dest, rides, walks."""
    back = labels.select(*LABEL_KEY, "by_line", "prev", "leg_m", "leg_ms")
    at = journeys.select("origin", "dest", F.col("dest").alias("station"), "rides", "walks")
    out = None
    for _ in range(MAX_RIDES + MAX_WALKS):
        found = cut_lineage(at.join(back, LABEL_KEY))
        ride = F.col("by_line").isNotNull()
        leg = found.select("origin", "dest", (F.col("rides") + F.col("walks")).alias("leg"), F.when(ride, "ride").otherwise("walk").alias("kind"), F.col("by_line").alias("line_id"), F.col("prev").alias("src"),
                           F.col("station").alias("dst"), F.col("leg_m").alias("meters"), F.col("leg_ms").alias("ms"))
        out = leg if out is None else out.unionByName(leg)
        at = found.select("origin", "dest", F.col("prev").alias("station"), F.when(ride, F.col("rides") - 1).otherwise(F.col("rides")).alias("rides"), F.when(ride, F.col("walks")).otherwise(F.col("walks") - 1).alias("walks")).where(
            "rides + walks > 0")
    return out


def od_matrix(stations: DataFrame, line_stops: DataFrame, plans: DataFrame, walks: DataFrame, least: float = OD_LEAST_PEOPLE) -> DataFrame:
    """People per day between stations: (origin, dest, band, meters, people, transfers, rides, walks, first_line, first_stop, walk_first, kept).

    Destinations have coverage and a line (or a walk to one) and can be reached; the day's trips are split over bands by
    the mix of the bands present, and inside a band by weight. Pairs below ``least`` are kept as rows with ``kept`` false,
    so that spawned = served + dropped. ``stations``: id, lat, lon, coverage, daily_trips.
    """
    lines = line_stops.groupBy(F.col("station_id").alias("id")).agg(F.countDistinct("line_id").alias("lines"))
    s = stations.join(lines, "id", "left").na.fill(0, ["lines"])
    near_line = walks.join(lines.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("_w", F.lit(True))
    s = s.join(near_line, "id", "left")
    o = s.where("daily_trips > 0").select(F.col("id").alias("origin"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), "daily_trips")
    d = s.where((F.col("coverage") > 0) & ((F.col("lines") > 0) | F.coalesce("_w", F.lit(False)))).select(
        F.col("id").alias("dest"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), "coverage", "lines")
    # Only reachable pairs are ever formed, and they move twice: to their destination and to their origin, where the sums over bands are made.
    p = plans.join(d, "dest").join(o, "origin").withColumn("meters", meters_between(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon")))
    p = p.withColumn("band", D.band_of(F.col("meters"))).withColumn("weight", D.destination_weight(F.col("coverage"), F.col("lines"), F.col("meters"))).where("weight > 0").drop(
        "o_lat", "o_lon", "d_lat", "d_lon", "coverage", "lines")
    by = Window.partitionBy("origin")
    share = D.band_share(F.col("band"), F.collect_set("band").over(by))
    out = p.withColumn("share", share).withColumn("pool", F.sum("weight").over(Window.partitionBy("origin", "band"))).withColumn(
        "people", F.col("daily_trips") * F.col("share") * F.col("weight") / F.col("pool"))
    return out.select("origin", "dest", "band", "meters", "people", (F.col("rides") - 1).alias("transfers"), "rides", "walks", "first_line", "first_stop", "walk_first",
                      (F.col("people") >= least).alias("kept"))


def od_station(od: DataFrame, stations: DataFrame, top: int = 12) -> DataFrame:
    """Per origin: trips spawned and served, reach, number of destinations and the largest ones. The pairs are worked out once and lie by origin, so that
    they are summed and ranked where they are."""
    ranked = od.where("kept").withColumn("rank", F.row_number().over(Window.partitionBy("origin").orderBy(-F.col("people"), "dest")))
    sums = ranked.groupBy("origin").agg(F.sum("people").alias("_served"), F.count("*").alias("destinations"),
                                        F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "dest", "people")))).alias("top"))
    j = stations.select(F.col("id").alias("origin"), "daily_trips").join(sums, "origin", "left").na.fill(0, ["_served", "destinations"])
    return j.select("origin", js_round(F.col("daily_trips").cast("double")).alias("spawn"), js_round(F.col("_served").cast("double")).alias("served"),
                    F.when(F.col("daily_trips") > 0, js_round(F.col("_served") / F.col("daily_trips"), 3)).otherwise(0.0).alias("reach"), "destinations", "top")


def od_stats(od: DataFrame) -> DataFrame:
    """People and pairs per band and number of transfers, with subtotals."""
    return od.where("kept").rollup("band", "transfers").agg(F.count("*").alias("pairs"), js_round(F.sum("people"), 1).alias("people"), F.grouping_id().alias("level"))


def od_line_loads(od: DataFrame) -> DataFrame:
    """Boardings per line, station and band by the first ride of each journey, and how many walk to it first."""
    return od.where("kept").groupBy(F.col("first_line").alias("line_id"), F.col("first_stop").alias("station_id"), "band").agg(
        F.sum("people").alias("people"), F.countDistinct("dest").alias("destinations"), F.sum(F.when(F.col("walk_first") == 1, F.col("people")).otherwise(0.0)).alias("walked_first"))


# ---- timetable --------------------------------------------------------------------------------------------------------

def departures(schedules: DataFrame, most: int | None = None) -> DataFrame:
    """(line_id, run_index, dep_sec): headway lines leave from first to last, timetable lines at their listed times, sorted
    and distinct; ``most``: at most so many a day, the first ones. ``schedules``: line_id, mode, first_sec, last_sec, headway_sec, times ARRAY."""
    headway = F.sequence(F.col("first_sec"), F.col("last_sec"), F.greatest("headway_sec", F.lit(1)))
    times = (F.when((F.col("mode") == "headway") & (F.col("last_sec") >= F.col("first_sec")), headway)
             .when(F.col("mode") == "timetable", F.array_sort(F.array_distinct("times"))))
    return schedules.select("line_id", F.posexplode(times if most is None else F.slice(times, 1, most)).alias("run_index", "dep_sec"))


def assign_vehicles(deps: DataFrame, vehicles: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vehicle of each run: the one named for it if it runs on the line, else round robin over the line's vehicles in id
    order. Also the named vehicles that could not be used, with the reason. ``vehicles``: id, line_id."""
    fleet = vehicles.where("line_id IS NOT NULL").groupBy("line_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    want = assignments.groupBy("line_id", "run_index").agg(F.max_by("vehicle_id", "ord").alias("want"))
    known = vehicles.select(F.col("id").alias("want"), F.lit(True).alias("_exists"))
    j = deps.join(fleet, "line_id", "left").join(want, ["line_id", "run_index"], "left").join(known, "want", "left")
    ok = F.coalesce(F.array_contains("ids", F.col("want")), F.lit(False))
    rr = F.when(F.size("ids") > 0, F.get("ids", (F.col("run_index") % F.size("ids")).cast("int")))
    j = j.withColumn("_ok", ok)
    runs = j.select("line_id", "run_index", "dep_sec", F.when(F.col("_ok"), F.col("want")).otherwise(rr).alias("vehicle_id"), F.col("_ok").alias("pinned"))
    missed = j.where(F.col("want").isNotNull() & ~F.col("_ok")).select("line_id", "run_index", "dep_sec", F.col("want").alias("vehicle_id"),
                                                                    F.when(F.col("_exists"), "vehicle-busy").otherwise("vehicle-gone").alias("reason"))
    return runs, missed


def segment_run_sec(d: Column, v: Column, a: Column, b: Column) -> Column:
    """Seconds to start, run and stop over ``d`` metres; short segments never reach full speed."""
    v, a, b = F.greatest(F.lit(1.0), v), F.greatest(F.lit(0.05), a), F.greatest(F.lit(0.05), b)
    ramp = v * v / (a * 2) + v * v / (b * 2)
    peak = F.sqrt(d * 2 * a * b / (a + b))
    return F.when(d <= 0, 0.0).when(d >= ramp, v / a + v / b + (d - ramp) / v).otherwise(peak / a + peak / b)


def timetable(runs: DataFrame, stops: DataFrame, kinds: DataFrame, vehicles: DataFrame, dwell_sec: float = 25.0, terminal_sec: float = 20.0) -> DataFrame:
    """Arrival and departure of every run at every stop. ``stops``: line_id, idx, station_id, cum_m; ``kinds``: kind,
    accel, brake; ``vehicles``: id, kind, max_speed. The offset of each stop depends on line and vehicle kind only, so it is
    computed once per (line, kind, speed) and joined with the runs."""
    w = Window.partitionBy("line_id").orderBy("idx")
    seg = stops.select("line_id", "idx", "station_id", F.abs(F.col("cum_m") - F.lag("cum_m").over(w)).alias("d"), F.lead("idx").over(w).isNull().alias("last"))
    veh = vehicles.select(F.col("id").alias("vehicle_id"), "kind", "max_speed")
    r = runs.where("vehicle_id IS NOT NULL").join(veh, "vehicle_id")
    combos = r.select("line_id", "kind", "max_speed").distinct().join(kinds, "kind")
    v = F.least(F.col("max_speed").cast("double"), F.lit(400.0)) / 3.6
    t = combos.join(seg, "line_id").withColumn("run_sec", F.coalesce(segment_run_sec(F.col("d"), v, F.col("accel"), F.col("brake")), F.lit(0.0)))
    t = t.withColumn("dwell", F.when((F.col("idx") == 0) | F.col("last"), dwell_sec + terminal_sec).otherwise(dwell_sec))
    wk = Window.partitionBy("line_id", "kind", "max_speed").orderBy("idx")
    # The first stop is left at the departure time; later stops add run time and dwell.
    gone = F.when(F.col("idx") == 0, 0.0).otherwise(F.col("run_sec") + F.col("dwell"))
    t = t.withColumn("dep_off", F.sum(gone).over(wk)).withColumn("arr_off", F.col("dep_off") - F.when(F.col("idx") == 0, 0.0).otherwise(F.col("dwell")))
    return r.join(t.select("line_id", "kind", "max_speed", "idx", "station_id", "arr_off", "dep_off"), ["line_id", "kind", "max_speed"]).select(
        "line_id", "run_index", "vehicle_id", "idx", "station_id", (F.col("dep_sec") + F.col("arr_off")).alias("arrival_sec"), (F.col("dep_sec") + F.col("dep_off")).alias("departure_sec"))


def next_departures(deps: DataFrame, at: int, n: int = 5) -> DataFrame:
    """The next ``n`` departures of each line after a time of day, going on with the next day. The rank is pushed below
    the shuffle, so a line with very many departures costs no more than others."""
    wait = F.when(F.col("dep_sec") >= at, F.col("dep_sec") - at).otherwise(F.col("dep_sec") - at + D.DAY_SEC)
    d = deps.withColumn("wait_sec", wait).withColumn("next_day", F.col("dep_sec") < at)
    return nearest_rank(d, ["line_id"], ["wait_sec", "run_index"], n)


# ---- observations and delays ------------------------------------------------------------------------------------------

def asof_plan(obs: DataFrame, plan: DataFrame, keys: list[str], time: str, columns: list[str], bucket_sec: int = 3600) -> DataFrame:
    """Each observation with the latest plan row of its key at or before it (``known`` struct, NULL when there is none)."""
    p = plan.select(*keys, time, *columns).withColumn("_plan", F.lit(True))
    both = obs.withColumn("_plan", F.lit(False)).unionByName(p, allowMissingColumns=True)
    bucket = F.floor(F.col(time).cast("double") / bucket_sec)
    out = last_known(both, keys, time, bucket, "_plan", columns)
    return out.where("NOT _plan").select(*obs.columns, "known")


def delay_trend(obs: DataFrame, trend_sec: int = TREND_SEC, on_time: int = ON_TIME_SEC) -> DataFrame:
    """Change against the stop before, worst so far and recovery, per run. ``obs``: run_id, idx, delay. A run has as many
    rows as its line has stops."""
    w = Window.partitionBy("run_id").orderBy("idx")
    delta = F.col("delay") - F.coalesce(F.lag("delay").over(w), F.col("delay"))
    peak = F.greatest(F.lit(0), F.max("delay").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    o = obs.withColumn("delta", delta).withColumn("peak", peak)
    trend = F.when(F.col("delta") > trend_sec, "worsening").when(F.col("delta") < -trend_sec, "recovering").otherwise("stable")
    return o.withColumn("trend", trend).withColumn("recovered", (F.col("peak") >= on_time) & (F.col("delay") <= on_time))


def delay_records(obs: DataFrame, trend_sec: int = TREND_SEC, on_time: int = ON_TIME_SEC) -> DataFrame:
    """Arrival and departure delay of each stop observation with its cause. ``obs``: run_id, idx, origin, scheduled, bus,
    planned_arr, planned_dep, arrived, departed, blocked_sec, congest_sec, late_start."""
    raw_dep = F.col("departed") - F.col("planned_dep")
    raw_arr = F.when(F.col("origin"), raw_dep).otherwise(F.col("arrived") - F.col("planned_arr"))
    dep = F.when(F.col("scheduled"), raw_dep).otherwise(F.greatest(F.lit(0), raw_dep))
    arr = F.when(F.col("scheduled"), raw_arr).otherwise(F.greatest(F.lit(0), raw_arr))
    w = Window.partitionBy("run_id").orderBy("idx")
    o = obs.withColumn("dep_delay", dep).withColumn("arr_delay", arr)
    o = o.withColumn("delta", F.col("dep_delay") - F.coalesce(F.lag("dep_delay").over(w), F.col("dep_delay")))
    dwell = F.greatest(F.lit(0), F.col("departed") - F.col("arrived"))
    excess = F.greatest(F.lit(0), dwell - F.greatest(F.lit(0), F.col("planned_dep") - F.col("planned_arr")))
    late = F.when(F.col("bus") & (F.col("congest_sec") >= trend_sec), "congestion").otherwise("delayed")
    cause = (F.when(F.col("late_start"), "departure")
             .when(F.col("blocked_sec") >= trend_sec, F.when(F.col("bus"), late).otherwise("blocked"))
             .when(excess >= trend_sec, "boarding").when(F.col("delta") > trend_sec, late).when(F.col("delta") < -trend_sec, "recovered")
             .when(F.col("dep_delay") > on_time, late).when(F.col("dep_delay") < -on_time, "early").otherwise("on-time"))
    return o.withColumn("cause", cause)


def punctuality(delays: DataFrame, on_time: int = ON_TIME_SEC) -> DataFrame:
    """On-time rate, mean and worst delay per line and in total. ``delays``: line_id, vehicle_id, delay, recovered."""
    d = F.col("delay")
    # Numbers per vehicle first, which are kept in a hash table; the worst vehicle is a struct, and Spark sorts all rows for the greatest of those.
    per = delays.groupBy("line_id", "vehicle_id").agg(
        F.count("*").alias("n"), F.count_if(F.abs(d) <= on_time).alias("on_time"), F.count_if(d > on_time).alias("late"), F.count_if(d < -on_time).alias("early"),
        F.count_if("recovered").alias("recovered"), F.sum(d).alias("sum"), F.count(d).alias("known"), F.max(d).alias("most"))
    worst = F.max(F.when(F.col("most") > 0, F.struct("most", (-F.col("vehicle_id")).alias("v"))))
    out = per.rollup("line_id").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("tracked"), *[F.sum(c).alias(c) for c in ("on_time", "late", "early", "recovered")],
        js_round(F.sum("sum") / F.nullif(F.sum("known"), F.lit(0))).alias("avg_delay"), F.greatest(F.lit(0), F.max("most")).alias("max_delay"), worst.alias("_w"))
    return out.withColumn("on_time_rate", js_round(F.col("on_time") / F.col("tracked"), 3)).withColumn("worst_vehicle", -F.col("_w.v")).drop("_w")


# ---- queues --------------------------------------------------------------------------------------------------------------

def largest_remainder(df: DataFrame, group: list[str], key: str, value: str, name: str = "whole") -> DataFrame:
    """Whole numbers that add up to the rounded total of their group: everyone gets the floor, the missing ones go to the
    largest remainders, ties to the lower key. Ranks are exact for groups of any size."""
    v = F.greatest(F.lit(0.0), F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    d = df.withColumn("_f", F.floor(v)).withColumn("_rest", v - F.floor(v))
    need = d.groupBy(*group).agg((F.floor(F.sum(F.col("_f") + F.col("_rest")) + 0.5) - F.sum("_f")).alias("_need"))
    ranked = numbered(d, group, -F.floor(F.col("_rest") * 1024), [F.col("_rest").desc(), F.col(key)], "_rank")
    return ranked.join(need, group).withColumn(name, F.col("_f") + (F.col("_rank") <= F.col("_need")).cast("long")).drop("_f", "_rest", "_rank", "_need")


def waiting_summary(cohorts: DataFrame, now: int) -> DataFrame:
    """People waiting and lost per (station), (station, line) and (station, company), with the longest wait in seconds.
    ``cohorts``: station_id, company_id, line_id (NULL = no line yet), dest_id, people, lost, start_sec."""
    c = cohorts.withColumn("line_key", F.coalesce("line_id", F.lit(0)))
    sets = [[F.col("station_id")], [F.col("station_id"), F.col("line_key")], [F.col("station_id"), F.col("company_id")]]
    out = c.groupingSets(sets, "station_id", "line_key", "company_id").agg(
        F.grouping_id().alias("level"), js_round(F.sum("people")).alias("waiting"), js_round(F.sum("lost")).alias("lost"),
        F.min(F.when(F.col("people") > 0, F.col("start_sec"))).alias("_oldest"))
    return out.withColumn("wait_sec", F.when(F.col("_oldest").isNull(), 0).otherwise(F.greatest(F.lit(0), F.lit(now) - F.col("_oldest")))).drop("_oldest")


def waiting_destinations(cohorts: DataFrame) -> DataFrame:
    """Where the people at each station want to go, in whole people that add up, with the lines they wait for (lines
    first in number order, 0 = none last)."""
    c = cohorts.where("people > 0").groupBy("station_id", F.coalesce("dest_id", F.lit(0)).alias("dest_key")).agg(
        F.sum("people").alias("people"), F.sort_array(F.collect_set(F.coalesce("line_id", F.lit(0)))).alias("_l"))
    lines = F.when(F.get("_l", 0) == 0, F.concat(F.slice("_l", 2, F.size("_l")), F.array(F.lit(0).cast("long")))).otherwise(F.col("_l"))
    return largest_remainder(c.withColumn("lines", lines).drop("_l"), ["station_id"], "dest_key", "people", "whole")


def expire_waiting(cohorts: DataFrame, now: int, limit: int = PATIENCE_SEC) -> tuple[DataFrame, DataFrame]:
    """Groups that waited longer than the limit leave: (cohorts left, people lost per station and line)."""
    gone = (F.lit(now) - F.col("start_sec")) > limit
    lost = cohorts.where(gone).groupBy("station_id", "line_id").agg(F.sum("people").alias("lost_people"), F.count("*").alias("groups"))
    return cohorts.where(~gone), lost


def reconcile_waiting(cohorts: DataFrame, line_stops: DataFrame) -> DataFrame:
    """Groups that wait for a line which does not serve their station go to the fallback queue (no line), and plans whose
    next leg does not start here on that line are dropped. ``moved`` and ``plan_reset`` say what happened; nobody is lost.
    ``cohorts`` adds plan_line and plan_from (NULL without a plan)."""
    served = line_stops.select("line_id", "station_id").distinct().withColumn("_ok", F.lit(True))
    j = cohorts.join(served, ["line_id", "station_id"], "left")
    moved = F.col("line_id").isNotNull() & F.col("_ok").isNull()
    j = j.withColumn("moved", moved).withColumn("line_id", F.when(F.col("moved"), F.lit(None)).otherwise(F.col("line_id")))
    feasible = F.coalesce((F.col("plan_line") == F.col("line_id")) & (F.col("plan_from") == F.col("station_id")), F.lit(False))
    reset = F.col("plan_line").isNotNull() & ~feasible
    return j.withColumn("plan_reset", reset).withColumn("plan_line", F.when(~reset, F.col("plan_line"))).withColumn(
        "plan_from", F.when(F.col("plan_line").isNotNull(), F.col("plan_from"))).drop("_ok")


# ---- daily statistics ---------------------------------------------------------------------------------------------------------

SUMS = ["riders", "transfers", "vehicle_km", "load_sum", "load_n", "wait_sum", "wait_n"]


def accumulate_daily(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Add events to the additive table (line_id, day, sums). The union with an existing table is the upsert."""
    rows = events.select("line_id", "day", *SUMS)
    if before is not None:
        rows = before.select("line_id", "day", *SUMS).unionByName(rows)
    return rows.groupBy("line_id", "day").agg(*[F.sum(c).alias(c) for c in SUMS])


def _shown(riders: Column, transfers: Column, km: Column, ls: Column, ln: Column, ws: Column, wn: Column) -> list[Column]:
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [js_round(z(riders)).alias("riders"), js_round(z(transfers)).alias("transfers"), js_round(z(km), 1).alias("vehicle_km"),
            F.when(z(ln) > 0, js_round(z(ls) / F.nullif(z(ln), F.lit(0.0)), 3)).otherwise(0.0).alias("avg_load"),
            F.when(z(wn) > 0, js_round(z(ws) / F.nullif(z(wn), F.lit(0.0)))).otherwise(0).alias("avg_wait")]


def aggregate_stats(daily: DataFrame, by: list[str]) -> DataFrame:
    return daily.groupBy(*by).agg(*_shown(*[F.sum(c) for c in SUMS]))


def line_stats(daily: DataFrame, lines: DataFrame, today: int, days: int = 7) -> DataFrame:
    """The last ``days`` days of each line, days without rows as zero, with riders of the seven days up to each. Only the
    days that can matter are read."""
    n = max(1, days)
    first = max(1, today - n + 1)
    grid = lines.select(F.col("id").alias("line_id")).withColumn("day", F.explode(F.sequence(F.lit(max(1, first - 6)), F.lit(today))))
    rows = daily.where(F.col("day").between(first - 6, today))
    j = grid.join(rows, ["line_id", "day"], "left")
    week = Window.partitionBy("line_id").orderBy("day").rangeBetween(-6, 0)
    return j.withColumn("week_riders", js_round(F.coalesce(F.sum("riders").over(week).cast("double"), F.lit(0.0)))).where(F.col("day") >= first).select(
        "line_id", "day", *_shown(*[F.col(c) for c in SUMS]), "week_riders")


def pax_ledger(events: DataFrame, lines: DataFrame) -> DataFrame:
    """Riders, transfers, arrivals and fare revenue per station and day. ``events``: station_id, line_id, day, kind
    (board/alight/transfer), people; ``lines``: id, length_m."""
    fare = FARE_BASE + F.greatest(F.lit(1.0), F.col("length_m") / 1000) * FARE_SHARE * FARE_PER_KM
    per = events.groupBy("station_id", "line_id", "day", "kind").agg(F.sum("people").alias("people"))
    j = per.join(lines.select(F.col("id").alias("line_id"), "length_m"), "line_id", "left")
    def n(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("people")).otherwise(0.0))
    return j.groupBy("station_id", "day").agg(n("board").alias("departed"), n("alight").alias("arrived"), n("transfer").alias("transferred"),
                                              F.sum(F.when(F.col("kind") == "alight", F.col("people") * F.coalesce(fare, F.lit(0.0))).otherwise(0.0)).alias("revenue"))


def pax_summary(daily: DataFrame, ledger: DataFrame, od: DataFrame | None, cohorts: DataFrame, day: int, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """One row for the network's day, and the busiest lines."""
    d = daily.where(F.col("day") == day)
    net = d.agg(F.countDistinct("line_id").alias("lines"), *_shown(*[F.sum(c) for c in SUMS]))
    st = ledger.where(F.col("day") == day).agg(F.count("*").alias("stations"), js_round(F.coalesce(F.sum("departed"), F.lit(0.0))).alias("departed"),
                                               js_round(F.coalesce(F.sum("arrived"), F.lit(0.0))).alias("arrived"), js_round(F.coalesce(F.sum("transferred"), F.lit(0.0))).alias("transferred"))
    q = cohorts.agg(js_round(F.coalesce(F.sum("people"), F.lit(0.0))).alias("waiting"))
    out = net.join(st, F.lit(True)).join(q, F.lit(True))  # one row each
    if od is not None:
        out = out.join(od.where("kept").agg(F.countDistinct("origin").alias("with_demand")), F.lit(True))
    best = d.groupBy("line_id").agg(F.sum("riders").alias("riders")).orderBy(F.col("riders").desc(), "line_id").limit(top)
    return out, best


# ---- fleet ------------------------------------------------------------------------------------------------------------------------

def service_state(vehicles: DataFrame, lines: DataFrame, runs: DataFrame, today: int) -> DataFrame:
    """State of each vehicle. ``vehicles``: id, line_id; ``lines``: id, scheduled, paused, n_stops; ``runs``: vehicle_id,
    active, paused AS run_paused, dep_day."""
    j = vehicles.join(lines.select(F.col("id").alias("line_id"), "scheduled", "paused", "n_stops"), "line_id", "left").join(
        runs.withColumnRenamed("vehicle_id", "id").withColumn("_rt", F.lit(True)), "id", "left")
    state = (F.when(F.col("line_id").isNull(), "idle").when(F.col("_rt").isNull(), "not-online")
             .when(F.coalesce("n_stops", F.lit(0)) == 0, "no-path")
             .when(~F.col("scheduled"), F.when(F.col("run_paused"), "paused").otherwise("run"))
             .when(F.col("paused"), F.when(F.col("active"), "run").otherwise("paused"))
             .when(F.col("active"), "run").when(F.col("dep_day").isNull(), "no-departure")
             .when(F.col("dep_day") > today, "service-ended").otherwise("before-departure"))
    return j.select("id", "line_id", state.alias("state"))


def fleet_counts(states: DataFrame) -> DataFrame:
    return states.rollup("line_id", "state").agg(F.count("*").alias("vehicles"), F.grouping_id().alias("level"))


def own_vehicles(vehicles: DataFrame, box: DataFrame, n: int, size: int = 128) -> DataFrame:
    """Each view with those of its viewer's vehicles that can be among its ``n`` nearest: columns of both. ``box``: view_id, viewer, box_min_lat..box_max_lon.

    An owner's vehicles are dealt to parts of about ``size`` that lie together, each with its centre and radius. A view meets the parts; by the triangle inequality those that
    begin beyond the place where ``n`` vehicles are sure to be reached have none of the nearest. Vehicles without a place rank by id."""
    lost = F.when(F.col("lat").isNull() | F.col("lon").isNull(), 1).when(F.isnan("lat") | F.isnan("lon"), 2).otherwise(0)
    v = vehicles.withColumn("_lost", lost)
    nowhere = nearest_rank(v.where("_lost > 0"), ["owner", "_lost"], ["id"], n).drop("rank", "_lost")
    row, col = F.floor((F.col("lat") + 90) * 1000), F.floor((F.col("lon") + 180) * 1000)
    code = F.lit(0).cast("long")
    for k in range(19):
        bit = lambda x: F.shiftright(x, k).bitwiseAND(F.lit(1))
        code = code + bit(row) * (1 << 2 * k + 1) + bit(col) * (1 << 2 * k)
    placed = cut_lineage(numbered(v.where("_lost = 0 AND owner IS NOT NULL").drop("_lost").withColumn("_z", code), ["owner"], F.floor(F.col("_z") / 1024), ["_z", "id"], "_n")
                         .withColumn("_part", F.floor((F.col("_n") - 1) / size)).drop("_z", "_n"))
    centre = placed.groupBy("owner", "_part").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"), F.count("*").alias("c_n"))
    reach = F.max(meters_between(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))) + 1.0  # a metre to spare, as great distances are less exact
    parts = placed.join(centre, ["owner", "_part"]).groupBy("owner", "_part", "c_lat", "c_lon", "c_n").agg(reach.alias("c_r"))
    d = meters_between(F.col("c_lat"), F.col("c_lon"), (F.col("box_min_lat") + F.col("box_max_lat")) / 2, (F.col("box_min_lon") + F.col("box_max_lon")) / 2)
    met = box.join(parts, F.col("owner") == F.col("viewer")).withColumn("_d", d)
    by = Window.partitionBy("view_id", "viewer")
    met = met.withColumn("_sum", F.sum("c_n").over(by.orderBy(F.col("_d") + F.col("c_r"), "_part").rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("_sure", F.min(F.when(F.col("_sum") >= n, F.col("_d") + F.col("c_r"))).over(by))
    near = met.where(F.coalesce(F.col("_d") - F.col("c_r") <= F.col("_sure"), F.lit(True))).select(*box.columns, "owner", "_part")
    return near.join(placed, ["owner", "_part"]).drop("_part").unionByName(box.join(nowhere, F.col("owner") == F.col("viewer")))


def pick_visible(vehicles: DataFrame, views: DataFrame, n: int) -> DataFrame:
    """Per view: the viewer's own vehicles, then those in the box by distance to its centre, at most ``n``.
    ``views``: view_id, owner, min_lat..max_lon; ``vehicles``: id, owner, lat, lon."""
    box = views.select("view_id", F.col("owner").alias("viewer"), "min_lat", "max_lat", "min_lon", "max_lon")
    seen = point_box_join(vehicles, box)
    own = own_vehicles(vehicles, box.select("view_id", "viewer", *[F.col(c).alias(f"box_{c}") for c in ("min_lat", "max_lat", "min_lon", "max_lon")]), n)
    cols = ["view_id", "id", "owner", "viewer", "lat", "lon", "box_min_lat", "box_max_lat", "box_min_lon", "box_max_lon"]
    both = seen.where("owner <> viewer").select(*cols).unionByName(own.select(*cols))
    d = meters_between(F.col("lat"), F.col("lon"), (F.col("box_min_lat") + F.col("box_max_lat")) / 2, (F.col("box_min_lon") + F.col("box_max_lon")) / 2)
    both = both.withColumn("_other", (F.col("owner") != F.col("viewer")).cast("int")).withColumn("meters", js_round(d, 3))
    return nearest_rank(both, ["view_id"], ["_other", "meters", "id"], n).select("view_id", "id", "meters", "rank")


def top_with_other(df: DataFrame, key: str, n: int = 256) -> DataFrame:
    """Counts of the ``n`` most frequent keys and one row ``other`` for the rest."""
    c = df.groupBy(key).agg(F.count("*").alias("n"))
    top = c.orderBy(F.col("n").desc(), key).limit(n)
    rest = c.join(top.select(key), key, "left_anti").agg(F.sum("n").alias("n")).where("n IS NOT NULL").select(F.lit("other").alias("item"), "n")
    return top.select(F.col(key).cast("string").alias("item"), "n").unionByName(rest)


def compare_lines(lines: DataFrame, line_stops: DataFrame, vehicles: DataFrame, trips: DataFrame, lengths: DataFrame, people: DataFrame) -> DataFrame:
    """One row per line with stops, vehicles, trips, length, time and people served; busiest first."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.where("line_id IS NOT NULL").groupBy("line_id").agg(F.count("*").alias(name))
    pop = line_stops.select("line_id", "station_id").distinct().join(people, "station_id").groupBy("line_id").agg(F.sum("pop").alias("people"))
    j = (lines.select(F.col("id").alias("line_id"), "name", "kind").join(count(line_stops, "stops"), "line_id", "left").join(count(vehicles, "vehicles"), "line_id", "left")
         .join(count(trips, "trips"), "line_id", "left").join(lengths, "line_id", "left").join(pop, "line_id", "left"))
    return j.na.fill(0, ["stops", "vehicles", "trips", "people"]).withColumn("broken", F.col("length_m").isNull()).orderBy(F.col("trips").desc(), F.col("vehicles").desc(), "name")


def snap_stops_to_line(stops: DataFrame, paths: DataFrame, max_m: float = 1500.0) -> DataFrame:
    """Stops whose node is not on their line's path, with the nearest path point within ``max_m``.
    ``stops``: line_id, station_id, node_id, lat, lon; ``paths``: line_id, node_id, lat, lon."""
    off = stops.where("node_id IS NOT NULL").join(paths.select("line_id", "node_id"), ["line_id", "node_id"], "left_anti")
    p = paths.select("line_id", F.col("node_id").alias("p_node"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    m = meters_between(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    near = off.join(p, "line_id").withColumn("m", m).where(F.col("m") < max_m)
    return near.groupBy("line_id", "station_id").agg(F.min(F.struct("m", "p_node", "p_lat", "p_lon")).alias("b")).select(
        "line_id", "station_id", F.col("b.p_node").alias("node_id"), F.col("b.p_lat").alias("lat"), F.col("b.p_lon").alias("lon"), js_round(F.col("b.m")).alias("distance_m"))


def write_lines_csv(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").option("header", True).option("quoteAll", True).csv(path)


# ---- import from tags ---------------------------------------------------------------------------------------------------------------

def import_links(candidates: DataFrame, rail_nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Where candidates join their network: (id, node_id, distance_m, direct). Buses use the road network, all other kinds the rail network. A candidate that
    is a node of its network is that node. Else a bus stop takes the nearer end of the nearest road segment within 80 m, a station on rails the
    nearest node within 200 m; the others have no row. ``candidates``: id, osm_type, osm_id, kind, lat, lon; ``roads``: edges."""
    ends = roads.select(F.explode(F.array("a", "b")).alias("osm_id")).distinct()
    bus = F.col("kind") == "bus"
    of_network = rail_nodes.select(F.col("id").alias("osm_id"), F.lit(False).alias("_bus")).distinct().unionByName(ends.withColumn("_bus", F.lit(True)))
    asked = candidates.select("id", "osm_type", "osm_id", "lat", "lon", bus.alias("_bus"))
    direct = asked.where("osm_type = 'node'").join(of_network, ["osm_id", "_bus"], "left_semi")
    rest = asked.join(direct.select("id"), "id", "left_anti")
    on_road = snap_to_segment(rest.where("_bus"), roads, IMPORT_SNAP_BUS_M).select("id", F.col("end_node").alias("node_id"), "distance_m")
    on_rail = snap_to_node(rest.where("NOT _bus"), rail_nodes, IMPORT_SNAP_RAIL_M).select("id", "node_id", "distance_m")
    return direct.select("id", F.col("osm_id").alias("node_id"), F.lit(0.0).alias("distance_m"), F.lit(True).alias("direct")).unionByName(
        on_road.unionByName(on_rail).withColumns({"distance_m": js_round(F.col("distance_m")).cast("double"), "direct": F.lit(False)}))


def import_stations(ds: OsmDataset, existing: DataFrame, rail_nodes: DataFrame, roads: DataFrame, box: dict | None = None) -> dict[str, DataFrame]:
    """New stations from tagged nodes and ways. Candidates are taken in order of rule, nodes before ways, id; a candidate
    is skipped if its element was imported before, if a station of its kind already stands or was just taken within 25 m, or
    if it does not join the network of its kind (``import_links``). ``existing``: osm_type, osm_id, kind, lat, lon; ``rail_nodes``: id, lat, lon; ``roads``: edges."""
    t = F.col("tags")
    # Edges, ends and stations there are enter several joins, so they are written once.
    existing = cut_lineage(existing)
    roads, rail_nodes = cut_lineage(roads.select("way_id", "seq", "a", "a_lat", "a_lon", "b", "b_lat", "b_lon")), cut_lineage(rail_nodes)
    rule = F.lit(None).cast("int")
    for i in reversed(range(len(IMPORT_RULES))):
        rule = F.when(TG.eq(t, *IMPORT_RULES[i]), i).otherwise(rule)

    def found(df: DataFrame, osm_type: str, rank: int) -> DataFrame:
        return df.where(rule.isNotNull()).select(F.lit(osm_type).alias("osm_type"), F.lit(rank).alias("_t"), F.col("id").alias("osm_id"), "lat", "lon", "tags", rule.alias("rule"))

    tagged = ds.ways.select("id", TG.read_once(t).alias("tags")).where(rule.isNotNull())
    refs = ds.way_nodes.join(tagged.select(F.col("id").alias("way_id")), "way_id", "left_semi")
    center = located_refs(refs, ds.nodes).groupBy(F.col("way_id").alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    nodes = ds.nodes.where("tags IS NOT NULL").select("id", "lat", "lon", TG.read_once(t).alias("tags"))
    c = found(nodes, "node", 0).unionByName(found(tagged.join(center, "id"), "way", 1))
    c = c.withColumn("kind", TG.station_kind(t)).where("kind IS NOT NULL")
    if box is not None:
        c = c.where(in_box(F.col("lat"), F.col("lon"), box))
    # The order of candidates: rule, nodes before ways, id.
    c = cut_lineage(c.withColumn("key", F.struct("rule", "_t", "osm_id")))
    old = c.join(existing.select("osm_type", "osm_id"), ["osm_type", "osm_id"], "left_semi")
    new = c.join(existing.select("osm_type", "osm_id"), ["osm_type", "osm_id"], "left_anti")
    new = new.withColumn("id", F.col("osm_id") * 2 + F.col("_t"))
    # Candidates without a network node nearby never take a place.
    snap = cut_lineage(import_links(new, rail_nodes, roads))
    linked = cut_lineage(new.join(snap, "id"))
    unlinked = new.join(snap, "id", "left_anti")
    near_old = neighbour_pairs(linked.select("id", "lat", "lon", "kind").unionByName(
        existing.select((-F.col("osm_id") - 1).alias("id"), "lat", "lon", "kind")), IMPORT_APART_M, ["kind"]).where("a_kind = b_kind")
    blocked = near_old.where("a_id >= 0 AND b_id < 0").select(F.col("a_id").alias("id")).distinct()
    free = linked.join(blocked, "id", "left_anti")
    keys = linked.select("id", "key")
    near = (near_old.where("a_id >= 0 AND b_id >= 0").select("a_id", "b_id").join(keys.toDF("a_id", "key"), "a_id").join(keys.toDF("b_id", "other"), "b_id").select("key", "other"))
    free_keys = free.select("key")
    near = near.join(free_keys, "key", "left_semi").join(free_keys.withColumnRenamed("key", "other"), "other", "left_semi")
    taken = keep_apart(free_keys, near)
    created = free.join(taken, "key", "left_semi")
    rule_name = F.element_at(F.array(*[F.lit(f"{k}={v}") for k, v in IMPORT_RULES]), F.col("rule") + 1)
    created = created.select("osm_type", "osm_id", "kind", TG.station_name(F.col("tags"), F.col("kind"), F.col("osm_id")).alias("name"), "lat", "lon", "node_id",
                             F.when(F.col("kind") == "bus", 450).otherwise(700).alias("catchment_m"), F.concat("osm_type", F.lit(":"), rule_name).alias("source"))
    counts = created.groupBy("kind", "source").agg(F.count("*").alias("created"))
    skipped = linked.join(taken, "key", "left_anti")
    return {"created": created, "counts": counts, "already": old, "near": skipped, "unlinked": unlinked}
