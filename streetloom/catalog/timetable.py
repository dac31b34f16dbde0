"""Timetables, delays, queues, daily statistics and the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.catalog.elements import hav
from streetloom.catalog.transit import CUM
from streetloom.functions import geo
from streetloom.operators import transit as TR
from streetloom.plans.demo import World

DEP = """dep AS (SELECT line_id, CAST(i AS INT) AS run_index, CAST(first_sec + i * headway_sec AS INT) AS dep_sec FROM d_schedules, LATERAL (SELECT unnest(range(0, (last_sec - first_sec) // headway_sec + 1)) AS i) g WHERE mode = 'headway'
 UNION ALL SELECT line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY t) - 1 AS INT), t FROM (SELECT DISTINCT line_id, CAST(first_sec + (k * k * 900) % 30000 AS INT) AS t FROM d_schedules, LATERAL (SELECT unnest(range(0, 12)) AS k) g WHERE mode = 'timetable') q)"""


def deps(w: World):
    times = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: (F.col("first_sec") + (k * k * 900) % 30000).cast("int"))
    return TR.departures(w.raw("d_schedules").withColumn("times", times), most=1440)


@query("departures", "O126", f"WITH {DEP} SELECT line_id, run_index, dep_sec FROM dep")
def _(w: World):
    return deps(w)


ASG = f"""{DEP}, fl AS (SELECT line_id, list(id ORDER BY id) AS ids FROM d_vehicles WHERE line_id IS NOT NULL GROUP BY line_id),
wa AS (SELECT line_id, run_index, CASE run_index % 3 WHEN 0 THEN line_id * 90 + run_index + 1 WHEN 1 THEN line_id * 90 + 95 ELSE 999999999 END AS want FROM dep WHERE run_index % 4 = 0),
ru AS (SELECT dep.line_id, dep.run_index, dep.dep_sec, wa.want, coalesce(list_contains(fl.ids, wa.want), false) AS pinned, CASE WHEN list_contains(fl.ids, wa.want) THEN wa.want WHEN fl.ids IS NOT NULL THEN fl.ids[dep.run_index % len(fl.ids) + 1] END AS vehicle_id
  FROM dep LEFT JOIN fl ON fl.line_id = dep.line_id LEFT JOIN wa ON wa.line_id = dep.line_id AND wa.run_index = dep.run_index)"""


def assigned(w: World):
    d = deps(w)
    k = F.col("run_index") % 3
    want = d.where("run_index % 4 = 0").select("line_id", "run_index", F.when(k == 0, F.col("line_id") * 90 + F.col("run_index") + 1).when(k == 1, F.col("line_id") * 90 + 95)
                                               .otherwise(F.lit(999999999).cast("long")).alias("vehicle_id"), F.lit(0).alias("ord"))
    return TR.assign_vehicles(d, w.raw("d_vehicles"), want)


@query("vehicle_assignment", "O127", f"""WITH {ASG} SELECT 'run' AS what, line_id, run_index, vehicle_id, CAST(pinned AS VARCHAR) AS note FROM ru
UNION ALL SELECT 'missed', line_id, run_index, want, CASE WHEN want IN (SELECT id FROM d_vehicles) THEN 'vehicle-busy' ELSE 'vehicle-gone' END FROM ru WHERE want IS NOT NULL AND NOT pinned""")
def _(w: World):
    runs, missed = assigned(w)
    return runs.select(F.lit("run").alias("what"), "line_id", "run_index", "vehicle_id", F.col("pinned").cast("string").alias("note")).unionByName(
        missed.select(F.lit("missed").alias("what"), "line_id", "run_index", "vehicle_id", F.col("reason").alias("note")))


KINDS_SQL = "kd AS (SELECT * FROM (VALUES ('metro', 1.0::DOUBLE, 1.1::DOUBLE), ('bus', 0.9::DOUBLE, 1.3::DOUBLE), ('tram', 1.2::DOUBLE, 1.2::DOUBLE)) AS v(kind, accel, brake))"


@query("timetable", "O128", f"""WITH {ASG}, {CUM}, {KINDS_SQL}, sg AS (SELECT line_id, idx, station_id, abs(cum - lag(cum) OVER (PARTITION BY line_id ORDER BY idx)) AS d, lead(idx) OVER (PARTITION BY line_id ORDER BY idx) IS NULL AS lst FROM cs),
cb AS (SELECT ru.line_id, ru.run_index, ru.vehicle_id, ru.dep_sec, least(v.max_speed, 400) / 3.6::DOUBLE AS v, kd.accel AS a, kd.brake AS b FROM ru JOIN d_vehicles v ON v.id = ru.vehicle_id JOIN kd ON kd.kind = v.kind),
x AS (SELECT cb.*, sg.idx, sg.station_id, CASE WHEN d IS NULL OR d <= 0 THEN 0 WHEN d >= v * v / (2 * a) + v * v / (2 * b) THEN v / a + v / b + (d - v * v / (2 * a) - v * v / (2 * b)) / v ELSE sqrt(2 * d * a * b / (a + b)) / a + sqrt(2 * d * a * b / (a + b)) / b END AS run,
   CASE WHEN lst THEN 45 ELSE 25 END AS dwell FROM cb JOIN sg ON sg.line_id = cb.line_id),
y AS (SELECT *, sum(CASE WHEN idx = 0 THEN 0 ELSE run + dwell END) OVER (PARTITION BY line_id, run_index ORDER BY idx) AS o FROM x)
SELECT line_id, run_index, vehicle_id, idx, station_id, floor((dep_sec + o - CASE WHEN idx = 0 THEN 0 ELSE dwell END) * 1000 + 0.5) / 1000 AS arrival_sec, floor((dep_sec + o) * 1000 + 0.5) / 1000 AS departure_sec FROM y""")
def _(w: World):
    kinds = w.spark.sql("SELECT * FROM VALUES ('metro', 1.0D, 1.1D), ('bus', 0.9D, 1.3D), ('tram', 1.2D, 1.2D) AS k(kind, accel, brake)")
    t = TR.timetable(assigned(w)[0], TR.cumulative_stops(w.line_stops, w.stations), kinds, w.raw("d_vehicles"))
    return t.select("line_id", "run_index", "vehicle_id", "idx", "station_id", geo.js_round(F.col("arrival_sec"), 3).alias("arrival_sec"), geo.js_round(F.col("departure_sec"), 3).alias("departure_sec"))


@query("next_departures", "O92", f"""WITH {DEP} SELECT line_id, run_index, CAST(wait_sec AS INT) AS wait_sec, next_day, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY wait_sec, run_index) AS n FROM
 (SELECT *, CASE WHEN dep_sec >= 70000 THEN dep_sec - 70000 ELSE dep_sec + 16400 END AS wait_sec, dep_sec < 70000 AS next_day FROM dep) d) q WHERE n <= 5""")
def _(w: World):
    return TR.next_departures(deps(w), 70000, 5).select("line_id", "run_index", "wait_sec", "next_day", "rank")


@query("asof_plan", "O50", """
SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS plan_event FROM events e WHERE event_type = 'view'""")
def _(w: World):
    e = w.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    obs = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    plan = e.where("event_type = 'purchase'").select(F.col("event_id").alias("plan_event"), "user_id", "ts")
    return TR.asof_plan(obs, plan, ["user_id"], "ts", ["plan_event"], 6 * 3600).select("event_id", F.col("known.plan_event").alias("plan_event"))


DELAY = """dl AS (SELECT *, departed - planned_dep AS rd, CASE WHEN origin THEN departed - planned_dep ELSE arrived - planned_arr END AS ra FROM d_obs),
d2 AS (SELECT *, CASE WHEN scheduled THEN rd ELSE greatest(0, rd) END AS dep_delay, CASE WHEN scheduled THEN ra ELSE greatest(0, ra) END AS arr_delay FROM dl),
d3 AS (SELECT *, dep_delay - coalesce(lag(dep_delay) OVER (PARTITION BY run_id ORDER BY idx), dep_delay) AS delta FROM d2),
d4 AS (SELECT *, greatest(0, greatest(0, departed - arrived) - greatest(0, planned_dep - planned_arr)) AS excess, CASE WHEN bus AND congest_sec >= 15 THEN 'congestion' ELSE 'delayed' END AS lt FROM d3),
d5 AS (SELECT *, CASE WHEN late_start THEN 'departure' WHEN blocked_sec >= 15 THEN CASE WHEN bus THEN lt ELSE 'blocked' END WHEN excess >= 15 THEN 'boarding' WHEN delta > 15 THEN lt WHEN delta < -15 THEN 'recovered'
   WHEN dep_delay > 60 THEN lt WHEN dep_delay < -60 THEN 'early' ELSE 'on-time' END AS cause FROM d4)"""


@query("delay_records", "O129", f"WITH {DELAY} SELECT run_id, idx, arr_delay, dep_delay, delta, cause FROM d5")
def _(w: World):
    return TR.delay_records(w.raw("d_obs")).select("run_id", "idx", "arr_delay", "dep_delay", "delta", "cause")


@query("delay_trend", "O90", f"""WITH {DELAY}, t AS (SELECT run_id, idx, dep_delay AS delay, delta, greatest(0, max(dep_delay) OVER (PARTITION BY run_id ORDER BY idx)) AS peak FROM d3)
SELECT run_id, idx, delta, peak, CASE WHEN delta > 15 THEN 'worsening' WHEN delta < -15 THEN 'recovering' ELSE 'stable' END AS trend, peak >= 60 AND delay <= 60 AS recovered FROM t""")
def _(w: World):
    d = TR.delay_records(w.raw("d_obs")).select("run_id", "idx", F.col("dep_delay").alias("delay"))
    return TR.delay_trend(d).select("run_id", "idx", "delta", "peak", "trend", "recovered")


@query("punctuality", "O130", f"""WITH {DELAY}, t AS (SELECT line_id, vehicle_id, dep_delay AS d, greatest(0, max(dep_delay) OVER (PARTITION BY run_id ORDER BY idx)) >= 60 AND dep_delay <= 60 AS rec FROM d3)
SELECT line_id, CAST(grouping(line_id) AS BIGINT) AS level, count(*) AS tracked, count(*) FILTER (WHERE abs(d) <= 60) AS on_time, count(*) FILTER (WHERE d > 60) AS late, count(*) FILTER (WHERE d < -60) AS early,
  count(*) FILTER (WHERE rec) AS recovered, CAST(floor(avg(d) + 0.5) AS BIGINT) AS avg_delay, greatest(0, max(d)) AS max_delay, floor(count(*) FILTER (WHERE abs(d) <= 60) / count(*) * 1000 + 0.5) / 1000 AS on_time_rate,
  arg_max(vehicle_id, {{'d': d, 'v': -vehicle_id}}) FILTER (WHERE d > 0) AS worst_vehicle FROM t GROUP BY ROLLUP (line_id)""")
def _(w: World):
    rec = TR.delay_records(w.raw("d_obs"))
    t = TR.delay_trend(rec.select("run_id", "idx", "line_id", "vehicle_id", F.col("dep_delay").alias("delay")))
    return TR.punctuality(t)


@query("whole_people", "O70", """
WITH c AS (SELECT station_id, coalesce(dest_id, 0) AS dest_key, sum(people) AS people FROM d_cohorts GROUP BY 1, 2),
f AS (SELECT *, floor(people) AS fl, people - floor(people) AS rest, floor(sum(people) OVER (PARTITION BY station_id) + 0.5) - sum(floor(people)) OVER (PARTITION BY station_id) AS need FROM c)
SELECT station_id, dest_key, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY station_id ORDER BY rest DESC, dest_key) <= need THEN 1 ELSE 0 END AS BIGINT) AS whole FROM f""")
def _(w: World):
    c = w.raw("d_cohorts").groupBy("station_id", F.coalesce("dest_id", F.lit(0)).alias("dest_key")).agg(F.sum("people").alias("people"))
    return TR.largest_remainder(c, ["station_id"], "dest_key", "people").select("station_id", "dest_key", "whole")


@query("waiting_summary", "O131", """
WITH c AS (SELECT *, coalesce(line_id, 0) AS line_key FROM d_cohorts)
SELECT station_id, line_key, company_id, CAST(grouping(station_id, line_key, company_id) AS BIGINT) AS level, CAST(floor(sum(people) + 0.5) AS BIGINT) AS waiting, CAST(floor(sum(lost) + 0.5) AS BIGINT) AS lost,
  CAST(greatest(0, 3600 - min(start_sec)) AS INT) AS wait_sec FROM c GROUP BY GROUPING SETS ((station_id), (station_id, line_key), (station_id, company_id))""")
def _(w: World):
    return TR.waiting_summary(w.raw("d_cohorts"), 3600)


@query("waiting_destinations", "O131", """
WITH c AS (SELECT station_id, coalesce(dest_id, 0) AS dest_key, sum(people) AS people, list_sort(list(DISTINCT coalesce(line_id, 0))) AS l FROM d_cohorts WHERE people > 0 GROUP BY 1, 2),
f AS (SELECT *, floor(people) AS fl, people - floor(people) AS rest, floor(sum(people) OVER (PARTITION BY station_id) + 0.5) - sum(floor(people)) OVER (PARTITION BY station_id) AS need FROM c)
SELECT station_id, dest_key, array_to_string(CASE WHEN l[1] = 0 THEN list_append(l[2:], 0) ELSE l END, ',') AS lines, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY station_id ORDER BY rest DESC, dest_key) <= need THEN 1 ELSE 0 END AS BIGINT) AS whole FROM f""")
def _(w: World):
    d = TR.waiting_destinations(w.raw("d_cohorts"))
    return d.select("station_id", "dest_key", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), "whole")


@query("expired_waiting", "O93", """
SELECT station_id, line_id, sum(people) AS lost_people, count(*) AS n_groups FROM d_cohorts WHERE 3600 - start_sec > 900 GROUP BY station_id, line_id""")
def _(w: World):
    return TR.expire_waiting(w.raw("d_cohorts"), 3600)[1].withColumnRenamed("groups", "n_groups")


@query("reconciled_waiting", "O132", """
WITH s AS (SELECT DISTINCT line_id, station_id FROM d_line_stops), j AS (SELECT c.*, c.line_id IS NOT NULL AND s.line_id IS NULL AS moved FROM d_cohorts c LEFT JOIN s ON s.line_id = c.line_id AND s.station_id = c.station_id),
k AS (SELECT *, CASE WHEN moved THEN NULL ELSE line_id END AS nl FROM j), r AS (SELECT *, plan_line IS NOT NULL AND NOT coalesce(plan_line = nl AND plan_from = station_id, false) AS rs FROM k)
SELECT station_id, nl AS line_id, moved, rs AS plan_reset, count(*) AS n_groups, sum(people) AS people FROM r GROUP BY station_id, nl, moved, rs""")
def _(w: World):
    r = TR.reconcile_waiting(w.raw("d_cohorts"), w.line_stops)
    return r.groupBy("station_id", "line_id", "moved", "plan_reset").agg(F.count("*").alias("n_groups"), F.sum("people").alias("people"))


DAILY = "dy AS (SELECT line_id, day, sum(riders) AS riders, sum(transfers) AS transfers, sum(vehicle_km) AS vehicle_km, sum(load_sum) AS load_sum, sum(load_n) AS load_n, sum(wait_sum) AS wait_sum, sum(wait_n) AS wait_n FROM d_ride_events GROUP BY line_id, day)"
SHOWN = """CAST(floor(coalesce({0}(riders), 0) + 0.5) AS BIGINT) AS riders, CAST(floor(coalesce({0}(transfers), 0) + 0.5) AS BIGINT) AS transfers, floor(coalesce({0}(vehicle_km), 0) * 10 + 0.5) / 10 AS vehicle_km,
 CASE WHEN coalesce({0}(load_n), 0) > 0 THEN floor({0}(load_sum) / {0}(load_n) * 1000 + 0.5) / 1000 ELSE 0.0 END::DOUBLE AS avg_load, CASE WHEN coalesce({0}(wait_n), 0) > 0 THEN CAST(floor({0}(wait_sum) / {0}(wait_n) + 0.5) AS BIGINT) ELSE 0 END AS avg_wait"""


def daily(w: World):
    e = w.raw("d_ride_events")
    # Two halves: what was stored before, and what comes on top of it.
    return TR.accumulate_daily(e.where("riders < 20"), TR.accumulate_daily(e.where("riders >= 20")))


@query("daily_statistics", "O133", f"WITH {DAILY} SELECT line_id, {SHOWN.format('sum')} FROM dy GROUP BY line_id")
def _(w: World):
    return TR.aggregate_stats(daily(w), ["line_id"])


@query("line_statistics", "O91", f"""WITH {DAILY}, g AS (SELECT id AS line_id, d AS day FROM d_lines, LATERAL (SELECT unnest(range(25, 46)) AS d) x), j AS (SELECT g.line_id, g.day, dy.* EXCLUDE (line_id, day) FROM g LEFT JOIN dy ON dy.line_id = g.line_id AND dy.day = g.day),
k AS (SELECT *, CAST(floor(coalesce(sum(riders) OVER (PARTITION BY line_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) + 0.5) AS BIGINT) AS week_riders FROM j)
SELECT line_id, CAST(day AS INT) AS day, {SHOWN.format('')}, week_riders FROM k WHERE day >= 31""")
def _(w: World):
    return TR.line_stats(daily(w), w.lines, 45, 15)


LEDGER = f"""{CUM}, ll AS (SELECT line_id, max(cum) AS m FROM cs GROUP BY line_id),
lg AS (SELECT station_id, day, sum(CASE WHEN kind = 'board' THEN riders ELSE 0 END) AS departed, sum(CASE WHEN kind = 'alight' THEN riders ELSE 0 END) AS arrived, sum(CASE WHEN kind = 'transfer' THEN riders ELSE 0 END) AS transferred,
  sum(CASE WHEN kind = 'alight' THEN riders * (3 + greatest(1, ll.m / 1000) * 0.6 * 0.5) ELSE 0 END) AS revenue FROM d_ride_events e LEFT JOIN ll ON ll.line_id = e.line_id GROUP BY station_id, day)"""


def ledger(w: World):
    length = TR.cumulative_stops(w.line_stops, w.stations).groupBy(F.col("line_id").alias("id")).agg(F.max("cum_m").alias("length_m"))
    return TR.pax_ledger(w.raw("d_ride_events").select("station_id", "line_id", "day", "kind", F.col("riders").alias("people")), length)


@query("passenger_ledger", "O134", f"WITH {LEDGER} SELECT station_id, day, departed, arrived, transferred, floor(revenue * 100 + 0.5) / 100 AS revenue FROM lg")
def _(w: World):
    return ledger(w).withColumn("revenue", geo.js_round(F.col("revenue"), 2))


@query("passenger_summary", "O139", f"""WITH {DAILY}, {LEDGER}, d AS (SELECT * FROM dy WHERE day = 20)
SELECT 'net' AS what, count(DISTINCT line_id) AS id, {SHOWN.format('sum')}, (SELECT count(*) FROM lg WHERE day = 20) AS stations, (SELECT CAST(floor(sum(arrived) + 0.5) AS BIGINT) FROM lg WHERE day = 20) AS arrived,
  (SELECT CAST(floor(sum(people) + 0.5) AS BIGINT) FROM d_cohorts) AS waiting FROM d
UNION ALL SELECT * FROM (SELECT 'top', line_id, CAST(riders AS BIGINT), NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM d ORDER BY riders DESC, line_id LIMIT 8) t""")
def _(w: World):
    net, top = TR.pax_summary(daily(w), ledger(w), None, w.raw("d_cohorts"), 20)
    return net.select(F.lit("net").alias("what"), F.col("lines").alias("id"), "riders", "transfers", "vehicle_km", "avg_load", "avg_wait", "stations", "arrived", "waiting").unionByName(
        top.select(F.lit("top").alias("what"), F.col("line_id").alias("id"), F.col("riders").cast("long").alias("riders")), allowMissingColumns=True)


STATE_SQL = """ln AS (SELECT id, id % 3 <> 0 AS scheduled, id % 5 = 1 AS paused, CASE WHEN id % 7 = 6 THEN 0 ELSE n_stops END AS n_stops FROM d_lines),
rn AS (SELECT id AS vehicle_id, id % 2 = 0 AS active, id % 4 = 1 AS run_paused, CASE WHEN id % 8 = 3 THEN NULL ELSE CAST(id % 3 AS INT) END AS dep_day FROM d_vehicles WHERE id % 6 <> 5),
st AS (SELECT v.id, v.line_id, CASE WHEN v.line_id IS NULL THEN 'idle' WHEN rn.vehicle_id IS NULL THEN 'not-online' WHEN coalesce(ln.n_stops, 0) = 0 THEN 'no-path' WHEN NOT scheduled THEN CASE WHEN run_paused THEN 'paused' ELSE 'run' END
  WHEN paused THEN CASE WHEN active THEN 'run' ELSE 'paused' END WHEN active THEN 'run' WHEN dep_day IS NULL THEN 'no-departure' WHEN dep_day > 1 THEN 'service-ended' ELSE 'before-departure' END AS state
  FROM d_vehicles v LEFT JOIN ln ON ln.id = v.line_id LEFT JOIN rn ON rn.vehicle_id = v.id)"""


def states(w: World):
    lines = w.lines.select("id", (F.col("id") % 3 != 0).alias("scheduled"), (F.col("id") % 5 == 1).alias("paused"), F.when(F.col("id") % 7 == 6, 0).otherwise(F.col("n_stops")).alias("n_stops"))
    v = w.raw("d_vehicles")
    runs = v.where("id % 6 <> 5").select(F.col("id").alias("vehicle_id"), (F.col("id") % 2 == 0).alias("active"), (F.col("id") % 4 == 1).alias("run_paused"),
                                         F.when(F.col("id") % 8 != 3, (F.col("id") % 3).cast("int")).alias("dep_day"))
    return TR.service_state(v, lines, runs, 1)


@query("service_states", "O140", f"WITH {STATE_SQL} SELECT id, line_id, state FROM st")
def _(w: World):
    return states(w)


@query("fleet_counts", "O140", f"WITH {STATE_SQL} SELECT line_id, state, count(*) AS vehicles, CAST(grouping(line_id, state) AS BIGINT) AS level FROM st GROUP BY ROLLUP (line_id, state)")
def _(w: World):
    return TR.fleet_counts(states(w))


@query("visible_vehicles", "O88", f"""WITH v AS (SELECT *, view_id % 10 AS viewer FROM d_views), c AS (SELECT v.view_id, q.id, q.owner, v.viewer, floor({hav('q.lat', 'q.lon', '((v.min_lat + v.max_lat) / 2)', '((v.min_lon + v.max_lon) / 2)')} * 1000 + 0.5) / 1000 AS meters
 FROM d_vehicles q JOIN v ON q.owner = v.viewer OR (q.lat BETWEEN v.min_lat AND v.max_lat AND q.lon BETWEEN v.min_lon AND v.max_lon))
SELECT view_id, id, meters, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY owner <> viewer, meters, id) AS n FROM c) q WHERE n <= 150""")
def _(w: World):
    return TR.pick_visible(w.raw("d_vehicles"), w.views.withColumn("owner", (F.col("view_id") % 10).cast("int")), 150)


@query("busiest_with_other", "O89", """
WITH c AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS rn FROM c)
SELECT CAST(k AS VARCHAR) AS item, n FROM r WHERE rn <= 20 UNION ALL SELECT 'other', CAST(sum(n) AS BIGINT) FROM r WHERE rn > 20""")
def _(w: World):
    return TR.top_with_other(w.table("lineitem"), "l_suppkey", 20)
