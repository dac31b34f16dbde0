"""Streams: the events table replayed through each live operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.catalog.elements import hav
from streetloom.catalog.history import ELEMS, FOLD_SQL
from streetloom.plans.demo import World
from streetloom.session import shared_path
from streetloom.streaming import live as L

HOUR = 3600


#: At least three micro-batches, one per DAYS of the time span; each has FILES files, so that no task writes or reads a whole one.
SLICES, DAYS, FILES = 3, 30, 4


def stream(w: World):
    """The events in order of time, in slices of the time span; the files of a slice are one micro-batch."""
    batch = w.table("events")
    path = shared_path(w.spark, "events")
    low, high = batch.agg(F.min(F.col("ts").cast("timestamp").cast("long")), F.max(F.col("ts").cast("timestamp").cast("long"))).first()
    n = slices_of(low, high)
    part = F.least(F.lit(n - 1), F.floor((F.col("ts").cast("timestamp").cast("long") - F.lit(low or 0)) * n / F.lit(max(1, (high or 0) - (low or 0)))))
    # Spark takes the files of a stream by their time: a slice's all before those of the next.
    for k in range(n):
        batch.where(part == k).repartition(FILES).write.parquet(f"{path}/{k}")
    s = w.spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/*")
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts"))


def slices_of(low, high) -> int:
    return max(SLICES, int(((high or 0) - (low or 0)) // (DAYS * 24 * HOUR)))


def kind():
    return F.when(F.col("event_type") == "click", "op").when(F.col("event_type") == "view", "view").when(F.col("event_type") == "error", "release") \
        .when(F.col("event_type") == "purchase", "lock").otherwise("chat")


@query("stream_rate_limit", "S1", """
WITH RECURSIVE k AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, CASE event_type WHEN 'click' THEN 'op' WHEN 'view' THEN 'view' WHEN 'error' THEN 'release' WHEN 'purchase' THEN 'lock' ELSE 'chat' END AS kind FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ms, event_id) AS n FROM k),
f AS (SELECT user_id, kind, n, event_id, true AS accepted, ms AS t1, NULL::BIGINT AS t2 FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.kind, e.n, e.event_id, f.t2 IS NULL OR e.ms - f.t2 > 43200000, CASE WHEN f.t2 IS NULL OR e.ms - f.t2 > 43200000 THEN e.ms ELSE f.t1 END, CASE WHEN f.t2 IS NULL OR e.ms - f.t2 > 43200000 THEN f.t1 ELSE f.t2 END
    FROM f JOIN e ON e.user_id = f.user_id AND e.kind = f.kind AND e.n = f.n + 1)
SELECT user_id, kind, event_id, accepted FROM f""")
def _(w: World):
    return L.run_once(L.rate_limit(stream(w).withColumn("kind", kind()), 2, 12 * HOUR), "append", "rate").drop("batch_id")


LOCK_RESULT = """CASE WHEN e.action = 'acquire' THEN CASE WHEN f.holder IS NULL OR f.holder = e.user_id OR e.ms >= f.until THEN 'granted' ELSE 'refused' END
  WHEN f.holder = e.user_id AND e.ms < f.until + 86400000 THEN CASE WHEN e.action = 'release' THEN 'released' ELSE 'refreshed' END ELSE 'ignored' END"""


@query("stream_locks", "S2", f"""
WITH RECURSIVE k AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, event_id // 1000 * 20 + event_id % 20 AS elem_id, CASE event_type WHEN 'purchase' THEN 'acquire' WHEN 'error' THEN 'release' ELSE 'ping' END AS action
  FROM events WHERE event_type IN ('purchase', 'error', 'view')),
e AS (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY ms, event_id) AS n FROM k),
f AS (SELECT DISTINCT elem_id, 0::BIGINT AS n, 0::BIGINT AS event_id, '' AS action, 0::BIGINT AS user_id, '' AS result, NULL::BIGINT AS holder, NULL::BIGINT AS until FROM e
  UNION ALL SELECT elem_id, n, event_id, action, user_id, result, CASE WHEN result IN ('granted', 'refreshed') THEN user_id WHEN result = 'released' OR gone THEN NULL ELSE holder END,
    CASE WHEN result IN ('granted', 'refreshed') THEN ms + 86400000 ELSE until END
  FROM (SELECT e.elem_id, e.n, e.event_id, e.action, e.user_id, e.ms, f.holder, f.until, coalesce(e.ms >= f.until + 86400000, false) AS gone, {LOCK_RESULT} AS result FROM f JOIN e ON e.elem_id = f.elem_id AND e.n = f.n + 1) s)
SELECT 'way' AS elem_type, elem_id, event_id, action, user_id, result FROM f WHERE n > 0""")
def _(w: World):
    action = F.when(F.col("event_type") == "purchase", "acquire").when(F.col("event_type") == "error", "release").otherwise("ping")
    e = stream(w).where("event_type IN ('purchase', 'error', 'view')").select(
        F.lit("way").alias("elem_type"), (F.floor(F.col("event_id") / 1000) * 20 + F.col("event_id") % 20).alias("elem_id"), "event_id", "user_id", action.alias("action"), "ms")
    return L.run_once(L.locks(e, 24 * HOUR), "append", "locks").drop("batch_id")


@query("stream_presence", "S3", "SELECT user_id, max(ts) AS last_ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def _(w: World):
    out = L.run_once(L.presence(stream(w).select("user_id", "ts", "event_id")), "update", "presence")
    return out.groupBy("user_id").agg(F.max_by(F.struct("last_ts", "event_id"), "batch_id").alias("l")).select("user_id", F.col("l.last_ts").cast("timestamp_ntz").alias("last_ts"), "l.event_id")


@query("stream_sessions", "S4", """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 5 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sn FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, sn HAVING max(ts) + INTERVAL 5 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(w: World):
    out = L.run_once(L.edit_sessions(stream(w), 5 * HOUR, "1 hour"), "append", "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("stream_capped_sessions", "S4", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, 1::BIGINT AS session_no, ms AS first, ms AS last FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, CASE WHEN ms - last >= 2592000000 THEN 1 WHEN fresh THEN session_no + 1 ELSE session_no END, CASE WHEN fresh THEN ms ELSE first END, ms
  FROM (SELECT e.*, f.session_no, f.first, f.last, e.ms - f.last >= 18000000 OR e.ms - f.first >= 86400000 AS fresh FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) s)
SELECT user_id, event_id, session_no FROM f""")
def _(w: World):
    return L.run_once(L.capped_sessions(stream(w), 5 * HOUR, 24 * HOUR), "append", "capped").drop("batch_id")


@query("stream_maintained_elements", "S5", FOLD_SQL + """, l AS (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY pos DESC) AS rn FROM f)
SELECT elem_id AS id, CAST(v AS INT) AS version, value FROM l WHERE rn = 1 AND v IS NOT NULL UNION ALL SELECT id, version, value FROM e WHERE id NOT IN (SELECT elem_id FROM c)""")
def _(w: World):
    base = w.sql(f"SELECT * FROM {ELEMS} e").select("id", F.col("version").cast("int").alias("version"), "value")
    s = stream(w)
    e = F.col("event_id")
    changes = s.select(e.alias("id"), (F.floor(e / 1000) * 200 + (e * 31) % 200).alias("elem_id"),
                       F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify").alias("action"),
                       F.when(e % 4 == 0, None).when(e % 7 == 0, 2).otherwise(1).cast("int").alias("expected"), F.concat(F.lit("v"), e.cast("string")).alias("value"))
    return L.maintain(changes, base, shared_path(w.spark, "maintain"))


# A queue is two lists, when groups came and how many are left of each; a vehicle takes from the front what it has room for.
QUEUE_SQL = """e AS (SELECT event_id // 1000 * 10 + event_id % 10 AS station_id, user_id % 3 AS line_id, event_id, event_type IN ('click', 'view') AS comes, floor(value)::DOUBLE AS people, epoch_ms(ts) AS ms,
  row_number() OVER (PARTITION BY event_id // 1000 * 10 + event_id % 10, user_id % 3 ORDER BY epoch_ms(ts), event_id) AS n FROM events),
f(station_id, line_id, n, event_id, s, p, boarded, lost) AS (SELECT DISTINCT station_id, line_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::DOUBLE[], 0::DOUBLE, 0::DOUBLE FROM e
 UNION ALL SELECT station_id, line_id, n, event_id, CASE WHEN comes THEN list_append(s1, ms) ELSE list_filter(s1, lambda x, i: rest[i] > 0) END, CASE WHEN comes THEN list_append(p1, people) ELSE list_filter(rest, lambda x: x > 0) END,
  CASE WHEN comes THEN 0 ELSE least(people, coalesce(list_sum(p1), 0)) END, gone
 FROM (SELECT *, list_transform(p1, lambda x, i: x - greatest(0, least(x, people - coalesce(list_sum(p1[:i - 1]), 0)))) AS rest FROM (
  SELECT *, p0[len(p0) - len(s1) + 1 :] AS p1, coalesce(list_sum(p0[: len(p0) - len(s1)]), 0) AS gone FROM (
   SELECT e.*, f.p AS p0, list_filter(f.s, lambda x: e.ms - x <= 21600000) AS s1 FROM f JOIN e ON e.station_id = f.station_id AND e.line_id = f.line_id AND e.n = f.n + 1) a) b) c)"""


@query("stream_queues", "S6", f"""WITH RECURSIVE {QUEUE_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY station_id, line_id ORDER BY n DESC) AS k FROM f)
SELECT station_id, line_id, event_id, boarded, 0::DOUBLE AS lost, coalesce(list_sum(p), 0) AS waiting FROM f WHERE n > 0
UNION ALL SELECT station_id, line_id, NULL, sum(boarded), sum(lost) + max(CASE WHEN k = 1 AND s[-1] + 21600001 < (SELECT max(epoch_ms(ts)) - 600000 FROM events) THEN list_sum(p) ELSE 0 END), 0::DOUBLE FROM z GROUP BY station_id, line_id""")
def _(w: World):
    kind = F.when(F.col("event_type").isin("click", "view"), "arrive").otherwise("board")
    e = stream(w).select((F.floor(F.col("event_id") / 1000) * 10 + F.col("event_id") % 10).alias("station_id"), (F.col("user_id") % 3).alias("line_id"), "event_id", kind.alias("kind"), F.floor("value").cast("double").alias("people"), "ms")
    # Who left may be reported by the next event or by the end of the queue, as batches fall; the sums do not depend on that.
    out = L.run_once(L.queues(e, 6 * HOUR), "append", "queues")
    total = out.groupBy("station_id", "line_id").agg(F.sum("boarded").alias("boarded"), F.sum("lost").alias("lost"))
    return out.where("event_id IS NOT NULL").select("station_id", "line_id", "event_id", "boarded", F.lit(0.0).alias("lost"), "waiting").unionByName(
        total.withColumns({"event_id": F.lit(None).cast("long"), "waiting": F.lit(0.0)}))


@query("stream_ridership", "S7", """
SELECT date_trunc('day', ts) AS start, user_id % 20 AS line_id, count(*) AS events, CAST(sum(event_id % 50) AS BIGINT) AS riders FROM events
GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(w: World):
    e = stream(w).select("ts", (F.col("user_id") % 20).alias("line_id"), (F.col("event_id") % 50).alias("riders"))
    out = L.run_once(L.ridership(e), "append", "riders")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "line_id", "events", "riders")


@query("stream_vehicle_cells", "S8", """
WITH e AS (SELECT ts, user_id AS vehicle_id, user_id % 20 AS line_id, user_id % 7 AS cell_y, user_id % 5 AS cell_x FROM events),
s AS (SELECT e.*, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL (k * 2) HOUR AS start FROM e CROSS JOIN (VALUES (0), (1), (2)) AS v(k))
SELECT start, cell_y, cell_x, line_id, count(*) AS reports, count(DISTINCT vehicle_id) AS vehicles FROM s GROUP BY start, cell_y, cell_x, line_id HAVING start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(w: World):
    e = stream(w).select("ts", F.col("user_id").alias("vehicle_id"), (F.col("user_id") % 20).alias("line_id"), ((F.col("user_id") % 7) * 0.01 + 0.005).alias("lat"), ((F.col("user_id") % 5) * 0.01 + 0.005).alias("lon"))
    out = L.run_once(L.vehicle_cells(e, "6 hours", "2 hours", "1 hour"), "append", "cells")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "cell_y", "cell_x", "line_id", "reports", "vehicles")


@query("stream_vehicle_speeds", "S8", f"""
WITH e AS (SELECT user_id AS vehicle_id, event_id, epoch_us(ts) // 1000 AS ms, 39.7::DOUBLE + (event_id * 37) % 1000 / 10000.0::DOUBLE AS lat, 116.1::DOUBLE + (event_id * 53) % 1000 / 10000.0::DOUBLE AS lon FROM events),
l AS (SELECT *, ms - lag(ms) OVER w AS took, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS m FROM e WINDOW w AS (PARTITION BY vehicle_id ORDER BY ms, event_id))
SELECT vehicle_id, event_id, CAST(floor(lat / 0.01::DOUBLE) AS BIGINT) AS cell_y, CAST(floor(lon / 0.01::DOUBLE) AS BIGINT) AS cell_x, CASE WHEN took > 0 AND took <= 21600000 THEN floor(m * 3600 / took * 1000 + 0.5) / 1000 END AS speed_kmh FROM l""")
def _(w: World):
    n = F.col("event_id")
    e = stream(w).select(F.col("user_id").alias("vehicle_id"), "event_id", "ms", (F.lit(39.7) + (n * 37) % 1000 / 10000.0).alias("lat"), (F.lit(116.1) + (n * 53) % 1000 / 10000.0).alias("lon"))
    out = L.run_once(L.vehicle_speeds(e, 6 * HOUR, "1 hour"), "append", "speeds")
    return out.select("vehicle_id", "event_id", "cell_y", "cell_x", F.floor(F.nanvl("speed_kmh", F.lit(None)) * 1000 + 0.5).cast("double").alias("k")).select("vehicle_id", "event_id", "cell_y", "cell_x", (F.col("k") / 1000).alias("speed_kmh"))


@query("stream_delays", "S9", """
WITH b AS (SELECT low, high, greatest(3, (high - low) // 2592000) AS n FROM (SELECT floor(epoch(min(ts)))::BIGINT AS low, floor(epoch(max(ts)))::BIGINT AS high FROM events) z),
o AS (SELECT user_id AS vehicle_id, event_id, event_id AS run_id, CAST(event_id % 2 AS INT) AS idx, CAST(20030 + event_id % 3600 + event_id % 2 * 180 + floor(value) % 300 - 100 AS BIGINT) AS departed,
   least(n - 1, floor((floor(epoch(ts)) - low) * n / greatest(1, high - low))) AS part FROM events, b),
j AS (SELECT o.*, CAST(o.departed - p.planned_dep AS BIGINT) AS delay FROM o JOIN d_obs p ON p.run_id = o.run_id AND p.idx = o.idx WHERE abs(o.departed - p.planned_dep) <= 1800),
d AS (SELECT *, delay - lag(delay) OVER (PARTITION BY vehicle_id ORDER BY part, departed, event_id) AS delta FROM j)
SELECT vehicle_id, event_id, run_id, idx, delay, CASE WHEN delta > 15 THEN 'worsening' WHEN delta < -15 THEN 'recovering' ELSE 'stable' END AS trend FROM d""")
def _(w: World):
    plan = w.raw("d_obs").select("run_id", "idx", "planned_dep")
    n = F.col("event_id")
    # Every event is one departure: the run is its number, the stop alternates.
    obs = stream(w).select(F.col("user_id").alias("vehicle_id"), "event_id", n.alias("run_id"), (n % 2).cast("int").alias("idx"),
                           (F.lit(20030) + n % 3600 + (n % 2) * 180 + F.floor("value") % 300 - 100).alias("departed"))
    # The clock of the runs starts anew every hour, so nothing counts as late here.
    return L.run_once(L.delay_stream(obs, plan, late="2 hours"), "append", "delays").drop("batch_id")


@query("stream_dedup", "S10", "SELECT event_id, user_id FROM events")
def _(w: World):
    s = stream(w).select("event_id", "user_id", "ts")
    return L.run_once(L.dedup(s.unionByName(stream(w).select("event_id", "user_id", "ts"))), "append", "dedup").select("event_id", "user_id")
