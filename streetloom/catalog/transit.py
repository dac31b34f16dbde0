"""Lines, itineraries, demand between stations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.catalog.elements import hav
from streetloom.catalog.people import ACT, CATCH, GRID, activity, contributions
from streetloom.catalog.roads import NB, ROAD_EDGES, TOP
from streetloom.functions import geo
from streetloom.operators import network as N, population as P, transit as TR
from streetloom.plans.demo import World
from streetloom.session import cut_lineage

CUM = f"""cs AS (SELECT line_id, idx, station_id, sum(CASE WHEN py IS NULL THEN 0 ELSE {hav('py', 'px', 'lat', 'lon')} END) OVER (PARTITION BY line_id ORDER BY idx) AS cum FROM
  (SELECT l.*, s.lat, s.lon, lag(s.lat) OVER (PARTITION BY line_id ORDER BY idx) AS py, lag(s.lon) OVER (PARTITION BY line_id ORDER BY idx) AS px FROM d_line_stops l JOIN d_stations s ON s.id = l.station_id) q)"""
RIDES = f"""{CUM}, rd AS (SELECT a.line_id, a.station_id AS src, b.station_id AS dst, CAST(floor(abs(b.cum - a.cum) + 0.5) AS BIGINT) AS meters,
  CAST(floor((abs(b.cum - a.cum) / (45 / 3.6::DOUBLE) + greatest(0, abs(b.idx - a.idx) - 1) * 20 + 300) * 1000 + 0.5) AS BIGINT) AS ms FROM cs a JOIN cs b ON b.line_id = a.line_id AND b.idx <> a.idx)"""
WALKS = f"{NB}, {TOP.format(48)}, wk AS (SELECT x.a AS src, x.b AS dst, CAST(floor(x.m + 0.5) AS BIGINT) AS meters, CAST(floor((x.m + 60) * 1000 + 0.5) AS BIGINT) AS ms FROM tp x JOIN tp y ON y.a = x.b AND y.b = x.a)"


def _layers() -> str:
    """Labels by number of legs: b is time, whether a walk came first, line and stop of the first ride."""
    out = ["k0 AS (SELECT id AS origin, id AS station, 0 AS r, 0 AS w, [0, 0, -1, -1]::BIGINT[] AS b, id IN (SELECT src FROM rd) AS served FROM d_stations)"]
    for k in range(1, 7):
        p = f"k{k - 1}"
        walk = " AND NOT p.served" if k == 1 else ""
        out.append(f"""k{k} AS (SELECT origin, station, r, w, min(b) AS b, bool_or(served) AS served FROM (
          SELECT p.origin, rd.dst AS station, p.r + 1 AS r, p.w, [p.b[1] + rd.ms, p.b[2], CASE WHEN p.b[3] < 0 THEN rd.line_id ELSE p.b[3] END, CASE WHEN p.b[3] < 0 THEN rd.src ELSE p.b[4] END] AS b, p.served FROM {p} p JOIN rd ON rd.src = p.station AND p.r < 4
          UNION ALL SELECT p.origin, wk.dst, p.r, p.w + 1, [p.b[1] + wk.ms, {'1' if k == 1 else 'p.b[2]'}, p.b[3], p.b[4]], p.served FROM {p} p JOIN wk ON wk.src = p.station AND p.w < 2{walk}) q WHERE b[1] <= 28800000 GROUP BY origin, station, r, w)""")
    out.append("kk AS (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(1, 7)) + ")")
    out.append("""it AS (SELECT origin, dest, b[1] AS ms, r, w, b[2] AS wf, b[3] AS fl, b[4] AS fs FROM (SELECT origin, station AS dest, b, r, w, row_number() OVER (PARTITION BY origin, station ORDER BY b[1], r, w) AS n FROM kk WHERE origin <> station) q WHERE n = 1 AND r > 0)""")
    return ", ".join(out)


ITIN = f"{RIDES}, {WALKS}, {_layers()}"


@query("cumulative_stops", "O84", f"WITH {CUM} SELECT line_id, idx, station_id, floor(cum * 1000 + 0.5) / 1000 AS cum_m FROM cs")
def _(w: World):
    return TR.cumulative_stops(w.line_stops, w.stations).select("line_id", "idx", "station_id", geo.js_round(F.col("cum_m"), 3).alias("cum_m"))


@query("ride_edges", "O121", f"WITH {RIDES} SELECT line_id, src, dst, meters, ms FROM rd")
def _(w: World):
    return TR.ride_edges(TR.cumulative_stops(w.line_stops, w.stations))


def rides(w: World):
    return TR.ride_edges(TR.cumulative_stops(w.line_stops, w.stations))


def walks(w: World):
    return TR.walk_edges(N.mutual_neighbours(w.stations, keep=48))


@query("itineraries", "O122", f"WITH {ITIN} SELECT origin, dest, ms, CAST(r AS INT) AS rides, CAST(w AS INT) AS walks FROM it")
def _(w: World):
    return TR.itineraries(w.stations, rides(w), walks(w)).select("origin", "dest", "ms", "rides", "walks")


@query("journey_legs", "O122", f"""WITH {ITIN}, n AS (SELECT origin, count(*) AS dests, sum(r + w) AS legs, sum(ms) AS ms FROM it GROUP BY origin) SELECT origin, dests, CAST(legs AS BIGINT) AS legs, CAST(legs AS BIGINT) AS joined, CAST(ms AS BIGINT) AS ms FROM n""")
def _(w: World):
    """Legs of all journeys from the labels they came by: as many as rides and walks, each beginning where the one before ends, together as long as the journey."""
    legs = TR.itinerary_legs(w.stations, rides(w), walks(w)).repartition("origin")
    before = F.lag("dst").over(Window.partitionBy("origin", "dest").orderBy("leg"))
    joined = F.coalesce(before, F.when(F.col("leg") == 1, F.col("origin"))) == F.col("src")
    return legs.withColumn("joined", joined).groupBy("origin").agg(
        F.countDistinct("dest").alias("dests"), F.count("*").alias("legs"), F.count_if("joined").alias("joined"), F.sum("ms").alias("ms"))


OD = f"""{GRID} {ACT} {CATCH}, {ITIN}, st AS (SELECT s.id, s.lat, s.lon, CASE WHEN d.coverage > 0 THEN d.coverage ELSE d.demand END AS cov, floor(d.demand * 0.22::DOUBLE + 0.5) AS trips,
   coalesce(n.k, 0) AS lines FROM d_stations s JOIN demand d ON d.id = s.id LEFT JOIN (SELECT station_id, count(DISTINCT line_id) AS k FROM d_line_stops GROUP BY station_id) n ON n.station_id = s.id),
pp AS (SELECT i.origin, i.dest, i.r, i.w, i.wf, i.fl, i.fs, o.trips, {hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS m, d.cov, d.lines FROM it i JOIN st o ON o.id = i.origin AND o.trips > 0 JOIN st d ON d.id = i.dest AND d.cov > 0),
pw AS (SELECT *, CASE WHEN m <= 15000 THEN 'local' WHEN m <= 100000 THEN 'regional' ELSE 'long' END AS band, (pow(cov, 0.75) + pow(300.0::DOUBLE, 0.75)) * (1 + lines) / pow(1 + m / 4000.0, 0.85) AS wt FROM pp),
mx AS (SELECT origin, sum(x) AS x FROM (SELECT DISTINCT origin, band, CASE band WHEN 'local' THEN 0.76 WHEN 'regional' THEN 0.2 ELSE 0.04 END::DOUBLE AS x FROM pw) q GROUP BY origin),
od AS (SELECT pw.*, trips * (CASE band WHEN 'local' THEN 0.76 WHEN 'regional' THEN 0.2 ELSE 0.04 END::DOUBLE / mx.x) * wt / sum(wt) OVER (PARTITION BY pw.origin, band) AS people FROM pw JOIN mx ON mx.origin = pw.origin)"""


def station_table(w: World):
    d = P.station_demand(w.stations, P.population_grid(contributions(w)), activity(w))
    return cut_lineage(d.select("id", "lat", "lon", "coverage", "daily_trips"))


def od(w: World, stations=None):
    wk = cut_lineage(walks(w))
    return TR.od_matrix(station_table(w) if stations is None else stations, w.line_stops, TR.itineraries(w.stations, rides(w), wk), wk)


@query("od_matrix", "O123", f"WITH {OD} SELECT origin, dest, band, floor(people * 10000 + 0.5) / 10000 AS people, CAST(r - 1 AS INT) AS transfers, people >= 0.02 AS kept FROM od")
def _(w: World):
    return od(w).select("origin", "dest", "band", geo.js_round(F.col("people"), 4).alias("people"), "transfers", "kept")


@query("od_summary", "O125", f"""WITH {OD} SELECT band, CAST(r - 1 AS INT) AS transfers, count(*) AS pairs, floor(sum(people) * 10 + 0.5) / 10 AS people, CAST(grouping(band, r) AS BIGINT) AS level
FROM od WHERE people >= 0.02 GROUP BY ROLLUP (band, r)""")
def _(w: World):
    return TR.od_stats(od(w))


@query("od_per_station", "O125", f"""WITH {OD}, k AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY people DESC, dest) AS n FROM od WHERE people >= 0.02),
a AS (SELECT origin, sum(people) AS served, count(*) AS destinations, max(CASE WHEN n = 1 THEN dest END) AS first_dest FROM k GROUP BY origin)
SELECT st.id AS origin, CAST(st.trips AS BIGINT) AS spawn, CAST(floor(coalesce(served, 0) + 0.5) AS BIGINT) AS served, CASE WHEN st.trips > 0 THEN floor(coalesce(served, 0) / st.trips * 1000 + 0.5) / 1000 ELSE 0.0 END::DOUBLE AS reach,
  coalesce(destinations, 0) AS destinations, first_dest FROM st LEFT JOIN a ON a.origin = st.id""")
def _(w: World):
    stations = station_table(w)
    s = TR.od_station(od(w, stations), stations)
    return s.select("origin", "spawn", "served", "reach", "destinations", F.get("top", 0)["dest"].alias("first_dest"))


@query("od_line_loads", "O124", f"""WITH {OD} SELECT fl AS line_id, fs AS station_id, band, floor(sum(people) * 100 + 0.5) / 100 AS people, count(DISTINCT dest) AS destinations, floor(sum(CASE WHEN wf = 1 THEN people ELSE 0 END) * 100 + 0.5) / 100 AS walked_first
FROM od WHERE people >= 0.02 GROUP BY fl, fs, band""")
def _(w: World):
    return TR.od_line_loads(od(w)).select("line_id", "station_id", "band", geo.js_round(F.col("people"), 2).alias("people"), "destinations",
                                          geo.js_round(F.col("walked_first"), 2).alias("walked_first"))


STATION_TAGS = {"subway": (0, {"railway": "station", "station": "subway"}), "rail": (0, {"railway": "station"}), "tram": (4, {"railway": "tram_stop"}), "bus": (6, {"highway": "bus_stop"})}
PLANE = "({0}x - {1}.lon) * (pi() / 180) * 6378137.0 * cos({1}.lat * (pi() / 180)) AS x{2}, ({0}y - {1}.lat) * (pi() / 180) * 6378137.0 AS y{2}"


@query("imported_stations", "O119", f"""WITH RECURSIVE {ROAD_EDGES},
rl AS (SELECT DISTINCT r.node_id AS id, n.lat, n.lon FROM d_way_nodes r JOIN o_ways w ON w.id = r.way_id AND t['railway'] = 'rail' JOIN d_nodes n ON n.id = r.node_id),
ca AS (SELECT id, 6 AS rule, 'bus' AS kind, t['name'] AS name, lat, lon FROM o_nodes WHERE t['highway'] = 'bus_stop'
 UNION ALL SELECT 20000000000000 + k.c * 1000000000 + s.id, CASE s.kind WHEN 'bus' THEN 6 WHEN 'tram' THEN 4 ELSE 0 END, s.kind, s.name, s.lat + k.d, s.lon FROM d_stations s CROSS JOIN (VALUES (0, 0.0::DOUBLE), (1, 0.00015::DOUBLE), (2, 0.00033::DOUBLE)) k(c, d)),
ex AS (SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 7000000000 END AS osm_id, 'bus' AS kind, lat, lon FROM o_nodes WHERE tags IS NOT NULL AND id % 9 = 0),
nw AS (SELECT * FROM ca WHERE id NOT IN (SELECT osm_id FROM ex)),
di AS (SELECT *, id AS node_id FROM nw WHERE (kind = 'bus' AND id IN (SELECT a FROM re UNION SELECT b FROM re)) OR (kind <> 'bus' AND id IN (SELECT id FROM rl))),
rs AS (SELECT * FROM nw WHERE id NOT IN (SELECT id FROM di)),
q AS (SELECT rs.id, re.way_id, re.seq, re.a, re.b, {PLANE.format('a', 'rs', 1)}, {PLANE.format('b_', 'rs', 2)} FROM rs JOIN re ON rs.kind = 'bus' AND abs(ay - rs.lat) < 0.003 AND abs(ax - rs.lon) < 0.004),
qt AS (SELECT *, greatest(0.0, least(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))) AS t FROM q),
qd AS (SELECT *, sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) AS m FROM qt),
sb AS (SELECT id, CASE WHEN t <= 0.5 THEN a ELSE b END AS node_id FROM qd WHERE m <= 80 QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, way_id, seq) = 1),
sr AS (SELECT rs.id, rl.id AS node_id, {hav('rs.lat', 'rs.lon', 'rl.lat', 'rl.lon')} AS m FROM rs JOIN rl ON rs.kind <> 'bus' AND abs(rs.lat - rl.lat) < 0.003 AND abs(rs.lon - rl.lon) < 0.004 QUALIFY m <= 200 AND row_number() OVER (PARTITION BY rs.id ORDER BY m, rl.id) = 1),
li AS (SELECT * FROM di UNION ALL SELECT rs.*, x.node_id FROM rs JOIN (SELECT id, node_id FROM sb UNION ALL SELECT id, node_id FROM sr) x ON x.id = rs.id),
fr AS (SELECT * FROM li WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.kind = li.kind AND abs(ex.lat - li.lat) < 0.0003 AND abs(ex.lon - li.lon) < 0.0005 AND {hav('ex.lat', 'ex.lon', 'li.lat', 'li.lon')} <= 25)),
ne AS (SELECT a.id AS hi, b.id AS lo FROM fr a JOIN fr b ON a.kind = b.kind AND (b.rule < a.rule OR (b.rule = a.rule AND b.id < a.id)) AND abs(a.lat - b.lat) < 0.0003 AND abs(a.lon - b.lon) < 0.0005 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 25),
st(id, state) USING KEY (id) AS (SELECT id, CASE WHEN id IN (SELECT hi FROM ne) THEN 0 ELSE 1 END AS state FROM fr UNION
 SELECT u.id, CASE WHEN bool_or(l.state = 1) THEN 2 ELSE 1 END FROM recurring.st AS u JOIN ne ON ne.hi = u.id JOIN recurring.st AS l ON l.id = ne.lo
 WHERE u.state = 0 AND EXISTS (SELECT 1 FROM st) GROUP BY u.id HAVING bool_or(l.state = 1) OR NOT bool_or(l.state = 0))
SELECT 'node' AS osm_type, li.id AS osm_id, li.kind, li.name, li.node_id, CAST(CASE WHEN li.kind = 'bus' THEN 450 ELSE 700 END AS INT) AS catchment_m,
 concat('node:', CASE li.rule WHEN 0 THEN 'railway=station' WHEN 4 THEN 'railway=tram_stop' ELSE 'highway=bus_stop' END) AS source FROM li JOIN st ON st.id = li.id AND st.state = 1""")
def _(w: World):
    from streetloom.functions import tags as T
    # Stops of the lattice, every ninth of them imported before under its own or another id, and three tagged nodes at each station, which stand too close to one another.
    base = w.dataset.with_(nodes=cut_lineage(w.nodes), ways=cut_lineage(w.ways))
    existing = base.nodes.where("tags IS NOT NULL AND id % 9 = 0").select(
        F.lit("node").alias("osm_type"), (F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(7_000_000_000)).alias("osm_id"), T.station_kind(F.col("tags")).alias("kind"), "lat", "lon")
    tags = F.coalesce(*[F.when(F.col("kind") == k, F.create_map(*[F.lit(x) for kv in t.items() for x in kv], F.lit("name"), F.col("name"))) for k, (_, t) in STATION_TAGS.items()])
    copies = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(d).alias("d")) for c, d in ((0, 0.0), (1, 0.00015), (2, 0.00033))])).alias("k")
    stations = w.stations.select("id", "lat", "lon", tags.alias("tags"), copies).select(
        (F.lit(20_000_000_000_000) + F.col("k.c") * 1_000_000_000 + F.col("id")).alias("id"), (F.col("lat") + F.col("k.d")).alias("lat"), "lon", F.lit(1).alias("version"), "tags")
    ds = base.with_(nodes=base.nodes.unionByName(stations))
    rail = N.build_edges(base, "rail")
    ends = rail.select(F.explode(F.array(*[F.struct(F.col(k).alias("id"), F.col(f"{k}_lat").alias("lat"), F.col(f"{k}_lon").alias("lon")) for k in "ab"])).alias("e")).select("e.*").distinct()
    return TR.import_stations(ds, existing, ends, N.build_edges(base, "road"))["created"].select("osm_type", "osm_id", "kind", "name", "node_id", "catchment_m", "source")


@query("line_comparison", "O143", f"""WITH {CUM}, p AS (SELECT id AS station_id, CAST(catchment_m AS BIGINT) AS pop FROM d_stations), s AS (SELECT line_id, count(*) AS stops FROM d_line_stops GROUP BY line_id),
v AS (SELECT line_id, count(*) AS vehicles FROM d_vehicles WHERE line_id IS NOT NULL GROUP BY line_id), l AS (SELECT line_id, max(cum) AS m FROM cs GROUP BY line_id),
t AS (SELECT line_id, count(*) AS trips FROM d_ride_events GROUP BY line_id), q AS (SELECT line_id, CAST(sum(pop) AS BIGINT) AS people FROM (SELECT DISTINCT line_id, station_id FROM d_line_stops) x JOIN p ON p.station_id = x.station_id GROUP BY line_id)
SELECT d.id AS line_id, d.name, coalesce(stops, 0) AS stops, coalesce(vehicles, 0) AS vehicles, coalesce(trips, 0) AS trips, floor(m * 10 + 0.5) / 10 AS length_m, coalesce(people, 0) AS people, m IS NULL AS broken
FROM d_lines d LEFT JOIN s ON s.line_id = d.id LEFT JOIN v ON v.line_id = d.id LEFT JOIN l ON l.line_id = d.id LEFT JOIN t ON t.line_id = d.id LEFT JOIN q ON q.line_id = d.id""")
def _(w: World):
    length = TR.cumulative_stops(w.line_stops, w.stations).groupBy("line_id").agg(geo.js_round(F.max("cum_m"), 1).alias("length_m"))
    pop = w.stations.select(F.col("id").alias("station_id"), F.col("catchment_m").cast("long").alias("pop"))
    return TR.compare_lines(w.lines, w.line_stops, w.raw("d_vehicles"), w.raw("d_ride_events"), length, pop).drop("kind")


@query("stops_snapped_to_line", "O144", f"""WITH off AS (SELECT l.line_id, l.station_id, s.lat, s.lon FROM d_line_stops l JOIN d_stations s ON s.id = l.station_id),
p AS (SELECT l.line_id, r.node_id, n.lat, n.lon FROM d_line_stops l JOIN d_way_nodes r ON r.way_id = l.station_id * 8 + l.idx * 4 JOIN d_nodes n ON n.id = r.node_id),
d AS (SELECT off.line_id, off.station_id, p.node_id, {hav('off.lat', 'off.lon', 'p.lat', 'p.lon')} AS m FROM off JOIN p ON p.line_id = off.line_id)
SELECT line_id, station_id, node_id, CAST(floor(m + 0.5) AS BIGINT) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY line_id, station_id ORDER BY m, node_id) AS n FROM d WHERE m < 1500) q WHERE n = 1""")
def _(w: World):
    st = w.stations.select(F.col("id").alias("station_id"), "lat", "lon")
    stops = w.line_stops.join(st, "station_id").withColumn("node_id", -F.col("station_id"))
    refs = w.line_stops.select("line_id", (F.col("station_id") * 8 + F.col("idx") * 4).alias("way_id")).join(w.way_nodes, "way_id")
    paths = refs.join(w.nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").select("line_id", "node_id", "lat", "lon")
    return TR.snap_stops_to_line(stops, paths).select("line_id", "station_id", "node_id", "distance_m")
