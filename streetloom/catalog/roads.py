"""Networks: edges, crossings, congestion, neighbours, snapping, components and path costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.catalog.elements import hav
from streetloom.functions import geo
from streetloom.operators import geometry as G, network as N, spatial
from streetloom.plans.demo import World

ROAD_EDGES = f"""
ri AS (SELECT id AS way_id, k, CASE k WHEN 'primary' THEN 55 WHEN 'secondary' THEN 40 WHEN 'tertiary' THEN 30 WHEN 'residential' THEN 20 ELSE 15 END AS lim,
   CASE k WHEN 'primary' THEN 0.7 WHEN 'secondary' THEN 0.75 WHEN 'tertiary' THEN 0.8 WHEN 'residential' THEN 0.8 ELSE 0.85 END::DOUBLE AS base
  FROM (SELECT id, t['highway'] AS k FROM o_ways WHERE t['highway'] IS NOT NULL) q),
re AS (SELECT r.way_id, q.seq, r.node_id AS a, q.node_id AS b, n.lat AS ay, n.lon AS ax, m.lat AS b_y, m.lon AS b_x, {hav('n.lat', 'n.lon', 'm.lat', 'm.lon')} AS len,
   greatest(5, least(110, floor(lim * base + 0.5))) AS speed, k, lim, base FROM d_way_nodes r JOIN d_way_nodes q ON q.way_id = r.way_id AND q.seq = r.seq + 1
  JOIN ri ON ri.way_id = r.way_id JOIN d_nodes n ON n.id = r.node_id JOIN d_nodes m ON m.id = q.node_id)"""


@query("road_edges", "O114", f"WITH {ROAD_EDGES} SELECT way_id, seq, a, b, floor(len * 1000 + 0.5) / 1000 AS length_m, CAST(speed AS INT) AS speed_kmh, base AS congestion FROM re")
def _(w: World):
    e = N.build_edges(w.dataset, "road")
    return e.select("way_id", "seq", "a", "b", geo.js_round(F.col("length_m"), 3).alias("length_m"), "speed_kmh", "congestion")


@query("rail_edges", "O114", f"""
SELECT r.way_id, q.seq, floor({hav('n.lat', 'n.lon', 'm.lat', 'm.lon')} * 1000 + 0.5) / 1000 AS length_m, CAST(100 AS INT) AS speed_kmh FROM d_way_nodes r JOIN d_way_nodes q ON q.way_id = r.way_id AND q.seq = r.seq + 1
JOIN o_ways w ON w.id = r.way_id AND t['railway'] = 'rail' JOIN d_nodes n ON n.id = r.node_id JOIN d_nodes m ON m.id = q.node_id""")
def _(w: World):
    return N.build_edges(w.dataset, "rail").select("way_id", "seq", geo.js_round(F.col("length_m"), 3).alias("length_m"), "speed_kmh")


def all_segments(w: World):
    """Roads and railways as one layer, so that the diagonal railways cross the lattice of roads."""
    both = N.build_edges(w.dataset, "road").unionByName(N.build_edges(w.dataset, "rail"))
    return both


SEGS = f"""{ROAD_EDGES},
sg AS (SELECT r.way_id, q.seq, r.node_id AS a, q.node_id AS b, n.lat AS ay, n.lon AS ax, m.lat AS b_y, m.lon AS b_x FROM d_way_nodes r JOIN d_way_nodes q ON q.way_id = r.way_id AND q.seq = r.seq + 1
  JOIN d_nodes n ON n.id = r.node_id JOIN d_nodes m ON m.id = q.node_id WHERE r.way_id % 4 <> 2),
gc AS (SELECT *, unnest(range(CAST(floor(least(ay, b_y) / 0.002) AS BIGINT), CAST(floor(greatest(ay, b_y) / 0.002) AS BIGINT) + 1)) AS cy FROM sg),
pr AS (SELECT DISTINCT i.way_id AS iw, i.seq AS iq, j.way_id AS jw, j.seq AS jq, i.a AS ia, i.b AS ib, j.a AS ja, j.b AS jb, i.ay AS iay, i.ax AS iax, i.b_y AS iby, i.b_x AS ibx, j.ay AS jay, j.ax AS jax, j.b_y AS jby, j.b_x AS jbx
  FROM gc i JOIN gc j ON i.cy = j.cy AND (i.way_id < j.way_id OR (i.way_id = j.way_id AND i.seq < j.seq)) AND i.a <> j.a AND i.a <> j.b AND i.b <> j.a AND i.b <> j.b
   AND greatest(i.ax, i.b_x) >= least(j.ax, j.b_x) AND greatest(j.ax, j.b_x) >= least(i.ax, i.b_x) AND greatest(i.ay, i.b_y) >= least(j.ay, j.b_y) AND greatest(j.ay, j.b_y) >= least(i.ay, i.b_y)),
xx AS (SELECT *, ((jax - iax) * (jby - jay) - (jay - iay) * (jbx - jax)) / den AS t, ((jax - iax) * (iby - iay) - (jay - iay) * (ibx - iax)) / den AS u
  FROM (SELECT *, (ibx - iax) * (jby - jay) - (iby - iay) * (jbx - jax) AS den FROM pr) p WHERE den <> 0),
cr AS (SELECT *, greatest(0, least(1, t)) AS tt, greatest(0, least(1, u)) AS uu FROM xx WHERE t BETWEEN -0.000001 AND 1.000001 AND u BETWEEN -0.000001 AND 1.000001)"""


@query("segment_crossings", "O45", f"""WITH {SEGS} SELECT iw AS i_way, CAST(iq AS INT) AS i_seq, jw AS j_way, CAST(jq AS INT) AS j_seq, floor(tt * 10000 + 0.5) / 10000 AS t, floor(uu * 10000 + 0.5) / 10000 AS u FROM cr""")
def _(w: World):
    x = N.segment_crossings(all_segments(w))
    return x.select(F.col("i_way_id").alias("i_way"), "i_seq", F.col("j_way_id").alias("j_way"), "j_seq", geo.js_round(F.col("t"), 4).alias("t"), geo.js_round(F.col("u"), 4).alias("u"))


PLANAR = f"""{SEGS},
cn AS (SELECT *, CASE WHEN tt <= 0.001 THEN ia WHEN tt >= 0.999 THEN ib END AS ie, CASE WHEN uu <= 0.001 THEN ja WHEN uu >= 0.999 THEN jb END AS je, iay + (iby - iay) * tt AS lat, iax + (ibx - iax) * tt AS lon FROM cr),
cm AS (SELECT *, coalesce(ie, je, CAST(-((floor(lat * 110574.0::DOUBLE / 1.5::DOUBLE + 0.5) + 10000000) * 40000000 + floor(lon * (111320.0::DOUBLE * cos(floor(lat) * (pi() / 180))) / 1.5::DOUBLE + 0.5) + 20000000) - 1 AS BIGINT)) AS node_id FROM cn),
ct AS (SELECT iw AS way_id, iq AS seq, tt AS t, node_id, lat, lon FROM cm UNION ALL SELECT jw, jq, uu, node_id, lat, lon FROM cm),
en AS (SELECT a AS node_id, ay AS lat, ax AS lon FROM sg UNION ALL SELECT b, b_y, b_x FROM sg),
sp AS (SELECT node_id, lat, lon FROM (SELECT node_id, lat, lon FROM ct WHERE node_id < 0 UNION ALL SELECT node_id, lat, lon FROM en WHERE node_id IN (SELECT node_id FROM ct)) x QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY lat, lon) = 1),
inn AS (SELECT ct.way_id, ct.seq, t, ct.node_id, sp.lat, sp.lon, lag(ct.node_id) OVER w AS pn, lag(t) OVER w AS pt FROM ct JOIN sg ON sg.way_id = ct.way_id AND sg.seq = ct.seq JOIN sp ON sp.node_id = ct.node_id
  WHERE ct.node_id <> sg.a AND ct.node_id <> sg.b WINDOW w AS (PARTITION BY ct.way_id, ct.seq ORDER BY t, ct.node_id, sp.lat, sp.lon)),
ch AS (SELECT way_id, seq, 1 AS k, t, node_id, lat, lon FROM inn WHERE pn IS NULL OR (pn <> node_id AND t - pt >= 0.000001) UNION ALL SELECT way_id, seq, 0, 0, a, ay, ax FROM sg UNION ALL SELECT way_id, seq, 2, 1, b, b_y, b_x FROM sg),
pa AS (SELECT way_id, seq, row_number() OVER w - 1 AS part, node_id AS a, lead(node_id) OVER w AS b, lat AS ay, lon AS ax, lead(lat) OVER w AS b_y, lead(lon) OVER w AS b_x FROM ch WINDOW w AS (PARTITION BY way_id, seq ORDER BY k, t, node_id)),
lk AS (SELECT DISTINCT least(ie, je) AS a, greatest(ie, je) AS b FROM cm WHERE ie IS NOT NULL AND je IS NOT NULL AND ie <> je)"""


@query("planar_network", "O115", f"""WITH {PLANAR},
al AS (SELECT way_id, seq, part, a, b, {hav('ay', 'ax', 'b_y', 'b_x')} AS len FROM pa WHERE b IS NOT NULL
  UNION ALL SELECT -1, 0, 0, lk.a, lk.b, greatest(0.5::DOUBLE, {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')}) FROM lk JOIN (SELECT DISTINCT * FROM en) p ON p.node_id = lk.a JOIN (SELECT DISTINCT * FROM en) q ON q.node_id = lk.b)
SELECT CAST(way_id AS BIGINT) AS way_id, CAST(seq AS INT) AS seq, CAST(part AS INT) AS part, a, b, floor(len * 1000 + 0.5) / 1000 AS length_m FROM al WHERE len > 0.01""")
def _(w: World):
    n = N.node_network(all_segments(w))
    return n.select("way_id", "seq", "part", "a", "b", geo.js_round(F.col("length_m"), 3).alias("length_m"))


CONG = f"""{ROAD_EDGES}, dg AS (SELECT node_id, count(*) AS d FROM (SELECT a AS node_id FROM re UNION ALL SELECT b FROM re) x GROUP BY node_id),
wn AS (SELECT DISTINCT way_id, node_id FROM (SELECT way_id, a AS node_id FROM re UNION ALL SELECT way_id, b FROM re) x),
js AS (SELECT wn.way_id, count(*) FILTER (WHERE d >= 3) AS junctions, avg(d) AS da FROM wn JOIN dg ON dg.node_id = wn.node_id GROUP BY wn.way_id),
wl AS (SELECT way_id, sum(len) AS len, max(k) AS kind, max(lim) AS lim, max(base) AS base FROM re GROUP BY way_id),
cg AS (SELECT wl.way_id, kind, lim, junctions, junctions / (len / 1000 + 0.15::DOUBLE) AS d, da, len, base FROM wl JOIN js ON js.way_id = wl.way_id),
co AS (SELECT *, greatest(0.25::DOUBLE, least(1.0::DOUBLE, base / (d / 12 + 1))) AS c FROM cg)"""


@query("way_congestion", "O68", f"""WITH {CONG} SELECT way_id, kind, CAST(lim AS INT) AS limit_kmh, junctions, floor(d * 100 + 0.5) / 100 AS density, floor(c * 1000 + 0.5) / 1000 AS congestion,
  CAST(greatest(5, least(110, floor(lim * c + 0.5))) AS INT) AS speed_kmh, floor(da * 100 + 0.5) / 100 AS degree_avg, CAST(floor(len + 0.5) AS BIGINT) AS length_m FROM co""")
def _(w: World):
    return N.way_congestion(N.build_edges(w.dataset, "road"), N.network_ways(w.ways, "road"))


@query("congestion_report", "O69", f"""WITH {CONG}, x AS (SELECT r.way_id, min(n.lat) AS a, max(n.lat) AS b, min(n.lon) AS c1, max(n.lon) AS d1 FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id)
SELECT co.way_id, floor(c * 1000 + 0.5) / 1000 AS congestion, CASE WHEN floor(c * 1000 + 0.5) / 1000 >= 0.75 THEN 'free' WHEN floor(c * 1000 + 0.5) / 1000 >= 0.5 THEN 'busy' ELSE 'jam' END AS level
FROM co JOIN x ON x.way_id = co.way_id WHERE d1 >= 116.17 AND c1 <= 116.22 AND b >= 39.76 AND a <= 39.81 ORDER BY floor(c * 1000 + 0.5), co.way_id LIMIT 500""")
def _(w: World):
    stats = N.way_congestion(N.build_edges(w.dataset, "road"), N.network_ways(w.ways, "road")).join(G.way_bbox(w.way_nodes, w.nodes), "way_id")
    return N.congestion_in_box(stats, {"min_lat": 39.76, "max_lat": 39.81, "min_lon": 116.17, "max_lon": 116.22}, 500).select("way_id", "congestion", "level")


@query("network_statistics", "O69", f"""WITH {CONG}, s AS (SELECT way_id, floor(c * 1000 + 0.5) / 1000 AS cc, CAST(greatest(5, least(110, floor(lim * c + 0.5))) AS INT) AS sp FROM co)
SELECT count(*) AS ways, floor(avg(cc) * 1000 + 0.5) / 1000 AS avg_congestion, min(cc) AS min_congestion, max(cc) AS max_congestion, (SELECT way_id FROM s ORDER BY sp, way_id LIMIT 1) AS slowest_way, min(sp) AS slowest_kmh FROM s""")
def _(w: World):
    return N.network_statistics(N.way_congestion(N.build_edges(w.dataset, "road"), N.network_ways(w.ways, "road")))


NB = f"""nb AS (SELECT a.id AS a, b.id AS b, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m, greatest(2300.0, least(4000.0, greatest(2300.0, greatest(a.catchment_m, b.catchment_m) * 1.5), a.catchment_m + b.catchment_m)) AS lim
  FROM d_stations a JOIN d_stations b ON b.id <> a.id AND abs(a.lat - b.lat) < 0.05 AND abs(a.lon - b.lon) < 0.08)"""
TOP = "tp AS (SELECT a, b, m FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY m, b) AS rn FROM nb WHERE m <= lim) q WHERE rn <= {})"


@query("mutual_neighbours", "O42", f"WITH {NB}, {TOP.format(6)} SELECT x.a, x.b, floor(x.m * 1000 + 0.5) / 1000 AS meters FROM tp x JOIN tp y ON y.a = x.b AND y.b = x.a")
def _(w: World):
    return N.mutual_neighbours(w.stations, keep=6).select("a", "b", geo.js_round(F.col("meters"), 3).alias("meters"))


def road_nodes(w: World):
    e = N.build_edges(w.dataset, "road")
    return e.select(F.col("a").alias("id"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon"))).distinct()


@query("snapped_to_nodes", "O43", f"""WITH {ROAD_EDGES}, rn AS (SELECT a AS id, ay AS lat, ax AS lon FROM re UNION SELECT b, b_y, b_x FROM re),
d AS (SELECT s.id, rn.id AS node_id, {hav('s.lat', 's.lon', 'rn.lat', 'rn.lon')} AS m FROM d_stations s JOIN rn ON abs(s.lat - rn.lat) < 0.006 AND abs(s.lon - rn.lon) < 0.01)
SELECT id, node_id, floor(m * 1000 + 0.5) / 1000 AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, node_id) AS k FROM d WHERE m <= 400) q WHERE k = 1""")
def _(w: World):
    return spatial.snap_to_node(w.stations, road_nodes(w), 400).select("id", "node_id", geo.js_round(F.col("distance_m"), 3).alias("distance_m"))


@query("snapped_to_segments", "O44", f"""WITH {ROAD_EDGES}, q AS (SELECT s.id, re.way_id, re.seq, re.a, re.b, (ax - s.lon) * (pi() / 180) * 6378137.0 * cos(s.lat * (pi() / 180)) AS x1, (ay - s.lat) * (pi() / 180) * 6378137.0 AS y1,
   (b_x - s.lon) * (pi() / 180) * 6378137.0 * cos(s.lat * (pi() / 180)) AS x2, (b_y - s.lat) * (pi() / 180) * 6378137.0 AS y2 FROM d_stations s JOIN re ON abs(ay - s.lat) < 0.008 AND abs(ax - s.lon) < 0.012),
t AS (SELECT *, greatest(0.0, least(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))) AS t FROM q),
d AS (SELECT *, floor(sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) * 1000 + 0.5) / 1000 AS m FROM t)
SELECT id, m AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m) AS k FROM d WHERE m <= 300) z WHERE k = 1""")
def _(w: World):
    s = spatial.snap_to_segment(w.stations, N.build_edges(w.dataset, "road"), 300)
    return s.select("id", geo.js_round(F.col("distance_m"), 3).alias("distance_m"))


@query("road_components", "O116", f"""WITH RECURSIVE {ROAD_EDGES}, e AS (SELECT a AS u, b AS v FROM re UNION SELECT b, a FROM re),
c(node_id, component) USING KEY (node_id) AS (SELECT DISTINCT u AS node_id, u AS component FROM e UNION
  SELECT e.v, min(c.component) FROM c JOIN e ON e.u = c.node_id JOIN recurring.c AS r ON r.node_id = e.v WHERE c.component < r.component GROUP BY e.v)
SELECT node_id, component FROM c""")
def _(w: World):
    return N.network_components(N.build_edges(w.dataset, "road"))


def station_origins(w: World):
    return spatial.snap_to_node(w.stations, road_nodes(w), 400).select(F.col("id").alias("origin"), "node_id")


HOPS = f"""{ROAD_EDGES}, hp AS (SELECT a AS src, b AS dst, len * (1.0::DOUBLE + 0.6::DOUBLE * 45.0 / greatest(15, speed)) AS c, len AS l, len / (speed / 3.6::DOUBLE) AS s, way_id FROM re),
hb AS (SELECT src, dst, c, l, s, way_id FROM hp UNION ALL SELECT dst, src, c, l, s, way_id FROM hp)"""
ORIGINS = f"""rn AS (SELECT a AS id, ay AS lat, ax AS lon FROM re UNION SELECT b, b_y, b_x FROM re),
sd AS (SELECT s.id, rn.id AS node_id, {hav('s.lat', 's.lon', 'rn.lat', 'rn.lon')} AS m FROM d_stations s JOIN rn ON abs(s.lat - rn.lat) < 0.006 AND abs(s.lon - rn.lon) < 0.01),
og AS (SELECT id AS origin, node_id FROM sd WHERE m <= 400 QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, node_id) = 1)"""
#: Labels that get cheaper round by round; each round replaces those it improves.
LABELS = """p(origin, node_id, cost, length_m, seconds) USING KEY (origin, node_id) AS (SELECT origin, node_id, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS length_m, 0.0::DOUBLE AS seconds FROM og UNION
  SELECT p.origin, hb.dst, min(p.cost + hb.c), arg_min(p.length_m + hb.l, p.cost + hb.c), arg_min(p.seconds + hb.s, p.cost + hb.c) FROM p JOIN hb ON hb.src = p.node_id JOIN og ON og.origin = p.origin
  LEFT JOIN recurring.p AS r ON r.origin = p.origin AND r.node_id = hb.dst WHERE p.cost + hb.c <= {most} AND (r.cost IS NULL OR p.cost + hb.c < r.cost) GROUP BY p.origin, hb.dst)"""


@query("path_costs", "O117", f"""WITH RECURSIVE {HOPS}, {ORIGINS}, {LABELS.format(most=2000)}
SELECT origin, node_id, floor(cost * 1000 + 0.5) / 1000 AS cost, floor(length_m * 100 + 0.5) / 100 AS length_m, floor(seconds * 100 + 0.5) / 100 AS seconds FROM p""")
def _(w: World):
    c = N.shortest_costs(N.build_edges(w.dataset, "road"), station_origins(w), max_cost=2000)
    return c.select("origin", "node_id", geo.js_round(F.col("cost"), 3).alias("cost"), geo.js_round(F.col("length_m"), 2).alias("length_m"), geo.js_round(F.col("seconds"), 2).alias("seconds"))


@query("line_routes", "O118", f"""WITH RECURSIVE {HOPS},
sg AS (SELECT re.way_id AS line_id, seq - 1 AS idx, a AS src, b AS dst, (SELECT max(c) FROM hb WHERE hb.src = re.a AND hb.dst = re.b AND hb.way_id = re.way_id) AS c FROM re),
og AS (SELECT src AS origin, src AS node_id, least(1500, max(c)) AS most FROM sg GROUP BY src), {LABELS.format(most='og.most')}
SELECT line_id, count(*) AS segments, min(CASE WHEN p.cost IS NULL THEN CAST(idx AS INT) END) AS first_broken, CASE WHEN bool_and(p.cost IS NOT NULL) THEN CAST(floor(sum(length_m) + 0.5) AS BIGINT) ELSE 0 END AS length_m,
  CASE WHEN bool_and(p.cost IS NOT NULL) THEN CAST(floor(sum(seconds) + 0.5) AS BIGINT) ELSE 0 END AS seconds FROM sg LEFT JOIN p ON p.origin = sg.src AND p.node_id = sg.dst GROUP BY line_id""")
def _(w: World):
    # A line along each road, which stops at every node of it.
    stops = w.way_nodes.join(N.network_ways(w.ways, "road").select("way_id"), "way_id", "left_semi").select(
        F.col("way_id").alias("line_id"), F.col("seq").alias("idx"), "node_id")
    return N.route_lines(stops, N.build_edges(w.dataset, "road"), max_cost=1500)[1]


@query("path_geometry", "O85", f"""
WITH p AS (SELECT r.way_id, r.seq, n.lat, n.lon, lag(n.lat) OVER w AS py, lag(n.lon) OVER w AS px FROM d_way_nodes r JOIN d_nodes_cut n ON n.id = r.node_id WINDOW w AS (PARTITION BY r.way_id ORDER BY r.seq))
SELECT way_id AS path_id, CAST(seq AS INT) AS idx, floor(sum(CASE WHEN py IS NULL THEN 0 ELSE {hav('py', 'px', 'lat', 'lon')} END) OVER (PARTITION BY way_id ORDER BY seq) * 100 + 0.5) / 100 AS distance_m, CAST(40 + seq AS INT) AS speed FROM p""")
def _(w: World):
    p = w.way_nodes.select(F.col("way_id").alias("path_id"), F.col("seq").alias("idx"), "node_id", (F.lit(40) + F.col("seq")).alias("speed"))
    return N.path_geometry(p, w.nodes_cut).select("path_id", "idx", geo.js_round(F.col("distance_m"), 2).alias("distance_m"), "speed")
