"""Population, activity, catchments and station demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.functions import geo
from streetloom.operators import geometry as G, population as P, spatial
from streetloom.plans.demo import World

KX = "(111320.0::DOUBLE * cos(39.9042 * (pi() / 180)))"
NUM = "TRY_CAST(regexp_extract(regexp_replace(t['{}'], '[^0-9.]', '', 'g'), '^[0-9]+(\\.[0-9]*)?') AS DOUBLE)"
CONTRIB = f"""
ringp AS (SELECT r.way_id, r.seq, n.lat, n.lon, first(n.lat) OVER w AS y0, first(n.lon) OVER w AS x0, lead(n.lat) OVER w AS lat2, lead(n.lon) OVER w AS lon2, avg(n.lat) OVER (PARTITION BY r.way_id) AS mid
  FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id JOIN d_ways q ON q.id = r.way_id AND q.closed WINDOW w AS (PARTITION BY r.way_id ORDER BY r.seq)),
area AS (SELECT way_id, abs(sum((lon - x0) * (coalesce(lat2, y0) - y0) - (coalesce(lon2, x0) - x0) * (lat - y0))) / 2 * cos(max(mid) * (pi() / 180)) * pow(pi() / 180 * 6378137.0, 2) AS m2,
  min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM ringp GROUP BY way_id),
cl AS (SELECT a.*, w.t, coalesce(nullif({NUM.format('building:levels')}, 0), 3) AS fl, t['building'] = 'office' OR (t['building'] = 'yes' AND t['shop'] IS NOT NULL) AS job, t['shop'] IS NOT NULL AS jt,
   CAST(floor(min_lon * {KX} / 250) AS BIGINT) AS x1, CAST(floor(max_lon * {KX} / 250) AS BIGINT) AS x2, CAST(floor(min_lat * 110574.0 / 250) AS BIGINT) AS y1, CAST(floor(max_lat * 110574.0 / 250) AS BIGINT) AS y2
  FROM area a JOIN o_ways w ON w.id = a.way_id WHERE t['building'] IS NOT NULL AND m2 >= 20),
pj AS (SELECT *, CASE WHEN NOT job THEN m2 * fl * 0.03 ELSE 0 END AS pop, CASE WHEN job THEN m2 * fl * 0.02 WHEN jt THEN least(m2, 400) * 0.02 ELSE 0 END AS jobs FROM cl),
contrib AS (SELECT way_id, x AS cell_x, y AS cell_y, pop / least((x2 - x1 + 1) * (y2 - y1 + 1), 9) AS pop, jobs / least((x2 - x1 + 1) * (y2 - y1 + 1), 9) AS jobs FROM
  (SELECT *, unnest(range(x1, least(x2, x1 + 2) + 1)) AS x FROM pj) p, LATERAL (SELECT unnest(range(p.y1, least(p.y2, p.y1 + 2) + 1)) AS y) yy)"""
GRID = CONTRIB + ", grid AS (SELECT cell_x, cell_y, sum(pop) AS pop, sum(jobs) AS jobs FROM contrib GROUP BY cell_x, cell_y)"
ACT = f""", arow AS (SELECT CASE WHEN t['landuse'] = 'commercial' THEN 1.6 WHEN t['leisure'] = 'park' THEN 0.8 WHEN t['shop'] IS NOT NULL THEN 1.6 ELSE 1.05 END AS f,
   CAST(floor(min_lon * {KX} / 250) AS BIGINT) AS x1, CAST(floor(max_lon * {KX} / 250) AS BIGINT) AS x2, CAST(floor(min_lat * 110574.0 / 250) AS BIGINT) AS y1, CAST(floor(max_lat * 110574.0 / 250) AS BIGINT) AS y2
  FROM area a JOIN o_ways w ON w.id = a.way_id WHERE (max_lon - min_lon) * {KX} * (max_lat - min_lat) * 110574.0 >= 25),
act AS (SELECT x AS cell_x, y AS cell_y, max(CASE WHEN x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 THEN f ELSE 1 + (f - 1) * 0.5 END)::DOUBLE AS activity
  FROM (SELECT *, unnest(range(x1 - 1, x2 + 2)) AS x FROM arow) p, LATERAL (SELECT unnest(range(p.y1 - 1, p.y2 + 2)) AS y) yy GROUP BY x, y)"""


def closed_geometry(w: World):
    refs = w.way_nodes.join(w.ways.where("closed").select(F.col("id").alias("way_id")), "way_id", "left_semi")
    return G.way_geometry(refs, w.nodes)


def contributions(w: World, **kw):
    return P.building_contribution(w.ways, closed_geometry(w), **kw)


def activity(w: World):
    return P.activity_grid(w.ways.where("closed").join(G.way_bbox(w.way_nodes, w.nodes).withColumnRenamed("way_id", "id"), "id"))


def r6(c: str):
    return geo.js_round(F.col(c), 6).alias(c)


@query("building_contributions", "O60", f"WITH {CONTRIB} SELECT way_id, cell_x, cell_y, floor(pop * 10000 + 0.5) / 10000 AS pop, floor(jobs * 10000 + 0.5) / 10000 AS jobs FROM contrib WHERE pop > 0 OR jobs > 0")
def _(w: World):
    c = contributions(w, compute_jobs=True)
    return c.select("way_id", "cell_x", "cell_y", geo.js_round(F.col("pop"), 4).alias("pop"), geo.js_round(F.col("jobs"), 4).alias("jobs"))


@query("population_grid", "O61", f"WITH {GRID} SELECT cell_x, cell_y, floor(pop * 10000 + 0.5) / 10000 AS pop, floor(jobs * 10000 + 0.5) / 10000 AS jobs FROM grid")
def _(w: World):
    g = P.population_grid(contributions(w, compute_jobs=True))
    return g.select("cell_x", "cell_y", geo.js_round(F.col("pop"), 4).alias("pop"), geo.js_round(F.col("jobs"), 4).alias("jobs"))


@query("population_grid_jobs_as_people", "O61", f"""WITH {CONTRIB.replace("CASE WHEN NOT job THEN m2 * fl * 0.03 ELSE 0 END AS pop", "m2 * fl * 0.03 AS pop").replace("CASE WHEN job THEN m2 * fl * 0.02 WHEN jt THEN least(m2, 400) * 0.02 ELSE 0 END AS jobs", "0.0 AS jobs")}
SELECT cell_x, cell_y, floor(sum(pop) * 10000 + 0.5) / 10000 AS pop FROM contrib GROUP BY cell_x, cell_y""")
def _(w: World):
    g = P.population_grid(contributions(w, jobs_as_pop=True))
    return g.select("cell_x", "cell_y", geo.js_round(F.col("pop"), 4).alias("pop"))


@query("updated_grid", "O62", f"""WITH {CONTRIB.replace("coalesce(nullif(" + NUM.format('building:levels') + ", 0), 3) AS fl", "coalesce(nullif(" + NUM.format('building:levels') + ", 0), 3) + CASE WHEN way_id % 3 = 0 THEN 2 ELSE 0 END AS fl")}
SELECT cell_x, cell_y, floor(sum(pop) * 1000 + 0.5) / 1000 AS pop FROM contrib WHERE pop > 0 GROUP BY cell_x, cell_y""")
def _(w: World):
    geom = closed_geometry(w)
    old = P.building_contribution(w.ways, geom)
    changed = w.ways.where("id % 3 = 0")
    t = F.col("tags")
    taller = changed.withColumn("tags", F.map_zip_with(t, F.create_map(F.lit("building:levels"), F.lit("2")), lambda k, a, b: F.when(
        b.isNotNull() & a.isNotNull(), (a.cast("int") + b.cast("int")).cast("string")).otherwise(F.coalesce(a, F.lit("")))))
    new = P.building_contribution(taller, geom)
    out = P.update_grid(P.population_grid(old), old.where("way_id % 3 = 0"), new)
    return out.select("cell_x", "cell_y", geo.js_round(F.col("pop"), 3).alias("pop"))


BOX = {"min_lat": 39.76, "max_lat": 39.81, "min_lon": 116.17, "max_lon": 116.22}
IN_CELLS = f"""cell_x BETWEEN floor(116.17 * {KX} / 250) AND floor(116.22 * {KX} / 250) AND cell_y BETWEEN floor(39.76 * 110574.0 / 250) AND floor(39.81 * 110574.0 / 250)"""


@query("box_grid", "O63", f"WITH {GRID} SELECT cell_x, cell_y, floor(pop * 10000 + 0.5) / 10000 AS pop FROM grid WHERE {IN_CELLS} AND pop > 0")
def _(w: World):
    g = P.grid_for_box(contributions(w), BOX)
    return g.select("cell_x", "cell_y", geo.js_round(F.col("pop"), 4).alias("pop"))


@query("activity_grid", "O64", f"WITH {GRID} {ACT} SELECT cell_x, cell_y, floor(activity * 1000000 + 0.5) / 1000000 AS activity FROM act")
def _(w: World):
    return activity(w).select("cell_x", "cell_y", r6("activity"))


NEAR = f"""near AS (SELECT s.id, s.catchment_m AS r, g.cell_x, g.cell_y, g.pop, g.jobs, coalesce(a.activity, 1) AS act,
   sqrt(pow(((g.cell_y + 0.5) * 250 / 110574.0 - s.lat) * 110574.0, 2) + pow(((g.cell_x + 0.5) * 250 / {KX} - s.lon) * {KX}, 2)) AS d
  FROM d_stations s JOIN grid g ON abs(g.cell_x - floor(s.lon * {KX} / 250)) <= ceil(s.catchment_m / 250.0) AND abs(g.cell_y - floor(s.lat * 110574.0 / 250)) <= ceil(s.catchment_m / 250.0)
  LEFT JOIN act a ON a.cell_x = g.cell_x AND a.cell_y = g.cell_y)"""


@query("radius_weights", "O41", f"""WITH {GRID} {ACT}, {NEAR} SELECT id, cell_x, cell_y, floor(d * 1000 + 0.5) / 1000 AS d, floor(greatest(0.25, 1 - d / r * 0.75) * 1000000 + 0.5) / 1000000 AS w FROM near WHERE d <= r AND pop + jobs > 0""")
def _(w: World):
    g = P.population_grid(contributions(w, compute_jobs=True))
    near = spatial.radius_join(w.stations, g, "catchment_m", P.CELL_M, 110574.0, P.m_per_deg_lon())
    return near.select("id", "cell_x", "cell_y", geo.js_round(F.col("d"), 3).alias("d"), r6("w"))


CATCH = f""", {NEAR}, s1 AS (SELECT id, sum(pop * w) AS p, sum(jobs * w) AS j, sum(pop * w * act) AS wp FROM (SELECT *, greatest(0.25, 1 - d / r * 0.75) AS w FROM near WHERE d <= r) z GROUP BY id),
s2 AS (SELECT s.id, floor(coalesce(p, 0) + 0.5) AS pop, floor(coalesce(j, 0) + 0.5) AS jobs, floor(coalesce(wp, 0) + 0.5) AS coverage,
  floor(CASE WHEN p > 0 THEN wp / p ELSE coalesce(a.activity, 1) END * 100 + 0.5) / 100 AS activity, floor(coalesce(p, 0) / (s.catchment_m * s.catchment_m * pi() / 1000000) + 0.5) AS density
  FROM d_stations s LEFT JOIN s1 ON s1.id = s.id LEFT JOIN act a ON a.cell_x = floor(s.lon * {KX} / 250) AND a.cell_y = floor(s.lat * 110574.0 / 250)),
demand AS (SELECT *, floor(pop * activity + 0.5) AS demand FROM s2)"""


@query("station_catchment", "O65", f"""WITH {GRID} {ACT} {CATCH} SELECT id, CAST(pop AS BIGINT) AS pop, CAST(jobs AS BIGINT) AS jobs, CAST(coverage AS BIGINT) AS coverage, activity,
  CAST(density AS BIGINT) AS density, CAST(demand AS BIGINT) AS demand FROM demand""")
def _(w: World):
    g = P.population_grid(contributions(w, compute_jobs=True))
    return P.catchment(w.stations, g, activity(w)).select("id", "pop", "jobs", "coverage", "activity", "density", "demand")


@query("station_demand", "O120", f"""WITH {GRID} {ACT} {CATCH} SELECT id, CAST(CASE WHEN coverage > 0 THEN coverage ELSE demand END AS BIGINT) AS coverage, CAST(demand AS BIGINT) AS demand,
  CAST(floor(demand * 0.22::DOUBLE + 0.5) AS BIGINT) AS daily_trips FROM demand""")
def _(w: World):
    return P.station_demand(w.stations, P.population_grid(contributions(w)), activity(w)).select("id", "coverage", "demand", "daily_trips")


@query("grid_totals", "O66", f"""WITH {GRID} {ACT} SELECT (SELECT CAST(floor(sum(pop) + 0.5) AS BIGINT) FROM grid) AS population, (SELECT CAST(floor(sum(jobs) + 0.5) AS BIGINT) FROM grid) AS jobs,
  (SELECT count(*) FROM grid WHERE pop > 0 OR jobs > 0) AS cells, (SELECT count(*) FROM act) AS activity_cells, (SELECT floor(avg(activity) * 1000 + 0.5) / 1000 FROM act) AS avg_activity,
  (SELECT count(*) FROM act WHERE activity >= 1.5) AS high, (SELECT count(*) FROM act WHERE activity <= 0.9) AS low""")
def _(w: World):
    return P.grid_totals(P.population_grid(contributions(w, compute_jobs=True)), activity(w))


@query("heat_map", "O67", f"""WITH {GRID} {ACT} SELECT g.cell_x, g.cell_y, CAST(floor(pop + 0.5) AS BIGINT) AS pop, CAST(floor(jobs + 0.5) AS BIGINT) AS jobs, floor(coalesce(activity, 1) * 100 + 0.5) / 100 AS activity
 FROM (SELECT * FROM grid WHERE {IN_CELLS}) g LEFT JOIN act a ON a.cell_x = g.cell_x AND a.cell_y = g.cell_y WHERE pop >= 20 OR jobs >= 20""")
def _(w: World):
    h = P.heatmap(P.population_grid(contributions(w, compute_jobs=True)), activity(w), BOX)
    return h.select("cell_x", "cell_y", "pop", "jobs", "activity")


@query("heat_map_with_activity", "O67", f"""WITH {GRID} {ACT}, b AS (SELECT * FROM grid WHERE {IN_CELLS} AND pop > 0), c AS (SELECT * FROM act WHERE {IN_CELLS})
SELECT coalesce(b.cell_x, c.cell_x) AS cell_x, coalesce(b.cell_y, c.cell_y) AS cell_y, CAST(floor(coalesce(pop, 0) + 0.5) AS BIGINT) AS pop, floor(coalesce(activity, 1) * 100 + 0.5) / 100 AS activity
FROM b FULL JOIN c ON c.cell_x = b.cell_x AND c.cell_y = b.cell_y WHERE b.pop IS NOT NULL OR activity <> 1""")
def _(w: World):
    h = P.heatmap(P.population_grid(contributions(w)), activity(w), BOX, min_pop=0)
    return h.select("cell_x", "cell_y", "pop", "activity")
