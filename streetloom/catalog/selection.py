"""Box queries, ledgers, statistics, search, payload sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.catalog.elements import hav
from streetloom.catalog.rules import CATEGORY_SQL, LINE_ALWAYS_SQL, LINE_CLASS_SQL, LINE_FAMILY_SQL, LINE_ZOOM_SQL, POINT_ZOOM_SQL, RANK_SQL, WITHHOLD_SQL
from streetloom.functions import geo, tags as TG
from streetloom.operators import geometry as G, selection as S
from streetloom.operators.spatial import box_join, point_box_join, points_in_areas
from streetloom.plans.demo import World
from streetloom.session import cut_lineage

EXT = """x AS (SELECT w.id, w.version, w.t, w.closed, e.* FROM o_ways w LEFT JOIN (SELECT r.way_id, min(n.lat) AS min_lat, max(n.lat) AS max_lat,
   min(n.lon) AS min_lon, max(n.lon) AS max_lon FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id) e ON e.way_id = w.id)"""
TOUCH = "{0}.max_lon >= v.min_lon AND {0}.min_lon <= v.max_lon AND {0}.max_lat >= v.min_lat AND {0}.min_lat <= v.max_lat"
HITS = f"""h AS (SELECT v.view_id, v.zoom, x.id, x.t, x.closed,
   CASE WHEN v.zoom >= 19 THEN 5 WHEN v.zoom >= 15 THEN 4 WHEN v.zoom >= 14 THEN 2 WHEN v.zoom >= 13 THEN 1 ELSE 0 END AS send,
   CASE WHEN v.zoom <= 13 THEN 20000 WHEN v.zoom <= 14 THEN 6000 WHEN v.zoom <= 15 THEN 1500 WHEN v.zoom <= 16 THEN 400 ELSE 0 END AS need,
   abs((x.max_lat - x.min_lat) * 110574 * (x.max_lon - x.min_lon) * 111320) AS area
   FROM x JOIN d_views v ON {TOUCH.format('x')})"""


def _numbers(w: World):
    return G.with_extents(w.dataset)


@query("box_categories", "O14 O21 O24 O31 O36 O51 O52 O57 (first slice)", f"""
WITH {EXT}, s AS (SELECT way_id, n.lat, n.lon, lag(n.lat) OVER (PARTITION BY way_id ORDER BY seq) AS plat,
   lag(n.lon) OVER (PARTITION BY way_id ORDER BY seq) AS plon FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id),
l AS (SELECT way_id, floor(sum({hav('plat', 'plon', 'lat', 'lon')}) * 10 + 0.5) / 10 AS m FROM s WHERE plat IS NOT NULL GROUP BY way_id),
h AS (SELECT v.view_id, v.zoom, x.id, x.t, l.m FROM x JOIN d_views v ON {TOUCH.format('x')} LEFT JOIN l ON l.way_id = x.id)
SELECT view_id, category, count(*) AS ways, floor(sum(m) * 10 + 0.5) / 10 AS length_m
FROM (SELECT view_id, m, {CATEGORY_SQL} AS category FROM h WHERE zoom >= {LINE_ZOOM_SQL}) c GROUP BY view_id, category""")
def _(w: World):
    hits = box_join(_numbers(w), w.views)
    seen = hits.where(TG.lod_visible(F.col("tags"), F.col("zoom")))
    return seen.withColumn("category", TG.category_of(F.col("tags"))).groupBy("view_id", "category").agg(
        F.count("*").alias("ways"), geo.js_round(F.sum("length_m"), 1).alias("length_m"))


@query("in_box", "O31", f"""
WITH {EXT} SELECT 'way' AS kind, v.view_id, x.id FROM x JOIN d_views v ON {TOUCH.format('x')}
UNION ALL SELECT 'node', v.view_id, n.id FROM d_nodes n JOIN d_views v ON n.lat BETWEEN v.min_lat AND v.max_lat AND n.lon BETWEEN v.min_lon AND v.max_lon""")
def _(w: World):
    v = w.views.drop("zoom")
    ways = box_join(G.way_bbox(w.way_nodes, w.nodes).withColumnRenamed("way_id", "id"), v)
    nodes = point_box_join(w.nodes, v)
    return ways.select(F.lit("way").alias("kind"), "view_id", "id").unionByName(nodes.select(F.lit("node").alias("kind"), "view_id", "id"))


@query("dataset_info", "O6", """
SELECT (SELECT count(*) FROM d_nodes) AS nodes, (SELECT min(lat) FROM d_nodes) AS min_lat, (SELECT max(lat) FROM d_nodes) AS max_lat,
  (SELECT min(lon) FROM d_nodes) AS min_lon, (SELECT max(lon) FROM d_nodes) AS max_lon, (SELECT max(id) + 1 FROM d_nodes) AS next_node_id,
  (SELECT count(*) FROM d_ways) AS ways, (SELECT max(id) + 1 FROM d_ways) AS next_way_id,
  (SELECT count(*) FROM d_relations) AS relations, (SELECT max(id) + 1 FROM d_relations) AS next_relation_id,
  (SELECT count(*) FROM d_way_nodes) AS way_nodes, (SELECT count(*) FROM d_relation_members) AS relation_members""")
def _(w: World):
    return S.dataset_info(w.dataset)


@query("tag_statistics", "O54", """
SELECT k AS key, count(DISTINCT id) AS ways FROM (SELECT id, unnest(map_keys(t)) AS k FROM o_ways) s GROUP BY k ORDER BY ways DESC, k LIMIT 60""")
def _(w: World):
    return S.tag_stats(w.ways, 60)


@query("box_statistics", "O55", f"""
WITH {EXT}, a AS (SELECT v.view_id, sum((t['building'] IS NOT NULL)::INT) AS buildings, sum((t['highway'] IS NOT NULL)::INT) AS highways,
   sum((t['waterway'] IS NOT NULL OR coalesce(t['natural'], '') = 'water')::INT) AS waterways,
   sum((t['landuse'] IS NOT NULL OR t['leisure'] IS NOT NULL OR t['natural'] IS NOT NULL)::INT) AS landuse, sum((t['railway'] IS NOT NULL)::INT) AS railways
   FROM x JOIN d_views v ON {TOUCH.format('x')} GROUP BY v.view_id),
p AS (SELECT v.view_id, count(*) AS pois FROM d_nodes n JOIN d_views v ON n.lat BETWEEN v.min_lat AND v.max_lat AND n.lon BETWEEN v.min_lon AND v.max_lon
   WHERE n.tags IS NOT NULL GROUP BY v.view_id)
SELECT v.view_id, CAST(coalesce(buildings, 0) AS BIGINT) AS buildings, CAST(coalesce(highways, 0) AS BIGINT) AS highways, CAST(coalesce(waterways, 0) AS BIGINT) AS waterways,
  CAST(coalesce(landuse, 0) AS BIGINT) AS landuse, CAST(coalesce(railways, 0) AS BIGINT) AS railways, CAST(coalesce(pois, 0) AS BIGINT) AS pois
FROM d_views v LEFT JOIN a ON a.view_id = v.view_id LEFT JOIN p ON p.view_id = v.view_id""")
def _(w: World):
    ext = w.ways.join(G.way_bbox(w.way_nodes, w.nodes).withColumnRenamed("way_id", "id"), "id")
    return S.bbox_stats(ext, w.nodes, w.views)


@query("class_choice", "O56", f"""
WITH c AS (SELECT cls, count(*) AS ways FROM (SELECT {LINE_CLASS_SQL} AS cls FROM o_ways) s WHERE cls IS NOT NULL GROUP BY cls),
m AS (SELECT *, {LINE_FAMILY_SQL} AS family, {LINE_ALWAYS_SQL} AS always, ({LINE_ALWAYS_SQL}) OR ways >= 1500 AS f FROM c),
r AS (SELECT *, sum(ways) OVER () - coalesce(sum(ways) FILTER (WHERE f) OVER (), 0) AS l,
   coalesce(sum(ways) OVER (PARTITION BY f ORDER BY ways DESC, cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m)
SELECT cls, family, ways, always, f OR l - b > 2500 AS chosen FROM r""")
def _(w: World):
    return S.choose_classes(S.class_counts(w.ways), limit=5000, budget=0.5, min_ways=1500)


@query("category_rollup", "O57", f"""
WITH {EXT} SELECT view_id, category, count(*) AS features, CAST(grouping(view_id, category) AS BIGINT) AS level
FROM (SELECT v.view_id, {CATEGORY_SQL} AS category FROM x JOIN d_views v ON {TOUCH.format('x')}) s GROUP BY ROLLUP (view_id, category)""")
def _(w: World):
    ext = w.ways.join(G.way_bbox(w.way_nodes, w.nodes).withColumnRenamed("way_id", "id"), "id")
    return S.category_counts(box_join(ext, w.views.drop("zoom")), ["view_id"])


WAY_LEDGER = f"""
WITH {EXT}, {HITS}, s AS (SELECT view_id, zoom, id, CASE WHEN zoom < ({LINE_ZOOM_SQL}) THEN 'invisible' ELSE coalesce({WITHHOLD_SQL.replace("WHEN area < 150 THEN 'building'", "")}, 'returned') END AS st FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY view_id, st ORDER BY id) AS rn FROM s),
l AS (SELECT view_id, zoom, count(*) AS candidates, count(*) FILTER (WHERE st = 'returned') AS visible,
  count(*) FILTER (WHERE st = 'returned' AND rn <= 1000) AS returned, count(*) FILTER (WHERE st = 'returned' AND rn > 1000) AS dropped,
  count(*) FILTER (WHERE st = 'invisible') AS invisible, count(*) FILTER (WHERE st = 'neverSend') AS withheld_never_send,
  count(*) FILTER (WHERE st = 'roadClass') AS withheld_road_class, count(*) FILTER (WHERE st = 'railMinor') AS withheld_rail_minor,
  count(*) FILTER (WHERE st = 'landuse') AS withheld_landuse, count(*) FILTER (WHERE st = 'building') AS withheld_building,
  count(*) FILTER (WHERE st = 'returned' AND rn > 1000) = 0 AS complete FROM r GROUP BY view_id, zoom)
"""


@query("selection_ledger", "O58", WAY_LEDGER + "SELECT * FROM l")
def _(w: World):
    status = S.with_status(box_join(_numbers(w), w.views), detail=4, limit=1000)
    return S.selection_ledger(status, "way").drop("kind")


@query("merged_ledger", "O59", WAY_LEDGER + """
SELECT CAST(floor(view_id / 10) AS BIGINT) AS block, max(CASE WHEN view_id % 10 = 1 THEN zoom END) AS zoom, CAST(sum(candidates) AS BIGINT) AS candidates,
  CAST(CASE WHEN bool_or(dropped > 1200) THEN NULL ELSE sum(dropped) END AS BIGINT) AS dropped, bool_and(complete) AS complete,
  CASE WHEN bool_and(complete) THEN 'all' WHEN bool_or(complete) THEN 'all,cut' ELSE 'cut' END AS notes FROM l GROUP BY 1""")
def _(w: World):
    status = S.with_status(box_join(_numbers(w), w.views), detail=4, limit=1000)
    parts = S.selection_ledger(status, "way").select(
        F.floor(F.col("view_id") / 10).alias("block"), F.col("view_id").alias("part"), "zoom", "candidates",
        F.when(F.col("dropped") <= 1200, F.col("dropped")).alias("dropped"), "complete",
        F.array(F.when(F.col("complete"), "all").otherwise("cut")).alias("notes"))
    return S.merge_ledgers(parts, ["block"], echo=["zoom"]).withColumn("notes", F.array_join("notes", ","))


@query("viewport_ledger", "O94", WAY_LEDGER.replace("1000", "15000") + f"""
, nh AS (SELECT v.view_id, v.zoom, n.id, n.t FROM o_nodes n JOIN d_views v ON n.lat BETWEEN v.min_lat AND v.max_lat AND n.lon BETWEEN v.min_lon AND v.max_lon WHERE n.t IS NOT NULL),
rb AS (SELECT m.relation_id, min(a) AS min_lat, max(b) AS max_lat, min(c) AS min_lon, max(d) AS max_lon FROM
  (SELECT m.relation_id, x.min_lat AS a, x.max_lat AS b, x.min_lon AS c, x.max_lon AS d FROM d_relation_members m JOIN x ON x.id = m.member_ref AND m.member_type = 'way'
   UNION ALL SELECT m.relation_id, n.lat, n.lat, n.lon, n.lon FROM d_relation_members m JOIN d_nodes n ON n.id = m.member_ref AND m.member_type = 'node') m GROUP BY m.relation_id),
rh AS (SELECT v.view_id, v.zoom, o.id, o.t FROM rb JOIN o_relations o ON o.id = rb.relation_id JOIN d_views v ON {TOUCH.format('rb')})
SELECT 'way' AS kind, view_id, zoom, candidates, visible, returned, withheld_road_class, complete FROM l
UNION ALL SELECT 'node', view_id, zoom, count(*), count(*) FILTER (WHERE zoom >= {POINT_ZOOM_SQL}), count(*) FILTER (WHERE zoom >= {POINT_ZOOM_SQL}), 0, true FROM nh GROUP BY view_id, zoom
UNION ALL SELECT 'relation', view_id, zoom, count(*), count(*) FILTER (WHERE zoom >= {LINE_ZOOM_SQL}), count(*) FILTER (WHERE zoom >= {LINE_ZOOM_SQL}), 0, true FROM rh GROUP BY view_id, zoom""")
def _(w: World):
    return S.viewport(w.dataset, w.views)["ledger"].select(
        "kind", "view_id", "zoom", "candidates", "visible", "returned", "withheld_road_class", "complete")


@query("viewport_ways", "O94", f"""
WITH {EXT}, {HITS}, s AS (SELECT view_id, id, CASE WHEN zoom < ({LINE_ZOOM_SQL}) THEN 'invisible' ELSE coalesce({WITHHOLD_SQL.replace("WHEN area < 150 THEN 'building'", "")}, 'returned') END AS st FROM h)
SELECT view_id, id FROM s WHERE st = 'returned'""")
def _(w: World):
    return S.viewport(w.dataset, w.views)["ways"].select("view_id", "id")


@query("lod_audit", "O83", f"""
SELECT count(*) AS checked, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE bad) / count(*) <= 0.02 AS ok FROM (
  SELECT (id % 61 = 0 AND coalesce({RANK_SQL}, -1) <> 9) OR (id % 67 = 0) AS bad FROM o_ways) s""")
def _(w: World):
    cls, zoom = TG.lod_keys(F.col("tags"))
    stored = w.ways.withColumn("road_class", F.when(F.col("id") % 61 == 0, F.lit(9)).otherwise(cls)) \
        .withColumn("lod_zoom", F.when(F.col("id") % 67 == 0, F.lit(None)).otherwise(zoom))
    return S.audit_lod(stored)


SEARCH_SQL = """
WITH hit AS (SELECT * FROM (
  SELECT * FROM (SELECT 0 AS r, 'way' AS type, id FROM o_ways WHERE contains(lower(t['name']), 'road 1') ORDER BY id LIMIT 700)
  UNION ALL SELECT * FROM (SELECT 1, 'node', id FROM o_nodes WHERE contains(lower(t['name']), 'road 1') ORDER BY id LIMIT 700)) u ORDER BY r, id LIMIT 700),
g AS (SELECT r.way_id, n.lat, n.lon, row_number() OVER (PARTITION BY r.way_id ORDER BY r.seq) - 1 AS i, count(*) OVER (PARTITION BY r.way_id) AS c
  FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id)
SELECT type, id, g.lat, g.lon FROM hit LEFT JOIN g ON g.way_id = hit.id AND g.i = floor(g.c / 2)"""


@query("search_names", "O87", SEARCH_SQL)
def _(w: World):
    return S.search(w.dataset, name="rOAD% 1", limit=700).select("type", "id", F.col("center.lat").alias("lat"), F.col("center.lon").alias("lon"))


@query("search_tag", "O87", """
WITH hit AS (SELECT id FROM o_ways WHERE t['building'] = 'office' ORDER BY id LIMIT 300)
SELECT 'way' AS type, h.id, n.lat, n.lon FROM hit h JOIN d_way_nodes r ON r.way_id = h.id AND r.seq = 2 JOIN d_nodes n ON n.id = r.node_id""")
def _(w: World):
    return S.search(w.dataset, key="building", value="office", limit=300).select(
        "type", "id", F.col("center.lat").alias("lat"), F.col("center.lon").alias("lon"))


@query("element_lookup", "O135", """
WITH want AS (SELECT DISTINCT elem_id AS id FROM d_changes WHERE elem_id IN (SELECT id FROM d_ways)),
hist AS (SELECT elem_id, string_agg(concat(CAST(id AS VARCHAR), ':', action), ',' ORDER BY id DESC) AS history FROM
  (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY id DESC) AS rn FROM d_changes) c WHERE rn <= 5 GROUP BY elem_id),
par AS (SELECT member_ref, string_agg(CAST(relation_id AS VARCHAR), ',' ORDER BY relation_id) AS parents FROM
  (SELECT DISTINCT member_ref, relation_id FROM d_relation_members WHERE member_type = 'way') p GROUP BY member_ref),
pts AS (SELECT r.way_id, count(*) AS points FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id)
SELECT w.id, d.version, p.points, h.history, r.parents FROM want w JOIN d_ways d ON d.id = w.id LEFT JOIN pts p ON p.way_id = w.id
LEFT JOIN hist h ON h.elem_id = w.id LEFT JOIN par r ON r.member_ref = w.id""")
def _(w: World):
    wanted = w.changes.select(F.lit("way").alias("type"), F.col("elem_id").alias("id")).distinct()
    out = S.lookup(w.dataset, w.changes, wanted, history=5)
    text = F.transform("history", lambda h: F.concat(h["change_id"].cast("string"), F.lit(":"), h["action"]))
    return out.select("id", "version", F.size("coords").cast("long").alias("points"), F.array_join(text, ",").alias("history"),
                      F.array_join(F.transform("parents", lambda p: p.cast("string")), ",").alias("parents"))


@query("delta_packing", "O13", """
WITH q AS (SELECT r.way_id, r.seq, CAST(floor(n.lat * 1000000.0::DOUBLE + 0.5) AS BIGINT) AS y, CAST(floor(n.lon * 1000000.0::DOUBLE + 0.5) AS BIGINT) AS x FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id),
d AS (SELECT way_id, seq, y - coalesce(lag(y) OVER (PARTITION BY way_id ORDER BY seq), 0) AS dy, x - coalesce(lag(x) OVER (PARTITION BY way_id ORDER BY seq), 0) AS dx FROM q)
SELECT way_id, string_agg(CAST(dy AS VARCHAR), ',' ORDER BY seq) AS dlat, string_agg(CAST(dx AS VARCHAR), ',' ORDER BY seq) AS dlon, true AS same FROM d GROUP BY way_id""")
def _(w: World):
    packed = S.pack_deltas(G.way_geometry(w.way_nodes, w.nodes))
    back = S.unpack_deltas(packed.withColumnRenamed("coords", "orig"))
    near = F.forall(F.zip_with("orig", "coords", lambda a, b: (F.abs(a["lat"] - b["lat"]) < 6e-7) & (F.abs(a["lon"] - b["lon"]) < 6e-7)), lambda x: x)
    def text(c):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return back.select("way_id", text("dlat").alias("dlat"), text("dlon").alias("dlon"), near.alias("same"))


PAYLOAD_SQL = f"""
WITH b AS (SELECT ({LINE_ZOOM_SQL}) AS z0, length(concat('{{"id":', id, ',"n":', node_count, ',"v":', version, '}}')) AS plain,
  length(concat('{{"i":', id, '}}')) AS packed FROM o_ways),
z AS (SELECT zoom, count(*) AS features, CAST(sum(plain) AS BIGINT) AS plain_bytes, CAST(sum(packed) AS BIGINT) AS packed_bytes FROM b JOIN
  (VALUES (4),(9),(10),(11),(12),(13),(14),(15),(16)) AS q(zoom) ON q.zoom >= z0 GROUP BY zoom)"""


@query("payload_sizes", "O12", PAYLOAD_SQL + """
SELECT CAST(zoom AS INT) AS zoom, plain_bytes AS before_bytes, packed_bytes AS after_bytes, floor((plain_bytes - packed_bytes) * 1000.0::DOUBLE / plain_bytes + 0.5) / 10 AS saved_pct FROM z""")
def _(w: World):
    sizes = S.payload_sizes(w.ways, [4, 9, 10, 11, 12, 13, 14, 15, 16], {
        "plain": F.struct("id", F.col("node_count").alias("n"), F.col("version").alias("v")), "packed": F.struct(F.col("id").alias("i"))})
    return S.payload_change(sizes.withColumnRenamed("plain_bytes", "bytes"), sizes.withColumnRenamed("packed_bytes", "bytes"), "bytes")


@query("points_in_areas", "O137", """
WITH e AS (SELECT r.way_id, n.lat AS y1, n.lon AS x1, m.lat AS y2, m.lon AS x2 FROM d_way_base b JOIN d_way_nodes r ON r.way_id = b.way_id AND b.kind = 2
   JOIN d_way_nodes q ON q.way_id = r.way_id AND q.seq = r.seq + 1 JOIN d_nodes n ON n.id = r.node_id JOIN d_nodes m ON m.id = q.node_id),
p AS (SELECT c.way_id * 10 + k AS id, n.lat + k * 0.00025::DOUBLE AS lat, n.lon + k * 0.0002::DOUBLE AS lon FROM d_way_base c JOIN d_way_nodes r ON r.way_id = c.way_id AND r.seq = 0 AND c.kind = 2
   JOIN d_nodes n ON n.id = r.node_id CROSS JOIN (VALUES (1), (2), (3)) AS k(k))
SELECT p.id AS point_id, e.way_id AS area_id FROM p JOIN e ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x1 - e.x2) * (p.lat - e.y2) / (e.y1 - e.y2) + e.x2
  AND abs(e.y1 - p.lat) < 0.01 AND abs(e.x1 - p.lon) < 1
GROUP BY p.id, e.way_id HAVING count(*) % 2 = 1""")
def _(w: World):
    closed = w.ways.where("closed").select(F.col("id").alias("way_id"))
    refs = w.way_nodes.join(closed, "way_id", "left_semi")
    located = cut_lineage(G.located_refs(refs, w.nodes))
    rings = G.points_in_order(located).select(F.col("way_id").alias("area_id"), F.lit(0).alias("ring_no"), "coords")
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    corner = located.where("seq = 0").select("way_id", "lat", "lon", k)
    pts = corner.select((F.col("way_id") * 10 + F.col("k")).alias("id"), (F.col("lat") + F.col("k") * F.lit(0.00025)).alias("lat"),
                        (F.col("lon") + F.col("k") * F.lit(0.0002)).alias("lon"))
    return points_in_areas(pts, rings)


@query("dense_blocks", "O138", """
WITH f AS (SELECT n.id, n.lat, n.lon, n.id % 3 <> 0 AS drawn FROM d_nodes n),
v AS (SELECT 39.73::DOUBLE AS y1, 39.85::DOUBLE AS y2, 116.13::DOUBLE AS x1, 116.26::DOUBLE AS x2),
g AS (SELECT CAST(floor(lat / (300.0::DOUBLE / 110574.0)) AS BIGINT) AS b_row, CAST(floor(lon / (300.0::DOUBLE / (111320.0 * greatest(0.15, cos(40 * (pi() / 180)))))) AS BIGINT) AS b_col,
   count(*) AS n, count(*) FILTER (WHERE drawn) AS n_drawn FROM f GROUP BY 1, 2),
s AS (SELECT g.*, n_drawn - 10 AS over, greatest(0, least((b_row + 1) * (300.0::DOUBLE / 110574.0), y2) - greatest(b_row * (300.0::DOUBLE / 110574.0), y1)) / (300.0::DOUBLE / 110574.0)
   * greatest(0, least((b_col + 1) * d, x2) - greatest(b_col * d, x1)) / d AS frac
  FROM g, v, (SELECT 300.0::DOUBLE / (111320.0 * greatest(0.15, cos(40 * (pi() / 180)))) AS d) q),
h AS (SELECT *, over > 0 AND n_drawn >= 3 AND frac >= 1.0 / 6 AS hot FROM s),
t AS (SELECT *, sum(n_drawn) OVER () AS total, sum(CASE WHEN hot THEN n_drawn ELSE 0 END) OVER () AS hs,
   sum(n_drawn) OVER (PARTITION BY hot ORDER BY over DESC, b_row, b_col ROWS UNBOUNDED PRECEDING) AS upto FROM h)
SELECT b_row, b_col, n, n_drawn, over, NOT hot AS by_budget FROM t WHERE hot OR (n_drawn >= 3 AND total - hs - (upto - n_drawn) > 1300)""")
def _(w: World):
    f = w.nodes.select("id", "lat", "lon", (F.col("id") % 3 != 0).alias("drawn"))
    return S.dense_blocks(f, {"min_lat": 39.73, "max_lat": 39.85, "min_lon": 116.13, "max_lon": 116.26}, threshold=10, budget=1300)
