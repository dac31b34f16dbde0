"""Generalised lines and areas, tiles, coverage."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.catalog.rules import LINE_ALWAYS_SQL, LINE_CLASS_SQL, LINE_ZOOM_SQL, RANK_SQL, WITHHOLD_SQL, AREA_CLASS_SQL
from streetloom.catalog.selection import EXT
from streetloom.functions import geo, shapes, tags as T
from streetloom.operators import drawing as DR, geometry as G
from streetloom.operators.drawing import TileGrid
from streetloom.plans.demo import World

TILES = 6


def grid(w: World) -> TileGrid:
    return TileGrid.over(w.nodes, TILES)


# Extent of the data, from which the grid follows.
GX = "gx AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM d_nodes)"
A, B, C, D = (f"(SELECT {x} FROM gx)" for x in "abcd")
ROW = f"least(5, greatest(0, CAST(floor(({{0}} - {A}) / (({B} - {A}) / 6)) AS INT)))"
COL = f"least(5, greatest(0, CAST(floor(({{0}} - {C}) / (({D} - {C}) / 6)) AS INT)))"


@query("tile_numbers", "O99", f"WITH {GX} SELECT n.id, CAST({ROW.format('lat')} * 6 + {COL.format('lon')} + 1 AS INT) AS tile FROM d_nodes n")
def _(w: World):
    return w.nodes.select("id", grid(w).tile_of(F.col("lat"), F.col("lon")).alias("tile"))


# Tiles that a row's box touches.
BOX_TILES = "tl.tile"
ON_TILES = f"""JOIN (SELECT r, c, CAST(r * 6 + c + 1 AS INT) AS tile FROM range(6) p(r), range(6) q(c)) tl ON tl.r >= {ROW.format('min_lat')} AND tl.r <= {ROW.format('max_lat')}
  AND tl.c >= {COL.format('min_lon')} AND tl.c <= {COL.format('max_lon')}"""


@query("tiles_of_ways", "O99", f"WITH {GX}, {EXT} SELECT id, {BOX_TILES} AS tile FROM x {ON_TILES} WHERE min_lat IS NOT NULL")
def _(w: World):
    b = G.way_bbox(w.way_nodes, w.nodes)
    return b.select(F.col("way_id").alias("id"), F.explode(grid(w).tiles_of_box(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))).alias("tile"))


COVER = f"""{EXT}, zx AS (SELECT x.*, z.zoom, CASE WHEN zoom >= 15 THEN 4 WHEN zoom >= 14 THEN 2 WHEN zoom >= 13 THEN 1 ELSE 0 END AS send,
   CASE WHEN zoom <= 13 THEN 20000 WHEN zoom <= 14 THEN 6000 ELSE 1500 END AS need, abs((max_lat - min_lat) * 110574 * (max_lon - min_lon) * 111320) AS area FROM x CROSS JOIN (VALUES (8), (9), (10), (11), (12), (13), (14)) AS z(zoom)),
zs AS (SELECT *, CASE WHEN zoom < ({LINE_ZOOM_SQL}) THEN 'invisible' WHEN held IS NOT NULL THEN 'lod' ELSE 'way' END AS st, ({LINE_CLASS_SQL}) AS cls, ({AREA_CLASS_SQL}) AS acls FROM (SELECT *, {WITHHOLD_SQL.replace("WHEN area < 150 THEN 'building'", "")} AS held FROM zx) h),
zc AS (SELECT zoom, cls, count(*) AS ways FROM zs WHERE st = 'way' AND NOT closed AND cls IS NOT NULL GROUP BY zoom, cls),
zm AS (SELECT zc.*, p.picked, ({LINE_ALWAYS_SQL}) OR ways >= 200 AS f FROM zc JOIN (SELECT zoom, count(*) AS picked FROM zs WHERE st = 'way' GROUP BY zoom) p ON p.zoom = zc.zoom),
zr AS (SELECT *, picked - coalesce(sum(ways) FILTER (WHERE f) OVER (PARTITION BY zoom), 0) AS l, coalesce(sum(ways) OVER (PARTITION BY zoom, f ORDER BY ways DESC, cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM zm),
ch AS (SELECT zoom, cls FROM zr WHERE f OR l - b > 7500),
cv AS (SELECT zs.id, zs.zoom, min_lat, max_lat, min_lon, max_lon, CASE WHEN st = 'way' AND NOT closed AND ch.cls IS NOT NULL THEN 'line' WHEN st = 'way' AND closed AND acls IS NOT NULL THEN 'area' ELSE st END AS status,
   CASE WHEN st = 'way' AND NOT closed AND ch.cls IS NOT NULL THEN zs.cls WHEN st = 'way' AND closed AND acls IS NOT NULL THEN acls WHEN st = 'lod' THEN CASE WHEN held = 'roadClass' THEN concat('roadClass:', CAST(({RANK_SQL}) AS VARCHAR)) ELSE held END END AS sub
  FROM zs LEFT JOIN ch ON ch.zoom = zs.zoom AND ch.cls = zs.cls)"""


@query("tile_coverage", "O102", f"WITH {GX}, {COVER} SELECT CAST(zoom AS INT) AS zoom, {BOX_TILES} AS tile, id AS way_id, status, sub FROM cv {ON_TILES} WHERE min_lat IS NOT NULL")
def _(w: World):
    return DR.tile_coverage(w.dataset, grid(w)).select("zoom", "tile", "way_id", "status", "sub")


VIEWS14 = "(SELECT view_id, 14 AS zoom, min_lat, max_lat, min_lon, max_lon FROM d_views)"


@query("tile_ledger", "O103", f"""WITH {GX}, {COVER}, ct AS (SELECT cv.*, {BOX_TILES} AS tile FROM cv {ON_TILES} WHERE min_lat IS NOT NULL),
vb AS (SELECT view_id, zoom, min_lat AS y1, max_lat AS y2, min_lon AS x1, max_lon AS x2, greatest(min_lat, {A}) AS min_lat, least(max_lat, {B}) AS max_lat, greatest(min_lon, {C}) AS min_lon, least(max_lon, {D}) AS max_lon FROM {VIEWS14}),
vt AS (SELECT view_id, zoom, y1, y2, x1, x2, {BOX_TILES} AS tile FROM vb {ON_TILES} WHERE max_lat >= min_lat AND max_lon >= min_lon)
SELECT v.view_id, c.status, count(DISTINCT c.id) AS ways FROM ct c JOIN vt v ON v.zoom = c.zoom AND v.tile = c.tile
 AND floor(c.max_lon * 100000 + 0.5) + 1 >= v.x1 * 100000 AND floor(c.min_lon * 100000 + 0.5) - 1 <= v.x2 * 100000 AND floor(c.max_lat * 100000 + 0.5) + 1 >= v.y1 * 100000 AND floor(c.min_lat * 100000 + 0.5) - 1 <= v.y2 * 100000
 GROUP BY v.view_id, c.status""")
def _(w: World):
    g = grid(w)
    return DR.tile_ledger(DR.tile_coverage(w.dataset, g, [14]), w.views.withColumn("zoom", F.lit(14)), g)


# Some ways have moved a degree to the north, out of the grid.
@query("dirty_tiles", "O104", f"""WITH {GX}, {EXT}, c AS (SELECT CAST(least({LINE_ZOOM_SQL}, 18) AS INT) AS lz, min_lat + CASE WHEN id % 500 = 7 THEN 1 ELSE 0 END AS min_lat, max_lat + CASE WHEN id % 500 = 7 THEN 1 ELSE 0 END AS max_lat,
   min_lon, max_lon FROM x WHERE min_lat IS NOT NULL AND id IN (SELECT elem_id FROM d_changes)),
t AS (SELECT lz, {BOX_TILES} AS tile FROM c {ON_TILES} WHERE max_lat <= {B} + 1e-9 UNION ALL SELECT -1, unnest(range(1, 37))::INT FROM c WHERE max_lat > {B} + 1e-9)
SELECT DISTINCT CAST(zoom AS INT) AS zoom, tile FROM t JOIN (VALUES (8),(9),(10),(11),(12),(13),(14)) AS z(zoom) ON zoom >= lz""")
def _(w: World):
    changed = w.changes.select(F.col("elem_id").alias("id")).distinct()
    ext = w.ways.join(changed, "id", "left_semi").join(G.way_bbox(w.way_nodes, w.nodes).withColumnRenamed("way_id", "id"), "id")
    north = F.when(F.col("id") % 500 == 7, 1).otherwise(0)
    rows = ext.select(T.lod_keys(F.col("tags"))[1].alias("lod_zoom"), (F.col("min_lat") + north).alias("min_lat"), (F.col("max_lat") + north).alias("max_lat"), "min_lon", "max_lon")
    return DR.dirty_tiles(rows, grid(w))


def open_roads(w: World):
    g = G.way_geometry(w.way_nodes, w.nodes)
    roads = w.ways.where(T.has(F.col("tags"), "highway")).select(F.col("id").alias("way_id"), T.line_class(F.col("tags")).alias("cls"))
    return roads.join(g, "way_id")


# Chains of the ways r (cls, id, ids) per class, walked by recursion from their ends: side is where a way is left, nx the next one.
WALK = """en AS (SELECT cls, id, 0 AS side, ids[1] AS node FROM r UNION ALL SELECT cls, id, 1, ids[-1] FROM r),
mt AS (SELECT cls, node, min((id, side)) AS x, max((id, side)) AS y FROM en GROUP BY cls, node HAVING count(*) = 2),
lk AS (SELECT cls, x[1] AS id, x[2] AS side, y[1] AS to_id, y[2] AS at_side FROM mt WHERE x[1] <> y[1] UNION ALL SELECT cls, y[1], y[2], x[1], x[2] FROM mt WHERE x[1] <> y[1]),
nx AS (SELECT cls, id, side, to_id, 1 - at_side AS to_side FROM lk),
wk AS (SELECT en.cls, en.id AS start, en.id AS id, 1 - en.side AS side, 0 AS pos FROM en WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.cls IS NOT DISTINCT FROM en.cls AND lk.id = en.id AND lk.side = en.side)
  UNION ALL SELECT wk.cls, wk.start, nx.to_id, nx.to_side, wk.pos + 1 FROM wk JOIN nx ON nx.cls IS NOT DISTINCT FROM wk.cls AND nx.id = wk.id AND nx.side = wk.side),
rg AS (SELECT r.cls, r.id AS start, r.id AS id, 1 AS side, 0 AS pos FROM r WHERE NOT EXISTS (SELECT 1 FROM wk WHERE wk.cls IS NOT DISTINCT FROM r.cls AND wk.id = r.id)
  UNION ALL SELECT rg.cls, rg.start, nx.to_id, nx.to_side, rg.pos + 1 FROM rg JOIN nx ON nx.cls IS NOT DISTINCT FROM rg.cls AND nx.id = rg.id AND nx.side = rg.side WHERE nx.to_id <> rg.start),
ch AS (SELECT cls, start, id, side, pos FROM (SELECT wk.*, max(pos) OVER (PARTITION BY cls, start) AS n, max_by(id, pos) OVER (PARTITION BY cls, start) AS last_id FROM wk) q WHERE start < last_id OR (n = 0 AND side = 1)
  UNION ALL SELECT cls, start, id, side, pos FROM (SELECT *, min(id) OVER (PARTITION BY cls, start) AS low FROM rg) q WHERE low = start),
nd AS (SELECT cls, start, pos, k, node, lag(node) OVER (PARTITION BY cls, start ORDER BY pos, k) AS before FROM (SELECT ch.cls, ch.start, ch.pos, unnest(range(1, len(r.ids) + 1)) AS k, unnest(CASE WHEN ch.side = 1 THEN r.ids ELSE list_reverse(r.ids) END) AS node
  FROM ch JOIN r ON r.id = ch.id AND r.cls IS NOT DISTINCT FROM ch.cls) q)"""
CHAINS = f"""r AS (SELECT w.id, ({LINE_CLASS_SQL}) AS cls, p.ids FROM o_ways w JOIN (SELECT r.way_id, list(r.node_id ORDER BY r.seq) AS ids FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id) p ON p.way_id = w.id WHERE t['highway'] IS NOT NULL),
{WALK}"""


@query("way_trails", "O95", f"""WITH RECURSIVE {CHAINS} SELECT cls, count(*) AS nodes, md5(string_agg(node::VARCHAR, ',' ORDER BY pos, k)) AS trail FROM nd WHERE before IS NULL OR before <> node GROUP BY cls, start""")
def _(w: World):
    t = DR.chain_ways(open_roads(w), ["cls"])
    return t.select("cls", F.size("trail").cast("long").alias("nodes"), F.md5(F.array_join(F.transform("trail", lambda n: n.cast("string")), ",")).alias("trail"))


def walk(number: int) -> str:
    """WALK over r<number>, with names of its own."""
    return re.sub(r"\b(en|mt|lk|nx|wk|rg|ch|nd|r)\b", rf"\g<1>{number}", WALK)


def path_text(geom: str = "geom"):
    """A path in whole units of 1e-5 degrees, so that it can be compared as text."""
    unit = lambda v: F.round(v * 100000).cast("long").cast("string")
    return F.array_join(F.transform(F.col(geom)[0], lambda p: F.concat(unit(p["lat"]), F.lit(","), unit(p["lon"]))), " ")


LAT0 = f"(({A} + {B}) / 2)"
KEY = "concat_ws(chr(1), cv.sub, coalesce(t['name'], ''), coalesce(t['bridge'], ''), coalesce(t['tunnel'], ''), coalesce(t['layer'], '')"
# Points tp (pid, tol, i, u, v in metres) kept by Douglas-Peucker, as kk (pid, i): each stretch is cut at its farthest point while that is beyond the tolerance.
KEPT = """kp(pid, lo, hi) AS (SELECT pid, 1::BIGINT, max(i)::BIGINT FROM tp GROUP BY pid UNION ALL
 SELECT pid, unnest([lo, far]), unnest([far, hi]) FROM (SELECT pid, lo, hi, best[2]::BIGINT AS far FROM (
  SELECT pid, lo, hi, max(tol) AS tol, min([-sqrt(pow(pu - share * du, 2) + pow(pv - share * dv, 2)), i]) AS best FROM (
   SELECT k.pid, k.lo, k.hi, p.i, p.tol, p.u - a.u AS pu, p.v - a.v AS pv, b.u - a.u AS du, b.v - a.v AS dv,
    CASE WHEN pow(b.u - a.u, 2) + pow(b.v - a.v, 2) > 0 THEN greatest(0, least(1, ((p.u - a.u) * (b.u - a.u) + (p.v - a.v) * (b.v - a.v)) / (pow(b.u - a.u, 2) + pow(b.v - a.v, 2)))) ELSE 0 END AS share
   FROM kp k JOIN tp p ON p.pid = k.pid AND p.i > k.lo AND p.i < k.hi JOIN tp a ON a.pid = k.pid AND a.i = k.lo JOIN tp b ON b.pid = k.pid AND b.i = k.hi) m GROUP BY pid, lo, hi) n WHERE -best[1] > tol) o),
kk AS (SELECT pid, lo AS i FROM kp UNION SELECT pid, hi FROM kp)"""
# Paths sc (pid, ring, zoom, pts) thinned to about a pixel.
THIN = f"""sd AS (SELECT *, list_filter(pts, lambda p, i: i = 1 OR p <> pts[i - 1]) AS q, 156543.03392804097::DOUBLE * cos({LAT0} * (pi() / 180)) / pow(2, zoom) AS tol FROM sc),
tp AS (SELECT pid, tol, i, q[i].y * 110574.0::DOUBLE AS u, q[i].x * (111320.0::DOUBLE * cos(radians({LAT0}))) AS v FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM sd WHERE len(q) >= CASE WHEN ring THEN 3 ELSE 2 END) z),
{KEPT},
th AS (SELECT sd.* EXCLUDE (pts, q, tol), list({{'y': CAST(floor(q[kk.i].y * 100000 + 0.5) AS BIGINT), 'x': CAST(floor(q[kk.i].x * 100000 + 0.5) AS BIGINT)}} ORDER BY kk.i) AS g, count(*) - CASE WHEN count(*) > 1 AND arg_min(q[kk.i], kk.i) = arg_max(q[kk.i], kk.i) THEN 1 ELSE 0 END AS different
 FROM sd JOIN kk ON kk.pid = sd.pid GROUP BY ALL),
ds AS (SELECT * EXCLUDE (g, different), CAST(len(g) AS INT) AS npts, array_to_string(list_transform(g, lambda p: concat(p.y, ',', p.x)), ' ') AS path, list_min(list_transform(g, lambda p: p.y)) / 100000.0::DOUBLE AS min_lat, list_max(list_transform(g, lambda p: p.y)) / 100000.0::DOUBLE AS max_lat,
 list_min(list_transform(g, lambda p: p.x)) / 100000.0::DOUBLE AS min_lon, list_max(list_transform(g, lambda p: p.x)) / 100000.0::DOUBLE AS max_lon FROM th WHERE len(g) >= 2 AND (NOT ring OR different >= 3))"""


@query("simplified_trails", "O96", f"""WITH RECURSIVE sc AS (SELECT r.way_id AS pid, list(n.lat ORDER BY r.seq) AS ys, list(n.lon ORDER BY r.seq) AS xs FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id),
tp AS (SELECT pid, 30.0::DOUBLE AS tol, i, ys[i] * 110574.0::DOUBLE AS u, xs[i] * (111320.0::DOUBLE * cos(radians(list_avg(ys)))) AS v FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS i FROM sc) z),
{KEPT}
SELECT sc.pid AS way_id, CAST(any_value(len(ys)) AS INT) AS before, CAST(count(*) AS INT) AS after, string_agg(concat(floor(ys[i] * 100000 + 0.5)::BIGINT, ',', floor(xs[i] * 100000 + 0.5)::BIGINT), ' ' ORDER BY i) AS path FROM sc JOIN kk ON kk.pid = sc.pid GROUP BY sc.pid""")
def _(w: World):
    g = G.way_geometry(w.way_nodes, w.nodes)
    s = g.withColumn("thin", shapes.simplified(F.col("coords"), F.lit(30.0))).withColumn("geom", F.array("thin"))
    return s.select("way_id", F.size("coords").alias("before"), F.size("thin").alias("after"), path_text().alias("path"))


def drawn(tiles: bool) -> str:
    """Display entries ds of all zooms, lines by tile or over the whole extent, areas once each."""
    tile, on = (BOX_TILES, ON_TILES) if tiles else ("0", "")
    filled = " OR ".join(f"coalesce(t['{k}'], '') <> ''" for k in ("building", "building:part", "landuse", "leisure", "natural", "water", "wetland", "amenity", "place"))
    return f"""{GX}, {COVER},
gm AS (SELECT r.way_id AS gid, list({{'y': n.lat, 'x': n.lon}} ORDER BY r.seq) AS pts, list(r.node_id ORDER BY r.seq) AS ids FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id HAVING count(*) >= 2),
dz AS (SELECT cv.id, cv.zoom, cv.status, cv.sub AS cls, cv.min_lat, cv.max_lat, cv.min_lon, cv.max_lon, CASE WHEN cv.status = 'line' THEN {KEY}, coalesce(t['surface'], '')) ELSE {KEY}) END AS gk FROM cv JOIN o_ways w ON w.id = cv.id WHERE status IN ('line', 'area')),
dl AS (SELECT dz.id, zoom, cls, gk, {tile} AS tile, concat_ws(chr(2), zoom, {tile}, gk) AS ck FROM dz {on} WHERE status = 'line'),
dk AS MATERIALIZED (SELECT ck, zoom, tile, gk, cls, row_number() OVER (ORDER BY ck) AS number FROM (SELECT DISTINCT ck, zoom, tile, gk, cls FROM dl) z),
r1 AS MATERIALIZED (SELECT dk.number AS cls, id, ids FROM dl JOIN dk ON dk.ck = dl.ck JOIN gm ON gid = id), {walk(1)},
lp AS (SELECT nd1.cls AS ck, start, list({{'y': n.lat, 'x': n.lon}} ORDER BY pos, k) AS pts FROM nd1 JOIN d_nodes n ON n.id = nd1.node WHERE before IS NULL OR before <> node GROUP BY nd1.cls, start),
lw AS (SELECT ch1.cls AS ck, ch1.start, count(*) AS ways, CAST(sum(len(r1.ids)) AS BIGINT) AS raw FROM ch1 JOIN r1 ON r1.cls = ch1.cls AND r1.id = ch1.id GROUP BY ch1.cls, ch1.start),
r2 AS MATERIALIZED (SELECT 2 * m.relation_id + CASE WHEN m.role = 'inner' THEN 1 ELSE 0 END AS cls, m.seq AS id, p.ids FROM d_relation_members m JOIN o_relations o ON o.id = m.relation_id JOIN (SELECT way_id, list(node_id ORDER BY seq) AS ids FROM d_way_nodes GROUP BY way_id) p ON p.way_id = m.member_ref
  WHERE m.member_type = 'way' AND len(p.ids) >= 2 AND t['type'] IN ('multipolygon', 'boundary') AND coalesce(t['highway'], t['railway'], t['waterway'], t['barrier'], '') = '' AND ({filled})), {walk(2)},
rp AS (SELECT cls, start, count(*) AS n, count(*) >= 4 AND arg_min(node, pos * 10000 + k) = arg_max(node, pos * 10000 + k) AS round, list({{'y': n.lat, 'x': n.lon}} ORDER BY pos, k) FILTER (n.lat IS NOT NULL) AS pts FROM nd2 LEFT JOIN d_nodes n ON n.id = nd2.node WHERE before IS NULL OR before <> node GROUP BY cls, start),
rq AS (SELECT *, row_number() OVER (PARTITION BY cls, round ORDER BY start) - 1 AS ring_no FROM rp),
ra AS (SELECT *, abs(list_sum(list_transform(range(1, len(pts) + 1), lambda i: (pts[i].x - pts[1].x) * (pts[i % len(pts) + 1].y - pts[1].y) - (pts[i % len(pts) + 1].x - pts[1].x) * (pts[i].y - pts[1].y)))) AS twice FROM rq WHERE round AND len(pts) = n),
rs AS (SELECT ra.cls // 2 AS rid, ra.cls % 2 AS inside, ring_no, pts, ({AREA_CLASS_SQL}) AS cls, ({LINE_ZOOM_SQL}) AS least_zoom FROM ra JOIN o_relations o ON o.id = ra.cls // 2 WHERE twice > 1e-13),
sc AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM (
 SELECT 'line' AS kind, x.zoom, x.tile, x.gk, lp.start AS part, x.cls, lw.ways, lw.raw, false AS ring, 0 AS wid, lp.pts FROM lp JOIN lw ON lw.ck = lp.ck AND lw.start = lp.start JOIN dk x ON x.number = lp.ck
 UNION ALL SELECT 'area', zoom, 0, gk, id, cls, 1, len(pts), true, id, pts FROM dz JOIN gm ON gid = id WHERE status = 'area'
 UNION ALL SELECT 'area', z.zoom, 0, concat('rel:', rid), 2 * ring_no + inside, cls, 1, len(pts), true, 0, pts FROM rs JOIN (VALUES (8), (9), (10), (11), (12), (13), (14)) AS z(zoom) ON z.zoom >= least_zoom) u),
{THIN}"""


FAMILY = "CASE WHEN kind = 'line' THEN CASE WHEN cls LIKE 'highway=%' THEN 'road' WHEN cls LIKE 'railway=%' THEN 'railway' ELSE 'other' END ELSE CASE WHEN cls LIKE 'landuse=%' OR cls LIKE 'leisure=%' THEN 'landuse' WHEN cls LIKE 'building=%' THEN 'building' ELSE 'other' END END"
ENTRY = f"gk AS group_key, CAST(part AS BIGINT) AS part, cls, {FAMILY} AS family, CAST(ways AS BIGINT) AS ways, npts, CAST(raw AS BIGINT) AS rawnpts, path"


@query("display_lines", "O96 O97", f"WITH RECURSIVE {drawn(False)} SELECT {ENTRY} FROM ds WHERE kind = 'line' AND zoom = 13")
def _(w: World):
    return DR.display_lines(w.dataset, 13, grid(w).lat0).select("group_key", "part", "cls", "family", "ways", "npts", "rawnpts", path_text().alias("path"))


@query("display_areas", "O96 O98", f"WITH RECURSIVE {drawn(False)} SELECT {ENTRY} FROM ds WHERE kind = 'area' AND zoom = 14")
def _(w: World):
    return DR.display_areas(w.dataset, 14, grid(w).lat0).select("group_key", "part", "cls", "family", "ways", "npts", "rawnpts", path_text().alias("path"))


def _reach(c: str, low: str, high: str) -> tuple[str, str]:
    """From where to where the segment (p -> q) is between two borders, as SQL."""
    still = f"CASE WHEN p.{c} BETWEEN {low} AND {high} THEN {{}} ELSE {{}} END"
    near, far = f"({low} - p.{c}) / nullif(q.{c} - p.{c}, 0)", f"({high} - p.{c}) / nullif(q.{c} - p.{c}, 0)"
    inf = "'infinity'::DOUBLE"
    return f"CASE WHEN q.{c} = p.{c} THEN {still.format('-' + inf, inf)} ELSE least({near}, {far}) END", f"CASE WHEN q.{c} = p.{c} THEN {still.format(inf, '-' + inf)} ELSE greatest({near}, {far}) END"


def _border(n: int, c: str, o: str, limit: str, sign: str) -> str:
    """One border of a ring cut, as a common table h<n> over h<n-1>."""
    at = lambda p, q: f"({p}.{o} + ({limit} - {p}.{c}) / nullif({q}.{c} - {p}.{c}, 0) * ({q}.{o} - {p}.{o}))"
    cross = f"{{'y': {limit}, 'x': {at('p', 'q')}}}" if c == "y" else f"{{'y': {at('p', 'q')}, 'x': {limit}}}"
    none = "[]::STRUCT(y DOUBLE, x DOUBLE)[]"
    return f"""h{n} AS (SELECT way_id, coalesce((SELECT flatten(list(list_concat(CASE WHEN (p.{c} {sign} {limit}) <> (q.{c} {sign} {limit}) THEN [{cross}] ELSE {none} END, CASE WHEN q.{c} {sign} {limit} THEN [q] ELSE {none} END) ORDER BY i))
  FROM (SELECT unnest(ps) AS q, unnest(list_concat(ps[-1:], ps[:-2])) AS p, unnest(range(len(ps))) AS i) z), {none}) AS ps FROM h{n - 1})"""


Y1, Y2, X1, X2 = "39.76::DOUBLE", "39.8::DOUBLE", "116.17::DOUBLE", "116.22::DOUBLE"
_YR, _XR = _reach("y", Y1, Y2), _reach("x", X1, X2)
CLIP_SQL = f"""g AS (SELECT r.way_id, list({{'y': n.lat, 'x': n.lon}} ORDER BY r.seq) AS ps FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id),
w AS (SELECT g.*, o.closed FROM g JOIN o_ways o ON o.id = g.way_id),
s AS (SELECT way_id, unnest(ps[:-2]) AS p, unnest(ps[2:]) AS q, unnest(range(len(ps) - 1)) AS i FROM w WHERE NOT closed AND len(ps) > 1),
t AS (SELECT way_id, i, p, q, greatest(0, {_YR[0]}, {_XR[0]}) AS t0, least(1, {_YR[1]}, {_XR[1]}) AS t1 FROM s),
f AS (SELECT *, CASE WHEN i = 0 OR t0 > 0 OR lag(t0) OVER v > lag(t1) OVER v OR lag(t1) OVER v < 1 THEN 1 ELSE 0 END AS fresh FROM t WINDOW v AS (PARTITION BY way_id ORDER BY i)),
lp AS (SELECT way_id, sum(fresh) AS parts, count(*) + sum(fresh) AS points, sum(CASE WHEN fresh = 1 THEN p.y + t0 * (q.y - p.y) ELSE 0 END + p.y + t1 * (q.y - p.y)) AS y, sum(CASE WHEN fresh = 1 THEN p.x + t0 * (q.x - p.x) ELSE 0 END + p.x + t1 * (q.x - p.x)) AS x
  FROM f WHERE t0 <= t1 GROUP BY way_id),
h0 AS (SELECT way_id, CASE WHEN ps[1] = ps[-1] THEN ps[:-2] ELSE ps END AS ps FROM w WHERE closed),
{_border(1, 'y', 'x', Y1, '>=')}, {_border(2, 'y', 'x', Y2, '<=')}, {_border(3, 'x', 'y', X1, '>=')}, {_border(4, 'x', 'y', X2, '<=')},
ap AS (SELECT way_id, 1 AS parts, len(ps) + 1 AS points, list_sum(list_transform(ps, lambda a: a.y)) + ps[1].y AS y, list_sum(list_transform(ps, lambda a: a.x)) + ps[1].x AS x FROM h4 WHERE len(ps) >= 3)"""


@query("clipped_shapes", "O100", f"""WITH {CLIP_SQL} SELECT way_id, CAST(parts AS INT) AS parts, CAST(points AS INT) AS points, floor(y * 1000 + 0.5) / 1000 AS sum_lat, floor(x * 1000 + 0.5) / 1000 AS sum_lon
FROM (SELECT * FROM lp UNION ALL SELECT * FROM ap) u""")
def _(w: World):
    g = G.way_geometry(w.way_nodes, w.nodes).join(w.ways.select(F.col("id").alias("way_id"), "closed"), "way_id")
    cut = shapes.clipped(F.when(F.col("closed"), "area").otherwise("line"), F.array("coords"), F.lit(39.76), F.lit(39.8), F.lit(116.17), F.lit(116.22))
    parts = g.withColumn("parts", cut).where(F.size("parts") > 0).withColumn("flat", F.flatten("parts"))
    total = lambda c: geo.js_round(F.aggregate("flat", F.lit(0.0), lambda a, p: a + p[c]), 3)
    return parts.select("way_id", F.size("parts").alias("parts"), F.size("flat").alias("points"), total("lat").alias("sum_lat"), total("lon").alias("sum_lon"))


BAKED = f"""{drawn(True)},
wx AS (SELECT DISTINCT id AS wid, min_lat, max_lat, min_lon, max_lon FROM dz),
bt AS (SELECT pid, tile FROM ds WHERE kind = 'line' UNION ALL SELECT pid, {BOX_TILES} FROM (SELECT ds.pid, wx.min_lat, wx.max_lat, wx.min_lon, wx.max_lon FROM ds JOIN wx ON wx.wid = ds.wid AND ds.wid <> 0 UNION ALL SELECT pid, min_lat, max_lat, min_lon, max_lon FROM ds WHERE wid = 0 AND kind = 'area') x {ON_TILES}),
bk AS (SELECT ds.* EXCLUDE (tile), CAST(bt.tile AS INT) AS tile, ('0x' || substr(sha1(concat_ws(chr(0), kind, zoom, bt.tile, concat_ws(chr(1), gk, part))), 1, 14))::BIGINT >> 3 AS id FROM ds JOIN bt ON bt.pid = ds.pid)"""


@query("baked_tiles", "O96 O101", f"WITH RECURSIVE {BAKED} SELECT CAST(zoom AS INT) AS zoom, tile, id, gk AS group_key, kind, cls, CAST(ways AS BIGINT) AS ways, npts, path FROM bk")
def _(w: World):
    return DR.bake_tiles(w.dataset, grid(w)).select("zoom", "tile", "id", "group_key", "kind", "cls", "ways", "npts", path_text().alias("path"))


@query("tile_entries_in_view", "O103", f"""WITH RECURSIVE {BAKED},
vb AS (SELECT view_id, zoom, min_lat AS y1, max_lat AS y2, min_lon AS x1, max_lon AS x2, greatest(min_lat, {A}) AS min_lat, least(max_lat, {B}) AS max_lat, greatest(min_lon, {C}) AS min_lon, least(max_lon, {D}) AS max_lon FROM d_views WHERE zoom <= 14),
vt AS (SELECT view_id, zoom, y1, y2, x1, x2, {BOX_TILES} AS tile FROM vb {ON_TILES} WHERE max_lat >= min_lat AND max_lon >= min_lon)
SELECT DISTINCT v.view_id, v.zoom, b.id, b.kind, b.cls, b.npts, b.path FROM bk b JOIN vt v ON v.zoom = b.zoom AND v.tile = b.tile AND b.max_lon >= v.x1 AND b.min_lon <= v.x2 AND b.max_lat >= v.y1 AND b.min_lat <= v.y2""")
def _(w: World):
    """Entries of the tiles that each view touches, at the view's own zoom, before they are cut to the view."""
    g = grid(w)
    return DR.read_tiles(DR.bake_tiles(w.dataset, g, [12, 14]), w.views.where("zoom <= 14"), g, clip=False).select("view_id", "zoom", "id", "kind", "cls", "npts", path_text().alias("path"))


@query("tiles_in_view", "O103")
def _(w: World):
    g = grid(w)
    return DR.read_tiles(DR.bake_tiles(w.dataset, g, [14]), w.views.withColumn("zoom", F.lit(14)), g).select("view_id", "id", "kind", "cls", F.size("geom").alias("parts"))


@query("relation_rings", "O136", f"""
WITH RECURSIVE r AS (SELECT (m.relation_id, CASE WHEN m.role = 'inner' THEN 'inner' ELSE 'outer' END) AS cls, m.seq AS id, p.ids FROM d_relation_members m JOIN d_relations t ON t.id = m.relation_id
  JOIN (SELECT way_id, list(node_id ORDER BY seq) AS ids FROM d_way_nodes GROUP BY way_id) p ON p.way_id = m.member_ref
  WHERE m.member_type = 'way' AND len(p.ids) >= 2 AND (t.tags LIKE '%"type":"multipolygon"%' OR t.tags LIKE '%"type":"boundary"%')),
{WALK},
pt AS (SELECT cls, start, node, row_number() OVER (PARTITION BY cls, start ORDER BY pos, k) AS i FROM nd WHERE before IS NULL OR before <> node),
cn AS (SELECT cls, start, count(*) AS n, count(*) >= 4 AND arg_min(node, i) = arg_max(node, i) AS round FROM pt GROUP BY cls, start),
no AS (SELECT *, row_number() OVER (PARTITION BY cls, round ORDER BY start) - 1 AS ring_no FROM cn),
lo AS (SELECT pt.cls, pt.start, i, lat, lon, first(lat) OVER v AS y0, first(lon) OVER v AS x0 FROM pt JOIN d_nodes d ON d.id = pt.node WINDOW v AS (PARTITION BY cls, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ld AS (SELECT *, coalesce(lead(lat) OVER v, y0) AS lat2, coalesce(lead(lon) OVER v, x0) AS lon2 FROM lo WINDOW v AS (PARTITION BY cls, start ORDER BY i)),
ar AS (SELECT cls, start, count(*) AS located, CASE WHEN count(*) >= 3 THEN abs(sum((lon - x0) * (lat2 - y0) - (lon2 - x0) * (lat - y0))) / 2 * cos(avg(lat) * (pi() / 180)) * pow(pi() / 180 * 6378137.0, 2) ELSE 0 END AS area FROM ld GROUP BY cls, start)
SELECT no.cls[1] AS relation_id, no.cls[2] AS role, CAST(ring_no AS INT) AS ring_no, CASE WHEN NOT round THEN 'open' WHEN coalesce(located, 0) < n THEN 'missing' WHEN area > 1e-9 THEN 'ring' ELSE 'degenerate' END AS status,
  CASE WHEN round THEN floor(coalesce(area, 0) * 10 + 0.5) / 10 ELSE 0 END AS area_m2 FROM no LEFT JOIN ar ON ar.cls = no.cls AND ar.start = no.start""")
def _(w: World):
    r = DR.relation_rings(w.dataset)
    return r.select("relation_id", "role", "ring_no", "status", geo.js_round(geo.ring_area_m2(F.col("coords")), 1).alias("area_m2"))
