"""Reference checks, tiles, merging, comparison and audits of whole datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.functions.tags import parse_tags
from streetloom.operators import datasets as DS, geometry as G
from streetloom.operators.datasets import Rect
from streetloom.plans.demo import World

RECTS = [Rect("sw", 39.73, 39.79, 116.14, 116.2), Rect("nw", 39.79, 39.86, 116.14, 116.2), Rect("se", 39.73, 39.79, 116.2, 116.27),
         Rect("ne", 39.79, 39.84, 116.2, 116.27), Rect("ne", 39.84, 39.86, 116.21, 116.27), Rect("far", 30.0, 31.0, 100.0, 101.0)]
RECT_VALUES = ", ".join(f"({i}, '{r.tile}', {r.min_lat}, {r.max_lat}, {r.min_lon}, {r.max_lon})" for i, r in enumerate(RECTS))
RECT_SQL = f"rc AS (SELECT ord, tile, y1::DOUBLE AS y1, y2::DOUBLE AS y2, x1::DOUBLE AS x1, x2::DOUBLE AS x2 FROM (VALUES {RECT_VALUES}) AS v(ord, tile, y1, y2, x1, x2))"
SCORE = """CASE WHEN {0}.lat >= y1 AND {0}.lat < y2 AND {0}.lon >= x1 AND {0}.lon < x2 THEN -1.0 ELSE
  pow(CASE WHEN {0}.lat < y1 THEN y1 - {0}.lat WHEN {0}.lat > y2 THEN {0}.lat - y2 ELSE 0 END, 2)
  + pow(CASE WHEN {0}.lon < x1 THEN x1 - {0}.lon WHEN {0}.lon > x2 THEN {0}.lon - x2 ELSE 0 END, 2) END"""


def tiled(name: str, source: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, arg_min(tile, s) AS tile, min(s).d >= 0 AS fallback FROM (
   SELECT p.*, rc.tile, {{'d': {SCORE.format('p')}, 'o': rc.ord}} AS s FROM {source} p CROSS JOIN rc) q GROUP BY {key})"""


@query("references_of", "O38", """
WITH want AS (SELECT 'node' AS type, id FROM d_nodes WHERE tags IS NOT NULL UNION ALL SELECT 'way', id FROM d_ways WHERE closed)
SELECT DISTINCT w.type, w.id, 'way' AS ref_type, r.way_id AS ref_id FROM want w JOIN d_way_nodes r ON r.node_id = w.id AND w.type = 'node'
UNION SELECT DISTINCT w.type, w.id, 'relation', m.relation_id FROM want w JOIN d_relation_members m ON m.member_type = w.type AND m.member_ref = w.id""")
def _(w: World):
    want = w.nodes.where("tags IS NOT NULL").select(F.lit("node").alias("type"), "id").unionByName(
        w.ways.where("closed").select(F.lit("way").alias("type"), "id"))
    return DS.references_of(want, w.dataset)


FEWER = "d_way_nodes_few AS (SELECT * FROM d_way_nodes WHERE way_id % 7 <> 3)"


@query("orphan_nodes", "O39", """
WITH few AS (SELECT * FROM d_way_nodes WHERE way_id % 7 <> 3)
SELECT n.id FROM d_nodes n WHERE n.tags IS NULL AND NOT EXISTS (SELECT 1 FROM few r WHERE r.node_id = n.id)
 AND NOT EXISTS (SELECT 1 FROM d_relation_members m WHERE m.member_type = 'node' AND m.member_ref = n.id)""")
def _(w: World):
    return DS.orphan_nodes(w.dataset.with_(way_nodes=w.way_nodes.where("way_id % 7 <> 3")))


@query("dangling_refs", "O40", """
WITH a AS (SELECT 'way_node' AS reference, count(*) AS total, count(*) FILTER (WHERE n.id IS NULL) AS dangling FROM d_way_nodes r LEFT JOIN d_nodes_cut n ON n.id = r.node_id
UNION ALL SELECT 'member_node', count(*), count(*) FILTER (WHERE n.id IS NULL) FROM d_relation_members r LEFT JOIN d_nodes_cut n ON n.id = r.member_ref WHERE member_type = 'node'
UNION ALL SELECT 'member_way', count(*), count(*) FILTER (WHERE n.id IS NULL) FROM d_relation_members r LEFT JOIN d_ways n ON n.id = r.member_ref WHERE member_type = 'way'
UNION ALL SELECT 'member_relation', count(*), count(*) FILTER (WHERE n.id IS NULL) FROM d_relation_members r LEFT JOIN d_relations n ON n.id = r.member_ref WHERE member_type = 'relation')
SELECT reference, total, dangling, floor(dangling / total * 1000000 + 0.5) / 1000000 AS share FROM a""")
def _(w: World):
    out = DS.dangling_refs(w.dataset.with_(nodes=w.nodes_cut))
    return out.withColumn("share", F.floor(F.col("share") * 1e6 + 0.5) / 1e6)


@query("tile_of_point", "O46", f"""WITH {RECT_SQL}, {tiled('t', 'd_nodes', 'id')} SELECT id, tile, fallback FROM t""")
def _(w: World):
    return DS.assign_tile(w.nodes, RECTS).select("id", "tile", "fallback")


@query("touching_tiles", "O47", f"""
WITH {RECT_SQL}, b AS (SELECT r.way_id, min(n.lat) AS a, max(n.lat) AS b, min(n.lon) AS c, max(n.lon) AS d FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id)
SELECT DISTINCT way_id, tile FROM b JOIN rc ON y1 <= b AND y2 >= a AND x1 <= d AND x2 >= c""")
def _(w: World):
    return DS.touching_tiles(G.way_bbox(w.way_nodes, w.nodes), RECTS).select("way_id", "tile")


@query("rect_overlaps", "O75", """
WITH r AS (SELECT view_id AS rect_id, view_id % 10 AS tile, min_lat, max_lat, min_lon, max_lon FROM d_views)
SELECT 'overlap' AS what, a.rect_id, b.rect_id AS other_id, a.tile = b.tile AS same_tile, NULL::DOUBLE AS min_lat, NULL::DOUBLE AS max_lon FROM r a JOIN r b ON a.rect_id < b.rect_id
  AND a.min_lat < b.max_lat AND b.min_lat < a.max_lat AND a.min_lon < b.max_lon AND b.min_lon < a.max_lon
UNION ALL SELECT 'extent', tile, NULL, NULL, min(min_lat), max(max_lon) FROM r GROUP BY tile""")
def _(w: World):
    r = w.views.select(F.col("view_id").alias("rect_id"), (F.col("view_id") % 10).alias("tile"), "min_lat", "max_lat", "min_lon", "max_lon")
    problems, whole = DS.check_rects(r)
    return problems.select(F.lit("overlap").alias("what"), "rect_id", "other_id", "same_tile", F.lit(None).cast("double").alias("min_lat"),
                           F.lit(None).cast("double").alias("max_lon")).unionByName(
        whole.select(F.lit("extent").alias("what"), F.col("tile").alias("rect_id"), F.lit(None).cast("long").alias("other_id"),
                     F.lit(None).cast("boolean").alias("same_tile"), "min_lat", "max_lon"))


ANCHOR = """an AS (SELECT way_id, arg_min(lat, s) AS lat, arg_min(lon, s) AS lon FROM (
  SELECT r.way_id, n.lat, n.lon, {'d': abs(r.seq - c.k // 2), 's': r.seq} AS s FROM d_way_nodes r JOIN d_nodes_cut n ON n.id = r.node_id
  JOIN (SELECT way_id, count(*) AS k FROM d_way_nodes GROUP BY way_id) c ON c.way_id = r.way_id) q GROUP BY way_id)"""
CUT = f"""{RECT_SQL}, {ANCHOR}, {tiled('wt', 'an', 'way_id')}, {tiled('nt', 'd_nodes_cut', 'id')}"""


@query("tile_cut", "O71", f"""
WITH {CUT}, sup AS (SELECT DISTINCT wt.tile, r.node_id FROM d_way_nodes r JOIN wt ON wt.way_id = r.way_id JOIN d_nodes_cut n ON n.id = r.node_id)
SELECT 'way' AS kind, way_id AS id, tile, false AS support FROM wt
UNION ALL SELECT 'node', id, tile, false FROM nt
UNION ALL SELECT 'node', s.node_id, s.tile, true FROM sup s WHERE NOT EXISTS (SELECT 1 FROM nt WHERE nt.id = s.node_id AND nt.tile = s.tile)""")
def _(w: World):
    cut = DS.tile_cut(w.dataset.with_(nodes=w.nodes_cut), RECTS)
    return cut["ways"].select(F.lit("way").alias("kind"), "id", "tile", F.lit(False).alias("support")).unionByName(
        cut["nodes"].select(F.lit("node").alias("kind"), "id", "tile", "support"))


REL_TILE = f"""{CUT}, rcand AS (
  SELECT m.relation_id, {{'r': 0, 's': m.seq}} AS s, an.lat, an.lon FROM d_relation_members m JOIN an ON an.way_id = m.member_ref WHERE m.member_type = 'way'
  UNION ALL SELECT m.relation_id, {{'r': 1, 's': m.seq}}, n.lat, n.lon FROM d_relation_members m JOIN d_nodes_cut n ON n.id = m.member_ref WHERE m.member_type = 'node'),
ra AS (SELECT relation_id, min(s).r AS rank, arg_min(lat, s) AS lat, arg_min(lon, s) AS lon FROM rcand GROUP BY relation_id),
{tiled('rt', 'ra', 'relation_id')}"""


@query("relation_tile", "O72", f"""WITH {REL_TILE} SELECT ra.relation_id, CAST(ra.rank AS INT) AS rank, rt.tile, rt.fallback FROM ra JOIN rt ON rt.relation_id = ra.relation_id""")
def _(w: World):
    ds = w.dataset.with_(nodes=w.nodes_cut)
    return DS.relation_tile(ds, RECTS, G.relation_bbox(ds)).select("relation_id", "rank", "tile", "fallback")


COPIES = """(SELECT id AS relation_id, CAST(k.s AS INT) AS source_order, concat('t', CAST((id + k.s * 7) % 5 AS VARCHAR(9))) AS tile,
  CAST(member_count - (id * (k.s + 1)) % 3 AS INT) AS member_count, CAST(version + k.s AS INT) AS version
  FROM d_relations CROSS JOIN (VALUES (0), (1), (2)) AS k(s) WHERE (id + k.s) % 4 <> 0)"""


@query("relation_dedup", "O73", f"""
WITH c AS {COPIES}, f AS (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY source_order) AS a,
   row_number() OVER (PARTITION BY relation_id ORDER BY member_count DESC, source_order) AS b, count(*) OVER (PARTITION BY relation_id) AS copies FROM c)
SELECT x.relation_id, x.tile, x.copies, y.source_order AS from_source, y.member_count, y.version FROM f x JOIN f y ON y.relation_id = x.relation_id AND x.a = 1 AND y.b = 1""")
def _(w: World):
    return DS.dedup_relations(w.sql(f"SELECT * FROM {COPIES} c"), ["version"])


@query("relation_replicas", "O74", f"""
WITH {RECT_SQL}, c AS (SELECT id AS relation_id, CAST(k.s AS INT) AS tile_order, CASE k.s WHEN 0 THEN 'sw' WHEN 1 THEN 'far' ELSE 'ne' END AS tile,
  CAST(member_count - (id * (k.s + 1)) % 3 AS INT) AS member_count FROM d_relations CROSS JOIN (VALUES (0), (1), (2)) AS k(s) WHERE (id + k.s) % 4 = 0),
e AS (SELECT m.relation_id, min(n.lat) AS a, max(n.lat) AS b, min(n.lon) AS c, max(n.lon) AS d FROM d_relation_members m JOIN d_way_nodes r ON r.way_id = m.member_ref AND m.member_type = 'way'
  JOIN d_nodes n ON n.id = r.node_id GROUP BY m.relation_id),
o AS (SELECT relation_id, arg_max(tile, {{'m': member_count, 'o': -tile_order}}) AS owner FROM c GROUP BY relation_id),
t AS (SELECT e.relation_id, rc.tile FROM e JOIN rc ON y1 <= b AND y2 >= a AND x1 <= d AND x2 >= e.c JOIN o ON o.relation_id = e.relation_id
  UNION SELECT c.relation_id, c.tile FROM c JOIN e ON e.relation_id = c.relation_id)
SELECT t.relation_id, o.owner, t.tile, CAST(count(*) OVER (PARTITION BY t.relation_id) AS INT) AS fanout FROM t JOIN o ON o.relation_id = t.relation_id""")
def _(w: World):
    copies = w.sql("""SELECT id AS relation_id, CAST(k.s AS INT) AS tile_order, CASE k.s WHEN 0 THEN 'sw' WHEN 1 THEN 'far' ELSE 'ne' END AS tile,
        CAST(member_count - (id * (k.s + 1)) % 3 AS INT) AS member_count FROM d_relations CROSS JOIN (VALUES (0), (1), (2)) AS k(s) WHERE (id + k.s) % 4 = 0""")
    ways_only = w.dataset.with_(relation_members=w.relation_members.where("member_type = 'way'"))
    return DS.replicate_relations(copies, G.relation_bbox(ways_only), RECTS).select("relation_id", "owner", "tile", "fanout")


@query("cropped_members", "O48", """
WITH b AS (SELECT r.way_id, min(n.lat) AS y1, max(n.lat) AS y2, min(n.lon) AS x1, max(n.lon) AS x2 FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id),
m AS (SELECT m.*, coalesce(b.y1, n.lat) AS y1, coalesce(b.y2, n.lat) AS y2, coalesce(b.x1, n.lon) AS x1, coalesce(b.x2, n.lon) AS x2 FROM d_relation_members m
  LEFT JOIN b ON m.member_type = 'way' AND b.way_id = m.member_ref LEFT JOIN d_nodes n ON m.member_type = 'node' AND n.id = m.member_ref),
e AS (SELECT relation_id, min(y1) AS y1, max(y2) AS y2, min(x1) AS x1, max(x2) AS x2 FROM m WHERE y1 IS NOT NULL GROUP BY relation_id),
c AS (SELECT v.view_id, e.relation_id, NOT (t['type'] = 'multipolygon') AND o.member_count > 4 AND NOT (e.x1 >= v.min_lon - px AND e.x2 <= v.max_lon + px AND e.y1 >= v.min_lat - py AND e.y2 <= v.max_lat + py) AS crop,
  v.min_lat - py AS c1, v.max_lat + py AS c2, v.min_lon - px AS c3, v.max_lon + px AS c4
  FROM e JOIN o_relations o ON o.id = e.relation_id JOIN (SELECT *, (max_lat - min_lat) * 0.25 AS py, (max_lon - min_lon) * 0.25 AS px FROM d_views) v
   ON e.x2 >= v.min_lon AND e.x1 <= v.max_lon AND e.y2 >= v.min_lat AND e.y1 <= v.max_lat),
h AS (SELECT c.view_id, m.relation_id, m.seq, m.role, c.crop, NOT c.crop OR m.member_type = 'relation' OR coalesce(m.x2 >= c3 AND m.x1 <= c4 AND m.y2 >= c1 AND m.y1 <= c2, m.member_type = 'way') AS hit FROM m JOIN c ON c.relation_id = m.relation_id)
SELECT view_id, relation_id, seq, crop, hit OR (role = 'inner' AND bool_or(hit AND role = 'inner') OVER (PARTITION BY view_id, relation_id)) AS kept FROM h""")
def _(w: World):
    return DS.crop_members(w.dataset, w.views, min_members=4).select("view_id", "relation_id", "seq", "crop", "kept")


def second(w: World):
    a = w.dataset
    def parsed(name: str):
        return w.raw(name).withColumn("tags", parse_tags(F.col("tags")))
    return a.with_(ways=parsed("d_ways_b"), nodes=parsed("d_nodes_b"), relations=w.relations.where("id % 9 <> 0"))


@query("dataset_overlap", "O49", """
SELECT 'way' AS kind, count(*) AS shared, count(*) FILTER (WHERE a.node_count <> b.node_count) AS shape_differs,
  count(*) FILTER (WHERE a.version <> b.version OR coalesce(a.tags, '') <> coalesce(b.tags, '')) AS content_differs FROM d_ways a JOIN d_ways_b b ON b.id = a.id
UNION ALL SELECT 'node', count(*), count(*) FILTER (WHERE a.lat <> b.lat OR a.lon <> b.lon), 0 FROM d_nodes a JOIN d_nodes_b b ON b.id = a.id
UNION ALL SELECT 'relation', count(*), 0, 0 FROM d_relations WHERE id % 9 <> 0""")
def _(w: World):
    return DS.dataset_overlap(w.dataset, second(w))


@query("dataset_diff", "O81", """
SELECT 'way' AS kind, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM d_ways a FULL JOIN d_ways_b b ON b.id = a.id WHERE a.id IS NULL OR b.id IS NULL OR a.version <> b.version OR a.node_count <> b.node_count OR a.tags <> b.tags
UNION ALL SELECT 'node', coalesce(a.id, b.id), CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END
FROM d_nodes a FULL JOIN d_nodes_b b ON b.id = a.id WHERE a.id IS NULL OR b.id IS NULL OR a.lat <> b.lat
UNION ALL SELECT 'relation', id, 'removed' FROM d_relations WHERE id % 9 = 0""")
def _(w: World):
    return DS.dataset_diff(w.dataset, second(w))


@query("append_merge", "O76", """
SELECT 'nodes' AS table_name, (SELECT count(*) FROM d_nodes) - (SELECT count(*) FROM d_nodes_b) AS inserted, (SELECT count(*) FROM d_nodes) AS total
UNION ALL SELECT 'ways', (SELECT count(*) FROM d_ways a WHERE NOT EXISTS (SELECT 1 FROM d_ways_b b WHERE b.id = a.id)), (SELECT count(*) FROM (SELECT id FROM d_ways UNION SELECT id FROM d_ways_b) u)
UNION ALL SELECT 'relations', (SELECT count(*) FROM d_relations WHERE id % 9 = 0), (SELECT count(*) FROM d_relations)
UNION ALL SELECT 'way_nodes', 0, (SELECT count(*) FROM d_way_nodes)
UNION ALL SELECT 'relation_members', 0, (SELECT count(*) FROM d_relation_members)""")
def _(w: World):
    merged, counts = DS.merge_append(second(w), w.dataset)
    total = None
    for name, df in merged.tables().items():
        row = df.agg(F.count("*").alias("total")).withColumn("table_name", F.lit(name))
        total = row if total is None else total.unionByName(row)
    return counts.join(total, "table_name")


PARTS = """(SELECT 'east' AS part, id, version, node_count, tags FROM d_ways UNION ALL SELECT 'west', id, version, node_count, tags FROM d_ways_b
  UNION ALL SELECT 'mid', id, CAST(CASE WHEN id % 19 = 0 THEN NULL ELSE version END AS INT), node_count, CASE WHEN id % 23 = 0 THEN NULL ELSE tags END FROM d_ways WHERE id % 3 = 0)"""


@query("merged_parts", "O77", f"""
WITH p AS {PARTS}, r AS (SELECT *, bool_or(version IS NULL) OVER (PARTITION BY id) AS unk, min(version) OVER (PARTITION BY id) <> max(version) OVER (PARTITION BY id) AS vd, count(*) OVER (PARTITION BY id) AS holders,
   min(concat(node_count, '|', coalesce(tags, '-'))) OVER (PARTITION BY id) <> max(concat(node_count, '|', coalesce(tags, '-'))) OVER (PARTITION BY id) AS df FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN unk THEN 0 ELSE -version END, part <> 'west', part) AS rn FROM r)
SELECT id, part AS picked, version, node_count, tags, holders, CASE WHEN df THEN CASE WHEN vd THEN 'version' ELSE 'same-version' END END AS kind,
  CASE WHEN df THEN CASE WHEN vd THEN 'version-newer-wins' ELSE 'content-differs' END END AS reason FROM q WHERE rn = 1""")
def _(w: World):
    return DS.merge_parts(w.sql(f"SELECT * FROM {PARTS} p"), ["node_count", "tags"], primary="west")


REL_PARTS = """(SELECT concat('p', CAST(k.s AS VARCHAR(9))) AS part, id, CAST(version + CASE WHEN id % 6 = 0 THEN k.s ELSE 0 END AS INT) AS version,
  CASE WHEN (id + k.s) % 5 = 0 THEN NULL ELSE CAST(id % 50 AS DOUBLE) END AS min_lat, CAST(id % 50 + 1 + (id * k.s) % 3 AS DOUBLE) AS max_lat,
  CAST(10 AS DOUBLE) AS min_lon, CAST(12 AS DOUBLE) AS max_lon, member_count AS member_total, CAST((id * k.s) % 4 AS INT) AS kept
  FROM d_relations CROSS JOIN (VALUES (0), (1), (2)) AS k(s))"""


@query("picked_relations", "O78", f"""
WITH p AS {REL_PARTS}, m AS (SELECT *, max(version) OVER (PARTITION BY id) AS top, min(version) OVER (PARTITION BY id) AS low FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, min_lat IS NULL, CASE WHEN min_lat IS NULL THEN 0 ELSE -(max_lat - min_lat) * (max_lon - min_lon) END,
   member_total DESC, kept DESC, part <> 'p1', part) AS rn, bool_or(version = top AND min_lat IS NOT NULL) OVER (PARTITION BY id) AS known, count(*) OVER (PARTITION BY id) AS holders FROM m)
SELECT id, part AS picked, holders, CASE WHEN low <> top THEN 'version' WHEN NOT known THEN 'same-version' ELSE 'derived-bbox' END AS kind,
  CASE WHEN low <> top THEN 'version-newer-wins' WHEN NOT known THEN 'content-differs' ELSE 'derived-bbox-extent-wins' END AS reason FROM q WHERE rn = 1""")
def _(w: World):
    return DS.pick_relation(w.sql(f"SELECT * FROM {REL_PARTS} p"), primary="p1")


@query("bounds_audit", "O79", """
SELECT CAST(trunc(n.lat) AS INT) AS lat_band, count(*) AS outside, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM d_way_nodes r WHERE r.node_id = n.id AND r.way_id % 5 <> 0)) AS referenced
FROM d_nodes_b n WHERE n.lat < 39.75 OR n.lat > 39.82 OR n.lon < 116.16 OR n.lon > 116.24 GROUP BY 1""")
def _(w: World):
    ds = second(w)
    return DS.bounds_audit(ds.with_(way_nodes=w.way_nodes.where("way_id % 5 <> 0")), {"min_lat": 39.75, "max_lat": 39.82, "min_lon": 116.16, "max_lon": 116.24})


@query("tile_audit", "O80", f"""
WITH {CUT}, sup AS (SELECT DISTINCT wt.tile, r.node_id FROM d_way_nodes r JOIN wt ON wt.way_id = r.way_id)
SELECT 'ways_in_many_tiles' AS check_name, 0::BIGINT AS n UNION ALL SELECT 'node_copies_differ', 0
UNION ALL SELECT 'dangling_in_tile', count(*) FROM d_way_nodes r JOIN wt ON wt.way_id = r.way_id WHERE NOT EXISTS (SELECT 1 FROM d_nodes_cut n WHERE n.id = r.node_id)
UNION ALL SELECT 'support_copies', count(*) FROM sup s JOIN nt ON nt.id = s.node_id WHERE nt.tile <> s.tile""")
def _(w: World):
    cut = DS.tile_cut(w.dataset.with_(nodes=w.nodes_cut), RECTS)
    return DS.tile_audit(cut["nodes"], cut["ways"], cut["way_nodes"])


@query("id_ranges", "O82", """
WITH m AS (SELECT 'a' AS dataset, 'node' AS kind, max(id) AS max_id FROM d_nodes UNION ALL SELECT 'a', 'way', max(id) FROM d_ways UNION ALL SELECT 'a', 'relation', max(id) FROM d_relations
  UNION ALL SELECT 'b', 'node', max(id) FROM d_nodes_b UNION ALL SELECT 'b', 'way', max(id) FROM d_ways_b UNION ALL SELECT 'b', 'relation', max(id) FROM d_relations WHERE id % 9 <> 0)
SELECT a.dataset, a.kind, a.max_id, a.max_id + 1 AS next_id, CASE WHEN a.max_id + 1 <= b.max_id THEN b.dataset ELSE '' END AS clashes_with FROM m a JOIN m b ON b.kind = a.kind AND b.dataset <> a.dataset""")
def _(w: World):
    return DS.id_ranges({"a": w.dataset, "b": second(w)})


@query("allocated_ids", "O82", """
SELECT o_orderkey, 1000000 + row_number() OVER (ORDER BY o_orderkey) - 1 AS new_id FROM orders""")
def _(w: World):
    return DS.allocate_ids(w.table("orders"), 1000000, "o_orderkey").select("o_orderkey", "new_id")


@query("archived_rows", "O11", """
SELECT 'kept' AS part, l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity < 10) GROUP BY l_returnflag
UNION ALL SELECT 'archived', l_returnflag, count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10 GROUP BY l_returnflag""")
def _(w: World):
    from streetloom.session import shared_path
    from streetloom.sources.layout import archive_and_delete
    df = w.table("lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    kept, archived = archive_and_delete(df, (F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10), shared_path(w.spark, "archive"))
    def count(d, name):
        return d.groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
    return count(kept, "kept").unionByName(count(archived, "archived"))
