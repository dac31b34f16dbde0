"""Change log queries and batch edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.catalog.elements import hav
from streetloom.functions import geo
from streetloom.operators import geometry as G, history as H
from streetloom.plans.demo import World


def log(w: World):
    return w.raw("d_log").withColumn("ts", F.col("ts").cast("timestamp"))


@query("recent_changes", "O86", "SELECT id, changeset_id, elem_id, action, undone FROM d_log ORDER BY id DESC LIMIT 100")
def _(w: World):
    return H.recent_changes(log(w), 100).select("id", "changeset_id", "elem_id", "action", "undone")


@query("element_history", "O86", """
SELECT elem_id, id, action, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY id DESC) AS rn FROM d_log) c WHERE rn <= 3""")
def _(w: World):
    every = w.changes.select("elem_type", "elem_id").distinct()
    return H.element_history(log(w), every, 3).select("elem_id", "id", "action", "rank")


@query("changesets", "O86", """
SELECT changeset_id, arg_min(author, id) AS author, count(*) AS op_count, bool_and(undone) AS reverted FROM d_log GROUP BY changeset_id""")
def _(w: World):
    return H.changesets(log(w)).select("changeset_id", "author", "op_count", "reverted")


@query("osmchange_rows", "O9", """
SELECT changeset_id, CAST(CASE action WHEN 'create' THEN 0 WHEN 'modify' THEN 1 ELSE 2 END AS INT) AS section, id, action, elem_type, elem_id, coalesce(after, before) AS snapshot
FROM d_log WHERE NOT undone""")
def _(w: World):
    return H.osmchange_rows(log(w))


# Per element: base version 1 for two of three elements; the expected version is right for most changes.
BATCH = """(SELECT event_id AS id, CAST(floor(event_id / 1000) AS BIGINT) * 200 + (event_id * 31) % 200 AS elem_id,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS action,
  CAST(CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS INT) AS expected, concat('v', CAST(event_id AS VARCHAR(20))) AS value FROM events)"""
ELEMS = "(SELECT DISTINCT CAST(floor(event_id / 1000) AS BIGINT) * 200 + (event_id * 31) % 200 AS id, CAST(1 AS INT) AS version, 'base' AS value FROM events WHERE ((event_id * 31) % 200) % 3 <> 0)"

FOLD_SQL = f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY id) AS pos FROM {BATCH} b), e AS {ELEMS},
f AS (SELECT c.elem_id, 0::BIGINT AS pos, 0::BIGINT AS change_id, e.version AS v, NULL::BOOLEAN AS accepted, NULL::VARCHAR AS reason, e.value AS value
   FROM (SELECT DISTINCT elem_id FROM c) c LEFT JOIN e ON e.id = c.elem_id
  UNION ALL
  SELECT elem_id, pos, change_id, CASE WHEN reason IS NOT NULL THEN v WHEN action = 'create' THEN 1 WHEN action = 'delete' THEN NULL ELSE v + 1 END,
    reason IS NULL, reason, CASE WHEN reason IS NULL THEN nv ELSE value END
  FROM (SELECT f.elem_id, c.pos, c.id AS change_id, f.v, c.action, f.value, c.value AS nv,
      CASE WHEN c.action = 'create' AND f.v IS NOT NULL THEN 'exists' WHEN c.action <> 'create' AND f.v IS NULL THEN 'missing'
           WHEN c.action <> 'create' AND c.expected IS NOT NULL AND c.expected <> f.v THEN 'version' END AS reason
    FROM f JOIN c ON c.elem_id = f.elem_id AND c.pos = f.pos + 1) s)
"""


@query("applied_changes", "O105", FOLD_SQL + "SELECT elem_id, change_id, accepted, reason FROM f WHERE pos > 0")
def _(w: World):
    _, outcome = H.apply_changes(w.sql(f"SELECT * FROM {ELEMS} e"), w.sql(f"SELECT * FROM {BATCH} b"))
    return outcome.select("elem_id", "change_id", "accepted", "reason")


@query("elements_after_batch", "O105", FOLD_SQL + """, l AS (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY pos DESC) AS rn FROM f)
SELECT elem_id AS id, v AS version, value FROM l WHERE rn = 1 AND v IS NOT NULL
UNION ALL SELECT id, version, value FROM e WHERE id NOT IN (SELECT elem_id FROM c)""")
def _(w: World):
    after, _ = H.apply_changes(w.sql(f"SELECT * FROM {ELEMS} e"), w.sql(f"SELECT * FROM {BATCH} b"))
    return after


CURRENT = """(SELECT elem_id AS id, txt AS value FROM (SELECT elem_id, action, txt, row_number() OVER (PARTITION BY elem_id ORDER BY id DESC) AS rn FROM d_log) q
   WHERE rn = 1 AND action <> 'delete')"""


@query("state_at", "O106", f"""
WITH cur AS {CURRENT}, m AS (SELECT max(id) // 2 AS t FROM d_log), l AS (SELECT elem_id, arg_min(coalesce(before, '~'), id) AS b FROM d_log, m WHERE id > m.t GROUP BY elem_id)
SELECT coalesce(cur.id, l.elem_id) AS id, CASE WHEN l.elem_id IS NULL THEN cur.value ELSE nullif(l.b, '~') END AS value FROM cur FULL JOIN l ON l.elem_id = cur.id
WHERE CASE WHEN l.elem_id IS NULL THEN cur.value ELSE nullif(l.b, '~') END IS NOT NULL""")
def _(w: World):
    half = w.table("events").agg(F.max("event_id")).first()[0] // 2
    return H.state_at(w.sql(f"SELECT * FROM {CURRENT} c"), log(w), half)


@query("reverted_changesets", "O107", f"""
WITH cur AS {CURRENT}, o AS (SELECT * FROM d_log WHERE NOT undone AND changeset_id % 3 = 0),
r AS (SELECT elem_id AS id, nullif(arg_min(coalesce(before, '~'), id), '~') AS value FROM o GROUP BY elem_id)
SELECT 'element' AS part, id, value, NULL::VARCHAR AS action FROM cur WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'element', id, value, NULL FROM r WHERE value IS NOT NULL
UNION ALL SELECT 'deleted', id, NULL, NULL FROM r WHERE value IS NULL
UNION ALL SELECT 'inverse', id, before, CASE WHEN before IS NULL THEN 'delete' ELSE 'modify' END FROM o""")
def _(w: World):
    out = H.revert_changesets(w.sql(f"SELECT * FROM {CURRENT} c"), log(w).where("changeset_id % 3 = 0"))
    none = F.lit(None).cast("string")
    return (out["elements"].select(F.lit("element").alias("part"), "id", "value", none.alias("action"))
            .unionByName(out["deleted"].select(F.lit("deleted").alias("part"), "id", none.alias("value"), none.alias("action")))
            .unionByName(out["inverse"].select(F.lit("inverse").alias("part"), F.col("of_change").alias("id"), F.col("after").alias("value"), "action")))


DELETED_WAYS = """gw AS (SELECT DISTINCT id FROM ({0}) z), left_refs AS (SELECT * FROM d_way_nodes WHERE way_id NOT IN (SELECT id FROM gw)),
orph AS (SELECT DISTINCT r.node_id AS id FROM d_way_nodes r JOIN gw ON gw.id = r.way_id JOIN d_nodes n ON n.id = r.node_id AND n.tags IS NULL
  WHERE NOT EXISTS (SELECT 1 FROM left_refs l WHERE l.node_id = r.node_id) AND NOT EXISTS (SELECT 1 FROM d_relation_members m WHERE m.member_type = 'node' AND m.member_ref = r.node_id))"""


@query("deleted_ways", "O109", f"""
WITH {DELETED_WAYS.format("SELECT id FROM d_ways WHERE version = 2")}
SELECT 'way' AS type, id FROM gw UNION ALL SELECT 'node', id FROM orph""")
def _(w: World):
    return H.delete_ways(w.dataset, w.ways.where("version = 2").select("id"))[1]


@query("deleted_nodes_cascade", "O108", f"""
WITH want AS (SELECT id FROM d_nodes WHERE tags IS NOT NULL), {DELETED_WAYS.format("SELECT way_id AS id FROM d_way_nodes WHERE node_id IN (SELECT id FROM want)")}
SELECT 'way' AS type, id FROM gw UNION SELECT 'node', id FROM orph UNION SELECT 'node', id FROM want
UNION SELECT 'relation', relation_id FROM d_relation_members WHERE member_type = 'node' AND member_ref IN (SELECT id FROM want)""")
def _(w: World):
    return H.delete_nodes(w.dataset, w.nodes.where("tags IS NOT NULL").select("id"), cascade=True)[0]


@query("deleted_nodes_refused", "O108", """
WITH few AS (SELECT * FROM d_way_nodes WHERE way_id % 7 <> 3), u AS (SELECT node_id AS id FROM few UNION SELECT member_ref FROM d_relation_members WHERE member_type = 'node')
SELECT id, id IN (SELECT id FROM u) AS refused FROM d_nodes""")
def _(w: World):
    deleted, refused = H.delete_nodes(w.dataset.with_(way_nodes=w.way_nodes.where("way_id % 7 <> 3")), w.nodes.select("id"))
    return deleted.select("id", F.lit(False).alias("refused")).unionByName(refused.select("id", F.lit(True).alias("refused")))


@query("split_ways", "O110", """
WITH cut AS (SELECT r.way_id, min(r.seq) AS pos FROM d_way_nodes r JOIN d_ways w ON w.id = r.way_id WHERE r.node_id % 3 = 0 GROUP BY r.way_id, r.node_id, w.node_count HAVING min(r.seq) > 0 AND min(r.seq) < w.node_count - 1),
p AS (SELECT way_id, 0 AS part, 0 AS a, min(pos) AS b FROM cut GROUP BY way_id UNION ALL
  SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY pos), pos, coalesce(lead(pos) OVER (PARTITION BY way_id ORDER BY pos), 999) FROM cut),
n AS (SELECT *, 5000000 + row_number() OVER (ORDER BY way_id, part) - 1 AS new_id FROM p WHERE part > 0)
SELECT r.way_id, CAST(p.part AS INT) AS part, coalesce(n.new_id, r.way_id) AS new_id, CAST(r.seq - p.a AS INT) AS seq, r.node_id
FROM d_way_nodes r JOIN p ON p.way_id = r.way_id AND r.seq BETWEEN p.a AND p.b LEFT JOIN n ON n.way_id = p.way_id AND n.part = p.part""")
def _(w: World):
    cuts = w.way_nodes.where("node_id % 3 = 0").select("way_id", "node_id")
    return H.split_ways(w.dataset, cuts, 5000000)


PAIRS = """(SELECT min(way_id) AS a, max(way_id) AS b FROM (SELECT r.way_id, r.node_id FROM d_way_nodes r JOIN d_ways w ON w.id = r.way_id
   WHERE (r.seq = 0 OR r.seq = w.node_count - 1) AND r.way_id % 4 < 2) e GROUP BY node_id HAVING count(*) = 2 AND min(way_id) < max(way_id) AND count(DISTINCT way_id) = 2
 UNION SELECT CAST(id AS BIGINT), CAST(id + 4 AS BIGINT) FROM d_ways WHERE id % 40 = 3 AND id + 4 IN (SELECT id FROM d_ways)
 UNION SELECT id, near FROM (SELECT x.way_id AS id, min(y.way_id) AS near FROM d_way_nodes x JOIN d_way_nodes y ON y.node_id = x.node_id + 1 AND y.way_id > x.way_id AND y.seq = 0
   WHERE x.seq = 1 AND x.node_id < 10000000000000 AND x.way_id % 8 = 4 GROUP BY x.way_id) q)"""


@query("merged_ways", "O111", f"""
WITH pr AS (SELECT DISTINCT a, b FROM {PAIRS} z), u AS (SELECT id FROM (SELECT a AS id FROM pr UNION ALL SELECT b FROM pr) t GROUP BY id HAVING count(*) > 1),
ok AS (SELECT * FROM pr WHERE a NOT IN (SELECT id FROM u) AND b NOT IN (SELECT id FROM u)),
ids AS (SELECT way_id, list(node_id ORDER BY seq) AS l FROM d_way_nodes GROUP BY way_id),
ends AS (SELECT ok.a, ok.b, x.l AS al, y.l AS bl, k.o, k.i, k.j, CASE WHEN k.i = 0 THEN x.l[1] ELSE x.l[-1] END AS na, CASE WHEN k.j = 0 THEN y.l[1] ELSE y.l[-1] END AS nb
  FROM ok JOIN ids x ON x.way_id = ok.a JOIN ids y ON y.way_id = ok.b CROSS JOIN (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) AS k(o, i, j)),
d AS (SELECT e.*, CASE WHEN na = nb THEN 0.0 ELSE {hav('n.lat', 'n.lon', 'm.lat', 'm.lon')} END AS d FROM ends e JOIN d_nodes n ON n.id = e.na JOIN d_nodes m ON m.id = e.nb),
best AS (SELECT *, na <> nb AND d <= 120 AS snapped FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d, o) AS rn FROM d) q WHERE rn = 1),
f AS (SELECT *, CASE WHEN i = 1 THEN al ELSE list_reverse(al) END AS pa, list_transform(CASE WHEN j = 0 THEN bl ELSE list_reverse(bl) END, lambda x: CASE WHEN snapped AND x = nb THEN na ELSE x END) AS pb FROM best)
SELECT a AS way_id, b AS removed_way, snapped, CASE WHEN na <> nb AND NOT snapped THEN floor(d * 10 + 0.5) / 10 ELSE 0.0 END::DOUBLE AS bridged_m, array_to_string(list_concat(pa, CASE WHEN pb[1] = pa[-1] THEN pb[2:] ELSE pb END), ',') AS nodes FROM f""")
def _(w: World):
    pairs = w.sql(f"SELECT DISTINCT a, b FROM {PAIRS} z")
    m = H.merge_ways(w.dataset, pairs, snap_m=120)["merged"]
    return m.select("way_id", "removed_way", "snapped", "bridged_m", F.array_join(F.transform("node_ids", lambda x: x.cast("string")), ",").alias("nodes"))


@query("joined_nodes", "O112", """
WITH pr AS (SELECT id AS f, id - 1 AS t FROM d_nodes WHERE id % 6 = 0 AND id < 10000000000000 AND id - 1 IN (SELECT id FROM d_nodes)),
tw AS (SELECT DISTINCT way_id FROM d_way_nodes WHERE node_id IN (SELECT f FROM pr)),
m AS (SELECT r.way_id, r.seq, coalesce(pr.t, r.node_id) AS node_id FROM d_way_nodes r JOIN tw ON tw.way_id = r.way_id LEFT JOIN pr ON pr.f = r.node_id),
k AS (SELECT *, lag(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS p FROM m), q AS (SELECT way_id, node_id, row_number() OVER (PARTITION BY way_id ORDER BY seq) - 1 AS seq, count(*) OVER (PARTITION BY way_id) AS c FROM k WHERE p IS NULL OR p <> node_id)
SELECT way_id, CAST(CASE WHEN c < 2 THEN -1 ELSE seq END AS INT) AS seq, node_id FROM q""")
def _(w: World):
    pairs = w.nodes.where("id % 6 = 0 AND id < 10000000000000").select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("to_id"))
    out = H.join_nodes(w.dataset, pairs)
    # Deleted ways are shown with seq -1 and the one node they shrank to.
    w1 = out["deleted_ways"].join(w.way_nodes.where("seq = 0"), "way_id").join(pairs.select(F.col("from_id").alias("node_id"), "to_id"), "node_id", "left")
    gone = w1.select("way_id", F.lit(-1).alias("seq"), F.coalesce("to_id", "node_id").alias("node_id"))
    return out["way_nodes"].unionByName(gone)


@query("reversed_ways", "O113", """
SELECT r.way_id, CAST(w.node_count - 1 - r.seq AS INT) AS seq, r.node_id FROM d_way_nodes r JOIN d_ways w ON w.id = r.way_id WHERE w.version = 1""")
def _(w: World):
    return H.reverse_ways(w.dataset, w.ways.where("version = 1"))


@query("bulk_retag", "O113", """
SELECT id, CAST(version + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS version,
  CASE WHEN id % 2 = 0 THEN NULL ELSE t['name'] END AS name, CASE WHEN id % 2 = 0 THEN concat('s', CAST(id % 3 AS VARCHAR)) END AS surface, t['highway'] AS highway FROM o_ways""")
def _(w: World):
    edits = w.ways.where("id % 2 = 0").select("id", F.create_map(F.lit("surface"), F.concat(F.lit(" s"), (F.col("id") % 3).cast("string"))).alias("set_tags"),
                                              F.array(F.lit("name")).alias("drop_keys"))
    t = F.col("tags")
    return H.retag(w.ways.select("id", "version", "tags"), edits).select("id", "version", t["name"].alias("name"), t["surface"].alias("surface"), t["highway"].alias("highway"))


REL_EDIT = "(SELECT id + CASE WHEN id % 10 = 0 THEN 900000000 ELSE 0 END AS id, CASE WHEN id % 20 = 0 THEN NULL ELSE tags END AS tags, id AS src FROM d_relations)"


@query("upserted_relations", "O113", f"""
WITH e AS {REL_EDIT}, m AS (SELECT e.id, m.member_type, m.member_ref, CASE m.member_type WHEN 'way' THEN m.member_ref IN (SELECT id FROM d_ways)
   WHEN 'node' THEN m.member_ref IN (SELECT id FROM d_nodes_cut) ELSE m.member_ref IN (SELECT id FROM d_relations) END AS there FROM e JOIN d_relation_members m ON m.relation_id = e.src),
a AS (SELECT id, bool_and(there) AS ok, count(*) AS n FROM m GROUP BY id)
SELECT e.id, CASE WHEN NOT a.ok THEN 'member_missing' WHEN o.id IS NULL AND e.tags IS NULL THEN 'type_missing' END AS reason,
  CASE WHEN a.ok AND (o.id IS NOT NULL OR e.tags IS NOT NULL) THEN CAST(coalesce(o.version + 1, 1) AS INT) END AS version
FROM e LEFT JOIN a ON a.id = e.id LEFT JOIN d_relations o ON o.id = e.id""")
def _(w: World):
    e = w.sql(f"SELECT * FROM {REL_EDIT} e")
    from streetloom.functions.tags import parse_tags
    members = e.select("id", "src").join(w.relation_members, F.col("src") == F.col("relation_id")).select(
        F.col("id").alias("relation_id"), "seq", "member_type", "member_ref", "role")
    out = H.upsert_relations(w.dataset.with_(nodes=w.nodes_cut), e.select("id", parse_tags(F.col("tags")).alias("tags")), members)
    return out["written"].select("id", F.lit(None).cast("string").alias("reason"), "version").unionByName(
        out["refused"].select("id", "reason", F.lit(None).cast("int").alias("version")))


@query("duplicated_ways", "O142", """
WITH ww AS (SELECT id, 7000000 + row_number() OVER (ORDER BY id) - 1 AS nid FROM d_ways WHERE closed),
nn AS (SELECT n.*, 8000000 + row_number() OVER (ORDER BY n.id) - 1 AS nid FROM d_nodes n WHERE id IN (SELECT node_id FROM d_way_nodes r JOIN ww ON ww.id = r.way_id))
SELECT ww.nid AS way_id, r.seq, nn.nid AS node_id, floor((nn.lat + 8.0::DOUBLE / 111320) * 1000000 + 0.5) / 1000000 AS lat,
  floor((nn.lon + 8.0::DOUBLE / 111320 / cos(nn.lat * (pi() / 180))) * 1000000 + 0.5) / 1000000 AS lon
FROM d_way_nodes r JOIN ww ON ww.id = r.way_id JOIN nn ON nn.id = r.node_id""")
def _(w: World):
    out = H.duplicate(w.dataset, w.ways.where("closed").select("id"), 8000000, 7000000)
    xy = out["nodes"].select(F.col("new_id").alias("node_id"), geo.js_round(F.col("lat"), 6).alias("lat"), geo.js_round(F.col("lon"), 6).alias("lon"))
    return out["way_nodes"].join(xy, "node_id").select("way_id", "seq", "node_id", "lat", "lon")


@query("orthogonal_ways", "O141", """
WITH c AS (SELECT r.way_id, r.seq, n.lat, n.lon, lead(n.lat) OVER (PARTITION BY r.way_id ORDER BY r.seq) AS lat2, lead(n.lon) OVER (PARTITION BY r.way_id ORDER BY r.seq) AS lon2 FROM d_way_nodes r
  JOIN d_ways w ON w.id = r.way_id AND w.closed JOIN d_nodes n ON n.id = r.node_id),
s AS (SELECT *, first(lat) OVER (PARTITION BY way_id ORDER BY seq) AS y0, """ + hav("lat", "lon", "lat2", "lon2") + """ AS d FROM c WHERE lat2 IS NOT NULL),
g AS (SELECT way_id, max(y0) AS y0, arg_min(atan2(lat2 - lat, (lon2 - lon) * cos(lat * (pi() / 180))), {'d': -floor(d * 1000 + 0.5), 's': seq}) AS g FROM s GROUP BY way_id),
x AS (SELECT s.way_id, g.g, cos(g.y0 * (pi() / 180)) AS k, s.lon * cos(g.y0 * (pi() / 180)) * cos(-g.g) - s.lat * sin(-g.g) AS x, s.lon * cos(g.y0 * (pi() / 180)) * sin(-g.g) + s.lat * cos(-g.g) AS y FROM s JOIN g ON g.way_id = s.way_id),
b AS (SELECT way_id, max(g) AS g, max(k) AS k, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM x GROUP BY way_id)
SELECT way_id, floor((x1 * sin(g) + y1 * cos(g)) * 100000 + 0.5) / 100000 AS lat1, floor((x1 * cos(g) - y1 * sin(g)) / k * 100000 + 0.5) / 100000 AS lon1,
  floor((x2 * sin(g) + y2 * cos(g)) * 100000 + 0.5) / 100000 AS lat2, floor((x2 * cos(g) - y2 * sin(g)) / k * 100000 + 0.5) / 100000 AS lon2 FROM b""")
def _(w: World):
    refs = w.way_nodes.join(w.ways.where("closed").select(F.col("id").alias("way_id")), "way_id", "left_semi")
    o = H.orthogonalise(G.way_geometry(refs, w.nodes))
    a, b = F.col("coords")[0], F.col("coords")[2]
    return o.select("way_id", geo.js_round(a["lat"], 5).alias("lat1"), geo.js_round(a["lon"], 5).alias("lon1"),
                    geo.js_round(b["lat"], 5).alias("lat2"), geo.js_round(b["lon"], 5).alias("lon2"))
