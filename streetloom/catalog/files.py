"""Files written from the derived dataset and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.operators import geometry as G
from streetloom.plans.demo import World
from streetloom.session import shared_path
from streetloom.sources import layout, osm_files as X


BOX = {"min_lat": 39.76, "max_lat": 39.8, "min_lon": 116.17, "max_lon": 116.22}


@query("xml_round_trip", "O1 O8", """
WITH b AS (SELECT r.way_id, min(n.lat) AS min_lat, max(n.lat) AS max_lat, min(n.lon) AS min_lon, max(n.lon) AS max_lon, count(*) AS refs FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id)
SELECT w.id, w.version, w.node_count, w.closed, t['highway'] AS highway, t['name'] AS name, t['building:levels'] AS levels, min_lat, max_lat, min_lon, max_lon FROM o_ways w JOIN b ON b.way_id = w.id""")
def _(w: World):
    path = shared_path(w.spark, "export")
    X.export_osm(w.dataset, path)
    ds = X.read_osm_xml(w.spark, path)
    t = F.col("tags")
    return ds.ways.join(G.way_bbox(ds.way_nodes, ds.nodes).withColumnRenamed("way_id", "id"), "id").select(
        "id", "version", "node_count", "closed", t["highway"].alias("highway"), t["name"].alias("name"), t["building:levels"].alias("levels"), "min_lat", "max_lat", "min_lon", "max_lon")


@query("export_rows", "O8", """
WITH b AS (SELECT r.way_id, min(n.lat) AS a, max(n.lat) AS b, min(n.lon) AS c, max(n.lon) AS d FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id),
hw AS (SELECT w.* FROM o_ways w JOIN b ON b.way_id = w.id WHERE d >= 116.17 AND c <= 116.22 AND b.b >= 39.76 AND a <= 39.8),
nd AS (SELECT way_id, string_agg(concat('    <nd ref="', node_id, '"/>'), chr(10) ORDER BY seq) AS x FROM d_way_nodes GROUP BY way_id)
SELECT CAST(2 AS INT) AS section, hw.id, concat('  <way id="', hw.id, '" version="', hw.version, '">', chr(10), nd.x, CASE WHEN t IS NULL THEN '' ELSE concat(chr(10), array_to_string(list_transform(map_entries(t), lambda e: concat('    <tag k="', e.key, '" v="', e.value, '"/>')), chr(10))) END, chr(10), '  </way>') AS xml
FROM hw JOIN nd ON nd.way_id = hw.id""")
def _(w: World):
    return X.export_rows(w.dataset, {"min_lat": 39.76, "max_lat": 39.8, "min_lon": 116.17, "max_lon": 116.22}).where("section = 2")


@query("export_nodes_relations", "O8", """
WITH tl AS (SELECT 1 AS section, id, t FROM o_nodes UNION ALL SELECT 3, id, t FROM o_relations),
tx AS (SELECT section, id, CASE WHEN t IS NULL OR cardinality(t) = 0 THEN NULL ELSE array_to_string(list_transform(map_entries(t), lambda e: concat('    <tag k="', e.key, '" v="', e.value, '"/>')), chr(10)) END AS tags FROM tl),
mm AS (SELECT relation_id AS id, string_agg(concat('    <member type="', member_type, '" ref="', member_ref, '" role="', role, '"/>'), chr(10) ORDER BY seq) AS x FROM d_relation_members GROUP BY relation_id),
el AS (SELECT 1 AS section, n.id, concat('  <node id="', n.id, '" lat="', rtrim(rtrim(printf('%.7f', lat), '0'), '.'), '" lon="', rtrim(rtrim(printf('%.7f', lon), '0'), '.'), '" version="', version, '"') AS head, 'node' AS kind, CAST(NULL AS VARCHAR) AS x
  FROM o_nodes n WHERE lat BETWEEN 39.76 AND 39.8 AND lon BETWEEN 116.17 AND 116.22
 UNION ALL SELECT 3, r.id, concat('  <relation id="', r.id, '" version="', version, '"'), 'relation', mm.x FROM o_relations r LEFT JOIN mm ON mm.id = r.id)
SELECT CAST(el.section AS INT) AS section, el.id, CASE WHEN x IS NULL AND tags IS NULL THEN concat(head, '/>') ELSE concat(head, '>', chr(10), concat_ws(chr(10), x, tags), chr(10), '  </', kind, '>') END AS xml
FROM el JOIN tx ON tx.section = el.section AND tx.id = el.id""")
def _(w: World):
    """The sections that ``export_rows`` writes but does not return."""
    return X.export_rows(w.dataset, BOX).where("section <> 2")


def normalised(w: World):
    o = w.table("orders")
    k = F.col("o_orderkey")
    pair = lambda v: F.struct(F.lit("k").alias("key"), F.lit(v).alias("value"))
    common = [F.when(k % 4 != 0, (k % 9).cast("int")).alias("version"), F.lit(None).cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"),
              F.when(k % 3 != 0, F.col("o_custkey").cast("string")).alias("uid"), (k % 7 != 0).alias("visible"),
              F.when(k % 6 == 0, F.array(pair("a"), pair("b"))).otherwise(F.array(pair("a"))).alias("pairs")]
    way = o.select(k.alias("id"), *common, F.when(k % 4 == 2, F.array(k, k + 1)).otherwise(F.array(k, k + 1, k)).alias("refs"))
    node = o.select(k.alias("id"), *common, F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    rel = o.select(k.alias("id"), *common, F.array(F.struct(F.lit("way").alias("type"), k.alias("ref"), F.lit("").alias("role"))).alias("members"))
    return X.normalise_elements({"way": way, "node": node, "relation": rel})


@query("normalised_elements", "O4", """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 9 END AS INT) AS version, CASE WHEN o_orderkey % 3 = 0 THEN concat('u', o_custkey) ELSE CAST(o_custkey AS VARCHAR) END AS editor,
  CASE WHEN o_orderkey % 6 = 0 THEN 'b' ELSE 'a' END AS k, o_orderkey % 4 <> 2 AS closed, CAST(CASE WHEN o_orderkey % 4 = 2 THEN 2 ELSE 3 END AS INT) AS node_count FROM orders WHERE o_orderkey % 7 <> 0""")
def _(w: World):
    return normalised(w).ways.select("id", "version", "editor", F.col("tags")["k"].alias("k"), "closed", "node_count")


@query("normalised_nodes_relations", "O4", """
WITH e AS (SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 9 END AS INT) AS version, CASE WHEN o_orderkey % 3 = 0 THEN concat('u', o_custkey) ELSE CAST(o_custkey AS VARCHAR) END AS editor,
  CASE WHEN o_orderkey % 6 = 0 THEN 'b' ELSE 'a' END AS k FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 'node' AS kind, id, version, editor, k, 1.0::DOUBLE AS lat, 2.0::DOUBLE AS lon, CAST(NULL AS VARCHAR) AS member_type, CAST(NULL AS BIGINT) AS member_ref FROM e
UNION ALL SELECT 'relation', id, version, editor, k, NULL, NULL, 'way', id FROM e""")
def _(w: World):
    """The kinds that ``normalised_elements`` builds but does not return."""
    ds = normalised(w)
    common = ["id", "version", "editor", F.col("tags")["k"].alias("k")]
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    nodes = ds.nodes.select(F.lit("node").alias("kind"), *common, "lat", "lon", null("string", "member_type"), null("long", "member_ref"))
    mem = ds.relation_members.select(F.col("relation_id").alias("id"), "member_type", "member_ref")
    rels = ds.relations.join(mem, "id", "left").select(F.lit("relation").alias("kind"), *common, null("double", "lat"), null("double", "lon"), "member_type", "member_ref")
    return nodes.unionByName(rels)


@query("limited_elements", "O5", """
SELECT 'node' AS kind, id FROM (SELECT id FROM d_nodes ORDER BY id LIMIT 2500) n UNION ALL SELECT 'way', id FROM (SELECT id FROM d_ways ORDER BY id LIMIT 2500) w
UNION ALL SELECT 'relation', id FROM (SELECT id FROM d_relations ORDER BY id LIMIT 2500) r""")
def _(w: World):
    ds = X.limit_elements(w.dataset, 2500)
    return ds.nodes.select(F.lit("node").alias("kind"), "id").unionByName(ds.ways.select(F.lit("way").alias("kind"), "id")).unionByName(ds.relations.select(F.lit("relation").alias("kind"), "id"))


@query("file_kinds", "O3")
def _(w: World):
    path = shared_path(w.spark, "kinds")
    X.export_osm(w.dataset, path)
    return X.sniff_osm_format(w.spark, f"{path}/part-*").groupBy("kind").agg(F.count("*").alias("files"))


@query("layout_box_read", "O7", "SELECT id, lat, lon FROM d_nodes WHERE lat BETWEEN 39.76 AND 39.8 AND lon BETWEEN 116.17 AND 116.22")
def _(w: World):
    path = shared_path(w.spark, "layout")
    layout.write_dataset(w.dataset, path, cell_deg=0.05)
    return layout.read_nodes_in_box(w.spark, path, BOX, cell_deg=0.05).select("id", "lat", "lon")


@query("layout_box_ways_relations", "O7", """
WITH b AS (SELECT r.way_id, min(n.lat) AS a, max(n.lat) AS b, min(n.lon) AS c, max(n.lon) AS d FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id GROUP BY r.way_id),
wy AS (SELECT way_id AS id FROM b WHERE d >= 116.17 AND c <= 116.22 AND b.b >= 39.76 AND a <= 39.8),
nd AS (SELECT id FROM d_nodes WHERE lat BETWEEN 39.76 AND 39.8 AND lon BETWEEN 116.17 AND 116.22)
SELECT 'way' AS kind, id FROM wy UNION ALL
SELECT DISTINCT 'relation', relation_id FROM d_relation_members WHERE (member_type = 'way' AND member_ref IN (SELECT id FROM wy)) OR (member_type = 'node' AND member_ref IN (SELECT id FROM nd))""")
def _(w: World):
    """The kinds that ``layout_box_read`` writes but does not read."""
    path = shared_path(w.spark, "layout")
    layout.write_dataset(w.dataset, path, cell_deg=0.05)
    ways = layout.read_ways_in_box(w.spark, path, BOX, cell_deg=0.05).select(F.lit("way").alias("kind"), "id")
    return ways.unionByName(layout.read_relations_in_box(w.spark, path, BOX, cell_deg=0.05).select(F.lit("relation").alias("kind"), "id"))


@query("layout_box_geometry", "O7 O36", """
WITH p AS (SELECT r.way_id AS id, r.seq, r.node_id, n.lat, n.lon FROM d_way_nodes r JOIN d_nodes n ON n.id = r.node_id),
b AS (SELECT id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM p GROUP BY id)
SELECT p.id, CAST(row_number() OVER (PARTITION BY p.id ORDER BY seq) - 1 AS INT) AS idx, p.node_id, p.lat, p.lon, b.min_lat, b.max_lat, b.min_lon, b.max_lon
FROM p JOIN b ON b.id = p.id WHERE max_lon >= 116.17 AND min_lon <= 116.22 AND max_lat >= 39.76 AND min_lat <= 39.8""")
def _(w: World):
    """Points of the ways of a box, from the files of its zones alone: no join with nodes."""
    path = shared_path(w.spark, "layout")
    layout.write_dataset(w.dataset, path, cell_deg=0.05)
    extent = ["min_lat", "max_lat", "min_lon", "max_lon"]
    points = F.posexplode(F.arrays_zip("coords", "node_ids")).alias("idx", "p")
    return layout.read_ways_in_box(w.spark, path, BOX, cell_deg=0.05).select("id", points, *extent).select("id", "idx", "p.node_ids", "p.coords.lat", "p.coords.lon", *extent).withColumnRenamed("node_ids", "node_id")


@query("snapshot_counts", "O10", """
SELECT 'nodes' AS table_name, count(*) AS source, count(*) AS copy, true AS ok FROM d_nodes UNION ALL SELECT 'ways', count(*), count(*), true FROM d_ways UNION ALL SELECT 'way_nodes', count(*), count(*), true FROM d_way_nodes
UNION ALL SELECT 'relations', count(*), count(*), true FROM d_relations UNION ALL SELECT 'relation_members', count(*), count(*), true FROM d_relation_members""")
def _(w: World):
    return layout.snapshot_dataset(w.dataset, shared_path(w.spark, "snapshot"))
