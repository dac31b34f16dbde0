"""Tags, coordinates, geometry, extents and reference checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.functions import geo, tags as T
from streetloom.operators import geometry as G
from streetloom.plans.demo import World

R6 = "{} * 1000000.0 + 0.5"
# haversine written out for the SQL side
HAV = ("2 * 6378137.0 * asin(least(1.0::DOUBLE, sqrt(pow(sin(({2} - {0}) * (pi() / 180) / 2), 2) + cos({0} * (pi() / 180)) "
       "* cos({2} * (pi() / 180)) * pow(sin(({3} - {1}) * (pi() / 180) / 2), 2))))")


def hav(a: str, b: str, c: str, d: str) -> str:
    return HAV.format(a, b, c, d)


@query("parse_clean_tags", "O14", """
WITH raw AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{"a ":" x ","b":"","c":"3"}'
   WHEN 1 THEN '{broken' WHEN 2 THEN '{}' WHEN 3 THEN NULL ELSE concat('{"name":" ', p_name, ' ","  ":"v"}') END AS txt, p_name
  FROM part)
SELECT id, CASE id % 5 WHEN 0 THEN 'a=x,c=3' WHEN 4 THEN concat('name=', trim(p_name)) END AS tag_list FROM raw""")
def _(w: World):
    raw = w.sql("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{"a ":" x ","b":"","c":"3"}'
        WHEN 1 THEN '{broken' WHEN 2 THEN '{}' WHEN 3 THEN NULL
        ELSE concat('{"name":" ', p_name, ' ","  ":"v"}') END AS txt FROM part""")
    cleaned = T.clean_tags(T.parse_tags(F.col("txt")))
    listed = F.array_join(F.transform(F.map_entries(cleaned), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return raw.select("id", listed.alias("tag_list"))


@query("tag_errors", "O15", """
WITH raw AS (SELECT p_partkey AS id, p_partkey % 6 AS k FROM part)
SELECT id, CASE k WHEN 1 THEN 'key_too_long' WHEN 2 THEN 'key_has_equals' WHEN 3 THEN 'value_too_long'
  WHEN 4 THEN 'key_has_equals,value_too_long' WHEN 5 THEN 'too_many_tags' ELSE '' END AS errors FROM raw""")
def _(w: World):
    long_key, long_value = F.repeat(F.lit("k"), 65), F.repeat(F.lit("v"), 1025)
    k = F.col("id") % 6
    one = F.lit("1")
    many = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(101)), lambda i: i.cast("string")),
                             F.array_repeat(one, 101))
    tags = (F.when(k == 1, F.create_map(long_key, one)).when(k == 2, F.create_map(F.lit("a=b"), one))
            .when(k == 3, F.create_map(F.lit("a"), long_value)).when(k == 4, F.create_map(F.lit("a=b"), long_value))
            .when(k == 5, many).otherwise(F.create_map(F.lit("name\u0007"), F.lit(" ok\u0001"))))
    parts = w.table("part").select(F.col("p_partkey").alias("id"))
    return parts.select("id", F.array_join(T.tag_errors(tags), ",").alias("errors"))


@query("valid_coordinates", "O16", """
SELECT p_partkey AS id, abs(y) <= 90 AND abs(x) <= 180 AS ok FROM (
  SELECT p_partkey, CAST(p_partkey % 200 - 100 AS DOUBLE) AS y, CAST(p_partkey % 400 - 200 AS DOUBLE) AS x FROM part) t""")
def _(w: World):
    p = w.table("part")
    y, x = (F.col("p_partkey") % 200 - 100).cast("double"), (F.col("p_partkey") % 400 - 200).cast("double")
    return p.select(F.col("p_partkey").alias("id"), geo.valid_coord(y, x).alias("ok"))


@query("segment_meters", "O17", f"""
SELECT a.way_id, a.seq, floor({hav('n.lat', 'n.lon', 'm.lat', 'm.lon')} * 1000 + 0.5) / 1000 AS meters
FROM d_way_nodes a JOIN d_way_nodes b ON b.way_id = a.way_id AND b.seq = a.seq + 1
JOIN d_nodes n ON n.id = a.node_id JOIN d_nodes m ON m.id = b.node_id""")
def _(w: World):
    s = G.way_segments(w.way_nodes, w.nodes)
    m = geo.meters_between(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return s.select("way_id", (F.col("seq") - 1).cast("int").alias("seq"), geo.js_round(m, 3).alias("meters"))


@query("ring_areas", "O18", """
WITH p AS (SELECT x.way_id, x.seq, n.lat, n.lon, count(*) OVER (PARTITION BY x.way_id) AS n,
    avg(n.lat) OVER (PARTITION BY x.way_id) AS mid,
    first(n.lat) OVER (PARTITION BY x.way_id ORDER BY x.seq) AS y0, first(n.lon) OVER (PARTITION BY x.way_id ORDER BY x.seq) AS x0
  FROM d_way_nodes x JOIN d_nodes n ON n.id = x.node_id JOIN d_way_base b ON b.way_id = x.way_id WHERE b.kind = 2),
q AS (SELECT *, coalesce(lead(lat) OVER (PARTITION BY way_id ORDER BY seq), y0) AS lat2,
    coalesce(lead(lon) OVER (PARTITION BY way_id ORDER BY seq), x0) AS lon2 FROM p)
SELECT way_id, floor(abs(sum((lon - x0) * (lat2 - y0) - (lon2 - x0) * (lat - y0))) / 2 * cos(max(mid) * (pi() / 180))
    * pow(pi() / 180 * 6378137.0, 2) * 10 + 0.5) / 10 AS area_m2,
  floor(abs((max(lat) - min(lat)) * 110574.0 * (max(lon) - min(lon)) * 111320.0) * 10 + 0.5) / 10 AS bbox_m2,
  floor(avg(lat) * 1000000 + 0.5) / 1000000 AS c_lat, floor(avg(lon) * 1000000 + 0.5) / 1000000 AS c_lon,
  floor((min(lat) + 100 / 6378137.0 / (pi() / 180)) * 1000000 + 0.5) / 1000000 AS north_100m
FROM q GROUP BY way_id""")
def _(w: World):
    closed = w.ways.where("closed").select(F.col("id").alias("way_id"))
    g = G.way_geometry(w.way_nodes.join(closed, "way_id", "left_semi"), w.nodes)
    lat = F.transform("coords", lambda p: p["lat"])
    lon = F.transform("coords", lambda p: p["lon"])
    lo_lat, hi_lat, lo_lon, hi_lon = F.array_min(lat), F.array_max(lat), F.array_min(lon), F.array_max(lon)
    c = geo.centroid(F.col("coords"))
    return g.select("way_id", geo.js_round(geo.ring_area_m2(F.col("coords")), 1).alias("area_m2"),
                    geo.js_round(geo.bbox_area_m2(lo_lat, hi_lat, lo_lon, hi_lon), 1).alias("bbox_m2"),
                    geo.js_round(c["lat"], 6).alias("c_lat"), geo.js_round(c["lon"], 6).alias("c_lon"),
                    geo.js_round(geo.offset_lat(lo_lat, 100.0), 6).alias("north_100m"))


@query("pixel_sizes", "O19", """
SELECT id, zoom, floor(156543.03392804097 * cos(min_lat * (pi() / 180)) / pow(2, zoom) * 10000 + 0.5) / 10000 AS m_per_px
FROM d_features""")
def _(w: World):
    m = geo.meters_per_pixel(F.col("zoom"), F.col("min_lat"))
    return w.features.select("id", "zoom", geo.js_round(m, 4).alias("m_per_px"))


GEOMETRY = """
WITH g AS (SELECT x.way_id, x.seq, n.lat, n.lon FROM d_way_nodes x JOIN d_nodes_cut n ON n.id = x.node_id)
"""


@query("way_geometry", "O36", GEOMETRY + """
SELECT way_id, string_agg(concat(CAST(CAST(round(lat * 100000) AS BIGINT) AS VARCHAR), ' ',
    CAST(CAST(round(lon * 100000) AS BIGINT) AS VARCHAR)), ',' ORDER BY seq) AS points FROM g GROUP BY way_id""")
def _(w: World):
    g = G.way_geometry(w.way_nodes, w.nodes_cut)
    text = F.transform("coords", lambda p: F.concat_ws(" ", F.round(p["lat"] * 100000).cast("long").cast("string"),
                                                       F.round(p["lon"] * 100000).cast("long").cast("string")))
    return g.select("way_id", F.array_join(text, ",").alias("points"))


@query("way_bbox", "O51", GEOMETRY + """
SELECT way_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM g GROUP BY way_id""")
def _(w: World):
    return G.way_bbox(w.way_nodes, w.nodes_cut)


@query("way_length", "O52", GEOMETRY + f"""
, s AS (SELECT way_id, lat, lon, lag(lat) OVER (PARTITION BY way_id ORDER BY seq) AS plat,
    lag(lon) OVER (PARTITION BY way_id ORDER BY seq) AS plon FROM g)
SELECT way_id, floor(sum({hav('plat', 'plon', 'lat', 'lon')}) * 10 + 0.5) / 10 AS length_m
FROM s WHERE plat IS NOT NULL GROUP BY way_id""")
def _(w: World):
    return G.way_length(w.way_nodes, w.nodes_cut)


RESOLVED = """
WITH b AS (SELECT x.way_id, min(n.lat) AS y1, max(n.lat) AS y2, min(n.lon) AS x1, max(n.lon) AS x2
  FROM d_way_nodes x JOIN d_nodes_cut n ON n.id = x.node_id GROUP BY x.way_id),
r AS (SELECT m.relation_id, m.seq, m.member_type, m.member_ref, b.y1, b.y2, b.x1, b.x2
  FROM d_relation_members m JOIN b ON b.way_id = m.member_ref WHERE m.member_type = 'way'
  UNION ALL
  SELECT m.relation_id, m.seq, m.member_type, m.member_ref, n.lat, n.lat, n.lon, n.lon
  FROM d_relation_members m JOIN d_nodes_cut n ON n.id = m.member_ref WHERE m.member_type = 'node')
"""


@query("relation_member_extents", "O37", RESOLVED + """
SELECT relation_id, seq, member_type, member_ref, y1 AS min_lat, y2 AS max_lat, x1 AS min_lon, x2 AS max_lon FROM r""")
def _(w: World):
    ds = w.dataset.with_(nodes=w.nodes_cut)
    return G.relation_members_resolved(ds).drop("role")


@query("relation_bbox", "O53", RESOLVED + """
SELECT relation_id, min(y1) AS min_lat, max(y2) AS max_lat, min(x1) AS min_lon, max(x2) AS max_lon FROM r GROUP BY relation_id""")
def _(w: World):
    return G.relation_bbox(w.dataset.with_(nodes=w.nodes_cut))
