"""Map, transit and change-log tables derived from the given tables by SQL that Spark and DuckDB both run.

Ways come from orders, stations and lines from suppliers, features from parts, change log and observations from
events. The world is a lattice of blocks of 0.13 degrees, 14,400 ways each, so the covered area grows with the data and
the density stays that of a town. Coordinates are integers divided by 100,000 and are equal in both engines.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.functions.tags import parse_tags
from streetloom.model import OsmDataset

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# Tag sets that walk through the branches of the classification rules.
FEATURE_TAGS: list[dict[str, str]] = [
    {"highway": "motorway", "name": "Ring", "ref": "G1", "layer": "1", "bridge": "yes", "maxspeed": "120"},
    {"highway": "trunk_link", "ref": "G2", "maxspeed": "none"},
    {"highway": "primary", "maxspeed": "50 mph", "oneway": "yes"},
    {"highway": "secondary", "tunnel": "yes", "maxspeed": "abc"},
    {"highway": "tertiary", "layer": "-2", "surface": "gravel"},
    {"highway": "residential", "name": " Lane ", "maxspeed": "500"},
    {"highway": "footway", "bridge": "boardwalk"},
    {"highway": "cycleway"},
    {"highway": "ferry_ramp", "maxspeed": "3"},
    {"highway": "bus_stop", "name": "Stop", "bus": "yes"},
    {"railway": "rail", "usage": "main", "name:zh": "京沪线"},
    {"railway": "rail", "service": "yard"},
    {"railway": "subway", "tunnel": "yes", "maxspeed": "80"},
    {"railway": "station", "station": "subway", "name": "Central"},
    {"railway": "halt", "highspeed": "yes"},
    {"railway": "tram_stop"},
    {"railway": "platform", "ref": "3"},
    {"public_transport": "station", "bus": "yes"},
    {"public_transport": "platform", "tram": "yes"},
    {"public_transport": "stop_position"},
    {"waterway": "river", "name": "Yong"},
    {"waterway": "riverbank", "natural": "water"},
    {"natural": "water", "water": "lake"},
    {"natural": "coastline"},
    {"natural": "tree_row"},
    {"natural": "peak", "name": "Top", "ele": "812 m"},
    {"natural": "volcano", "ele": "99.5"},
    {"natural": "wood"},
    {"landuse": "forest", "name": "Grove"},
    {"landuse": "residential"},
    {"landuse": "reservoir"},
    {"leisure": "park"},
    {"leisure": "pitch", "sport": "soccer"},
    {"building": "apartments", "building:levels": "12", "addr:housenumber": "7"},
    {"building": "yes", "height": "10 m", "shop": "books"},
    {"building": "no", "building:part": "office", "building:levels": "2.5.1"},
    {"building": "house", "addr:housenumber": " 12a "},
    {"building": "yes", "landuse": "retail", "amenity": "bank"},
    {"amenity": "parking"},
    {"amenity": "restaurant", "name:en": "Diner"},
    {"amenity": "bus_station", "name:zh-Hans": "总站"},
    {"shop": "supermarket", "ref": "S9"},
    {"tourism": "hotel"},
    {"office": "it"},
    {"boundary": "administrative", "admin_level": "4", "type": "boundary"},
    {"boundary": "administrative", "admin_level": "8", "type": "boundary", "place": "town"},
    {"power": "line"},
    {"power": "tower"},
    {"barrier": "fence"},
    {"aeroway": "runway"},
    {"man_made": "pipeline"},
    {"place": "suburb", "name": "East"},
    {"type": "multipolygon", "landuse": "farmland"},
    {"type": "multipolygon", "highway": "pedestrian"},
    {"craft": "brewery", "note": "x"},
    {"note": "b", "fixme": "a", "source": "c", "created_by": "d"},
    {"highway": "service", "covered": "yes", "area": "yes"},
    {"highway": "living_street", "layer": "1.6", "psv": "yes"},
    {"historic": "ruins", "military": "bunker"},
]


def _feature_case() -> str:
    def quoted(tags: dict[str, str]) -> str:
        return "'" + json.dumps(tags, ensure_ascii=False, separators=(",", ":")) + "'"
    whens = " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(FEATURE_TAGS))
    return f"CASE p_partkey % {len(FEATURE_TAGS) + 1} {whens} END"


SQL: dict[str, str] = {}

SQL["d_way_base"] = """
SELECT b.*, 13000 * ((921 + CAST(floor((block + 2278) / 2760) AS BIGINT)) % 1230) - 8000000 AS lat0,
       13000 * ((block + 2278) % 2760) - 18000000 AS lon0
FROM (SELECT o_orderkey AS way_id, o_orderkey % 4 AS kind, CAST(floor(o_orderkey / 14400) AS BIGINT) AS block,
             (o_orderkey * 7919) % 120 AS gx,
             (o_orderkey * 31 + CAST(floor(o_orderkey / 120) AS BIGINT) * 47) % 120 AS gy,
             CASE WHEN o_orderkey % 4 = 2 THEN 5 ELSE 2 + o_orderkey % 5 END AS n,
             o_custkey, o_orderpriority
      FROM orders) b"""

SQL["d_way_nodes"] = """
SELECT w.way_id, CAST(s.i AS INT) AS seq,
       CASE WHEN w.kind = 0 THEN 1 + w.block * 1000000 + (w.gx + s.i) * 1000 + w.gy
            WHEN w.kind = 1 THEN 1 + w.block * 1000000 + w.gx * 1000 + w.gy + s.i
            WHEN w.kind = 2 THEN 10000000000000 + w.way_id * 10 + s.i % 4
            ELSE 10000000000000 + w.way_id * 10 + s.i END AS node_id
FROM d_way_base w CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS s(i)
WHERE s.i < w.n"""

SQL["d_nodes"] = """
SELECT node_id AS id, CAST(min(lat) AS DOUBLE) / 100000 AS lat, CAST(min(lon) AS DOUBLE) / 100000 AS lon,
       CAST(1 AS INT) AS version,
       CASE WHEN node_id < 10000000000000 AND node_id % 17 = 0
            THEN concat('{"highway":"bus_stop","name":"Stop ', CAST(node_id AS VARCHAR(20)), '"}') END AS tags
FROM (SELECT x.node_id,
        w.lat0 + CASE WHEN w.kind = 0 THEN w.gy * 100 WHEN w.kind = 1 THEN (w.gy + x.seq) * 100
             WHEN w.kind = 2 THEN w.gy * 100 + 30 + CASE WHEN x.seq IN (2, 3) THEN (2 + w.way_id % 7) * 10 ELSE 0 END
             ELSE w.gy * 100 + x.seq * 170 END AS lat,
        w.lon0 + CASE WHEN w.kind = 0 THEN (w.gx + x.seq) * 100 WHEN w.kind = 1 THEN w.gx * 100
             WHEN w.kind = 2 THEN w.gx * 100 + 30 + CASE WHEN x.seq IN (1, 2) THEN (2 + w.way_id % 7) * 10 ELSE 0 END
             ELSE w.gx * 100 + x.seq * 230 END AS lon
      FROM d_way_nodes x JOIN d_way_base w ON w.way_id = x.way_id) t
GROUP BY node_id"""

SQL["d_ways"] = """
SELECT way_id AS id, CAST(1 + way_id % 3 AS INT) AS version, CAST(n AS INT) AS node_count, kind = 2 AS closed,
  CASE WHEN kind < 2 THEN concat('{"highway":"',
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary'
              WHEN '3' THEN 'tertiary' WHEN '4' THEN 'residential' ELSE 'service' END,
         '","name":"Road ', CAST(way_id % 50 AS VARCHAR(20)), '"}')
       WHEN kind = 2 AND way_id % 20 = 2 THEN '{"landuse":"commercial"}'
       WHEN kind = 2 AND way_id % 20 = 6 THEN '{"leisure":"park","name":"Green"}'
       WHEN kind = 2 THEN concat('{"building":"',
         CASE way_id % 3 WHEN 0 THEN 'apartments' WHEN 1 THEN 'yes' ELSE 'office' END,
         '","building:levels":"', CAST(1 + way_id % 9 AS VARCHAR(20)), '"',
         CASE WHEN way_id % 11 = 0 THEN ',"shop":"books"' ELSE '' END, '}')
       ELSE concat('{"railway":"rail"', CASE WHEN way_id % 3 = 0 THEN ',"usage":"main"' ELSE '' END, '}') END AS tags
FROM d_way_base"""

# The last nodes of some ways are not in this extract, as at the border of a cut file.
SQL["d_nodes_cut"] = "SELECT * FROM d_nodes WHERE id % 97 <> 0"

SQL["d_relation_members"] = """
SELECT o_custkey AS relation_id, way_id AS seq,
       CASE WHEN way_id % 13 = 0 THEN 'node' WHEN way_id % 17 = 0 THEN 'relation' ELSE 'way' END AS member_type,
       CASE WHEN way_id % 13 = 0 THEN 1 + block * 1000000 + gx * 1000 + gy
            WHEN way_id % 17 = 0 THEN o_custkey + 1 ELSE way_id END AS member_ref,
       CASE WHEN kind = 2 THEN CASE WHEN way_id % 3 = 0 THEN 'inner' ELSE 'outer' END ELSE '' END AS role
FROM d_way_base"""

SQL["d_relations"] = """
SELECT o_custkey AS id, CAST(1 + o_custkey % 4 AS INT) AS version, CAST(count(*) AS INT) AS member_count,
       CASE o_custkey % 4 WHEN 0 THEN '{"type":"multipolygon","landuse":"forest"}'
            WHEN 1 THEN '{"type":"route","route":"bus"}'
            WHEN 2 THEN '{"type":"boundary","boundary":"administrative","admin_level":"6"}'
            ELSE '{"type":"multipolygon","building":"yes"}' END AS tags
FROM orders GROUP BY o_custkey"""

SQL["d_features"] = f"""
SELECT p_partkey AS id, {_feature_case()} AS tags, CAST(p_size AS INT) AS size, p_partkey % 3 <> 0 AS closed,
       CAST(p_partkey % 20 AS INT) AS zoom,
       CAST(p_partkey % 16000 - 8000 AS DOUBLE) / 100 AS min_lat,
       CAST((p_partkey % 16000 - 8000) * 1000 + p_size * 5 AS DOUBLE) / 100000 AS max_lat,
       CAST((p_partkey * 7) % 34000 - 17000 AS DOUBLE) / 100 AS min_lon,
       CAST(((p_partkey * 7) % 34000 - 17000) * 1000 + p_size * 7 AS DOUBLE) / 100000 AS max_lon
FROM part"""

SQL["d_changes"] = """
SELECT event_id AS id, CAST(floor(event_id / 20) AS BIGINT) AS changeset_id, 'way' AS elem_type,
       CAST(floor(event_id / 1000) AS BIGINT) * 200 + (event_id * 31) % 200 AS elem_id,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS action,
       ts, user_id AS author, value, event_id % 29 = 0 AS undone
FROM events"""

SQL["d_stations"] = """
SELECT s_suppkey AS id,
       CAST(13000 * ((921 + CAST(floor((blk + 2278) / 2760) AS BIGINT)) % 1230) - 8000000
            + ((s_suppkey * 37) % 120) * 100 + 17 AS DOUBLE) / 100000 AS lat,
       CAST(13000 * ((blk + 2278) % 2760) - 18000000
            + ((s_suppkey * 53 + CAST(floor(s_suppkey / 120) AS BIGINT) * 7) % 120) * 100 + 23 AS DOUBLE) / 100000 AS lon,
       CAST(450 + (s_suppkey % 4) * 250 AS INT) AS catchment_m,
       CASE s_suppkey % 5 WHEN 0 THEN 'subway' WHEN 1 THEN 'rail' WHEN 2 THEN 'bus' WHEN 3 THEN 'tram' ELSE 'rail' END AS kind,
       concat('St ', CAST(s_suppkey AS VARCHAR(20))) AS name
FROM (SELECT s_suppkey, CAST(floor(s_suppkey / 100) AS BIGINT) AS blk FROM supplier) s"""

# Six new stations per line, and the first four of the next line as well, so that lines meet.
SQL["d_line_stops"] = """
SELECT CAST(floor(s_suppkey / 6) AS BIGINT) AS line_id, CAST(s_suppkey % 6 AS INT) AS idx, s_suppkey AS station_id FROM supplier
UNION ALL
SELECT CAST(floor(s_suppkey / 6) AS BIGINT) - 1 AS line_id, CAST(6 + s_suppkey % 6 AS INT) AS idx, s_suppkey AS station_id
FROM supplier WHERE s_suppkey % 6 < 4 AND s_suppkey >= 6"""

SQL["d_lines"] = """
SELECT line_id AS id, CASE line_id % 3 WHEN 0 THEN 'subway' WHEN 1 THEN 'rail' ELSE 'bus' END AS kind,
       concat('Line ', CAST(line_id AS VARCHAR(20))) AS name, CAST(count(*) AS INT) AS n_stops, line_id % 4 = 0 AS is_loop
FROM d_line_stops GROUP BY line_id"""

# Three boxes per block at different zooms: parts of it, and one that covers it all.
SQL["d_views"] = """
SELECT b.block * 10 + k.i AS view_id, CAST(k.z AS INT) AS zoom,
       CAST(b.lat0 + k.a AS DOUBLE) / 100000 AS min_lat, CAST(b.lat0 + k.b AS DOUBLE) / 100000 AS max_lat,
       CAST(b.lon0 + k.c AS DOUBLE) / 100000 AS min_lon, CAST(b.lon0 + k.d AS DOUBLE) / 100000 AS max_lon
FROM (SELECT DISTINCT block, lat0, lon0 FROM d_way_base) b
CROSS JOIN (VALUES (1, 14, 2005, 6005, 3005, 7005), (2, 16, 155, 3333, 8001, 9995), (3, 12, -5, 13005, -5, 13105)) AS k(i, z, a, b, c, d)"""

# A second copy of the dataset that drifted: some elements newer, some edited without a new version, some gone, some moved.
SQL["d_ways_b"] = """
SELECT id + CASE WHEN id % 50 = 7 THEN 9000000000000 ELSE 0 END AS id,
       CAST(version + CASE WHEN id % 31 = 0 THEN 1 WHEN id % 47 = 0 THEN -1 ELSE 0 END AS INT) AS version,
       CAST(node_count + CASE WHEN id % 37 = 0 THEN 1 ELSE 0 END AS INT) AS node_count, closed,
       CASE WHEN id % 41 = 0 THEN '{"note":"edited"}' ELSE tags END AS tags
FROM d_ways WHERE id % 43 <> 5"""
SQL["d_nodes_b"] = """
SELECT id, lat + CASE WHEN id % 53 = 0 THEN 0.5 ELSE 0 END AS lat, lon, version, tags FROM d_nodes WHERE id % 59 <> 1"""

# The log with snapshots of the one edited value.
SQL["d_log"] = """
SELECT *, CASE WHEN action <> 'create' THEN lag(CASE WHEN action <> 'delete' THEN txt END) OVER (PARTITION BY elem_id ORDER BY id) END AS before,
       CASE WHEN action <> 'delete' THEN txt END AS after
FROM (SELECT *, concat('v', CAST(id AS VARCHAR(20))) AS txt FROM d_changes) c"""

SQL["d_schedules"] = """
SELECT id AS line_id, CASE WHEN id % 4 = 3 THEN 'timetable' ELSE 'headway' END AS mode, CAST(18000 + (id % 5) * 600 AS INT) AS first_sec,
       CAST(72000 + (id % 3) * 3600 AS INT) AS last_sec, CAST(420 + (id % 7) * 300 AS INT) AS headway_sec FROM d_lines"""

SQL["d_vehicles"] = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(floor(c_custkey / 90) AS BIGINT) END AS line_id,
       CASE c_custkey % 3 WHEN 0 THEN 'metro' WHEN 1 THEN 'bus' ELSE 'tram' END AS kind, CAST(50 + (c_custkey % 4) * 15 AS INT) AS max_speed, c_nationkey AS owner,
       CAST(39.73 AS DOUBLE) + CAST((c_custkey * 37) % 1200 AS DOUBLE) / 10000 AS lat, CAST(116.14 AS DOUBLE) + CAST((c_custkey * 53) % 1250 AS DOUBLE) / 10000 AS lon
FROM customer"""

# Stop observations: each order is a run, its way's references are the stops.
SQL["d_obs"] = """
SELECT r.way_id AS run_id, r.seq AS idx, w.o_custkey AS vehicle_id, CAST(floor(w.o_custkey / 90) AS BIGINT) AS line_id, r.seq = 0 AS origin,
       r.way_id % 5 <> 0 AS scheduled, r.way_id % 3 = 1 AS bus, CAST(20000 + r.way_id % 3600 + r.seq * 180 AS BIGINT) AS planned_arr,
       CAST(20000 + r.way_id % 3600 + r.seq * 180 + 30 AS BIGINT) AS planned_dep,
       CAST(20000 + r.way_id % 3600 + r.seq * 180 + (r.way_id * 7 + r.seq * 31) % 190 - 70 AS BIGINT) AS arrived,
       CAST(20000 + r.way_id % 3600 + r.seq * 180 + (r.way_id * 7 + r.seq * 31) % 190 - 70 + 25 + (r.way_id + r.seq * 3) % 40 AS BIGINT) AS departed,
       CAST((r.way_id * 3 + r.seq) % 20 AS INT) AS blocked_sec, CAST((r.way_id + r.seq * 5) % 22 AS INT) AS congest_sec, r.seq = 0 AND r.way_id % 11 = 0 AS late_start
FROM d_way_nodes r JOIN d_way_base w ON w.way_id = r.way_id"""

# Waiting groups and daily statistics from line items.
SQL["d_cohorts"] = """
SELECT l_suppkey AS station_id, CAST(l_linenumber AS BIGINT) AS company_id, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST(floor(l_suppkey / 6) AS BIGINT) + l_partkey % 3 END AS line_id,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(floor(l_suppkey / 6) AS BIGINT) * 6 + l_partkey % 6 END AS dest_id, CAST(l_quantity AS DOUBLE) / 16 AS people,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DOUBLE) / 32 ELSE 0 END AS lost, CAST(l_orderkey % 4000 AS INT) AS start_sec,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(floor(l_suppkey / 6) AS BIGINT) + l_partkey % 2 END AS plan_line,
       CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 10 = 1 THEN l_suppkey + 1 ELSE l_suppkey END AS plan_from, l_orderkey, l_partkey
FROM lineitem"""
SQL["d_ride_events"] = """
SELECT CAST(floor(l_suppkey / 6) AS BIGINT) AS line_id, l_suppkey AS station_id, CAST(1 + l_orderkey % 40 AS INT) AS day, CAST(l_quantity AS DOUBLE) AS riders,
       CAST(l_linenumber AS DOUBLE) AS transfers, CAST(l_partkey % 100 AS DOUBLE) / 8 AS vehicle_km, CAST(l_quantity AS DOUBLE) / 64 AS load_sum, CAST(1 AS BIGINT) AS load_n,
       CAST(l_partkey % 600 AS DOUBLE) AS wait_sum, CAST(1 + l_linenumber % 3 AS BIGINT) AS wait_n,
       CASE l_linenumber % 3 WHEN 0 THEN 'board' WHEN 1 THEN 'alight' ELSE 'transfer' END AS kind FROM lineitem"""

# Which name needs which: found by scanning the text.
_NAME = re.compile(r"\b([do]_[a-z_]+[a-z])\b")

# DuckDB-only helpers: the same tables with the tag text as a map ``t``.
for _n in ("nodes", "ways", "features", "relations"):
    SQL[f"o_{_n}"] = f"SELECT *, CAST(json(tags) AS MAP(VARCHAR, VARCHAR)) AS t FROM d_{_n}"


def with_clause(text: str) -> str:
    """``WITH`` list of every derived table that ``text`` names, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _NAME.findall(sql):
            if name in SQL and name not in order:
                visit(SQL[name])
                order.append(name)
    visit(text)
    return ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in order)


def complete_sql(text: str) -> str:
    """Prefix a statement (which may start with its own WITH list) with the derived tables it needs."""
    head = with_clause(text)
    body = text.strip()
    if not head:
        return body
    m = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if m:
        return f"WITH {'RECURSIVE ' if m.group(1) else ''}{head},\n{body[m.end():]}"
    return f"WITH {head}\n{body}"


class World:
    """Lazy access to the given tables and the derived ones for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        full = complete_sql(text)
        for name in TABLES:
            if re.search(rf"\b{name}\b", full):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(full)

    def raw(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def tagged(self, name: str) -> DataFrame:
        return self.raw(name).withColumn("tags", parse_tags(F.col("tags")))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.tagged("d_nodes")

    @cached_property
    def nodes_cut(self) -> DataFrame:
        return self.tagged("d_nodes_cut")

    @cached_property
    def ways(self) -> DataFrame:
        return self.tagged("d_ways")

    @cached_property
    def way_nodes(self) -> DataFrame:
        return self.raw("d_way_nodes")

    @cached_property
    def relations(self) -> DataFrame:
        return self.tagged("d_relations")

    @cached_property
    def relation_members(self) -> DataFrame:
        return self.raw("d_relation_members")

    @cached_property
    def features(self) -> DataFrame:
        return self.tagged("d_features")

    @cached_property
    def changes(self) -> DataFrame:
        return self.raw("d_changes").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def stations(self) -> DataFrame:
        return self.raw("d_stations")

    @cached_property
    def line_stops(self) -> DataFrame:
        return self.raw("d_line_stops")

    @cached_property
    def lines(self) -> DataFrame:
        return self.raw("d_lines")

    @cached_property
    def views(self) -> DataFrame:
        return self.raw("d_views")

    @cached_property
    def dataset(self) -> OsmDataset:
        return OsmDataset(self.nodes, self.ways, self.way_nodes, self.relations, self.relation_members)
