"""Classification of features, zoom rules, labels, speeds, time and demand expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from streetloom.catalog import query
from streetloom.functions import demand as D, geo, roads as R, sql as SQL, tags as T
from streetloom.operators import rules as RU, spatial
from streetloom.plans.demo import World

RANK_SQL = """CASE WHEN t['highway'] IS NULL THEN NULL
 WHEN t['highway'] IN ('motorway','motorway_link','trunk','trunk_link','primary','primary_link') THEN 0
 WHEN t['highway'] IN ('secondary','secondary_link') THEN 1 WHEN t['highway'] IN ('tertiary','tertiary_link') THEN 2
 WHEN t['highway'] IN ('unclassified','residential','road','living_street') THEN 3
 WHEN t['highway'] IN ('service','track','footway','path','steps','cycleway','bridleway','pedestrian','construction',
   'proposed','busway','bus_guideway','raceway','corridor','platform') THEN 4 ELSE 5 END"""
LINE_ZOOM_SQL = f"""CASE WHEN t IS NULL THEN 17
 WHEN t['highway'] IS NOT NULL THEN CASE ({RANK_SQL}) WHEN 0 THEN 9 WHEN 1 THEN 12 WHEN 2 THEN 13 WHEN 3 THEN 14 ELSE 16 END
 WHEN t['railway'] IS NOT NULL THEN CASE WHEN t['usage'] = 'main' OR t['railway'] = 'rail' THEN 10
   WHEN t['railway'] IN ('subway','light_rail','tram') THEN 13 WHEN t['railway'] = 'platform' THEN 16 ELSE 14 END
 WHEN t['waterway'] IS NOT NULL THEN 12 WHEN t['natural'] = 'water' THEN 9
 WHEN t['building'] IS NOT NULL OR t['building:part'] IS NOT NULL THEN 15
 WHEN coalesce(t['landuse'], t['natural'], t['leisure'], t['amenity'], t['shop'], t['tourism'], t['office'], t['man_made'],
   t['aeroway']) IS NOT NULL THEN CASE WHEN t['landuse'] IN ('residential','commercial','industrial','forest')
     OR t['amenity'] = 'parking' OR t['leisure'] = 'park' THEN 13 ELSE 15 END
 WHEN t['boundary'] = 'administrative' THEN CASE WHEN coalesce(TRY_CAST(t['admin_level'] AS DOUBLE), 8) <= 4 THEN 6
   WHEN coalesce(TRY_CAST(t['admin_level'] AS DOUBLE), 8) <= 6 THEN 9 ELSE 12 END
 WHEN t['power'] IN ('line','minor_line') THEN 14 WHEN t['barrier'] IS NOT NULL THEN 17 ELSE 16 END"""
POINT_ZOOM_SQL = """CASE WHEN t IS NULL THEN 17 WHEN t['place'] IS NOT NULL THEN 8
 WHEN t['natural'] IN ('peak','spring','cave_entrance') THEN 13
 WHEN coalesce(t['amenity'], t['shop'], t['tourism'], t['office'], t['craft'], t['leisure'], t['historic'], t['healthcare'],
   t['emergency'], t['public_transport']) IS NOT NULL OR t['railway'] IN ('station','halt')
   OR t['highway'] IN ('bus_stop','traffic_signals') OR t['man_made'] = 'tower' OR t['power'] = 'tower' THEN 16 ELSE 17 END"""
WATER_SQL = """(t['waterway'] IS NOT NULL OR t['water'] IS NOT NULL
 OR coalesce(t['natural'] IN ('water','bay','strait','coastline','spring'), false)
 OR coalesce(t['landuse'] IN ('basin','salt_pond','reservoir'), false)
 OR coalesce(t['leisure'] IN ('swimming_pool','marina','water_park'), false))"""
CATEGORY_SQL = f"""CASE WHEN t['building'] IS NOT NULL OR t['building:part'] IS NOT NULL THEN 'building'
 WHEN t['boundary'] IS NOT NULL THEN 'boundary' WHEN t['power'] IS NOT NULL THEN 'power' WHEN t['barrier'] IS NOT NULL THEN 'barrier'
 WHEN t['highway'] IN ('footway','path','steps','cycleway','bridleway','corridor','track') THEN 'path'
 WHEN t['highway'] IN ('bus_stop','platform','bus_guideway') THEN 'transport' WHEN t['highway'] IS NOT NULL THEN 'road'
 WHEN t['railway'] IN ('station','halt','tram_stop','subway_entrance','stop','platform') THEN 'transport'
 WHEN t['railway'] IS NOT NULL THEN 'railway'
 WHEN coalesce(t['aeroway'], t['public_transport'], t['route']) IS NOT NULL THEN 'transport'
 WHEN {WATER_SQL} THEN 'water'
 WHEN t['amenity'] IN ('bus_station','taxi','ferry_terminal','parking','parking_entrance','bicycle_parking','bicycle_rental',
   'motorcycle_parking','car_rental','car_sharing','charging_station') THEN 'transport'
 WHEN coalesce(t['amenity'], t['shop'], t['tourism'], t['historic'], t['office'], t['craft'], t['healthcare'], t['emergency'])
   IS NOT NULL THEN 'poi'
 WHEN coalesce(t['landuse'], t['leisure'], t['natural'], t['man_made'], t['military']) IS NOT NULL THEN 'landuse' ELSE 'other' END"""


@query("road_ranks", "O20", f"SELECT id, CAST({RANK_SQL} AS INT) AS road_rank FROM o_features")
def _(w: World):
    t = F.col("tags")
    return w.features.select("id", T.road_rank(t).alias("road_rank"))


@query("zoom_visibility", "O21", f"""
SELECT id, zoom, zoom >= {LINE_ZOOM_SQL} AS as_line, zoom >= {POINT_ZOOM_SQL} AS as_point,
  zoom >= CASE WHEN t['highway'] IS NOT NULL AND ({RANK_SQL}) = 0 THEN 7 ELSE {LINE_ZOOM_SQL} END AS as_line_floor7
FROM o_features""")
def _(w: World):
    t = F.col("tags")
    z = F.col("zoom")
    return w.features.select("id", "zoom", T.lod_visible(t, z).alias("as_line"), T.lod_visible(t, z, "point").alias("as_point"),
                             T.lod_visible(t, z, "line", {"trunk": 7}).alias("as_line_floor7"))


@query("lod_keys", "O22", f"""
SELECT id, CAST(coalesce({RANK_SQL}, -1) AS INT) AS road_class, CAST(least({LINE_ZOOM_SQL}, 18) AS INT) AS lod_zoom FROM o_ways""")
def _(w: World):
    t = F.col("tags")
    cls, zoom = T.lod_keys(t)
    return w.ways.select("id", cls.alias("road_class"), zoom.alias("lod_zoom"))


WITHHOLD_SQL = f"""CASE WHEN t IS NULL THEN NULL
 WHEN t['natural'] IN ('tree','tree_row') OR t['highway'] = 'cycleway' THEN 'neverSend'
 WHEN ({RANK_SQL}) IS NOT NULL THEN CASE WHEN ({RANK_SQL}) > 0 AND ({RANK_SQL}) > send THEN 'roadClass' END
 WHEN t['railway'] IS NOT NULL THEN CASE WHEN t['railway'] = 'rail' AND coalesce(t['usage'], '') <> 'main'
    AND (zoom < 14 OR send < 3) THEN 'railMinor' END
 WHEN t['waterway'] IS NOT NULL OR t['boundary'] = 'administrative' OR t['natural'] IN ('water','coastline') THEN NULL
 WHEN (t['landuse'] IS NOT NULL OR t['leisure'] IS NOT NULL) AND t['building'] IS NULL AND t['building:part'] IS NULL
    AND coalesce(t['landuse'], '') NOT IN ('reservoir','basin') AND coalesce(t['natural'], '') <> 'bay'
    AND closed AND need > 0 AND area < need THEN 'landuse'
 WHEN t['building'] IS NULL AND t['building:part'] IS NULL THEN NULL
 WHEN zoom < CASE WHEN t['name'] IS NOT NULL OR t['amenity'] IS NOT NULL OR t['shop'] IS NOT NULL OR t['tourism'] IS NOT NULL
    OR coalesce(TRY_CAST(regexp_extract(regexp_replace(t['building:levels'], '[^0-9.]', '', 'g'), '^[0-9]+(\\.[0-9]*)?') AS DOUBLE), 0) >= 5
    THEN 15 ELSE 16 END + CASE WHEN t['landuse'] IS NOT NULL OR t['natural'] IS NOT NULL OR t['place'] IS NOT NULL
    THEN 0 ELSE 1 END THEN 'building'
 WHEN area < 150 THEN 'building' END"""
WITHHOLD_INPUT = """(SELECT *, CASE WHEN zoom >= 19 THEN 5 WHEN zoom >= 15 THEN 4 WHEN zoom >= 14 THEN 2 WHEN zoom >= 13 THEN 1 ELSE 0 END AS send,
   CASE WHEN zoom <= 13 THEN 20000 WHEN zoom <= 14 THEN 6000 WHEN zoom <= 15 THEN 1500 WHEN zoom <= 16 THEN 400 ELSE 0 END AS need,
   abs((max_lat - min_lat) * 110574 * (max_lon - min_lon) * 111320) AS area FROM o_features) f"""


@query("withhold_class", "O23", f"SELECT id, zoom, {WITHHOLD_SQL} AS withheld FROM {WITHHOLD_INPUT}")
def _(w: World):
    t = F.col("tags")
    area = geo.bbox_area_m2(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
    cls = T.lod_withhold(t, F.col("zoom"), area, F.col("closed"), min_fill_area=150)
    return w.features.select("id", "zoom", cls.alias("withheld"))


@query("feature_category", "O24", f"SELECT id, {CATEGORY_SQL} AS category FROM o_features")
def _(w: World):
    t = F.col("tags")
    return w.features.select("id", T.category_of(t).alias("category"))


STYLE_RULES = """SELECT * FROM VALUES
 (1, 3, array('line'), map('highway', array('motorway', 'trunk', 'primary'))),
 (2, 3, array('line'), map('highway', array('*'))),
 (3, 5, array('line'), map('highway', array('*'), 'bridge', array('yes'))),
 (4, 2, array('line', 'area'), map('natural', array('water'))),
 (5, 4, array('line'), map('railway', array('rail', 'subway'))),
 (6, 1, array('area', 'line'), map('landuse', array('*'))),
 (7, 6, array('area'), map('building', array('*'))),
 (8, 1, array('line'), map('waterway', array('*'))),
 (9, 2, array('line'), map('waterway', array('river')))
 AS r(ord, layer, geo, conditions)"""


@query("style_rules", "O25", """
SELECT * FROM (SELECT id, CAST(CASE WHEN t['highway'] IS NOT NULL AND t['bridge'] = 'yes' THEN 3 WHEN t['railway'] IN ('rail','subway') THEN 5
   WHEN t['highway'] IN ('motorway','trunk','primary') THEN 1 WHEN t['highway'] IS NOT NULL THEN 2
   WHEN t['natural'] = 'water' THEN 4 WHEN t['waterway'] = 'river' THEN 9 WHEN t['landuse'] IS NOT NULL THEN 6
   WHEN t['waterway'] IS NOT NULL THEN 8 END AS INT) AS ord,
  CAST(CASE WHEN t['highway'] IS NOT NULL AND t['bridge'] = 'yes' THEN 5 WHEN t['railway'] IN ('rail','subway') THEN 4
   WHEN t['highway'] IS NOT NULL THEN 3 WHEN t['natural'] = 'water' OR t['waterway'] = 'river' THEN 2
   ELSE 1 END AS INT) AS layer FROM o_features) s WHERE ord IS NOT NULL""")
def _(w: World):
    return RU.match_rules(w.features, w.spark.sql(STYLE_RULES), "line")


PRIORITY_SQL = f"""CASE WHEN t['highway'] IN ('motorway','motorway_link','trunk','trunk_link') THEN 9
 WHEN t['highway'] IN ('primary','primary_link') THEN 8 WHEN t['highway'] IN ('secondary','secondary_link') THEN 7
 WHEN t['highway'] IN ('tertiary','tertiary_link') THEN 6
 WHEN t['highway'] IN ('unclassified','residential','living_street','pedestrian') THEN 5
 WHEN t['highway'] IN ('service','track','road') THEN 4 WHEN t['highway'] IS NOT NULL THEN 3
 WHEN t['place'] = 'city' THEN 10 WHEN t['place'] = 'town' THEN 9 WHEN t['place'] IN ('borough','village') THEN 8
 WHEN t['place'] IN ('suburb','quarter') THEN 7 WHEN t['place'] IN ('neighbourhood','hamlet','square','island') THEN 6
 WHEN t['place'] IN ('isolated_dwelling','locality','farm','islet') THEN 5
 WHEN t['natural'] IN ('peak','volcano') THEN 8
 WHEN t['railway'] IN ('station','halt') OR t['public_transport'] = 'station' OR t['aeroway'] = 'aerodrome' THEN 7
 WHEN t['railway'] IS NOT NULL THEN 5 WHEN {WATER_SQL} THEN 6 WHEN t['boundary'] IS NOT NULL THEN 5
 WHEN t['building'] IS NOT NULL OR t['building:part'] IS NOT NULL THEN 4
 WHEN coalesce(t['amenity'], t['shop'], t['tourism'], t['historic'], t['office'], t['craft'], t['healthcare'], t['emergency'])
   IS NOT NULL THEN 5
 WHEN coalesce(t['leisure'], t['landuse'], t['natural'], t['man_made'], t['military']) IS NOT NULL THEN 4 ELSE 5 END"""


@query("labels_on_map", "O26", f"""
WITH n AS (SELECT *, coalesce(nullif(trim(t['name']), ''), nullif(trim(t['name:zh']), '')) AS nm,
   nullif(trim(regexp_replace(trim(t['ele']), '\\s*m$', '', 'i')), '') AS ele FROM o_features)
SELECT id, label, CAST(priority AS INT) AS priority FROM (SELECT id,
  CASE WHEN t['natural'] IN ('peak','volcano') THEN CASE WHEN nm IS NOT NULL AND ele IS NOT NULL THEN concat(nm, ' (', ele, ' m)')
      WHEN nm IS NOT NULL THEN nm WHEN ele IS NOT NULL THEN concat(ele, ' m') END
    WHEN nm IS NOT NULL THEN nm WHEN t['ref'] IS NOT NULL THEN trim(t['ref'])
    WHEN t['building'] IS NOT NULL THEN trim(t['addr:housenumber']) END AS label,
  CASE WHEN t['natural'] IN ('peak','volcano') THEN CASE WHEN nm IS NOT NULL THEN 8 WHEN ele IS NOT NULL THEN 6 END
    WHEN nm IS NOT NULL THEN {PRIORITY_SQL}
    WHEN t['ref'] IS NOT NULL THEN CASE WHEN t['highway'] IN ('motorway','motorway_link','trunk','trunk_link') THEN 7
      WHEN t['highway'] IN ('primary','primary_link') THEN 6
      WHEN coalesce(t['highway'], t['railway'], t['route'], t['public_transport'], t['aeroway']) IS NOT NULL THEN 5 ELSE 4 END
    WHEN t['building'] IS NOT NULL AND t['addr:housenumber'] IS NOT NULL THEN 2 END AS priority
  FROM n) s WHERE label IS NOT NULL""")
def _(w: World):
    t = F.col("tags")
    lab = T.label_of(t)
    return w.features.select("id", lab["text"].alias("label"), lab["priority"].alias("priority")).where("label IS NOT NULL")


FIRST_KEYS_SQL = "concat('tags:', array_to_string(list_sort(map_keys(t))[1:3], ','))"
LINE_CLASS_SQL = f"""CASE WHEN t IS NULL THEN NULL WHEN t['highway'] IS NOT NULL THEN concat('highway=', t['highway'])
 WHEN t['railway'] IS NOT NULL THEN concat('railway=', t['railway']) WHEN t['waterway'] IS NOT NULL THEN concat('waterway=', t['waterway'])
 WHEN t['natural'] = 'coastline' THEN 'natural=coastline' WHEN t['natural'] IN ('water','bay','strait') THEN NULL
 WHEN t['boundary'] = 'administrative' THEN concat('boundary@', coalesce(t['admin_level'], ''))
 WHEN t['power'] IN ('line','minor_line') THEN concat('power=', t['power']) WHEN t['man_made'] = 'pipeline' THEN 'man_made=pipeline'
 WHEN t['aeroway'] IS NOT NULL THEN concat('aeroway=', t['aeroway']) WHEN t['barrier'] IS NOT NULL THEN concat('barrier=', t['barrier'])
 ELSE {FIRST_KEYS_SQL} END"""
LINE_FAMILY_SQL = """CASE WHEN cls LIKE 'highway=%' THEN 'road' WHEN cls LIKE 'railway=%' THEN 'railway' WHEN cls LIKE 'waterway=%' THEN 'waterway'
 WHEN cls = 'natural=coastline' THEN 'water' WHEN cls LIKE 'boundary@%' THEN 'boundary' ELSE 'other' END"""
LINE_ALWAYS_SQL = """CASE WHEN cls IS NULL THEN false
 WHEN cls LIKE 'highway=%' THEN substr(cls, 9) IN ('motorway','motorway_link','trunk','trunk_link','primary','primary_link')
 WHEN cls LIKE 'railway=%' THEN substr(cls, 9) NOT IN ('platform','station','halt','turntable','roundhouse')
 WHEN cls LIKE 'waterway=%' THEN substr(cls, 10) NOT IN ('riverbank','dock','boatyard')
 ELSE cls = 'natural=coastline' OR cls LIKE 'boundary@%' END"""


def _part(key: str) -> str:
    return f"coalesce(t['{key}'], '')"


@query("line_classes", "O27", f"""
SELECT id, cls, {LINE_FAMILY_SQL} AS family, {LINE_ALWAYS_SQL} AS always,
  replace(concat(cls, chr(1), {", chr(1), ".join(_part(k) for k in ["name", "bridge", "tunnel", "layer", "surface"])}), chr(1), '|') AS group_key
FROM (SELECT id, t, {LINE_CLASS_SQL} AS cls FROM o_features) f WHERE cls IS NOT NULL""")
def _(w: World):
    t = F.col("tags")
    cls = F.col("cls")
    return w.features.withColumn("cls", T.line_class(t)).where(cls.isNotNull()).select(
        "id", "cls", T.line_family(cls).alias("family"), T.line_always(cls).alias("always"),
        F.regexp_replace(T.line_group_key(cls, t), T.KEY_SEPARATOR, "|").alias("group_key"))


AREA_CLASS_SQL = "CASE WHEN t IS NULL THEN NULL " + " ".join(
    f"WHEN t['{k}'] IS NOT NULL THEN concat('{k}=', t['{k}']"
    + (", '@', coalesce(t['admin_level'], ''))" if k == "boundary" else ")")
    for k in ["waterway", "natural", "landuse", "leisure", "amenity", "shop", "tourism", "historic", "building", "place",
              "man_made", "aeroway", "military", "power", "boundary", "golf", "sport", "healthcare", "office", "craft",
              "emergency", "highway", "railway", "barrier"]) + f" ELSE {FIRST_KEYS_SQL} END"
AREA_FAMILY_SQL = """CASE WHEN cls LIKE 'natural=water%' OR cls LIKE 'natural=coastline%' OR cls LIKE 'natural=bay%'
   OR cls LIKE 'natural=strait%' OR cls LIKE 'waterway=%' THEN 'water'
 WHEN cls LIKE 'landuse=%' OR cls LIKE 'leisure=%' OR cls LIKE 'natural=%' THEN 'landuse'
 WHEN cls LIKE 'building=%' THEN 'building' WHEN cls LIKE 'boundary=%' THEN 'boundary' ELSE 'other' END"""


@query("area_classes", "O28", f"""
SELECT id, cls, {AREA_FAMILY_SQL} AS family,
  replace(concat(cls, chr(1), {", chr(1), ".join(_part(k) for k in ["name", "bridge", "tunnel", "layer"])}), chr(1), '|') AS group_key,
  coalesce(t['type'] IN ('multipolygon','boundary') AND t['highway'] IS NULL AND t['railway'] IS NULL AND t['waterway'] IS NULL
    AND t['barrier'] IS NULL AND cls NOT LIKE 'tags:%' AND coalesce(t['building'], t['building:part'], t['landuse'], t['leisure'],
      t['natural'], t['water'], t['wetland'], t['amenity'], t['place']) IS NOT NULL, false) AS area_like,
  array_to_string(list_filter(list_sort(map_keys(t)), lambda k: k IN ('name','ref','bridge','tunnel','layer','surface')
     OR (cls NOT LIKE 'tags:%' AND (k = split_part(cls, '=', 1) OR (k = 'admin_level' AND cls LIKE 'boundary=%')))
     OR (cls LIKE 'tags:%' AND list_contains(list_sort(map_keys(t))[1:4], k))), ',') AS kept
FROM (SELECT id, t, {AREA_CLASS_SQL} AS cls FROM o_features) f WHERE cls IS NOT NULL""")
def _(w: World):
    t = F.col("tags")
    cls = F.col("cls")
    return w.features.withColumn("cls", T.area_class(t)).where(cls.isNotNull()).select(
        "id", "cls", T.area_family(cls).alias("family"),
        F.regexp_replace(T.area_group_key(cls, t), T.KEY_SEPARATOR, "|").alias("group_key"),
        T.relation_area_like(t).alias("area_like"),
        F.array_join(F.array_sort(F.map_keys(T.area_tags(t))), ",").alias("kept"))


MAXSPEED_SQL = """CASE WHEN s IN ('none','signals') THEN 160 WHEN num > 0 THEN greatest(5, least(400,
   floor(CASE WHEN s LIKE '%mph%' THEN num * 1.60934::DOUBLE ELSE num END + 0.5))) ELSE 50 END"""


@query("max_speeds", "O29", f"""
SELECT id, CAST({MAXSPEED_SQL} AS DOUBLE) AS kmh FROM (SELECT id, lower(trim(t['maxspeed'])) AS s,
  TRY_CAST(regexp_extract(regexp_replace(lower(trim(t['maxspeed'])), '[^0-9.]', '', 'g'), '^[0-9]+(\\.[0-9]*)?') AS DOUBLE) AS num
  FROM o_features) f""")
def _(w: World):
    t = F.col("tags")
    return w.features.select("id", R.parse_maxspeed(t["maxspeed"], F.lit(50.0)).alias("kmh"))


@query("effective_layers", "O30", """
SELECT id, CAST(CASE WHEN t['layer'] IS NOT NULL THEN floor(CAST(t['layer'] AS DOUBLE) + 0.5)
  WHEN t['bridge'] IN ('yes','viaduct','boardwalk') THEN 1
  WHEN t['tunnel'] IN ('yes','building_passage') OR t['covered'] = 'yes' THEN -1 ELSE 0 END AS INT) AS layer FROM o_features""")
def _(w: World):
    t = F.col("tags")
    return w.features.select("id", R.effective_layer(t).alias("layer"))


STATION_KIND_SQL = """CASE WHEN t['railway'] IN ('station','halt') OR t['public_transport'] = 'station' THEN
   CASE WHEN t['subway'] = 'yes' OR t['station'] = 'subway' THEN 'subway' WHEN t['highspeed'] IN ('yes','true') THEN 'hsr'
     WHEN t['bus'] = 'yes' AND coalesce(t['train'], '') <> 'yes' THEN 'bus' ELSE 'rail' END
 WHEN t['railway'] = 'tram_stop' THEN 'tram' WHEN t['railway'] = 'subway_entrance' THEN 'subway'
 WHEN t['amenity'] = 'bus_station' OR t['highway'] = 'bus_stop' THEN 'bus'
 WHEN t['public_transport'] IN ('platform','stop_position') THEN CASE WHEN t['tram'] = 'yes' THEN 'tram' ELSE 'bus' END
 WHEN t['railway'] = 'platform' THEN 'rail' END"""


@query("station_kinds", "O32", f"""
SELECT id, kind, coalesce(nullif(substr(trim(coalesce(t['name:zh'], t['name:zh-Hans'], t['name'], t['name:en'], '')), 1, 32), ''),
  concat(CASE kind WHEN 'rail' THEN '普速车站' WHEN 'subway' THEN '地铁站' WHEN 'hsr' THEN '高铁站' WHEN 'tram' THEN '有轨电车站'
    WHEN 'bus' THEN '公交站' END, ' #', CAST(id AS VARCHAR))) AS name
FROM (SELECT id, t, {STATION_KIND_SQL} AS kind FROM o_features) f WHERE kind IS NOT NULL""")
def _(w: World):
    t = F.col("tags")
    kind = T.station_kind(t)
    return w.features.withColumn("kind", kind).where("kind IS NOT NULL").select(
        "id", "kind", T.station_name(t, F.col("kind"), F.col("id")).alias("name"))


NUM_SQL = "TRY_CAST(regexp_extract(regexp_replace(t['{}'], '[^0-9.]', '', 'g'), '^[0-9]+(\\.[0-9]*)?') AS DOUBLE)"


@query("building_floors", "O33", f"""
SELECT id, coalesce({NUM_SQL.format('building:levels')}, CASE WHEN {NUM_SQL.format('height')} IS NOT NULL THEN greatest(1.0, floor({NUM_SQL.format('height')} / 3.2 + 0.5)) END,
  CASE WHEN t['building'] IN ('house','detached','hut','garage','shed','garages') THEN 1.0 ELSE 3.0 END)::DOUBLE AS floors,
  CASE WHEN {NUM_SQL.format('height')} IS NOT NULL THEN {NUM_SQL.format('height')}
    WHEN {NUM_SQL.format('building:levels')} IS NOT NULL THEN floor(({NUM_SQL.format('building:levels')} * 3.2::DOUBLE + 1) * 1000 + 0.5) / 1000 ELSE 6.0 END::DOUBLE AS height_m
FROM o_features WHERE t['building'] IS NOT NULL""")
def _(w: World):
    t = F.col("tags")
    b = w.features.where(T.has(t, "building"))
    return b.select("id", T.effective_floors(t).cast("double").alias("floors"),
                    geo.js_round(T.building_height(t), 3).alias("height_m"))


@query("clock_helpers", "O34", """
WITH e AS (SELECT event_id AS id, CAST(event_id % 90000 AS BIGINT) AS s, event_id % 40 + 1 AS d, event_id % 24 AS h,
   CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'regional' ELSE 'long' END AS band FROM events),
m AS (SELECT *, CASE band WHEN 'local' THEN [1.00,0.90,0.85,0.85,0.90,1.00,1.15,1.35,1.40,1.20,1.05,0.95,0.90,0.95,1.05,1.15,1.15,1.10]
   WHEN 'regional' THEN [0.95,0.90,0.85,0.85,0.90,1.00,1.10,1.20,1.20,1.10,1.05,1.00,0.95,1.00,1.05,1.10,1.10,1.05]
   ELSE [0.90,0.90,0.90,0.90,0.95,1.00,1.05,1.10,1.10,1.05,1.05,1.00,1.00,1.05,1.05,1.05,1.05,1.00] END::DOUBLE[] AS shape,
   CASE WHEN d % 7 IN (0, 6) THEN CASE band WHEN 'local' THEN 0.42 WHEN 'regional' THEN 0.75 ELSE 1.15 END ELSE 1 END::DOUBLE AS wk FROM e)
SELECT id, concat(lpad(CAST(CAST(floor((s % 86400) / 3600) AS INT) AS VARCHAR), 2, '0'), ':',
    lpad(CAST(CAST(floor((s % 3600) / 60) AS INT) AS VARCHAR), 2, '0')) AS hhmm,
  CASE id % 4 WHEN 0 THEN CAST(h * 3600 + 5 * 60 AS INT) WHEN 1 THEN CAST(h * 3600 + 59 * 60 + 9 AS INT) WHEN 2 THEN NULL
    ELSE CAST(least(86400, s) AS INT) END AS sec,
  floor(CASE WHEN h < 18 THEN shape[CAST(h AS INT) + 1] / (list_sum(shape) / 18) ELSE 0.15 END * 1000000 + 0.5) / 1000000 AS shape,
  wk AS weekend,
  floor(wk * (0.92::DOUBLE + ((d::HUGEINT * 2654435761) % 4294967296 % 160) / 1000.0) * 1000000 + 0.5) / 1000000 AS day_factor
FROM m""")
def _(w: World):
    e = w.table("events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 90000).alias("s"), (F.col("event_id") % 40 + 1).alias("d"),
        (F.col("event_id") % 24).alias("h"),
        F.when(F.col("event_id") % 3 == 0, "local").when(F.col("event_id") % 3 == 1, "regional").otherwise("long").alias("band"))
    text = (F.when(F.col("id") % 4 == 0, F.concat(F.col("h").cast("string"), F.lit(":05")))
            .when(F.col("id") % 4 == 1, F.concat(F.col("h").cast("string"), F.lit(":59:09")))
            .when(F.col("id") % 4 == 2, F.lit("later")).otherwise(F.col("s").cast("string")))
    return e.select("id", D.hhmm(F.col("s")).alias("hhmm"), D.sec_of_day(text).alias("sec"),
                    geo.js_round(D.hourly_shape(F.col("band"), F.col("h")), 6).alias("shape"),
                    D.weekend_factor(F.col("d"), F.col("band")).alias("weekend"),
                    geo.js_round(D.daily_factor(F.col("d"), F.col("band")), 6).alias("day_factor"))


@query("distance_weights", "O35", """
SELECT id, band, floor(1 / pow(m / 4000.0 + 1, 0.85) * 1000000 + 0.5) / 1000000 AS weight,
  CASE WHEN cov > 0 THEN floor((pow(cov::DOUBLE, 0.75) + pow(300.0::DOUBLE, 0.75)) * (1 + lines) / pow(m / 4000.0 + 1, 0.85) * 10000 + 0.5) / 10000 ELSE 0 END::DOUBLE AS pull,
  floor(CASE id % 3 WHEN 0 THEN CASE band WHEN 'local' THEN 0.76 WHEN 'regional' THEN 0.2 ELSE 0.04 END
    WHEN 1 THEN CASE band WHEN 'local' THEN 0.95 WHEN 'long' THEN 0.05 ELSE 0 END
    ELSE CASE band WHEN 'long' THEN 1 ELSE 0 END END * 1000000 + 0.5) / 1000000 AS share
FROM (SELECT o_orderkey AS id, o_totalprice AS m, o_custkey % 900 AS cov, o_orderkey % 5 AS lines,
   CASE WHEN o_totalprice <= 15000 THEN 'local' WHEN o_totalprice <= 100000 THEN 'regional' ELSE 'long' END AS band FROM orders) o""")
def _(w: World):
    o = w.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("m"),
                                 (F.col("o_custkey") % 900).alias("cov"), (F.col("o_orderkey") % 5).alias("lines"))
    have = (F.when(F.col("id") % 3 == 0, F.array(F.lit("local"), F.lit("regional"), F.lit("long")))
            .when(F.col("id") % 3 == 1, F.array(F.lit("local"), F.lit("long"))).otherwise(F.array(F.lit("long"))))
    m, band = F.col("m"), D.band_of(F.col("m"))
    return o.select("id", band.alias("band"), geo.js_round(D.distance_weight(m), 6).alias("weight"),
                    geo.js_round(D.destination_weight(F.col("cov"), F.col("lines"), m), 4).alias("pull"),
                    geo.js_round(D.band_share(band, have), 6).alias("share"))


@query("ranked_search", "O145", """
WITH k AS (SELECT unnest(['bolt', 'red', '12', 'econ', 'brand#7']) AS kw),
i AS (SELECT p_partkey AS item_id, p_name AS name, lower(p_name) AS nm, lower(p_brand) AS b, lower(p_type) AS ty FROM part)
SELECT kw, item_id, name, CAST(score AS INT) AS score FROM (SELECT kw, item_id, name,
  CASE WHEN nm = kw THEN 0 WHEN starts_with(nm, kw) THEN 1 WHEN contains(nm, kw) THEN 2 WHEN contains(CAST(item_id AS VARCHAR), kw) THEN 3
    WHEN contains(b, kw) THEN 4 WHEN contains(ty, kw) THEN 5 END AS score FROM i CROSS JOIN k) s WHERE score IS NOT NULL""")
def _(w: World):
    items = w.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"),
                                   F.array().cast("array<string>").alias("aliases"), F.create_map(F.lit("type"), F.col("p_type")).alias("tags"))
    return RU.ranked_search(items, ["bolt", "red", "12", "econ", "Brand#7 "])


@query("segment_helpers", "O146", """
WITH q AS (SELECT s.id, x.way_id, (a.lon - s.lon) * (pi() / 180) * 6378137.0 * cos(s.lat * (pi() / 180)) AS x1, (a.lat - s.lat) * (pi() / 180) * 6378137.0 AS y1,
   (b.lon - s.lon) * (pi() / 180) * 6378137.0 * cos(s.lat * (pi() / 180)) AS x2, (b.lat - s.lat) * (pi() / 180) * 6378137.0 AS y2
 FROM d_stations s JOIN d_way_nodes x ON x.way_id = s.id * 4 AND x.seq = 0 JOIN d_way_nodes y ON y.way_id = x.way_id AND y.seq = 1
 JOIN d_nodes a ON a.id = x.node_id JOIN d_nodes b ON b.id = y.node_id),
r AS (SELECT *, greatest(0.0, least(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))) AS t FROM q)
SELECT id, floor(t * 1000000 + 0.5) / 1000000 AS pos, floor(sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) * 100 + 0.5) / 100 AS dist_m FROM r""")
def _(w: World):
    from streetloom.operators.geometry import way_segments
    seg = way_segments(w.way_nodes, w.nodes).where("seq = 1")
    p = w.stations.select("id", "lat", "lon", (F.col("id") * 4).alias("way_id"))
    args = [F.col(c) for c in ("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon")]
    return p.join(seg, "way_id").select("id", geo.js_round(geo.segment_t(*args), 6).alias("pos"),
                                        geo.js_round(geo.segment_distance_m(*args), 2).alias("dist_m"))


@query("segment_helpers_near", "O146", """
WITH q AS (SELECT s.id, x.way_id, y.seq, (a.lon - s.lon) * (pi() / 180) * 6378137.0 * cos(s.lat * (pi() / 180)) AS x1, (a.lat - s.lat) * (pi() / 180) * 6378137.0 AS y1,
   (b.lon - s.lon) * (pi() / 180) * 6378137.0 * cos(s.lat * (pi() / 180)) AS x2, (b.lat - s.lat) * (pi() / 180) * 6378137.0 AS y2
 FROM d_way_nodes x JOIN d_way_nodes y ON y.way_id = x.way_id AND y.seq = x.seq + 1 JOIN d_nodes a ON a.id = x.node_id JOIN d_nodes b ON b.id = y.node_id
 JOIN d_stations s ON greatest(a.lat, b.lat) >= s.lat - 0.004 AND least(a.lat, b.lat) <= s.lat + 0.004 AND greatest(a.lon, b.lon) >= s.lon - 0.005 AND least(a.lon, b.lon) <= s.lon + 0.005),
r AS (SELECT *, greatest(0.0, least(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))) AS t FROM q),
d AS (SELECT *, sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) AS m FROM r)
SELECT id, way_id, CAST(seq AS INT) AS seq, floor(t * 1000000 + 0.5) / 1000000 AS pos, floor(m * 100 + 0.5) / 100 AS dist_m FROM d WHERE m <= 300""")
def _(w: World):
    """Every segment of every way near a station, where ``segment_helpers`` has one per station."""
    from streetloom.operators.geometry import way_segments
    near = spatial.near_segments(w.stations, way_segments(w.way_nodes, w.nodes).where("gap = 1"), 300)
    return near.select("id", "way_id", F.col("seq").cast("int").alias("seq"), geo.js_round(F.col("t"), 6).alias("pos"), geo.js_round(F.col("m"), 2).alias("dist_m"))


@query("sql_functions", "SQL functions", "SELECT f.name AS function, count(*) AS rows, count(*) AS same FROM o_features CROSS JOIN (VALUES " + ", ".join(f"('{r.name}')" for r in SQL.RULES) + ") AS f(name) GROUP BY f.name")
def _(w: World):
    """Every registered function beside the Column it is made of, over all features."""
    SQL.register(w.spark)
    f = w.features.select("id", "tags", F.col("zoom").cast("int").alias("zoom"), "closed", F.col("size").cast("double").alias("area_m2"), "min_lat", "max_lat", "min_lon", "max_lon", T.line_class(F.col("tags")).alias("line_cls"),
                          T.area_class(F.col("tags")).alias("area_cls"), T.station_kind(F.col("tags")).alias("kind"), (F.col("size") * 731.0).alias("meters"), (F.col("id") % 90000).alias("sec"))
    given = {"cls": "coalesce(line_cls, area_cls)", "ident": "id", "limit_kmh": "CAST(10 + id % 90 AS INT)", "congestion": "(id % 11) / 10D", "coverage": "CAST(id % 5000 AS DOUBLE)", "lines": "id % 7",
             "clock": "concat(CAST(id % 30 AS STRING), ':', CAST(id % 60 AS STRING))", "lat1": "min_lat", "lat2": "max_lat", "lon1": "min_lon", "lon2": "max_lon", "lat": "min_lat", "lon": "min_lon"}
    same = []
    for r in SQL.RULES:
        args = [given.get(n, n) for n in r.names()]
        args = ["CAST(zoom AS DOUBLE)" if r.name == "meters_per_pixel" and a == "zoom" else a for a in args]
        same.append(F.expr(f"{r.name}({', '.join(args)})").eqNullSafe(r.over(*map(F.expr, args))).alias(r.name))
    # One pass for each few functions: all of them at once would be one very large expression.
    out = None
    for k in range(0, len(same), 6):
        few = [r.name for r in SQL.RULES[k : k + 6]]
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("function"), F.col(n).alias("ok")) for n in few])).alias("s")
        part = f.select(*same[k : k + 6]).select(each).groupBy("s.function").agg(F.count("*").alias("rows"), F.count_if("s.ok").alias("same"))
        out = part if out is None else out.unionByName(part)
    return out
