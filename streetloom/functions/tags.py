"""Column expressions over a ``MAP<STRING,STRING>`` of tags. No UDFs: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values (must equal the reference for equal results) --------------------------------

ROAD_CLASSES = {
    0: ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"],
    1: ["secondary", "secondary_link"],
    2: ["tertiary", "tertiary_link"],
    3: ["unclassified", "residential", "road", "living_street"],
    4: ["service", "track", "footway", "path", "steps", "cycleway", "bridleway", "pedestrian",
        "construction", "proposed", "busway", "bus_guideway", "raceway", "corridor", "platform"],
}
UNKNOWN_RANK = 5
RANK_NAMES = ["trunk", "secondary", "tertiary", "minor", "detail", "unknown"]
ROAD_FLOORS = {"trunk": 9, "secondary": 12, "tertiary": 13, "minor": 14, "detail": 16}
# (first zoom, deepest road rank that is returned from that zoom on)
ROAD_SEND_STEPS = [(0, 0), (13, 1), (14, 2), (15, 4), (19, 5)]
# (last zoom, least area in m2) for filled land areas
LANDUSE_MIN_AREA = [(13, 20000), (14, 6000), (15, 1500), (16, 400)]
# detail level -> (first zoom for important buildings, bias); other levels do not thin buildings
BUILDING_ZOOM = {2: (15, 0), 3: (99, 0), 4: (15, 1)}
MAIN_ROADS = ["motorway", "trunk", "motorway_link", "trunk_link", "primary", "primary_link"]
PATH_HIGHWAYS = ["footway", "path", "steps", "cycleway", "bridleway", "corridor", "track"]
TRANSPORT_HIGHWAYS = ["bus_stop", "platform", "bus_guideway"]
TRANSPORT_RAILWAYS = ["station", "halt", "tram_stop", "subway_entrance", "stop", "platform"]
TRANSPORT_AMENITIES = ["bus_station", "taxi", "ferry_terminal", "parking", "parking_entrance", "bicycle_parking",
                       "bicycle_rental", "motorcycle_parking", "car_rental", "car_sharing", "charging_station"]
AREA_RAILWAYS = ["platform", "station", "halt", "turntable", "roundhouse"]
AREA_WATERWAYS = ["riverbank", "dock", "boatyard"]
AREA_CLASS_KEYS = ["waterway", "natural", "landuse", "leisure", "amenity", "shop", "tourism", "historic", "building",
                   "place", "man_made", "aeroway", "military", "power", "boundary", "golf", "sport", "healthcare",
                   "office", "craft", "emergency", "highway", "railway", "barrier"]
AREA_EXTRA_KEYS = ["name", "ref", "bridge", "tunnel", "layer", "surface"]
LINE_TAG_KEYS = ["name", "ref", "highway", "railway", "waterway", "natural", "boundary", "admin_level", "bridge",
                 "tunnel", "layer", "surface", "usage", "service", "oneway", "power", "man_made", "barrier",
                 "aeroway", "route", "area", "access"]
PLACE_PRIORITY = {"city": 10, "town": 9, "borough": 8, "village": 8, "suburb": 7, "quarter": 7, "neighbourhood": 6,
                  "hamlet": 6, "isolated_dwelling": 5, "locality": 5, "farm": 5, "square": 6, "island": 6, "islet": 5}
STATION_KIND_NAMES = {"hsr": "高铁站", "intercity": "城际站", "rail": "普速车站", "subway": "地铁站",
                      "light_rail": "轻轨站", "tram": "有轨电车站", "bus": "公交站"}
KEY_SEPARATOR = "\u0001"
# -------------------------------------------------------------------------------------------------


def parse_tags(raw: Column) -> Column:
    """JSON object text to a map; broken text and empty objects give NULL, never an error."""
    m = F.from_json(raw, "map<string,string>")
    return F.when(F.size(m) > 0, m)


def read_once(tags: Column) -> Column:
    """The same tags out of an explode, which no filter passes: a filter above would else be moved below them and parse the text again for each tag it asks for."""
    return F.explode(F.array(tags))


def clean_tags(tags: Column, cap: int | None = None) -> Column:
    """Trim keys and values, drop empty ones, keep the first ``cap`` keys (all by default); later duplicates of a key win."""
    trimmed = F.transform(F.map_entries(tags), lambda e: F.struct(F.trim(e["key"]).alias("key"),
                                                                  F.trim(e["value"]).alias("value")))
    kept = F.filter(trimmed, lambda e: (e["key"] != "") & (F.coalesce(e["value"], F.lit("")) != ""))
    return tags_from_pairs(kept, cap)


def tags_from_pairs(pairs: Column, cap: int | None = None) -> Column:
    """``ARRAY<STRUCT<key,value>>`` to a map: key order of first sight, value of last sight, at most ``cap`` keys if given."""
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    kept = keys if cap is None else F.slice(keys, 1, cap)
    values = F.transform(kept, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"])
    # Only sets with a repeated key need the search for the last value.
    made = F.when(F.size(keys) == F.size(pairs), F.map_from_entries(pairs if cap is None else F.slice(pairs, 1, cap))).otherwise(
        F.map_from_arrays(kept, values))
    return F.when(F.size(keys) > 0, made)


def val(tags: Column, key: str) -> Column:
    """Tag value, NULL when absent or empty."""
    return F.nullif(tags[key], F.lit(""))


def has(tags: Column, key: str) -> Column:
    return F.coalesce(tags[key], F.lit("")) != ""


def any_of(tags: Column, *keys: str) -> Column:
    out = has(tags, keys[0])
    for k in keys[1:]:
        out = out | has(tags, k)
    return out


def is_in(tags: Column, key: str, values: list[str]) -> Column:
    return F.coalesce(tags[key].isin(*values), F.lit(False))


def eq(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(tags[key] == value, F.lit(False))


def first_number(text: Column, keep: str = "0-9.") -> Column:
    """Strip everything but digits and dots, then read the number at the front (NULL when there is none)."""
    digits = F.regexp_replace(text, f"[^{keep}]", "")
    return F.regexp_extract(digits, r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")


# ---- validation -----------------------------------------------------------------------------------

def tag_errors(tags: Column, max_tags: int = 100, max_key: int = 64, max_value: int = 1024) -> Column:
    """Reasons why a tag set is refused, as ``ARRAY<STRING>`` in a fixed order (empty when accepted)."""
    pairs = _scrubbed_pairs(tags)
    long_key = F.exists(pairs, lambda e: F.length(e["key"]) > max_key)
    equals = F.exists(pairs, lambda e: e["key"].contains("="))
    long_value = F.exists(pairs, lambda e: F.length(e["value"]) > max_value)
    return F.array_compact(F.array(
        F.when(F.size(tags) > max_tags, F.lit("too_many_tags")),
        F.when(long_key, F.lit("key_too_long")),
        F.when(equals, F.lit("key_has_equals")),
        F.when(long_value, F.lit("value_too_long")),
    ))


def _scrubbed_pairs(tags: Column) -> Column:
    def scrub(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""))
    pairs = F.transform(F.map_entries(tags), lambda e: F.struct(scrub(e["key"]).alias("key"),
                                                                scrub(e["value"]).alias("value")))
    return F.filter(pairs, lambda e: (e["key"] != "") & (F.coalesce(e["value"], F.lit("")) != ""))


def strip_controls(tags: Column) -> Column:
    """Remove control characters, trim, drop empty keys and values."""
    return tags_from_pairs(_scrubbed_pairs(tags))


# ---- roads and zoom rules ---------------------------------------------------------------------------

def road_rank(tags: Column) -> Column:
    """0 trunk ... 4 detail, 5 unknown class, NULL when not a road."""
    hw = tags["highway"]
    out = F.when(~has(tags, "highway"), F.lit(None).cast("int"))
    for rank, names in ROAD_CLASSES.items():
        out = out.when(hw.isin(*names), F.lit(rank))
    return out.otherwise(F.lit(UNKNOWN_RANK))


def road_floor(rank: Column, floors: dict[str, int] | None = None) -> Column:
    table = {**ROAD_FLOORS, **(floors or {})}
    return (F.when(rank == 0, table["trunk"]).when(rank == 1, table["secondary"]).when(rank == 2, table["tertiary"])
            .when(rank == 3, table["minor"]).otherwise(table["detail"]))


def min_zoom_line(tags: Column, floors: dict[str, int] | None = None) -> Column:
    """Least zoom at which a line or area is visible; the order of the branches is part of the rule."""
    lvl = F.coalesce(F.nullif(tags["admin_level"].try_cast("double"), F.lit(0.0)), F.lit(8.0))
    fill = any_of(tags, "landuse", "natural", "leisure", "amenity", "shop", "tourism", "office", "man_made", "aeroway")
    town = is_in(tags, "landuse", ["residential", "commercial", "industrial"])
    open_area = eq(tags, "amenity", "parking") | eq(tags, "leisure", "park") | eq(tags, "landuse", "forest")
    return (
        F.when(tags.isNull(), 17)
        .when(has(tags, "highway"), road_floor(road_rank(tags), floors))
        .when(has(tags, "railway"),
              F.when(eq(tags, "usage", "main") | eq(tags, "railway", "rail"), 10)
              .when(is_in(tags, "railway", ["subway", "light_rail", "tram"]), 13)
              .when(eq(tags, "railway", "platform"), 16).otherwise(14))
        .when(has(tags, "waterway"), 12)
        .when(eq(tags, "natural", "water"), 9)
        .when(any_of(tags, "building", "building:part"), 15)
        .when(fill, F.when(town | open_area, 13).otherwise(15))
        .when(eq(tags, "boundary", "administrative"), F.when(lvl <= 4, 6).when(lvl <= 6, 9).otherwise(12))
        .when(is_in(tags, "power", ["line", "minor_line"]), 14)
        .when(has(tags, "barrier"), 17)
        .otherwise(16)
    ).cast("int")


def min_zoom_point(tags: Column) -> Column:
    poi = (any_of(tags, "amenity", "shop", "tourism", "office", "craft", "leisure", "historic", "healthcare",
                  "emergency", "public_transport")
           | is_in(tags, "railway", ["station", "halt"]) | is_in(tags, "highway", ["bus_stop", "traffic_signals"])
           | eq(tags, "man_made", "tower") | eq(tags, "power", "tower"))
    return (
        F.when(tags.isNull(), 17)
        .when(has(tags, "place"), 8)
        .when(is_in(tags, "natural", ["peak", "spring", "cave_entrance"]), 13)
        .when(poi, 16).otherwise(17)
    ).cast("int")


def lod_visible(tags: Column, zoom: int | Column, geometry: str = "line", floors: dict[str, int] | None = None) -> Column:
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    least = min_zoom_point(tags) if geometry == "point" else min_zoom_line(tags, floors)
    return zoom >= least


def lod_keys(tags: Column) -> tuple[Column, Column]:
    """(road_class, lod_zoom): -1 for non-roads; least visible zoom within 0..18."""
    return F.coalesce(road_rank(tags), F.lit(-1)), F.least(min_zoom_line(tags), F.lit(18))


def road_send_rank(zoom: int | Column) -> Column:
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    out = F.lit(0)
    for first, rank in ROAD_SEND_STEPS:
        out = F.when(zoom >= first, rank).otherwise(out)
    return out


def landuse_min_area(zoom: int | Column) -> Column:
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    out = F.when(zoom <= LANDUSE_MIN_AREA[0][0], LANDUSE_MIN_AREA[0][1])
    for last, area in LANDUSE_MIN_AREA[1:]:
        out = out.when(zoom <= last, area)
    return out.otherwise(0)


def never_send_class(tags: Column) -> Column:
    return (F.when(is_in(tags, "natural", ["tree", "tree_row"]), "trees")
            .when(eq(tags, "highway", "cycleway"), "cycleways"))


def lod_withhold(tags: Column, zoom: int | Column, bbox_area_m2: Column, closed: Column, detail: int = 4,
                 min_fill_area: float = 0.0, never_send: bool = True,
                 floors: dict[str, int] | None = None) -> Column:
    """Why a visible feature is held back at this zoom: neverSend, roadClass, railMinor, landuse, building or NULL."""
    return lod_withheld(lod_traits(tags, detail), zoom, bbox_area_m2, closed, detail, min_fill_area, never_send, floors)


def lod_traits(tags: Column, detail: int = 4) -> dict[str, Column]:
    """What ``lod_withheld`` asks of the tags, the same at every zoom: where many zooms are asked, it can be worked out once per feature."""
    building = any_of(tags, "building", "building:part")
    fill = (any_of(tags, "landuse", "leisure") & ~building & ~is_in(tags, "landuse", ["reservoir", "basin"])
            & ~is_in(tags, "natural", ["water", "coastline", "bay"]))
    base, bias = BUILDING_ZOOM.get(detail, (0, 0))
    levels = F.coalesce(first_number(tags["building:levels"]), F.lit(0.0))
    important = any_of(tags, "name", "amenity", "shop", "tourism") | (levels >= 5)
    skeleton = any_of(tags, "landuse", "natural", "place")
    return {
        "bare": tags.isNull(), "never": never_send_class(tags), "rank": road_rank(tags), "rail": has(tags, "railway"),
        "side_rail": eq(tags, "railway", "rail") & ~eq(tags, "usage", "main"),
        "open": has(tags, "waterway") | eq(tags, "boundary", "administrative") | is_in(tags, "natural", ["water", "coastline"]),
        "fill": fill, "building": building,
        "need": F.when(important, base).otherwise(base + 1) + F.when(skeleton, 0).otherwise(bias),
    }


def lod_withheld(traits: dict[str, Column], zoom: int | Column, bbox_area_m2: Column, closed: Column, detail: int = 4, min_fill_area: float = 0.0,
                 never_send: bool = True, floors: dict[str, int] | None = None) -> Column:
    """``lod_withhold`` of features whose ``lod_traits`` are known."""
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    ruled = detail in BUILDING_ZOOM
    send = road_send_rank(zoom) if ruled else F.lit(UNKNOWN_RANK)
    rank = traits["rank"]
    nothing = F.lit(None).cast("string")

    rail_minor, small_fill, by_zoom = nothing, F.lit(False), F.lit(False)
    if ruled:
        need = {**ROAD_FLOORS, **(floors or {})}["minor"]
        rail_minor = F.when(traits["side_rail"] & ((zoom < need) | (send < 3)), "railMinor")
        small_fill = traits["fill"] & F.coalesce(closed, F.lit(False)) & (landuse_min_area(zoom) > 0) \
            & (bbox_area_m2 < landuse_min_area(zoom))
        by_zoom = zoom < traits["need"]
    small_building = (bbox_area_m2 < min_fill_area) if min_fill_area > 0 else F.lit(False)

    return (
        F.when(traits["bare"], nothing)
        .when(traits["never"].isNotNull() & F.lit(never_send), "neverSend")
        .when(rank == 0, nothing)
        .when(rank > send, "roadClass")
        .when(rank.isNotNull(), nothing)
        .when(traits["rail"], rail_minor)
        .when(traits["open"], nothing)
        .when(small_fill, "landuse")
        .when(~traits["building"], nothing)
        .when(by_zoom | small_building, "building")
    )


# ---- categories, labels, classes ---------------------------------------------------------------------

def is_water(tags: Column) -> Column:
    return (any_of(tags, "waterway", "water") | is_in(tags, "natural", ["water", "bay", "strait", "coastline", "spring"])
            | is_in(tags, "landuse", ["basin", "salt_pond", "reservoir"])
            | is_in(tags, "leisure", ["swimming_pool", "marina", "water_park"]))


POI_KEYS = ["amenity", "shop", "tourism", "historic", "office", "craft", "healthcare", "emergency"]


def category_of(tags: Column) -> Column:
    return (
        F.when(any_of(tags, "building", "building:part"), "building")
        .when(has(tags, "boundary"), "boundary")
        .when(has(tags, "power"), "power")
        .when(has(tags, "barrier"), "barrier")
        .when(has(tags, "highway"), F.when(is_in(tags, "highway", PATH_HIGHWAYS), "path")
              .when(is_in(tags, "highway", TRANSPORT_HIGHWAYS), "transport").otherwise("road"))
        .when(has(tags, "railway"), F.when(is_in(tags, "railway", TRANSPORT_RAILWAYS), "transport").otherwise("railway"))
        .when(any_of(tags, "aeroway", "public_transport", "route"), "transport")
        .when(is_water(tags), "water")
        .when(is_in(tags, "amenity", TRANSPORT_AMENITIES), "transport")
        .when(any_of(tags, *POI_KEYS), "poi")
        .when(any_of(tags, "landuse", "leisure", "natural", "man_made", "military"), "landuse")
        .otherwise("other")
    )


def _text(tags: Column, key: str) -> Column:
    return F.nullif(F.trim(tags[key]), F.lit(""))


def label_priority(tags: Column) -> Column:
    hw = tags["highway"]
    place = F.lit(None).cast("int")
    for name, p in PLACE_PRIORITY.items():
        place = F.when(eq(tags, "place", name), p).otherwise(place)
    return (
        F.when(has(tags, "highway"),
               F.when(hw.isin("motorway", "motorway_link", "trunk", "trunk_link"), 9)
               .when(hw.isin("primary", "primary_link"), 8).when(hw.isin("secondary", "secondary_link"), 7)
               .when(hw.isin("tertiary", "tertiary_link"), 6)
               .when(hw.isin("unclassified", "residential", "living_street", "pedestrian"), 5)
               .when(hw.isin("service", "track", "road"), 4).otherwise(3))
        .when(place.isNotNull(), place)
        .when(is_in(tags, "natural", ["peak", "volcano"]), 8)
        .when(is_in(tags, "railway", ["station", "halt"]) | eq(tags, "public_transport", "station")
              | eq(tags, "aeroway", "aerodrome"), 7)
        .when(has(tags, "railway"), 5)
        .when(is_water(tags), 6)
        .when(has(tags, "boundary"), 5)
        .when(any_of(tags, "building", "building:part"), 4)
        .when(any_of(tags, *POI_KEYS), 5)
        .when(any_of(tags, "leisure", "landuse", "natural", "man_made", "military"), 4)
        .otherwise(5)
    )


def label_of(tags: Column) -> Column:
    """``STRUCT<text, priority>`` or NULL when the feature has nothing to write."""
    name = F.coalesce(_text(tags, "name"), _text(tags, "name:zh"))
    ele = F.nullif(F.trim(F.regexp_replace(F.trim(tags["ele"]), r"(?i)\s*m$", "")), F.lit(""))
    ref = _text(tags, "ref")
    house = _text(tags, "addr:housenumber")
    hw = tags["highway"]
    ref_priority = (F.when(hw.isin("motorway", "motorway_link", "trunk", "trunk_link"), 7)
                    .when(hw.isin("primary", "primary_link"), 6)
                    .when(any_of(tags, "highway", "railway", "route", "public_transport", "aeroway"), 5).otherwise(4))

    def made(text: Column, priority: Column) -> Column:
        return F.struct(text.alias("text"), priority.cast("int").alias("priority"))

    peak = (F.when(name.isNotNull() & ele.isNotNull(), made(F.concat(name, F.lit(" ("), ele, F.lit(" m)")), F.lit(8)))
            .when(name.isNotNull(), made(name, F.lit(8)))
            .when(ele.isNotNull(), made(F.concat(ele, F.lit(" m")), F.lit(6))))
    return (F.when(is_in(tags, "natural", ["peak", "volcano"]), peak)
            .when(name.isNotNull(), made(name, label_priority(tags)))
            .when(ref.isNotNull(), made(ref, ref_priority))
            .when(any_of(tags, "building", "building:part") & house.isNotNull(), made(house, F.lit(2))))


def _first_keys(tags: Column, n: int) -> Column:
    keys = F.slice(F.array_sort(F.map_keys(tags)), 1, n)
    return F.when(F.size(keys) > 0, F.concat(F.lit("tags:"), F.array_join(keys, ",")))


def line_class(tags: Column) -> Column:
    def kv(key: str) -> Column:
        return F.concat(F.lit(f"{key}="), tags[key])
    return (
        F.when(tags.isNull(), F.lit(None).cast("string"))
        .when(has(tags, "highway"), kv("highway")).when(has(tags, "railway"), kv("railway"))
        .when(has(tags, "waterway"), kv("waterway"))
        .when(eq(tags, "natural", "coastline"), "natural=coastline")
        .when(is_in(tags, "natural", ["water", "bay", "strait"]), F.lit(None).cast("string"))
        .when(eq(tags, "boundary", "administrative"),
              F.concat(F.lit("boundary@"), F.coalesce(tags["admin_level"], F.lit(""))))
        .when(is_in(tags, "power", ["line", "minor_line"]), kv("power"))
        .when(eq(tags, "man_made", "pipeline"), "man_made=pipeline")
        .when(has(tags, "aeroway"), kv("aeroway")).when(has(tags, "barrier"), kv("barrier"))
        .otherwise(_first_keys(tags, 3))
    )


def line_family(cls: Column) -> Column:
    return (F.when(cls.startswith("highway="), "road").when(cls.startswith("railway="), "railway")
            .when(cls.startswith("waterway="), "waterway").when(cls == "natural=coastline", "water")
            .when(cls.startswith("boundary@"), "boundary").otherwise("other"))


def line_always(cls: Column) -> Column:
    """Classes that are generalised whatever their size."""
    value = F.substring_index(cls, "=", -1)
    return F.coalesce(
        F.when(cls.startswith("highway="), value.isin(*ROAD_CLASSES[0]))
        .when(cls.startswith("railway="), ~value.isin(*AREA_RAILWAYS))
        .when(cls.startswith("waterway="), ~value.isin(*AREA_WATERWAYS))
        .otherwise((cls == "natural=coastline") | cls.startswith("boundary@")), F.lit(False))


def _key_parts(cls: Column, tags: Column, keys: list[str]) -> Column:
    return F.concat_ws(KEY_SEPARATOR, cls, *[F.coalesce(tags[k], F.lit("")) for k in keys])


def line_group_key(cls: Column, tags: Column) -> Column:
    return _key_parts(cls, tags, ["name", "bridge", "tunnel", "layer", "surface"])


def kept_tags(tags: Column, keys: list[str]) -> Column:
    return F.map_filter(tags, lambda k, v: k.isin(*keys) & (F.coalesce(v, F.lit("")) != ""))


def line_tags(tags: Column) -> Column:
    return kept_tags(tags, LINE_TAG_KEYS)


def area_class(tags: Column) -> Column:
    out = F.when(tags.isNull(), F.lit(None).cast("string"))
    for key in AREA_CLASS_KEYS:
        named = F.concat(F.lit(f"{key}="), tags[key])
        if key == "boundary":
            named = F.concat(named, F.lit("@"), F.coalesce(tags["admin_level"], F.lit("")))
        out = out.when(has(tags, key), named)
    return out.otherwise(_first_keys(tags, 3))


def area_family(cls: Column) -> Column:
    water = F.lit(False)
    for start in ["natural=water", "natural=coastline", "natural=bay", "natural=strait", "waterway="]:
        water = water | cls.startswith(start)
    land = cls.startswith("landuse=") | cls.startswith("leisure=") | cls.startswith("natural=")
    return (F.when(water, "water").when(land, "landuse").when(cls.startswith("building="), "building")
            .when(cls.startswith("boundary="), "boundary").otherwise("other"))


def area_group_key(cls: Column, tags: Column) -> Column:
    return _key_parts(cls, tags, ["name", "bridge", "tunnel", "layer"])


def area_tags(tags: Column) -> Column:
    """The few tags an area entry carries: the fixed extras plus the tag that named its class."""
    cls = area_class(tags)
    key = F.substring_index(cls, "=", 1)
    plain = F.coalesce(cls.startswith("tags:"), F.lit(True))
    first4 = F.slice(F.array_sort(F.map_keys(tags)), 1, 4)
    return F.map_filter(tags, lambda k, v: (F.coalesce(v, F.lit("")) != "") & (
        k.isin(*AREA_EXTRA_KEYS)
        | (~plain & ((k == key) | ((key == "boundary") & (k == "admin_level"))))
        | (plain & F.array_contains(first4, k))))


def relation_area_like(tags: Column) -> Column:
    cls = area_class(tags)
    filled = any_of(tags, "building", "building:part", "landuse", "leisure", "natural", "water", "wetland", "amenity", "place")
    return F.coalesce(
        is_in(tags, "type", ["multipolygon", "boundary"]) & ~any_of(tags, "highway", "railway", "waterway", "barrier")
        & cls.isNotNull() & ~cls.startswith("tags:") & filled, F.lit(False))


# ---- stations and buildings ----------------------------------------------------------------------------

def station_kind(tags: Column) -> Column:
    def yes(key: str) -> Column:
        return eq(tags, key, "yes")
    big = is_in(tags, "railway", ["station", "halt"]) | eq(tags, "public_transport", "station")
    stop = is_in(tags, "public_transport", ["platform", "stop_position"])
    return (
        F.when(big,
               F.when(yes("subway") | eq(tags, "station", "subway") | yes("subway:entrance"), "subway")
               .when(is_in(tags, "highspeed", ["yes", "true"]), "hsr")
               .when(yes("tram") | eq(tags, "station", "tram"), "tram")
               .when(yes("light_rail") | eq(tags, "station", "light_rail"), "light_rail")
               .when(is_in(tags, "bus", ["yes", "true"]) & ~yes("train"), "bus").otherwise("rail"))
        .when(eq(tags, "railway", "tram_stop"), "tram")
        .when(eq(tags, "railway", "subway_entrance"), "subway")
        .when(eq(tags, "amenity", "bus_station") | eq(tags, "highway", "bus_stop"), "bus")
        .when(stop,
              F.when(yes("tram"), "tram").when(yes("subway"), "subway").when(yes("light_rail"), "light_rail")
              .when(yes("train") | eq(tags, "railway", "platform"), "rail").otherwise("bus"))
        .when(eq(tags, "railway", "platform"), "rail")
    )


def station_name(tags: Column, kind: Column, ident: Column) -> Column:
    raw = F.coalesce(*[val(tags, k) for k in ["name:zh", "name:zh-Hans", "name", "name:en"]], F.lit(""))
    clean = F.substring(F.trim(F.regexp_replace(raw, r"[\x00-\x1f]", "")), 1, 32)
    label = F.lit("车站")
    for k, text in STATION_KIND_NAMES.items():
        label = F.when(kind == k, text).otherwise(label)
    return F.coalesce(F.nullif(clean, F.lit("")), F.concat(label, F.lit(" #"), ident.cast("string")))


def effective_floors(tags: Column) -> Column:
    """Floors from levels, else from the height at 3.2 m each, else by building type."""
    kind = building_value(tags)
    levels = F.nullif(first_number(F.coalesce(val(tags, "building:levels"), val(tags, "levels"))), F.lit(0.0))
    height = F.nullif(first_number(tags["height"]), F.lit(0.0))
    by_height = F.greatest(F.lit(1.0), F.floor(height / 3.2 + 0.5).cast("double"))
    low = kind.isin("house", "detached", "hut", "garage", "shed", "garages")
    return F.coalesce(levels, F.when(height.isNotNull(), by_height), F.when(low, 1.0).otherwise(3.0))


def building_value(tags: Column) -> Column:
    """The building type, from ``building`` or else ``building:part``; ``no`` counts as absent."""
    return F.coalesce(F.nullif(val(tags, "building"), F.lit("no")), F.nullif(val(tags, "building:part"), F.lit("no")))


def building_height(tags: Column) -> Column:
    """Metres from the height, else 3.2 m per level plus one, at most 500; 6 when neither is known."""
    def positive(key: str, other: str) -> Column:
        n = first_number(F.coalesce(val(tags, key), val(tags, other)))
        return F.when(n > 0, n)
    metres = F.coalesce(positive("height", "building:height"), positive("building:levels", "levels") * 3.2 + 1)
    return F.when(metres.isNull(), 6.0).otherwise(F.least(metres, F.lit(500.0)))
