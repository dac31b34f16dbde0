"""Whole-dataset operations: references, tiles, merging, comparison and audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.functions.tags import any_of, eq, has
from streetloom.model import OsmDataset
from streetloom.operators import geometry as G
from streetloom.operators.ordered import even_chunk, numbered
from streetloom.operators.spatial import box_join
from streetloom.session import cut_lineage, drop_cut

KINDS = {"node": "nodes", "way": "ways", "relation": "relations"}


# ---- references -------------------------------------------------------------------------------------------

def references_of(ids: DataFrame, ds: OsmDataset) -> DataFrame:
    """Who uses the given elements: (type, id, ref_type, ref_id), each user once."""
    nodes = ids.where("type = 'node'").select(F.col("id").alias("node_id"))
    ways = (ds.way_nodes.join(nodes, "node_id", "left_semi").select(
        F.lit("node").alias("type"), F.col("node_id").alias("id"), F.lit("way").alias("ref_type"), F.col("way_id").alias("ref_id")))
    m = ds.relation_members
    rels = m.join(ids, (m.member_type == ids.type) & (m.member_ref == ids.id), "left_semi").select(
        F.col("member_type").alias("type"), F.col("member_ref").alias("id"), F.lit("relation").alias("ref_type"), F.col("relation_id").alias("ref_id"))
    return ways.unionByName(rels).distinct()


def orphan_nodes(ds: OsmDataset, ids: DataFrame | None = None) -> DataFrame:
    """Untagged nodes that no way and no relation names."""
    n = ds.nodes.where(F.col("tags").isNull()).select("id")
    if ids is not None:
        n = n.join(ids.select("id"), "id", "left_semi")
    in_ways = ds.way_nodes.select(F.col("node_id").alias("id"))
    in_rels = ds.relation_members.where("member_type = 'node'").select(F.col("member_ref").alias("id"))
    return n.join(in_ways, "id", "left_anti").join(in_rels, "id", "left_anti")


def dangling_refs(ds: OsmDataset) -> DataFrame:
    """References without target by kind of reference: total, dangling and share."""
    def part(name: str, refs: DataFrame, targets: DataFrame) -> DataFrame:
        # Count references per target first, so that a target that is named very often meets the join as one row.
        per = refs.groupBy("ref").agg(F.count("*").alias("n"))
        t = targets.select(F.col("id").alias("ref"), F.lit(1).alias("_there"))
        return per.join(t, "ref", "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("n"))), F.lit(0)).alias("dangling")).withColumn("reference", F.lit(name))

    out = part("way_node", ds.way_nodes.select(F.col("node_id").alias("ref")), ds.nodes)
    for kind, table in KINDS.items():
        refs = ds.relation_members.where(F.col("member_type") == kind).select(F.col("member_ref").alias("ref"))
        out = out.unionByName(part(f"member_{kind}", refs, getattr(ds, table)))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col("dangling") / F.col("total")).otherwise(0.0))


# ---- tiles of a registry -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rect:
    """One rectangle of a tile, half-open for points: [min, max)."""

    tile: str
    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float


def _rect_array(rects: list[Rect]) -> Column:
    """The registry as one constant array: it is configuration, and a pass over it needs no join."""
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r.tile).alias("tile"), F.lit(r.min_lat).alias("y1"), F.lit(r.max_lat).alias("y2"),
                              F.lit(r.min_lon).alias("x1"), F.lit(r.max_lon).alias("x2")) for i, r in enumerate(rects)])


def tile_of_point(lat: Column, lon: Column, rects: list[Rect]) -> Column:
    """``STRUCT<tile, fallback>``: the rectangle that holds the point, else the nearest one in squared degrees; ties go to
    the earlier rectangle."""
    def gap(v: Column, lo: Column, hi: Column) -> Column:
        return F.when(v < lo, lo - v).when(v > hi, v - hi).otherwise(0.0)

    def score(r: Column) -> Column:
        inside = (lat >= r["y1"]) & (lat < r["y2"]) & (lon >= r["x1"]) & (lon < r["x2"])
        dy, dx = gap(lat, r["y1"], r["y2"]), gap(lon, r["x1"], r["x2"])
        return F.struct(F.when(inside, -1.0).otherwise(dy * dy + dx * dx).alias("d"), r["ord"].alias("ord"), r["tile"].alias("tile"))

    best = F.array_min(F.transform(_rect_array(rects), score))
    return F.struct(best["tile"].alias("tile"), (best["d"] >= 0).alias("fallback"))


def assign_tile(points: DataFrame, rects: list[Rect]) -> DataFrame:
    return points.withColumn("_t", tile_of_point(F.col("lat"), F.col("lon"), rects)).select(
        *points.columns, F.col("_t.tile").alias("tile"), F.col("_t.fallback").alias("fallback"))


def touched(rects: list[Rect]) -> Column:
    """Distinct tiles whose closed rectangles meet the row's extent, in registry order."""
    hit = F.filter(_rect_array(rects), lambda r: (r["y1"] <= F.col("max_lat")) & (r["y2"] >= F.col("min_lat"))
                   & (r["x1"] <= F.col("max_lon")) & (r["x2"] >= F.col("min_lon")))
    return F.array_distinct(F.transform(hit, lambda r: r["tile"]))


def touching_tiles(boxes: DataFrame, rects: list[Rect]) -> DataFrame:
    return boxes.withColumn("tile", F.explode(touched(rects)))


def check_rects(rects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of rectangles that overlap with inner area, enclosing extent per tile). ``rects``: rect_id, tile, extent."""
    b = rects.select(F.col("rect_id").alias("other_id"), F.col("tile").alias("other_tile"), "min_lat", "max_lat", "min_lon", "max_lon")
    pairs = box_join(rects, b).where("rect_id < other_id").where(
        (F.col("min_lat") < F.col("box_max_lat")) & (F.col("box_min_lat") < F.col("max_lat"))
        & (F.col("min_lon") < F.col("box_max_lon")) & (F.col("box_min_lon") < F.col("max_lon")))
    problems = pairs.select("rect_id", "other_id", (F.col("tile") == F.col("other_tile")).alias("same_tile"))
    whole = rects.groupBy("tile").agg(F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"),
                                      F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon"))
    return problems, whole


def way_anchor(ds: OsmDataset) -> DataFrame:
    """(way_id, lat, lon) of the middle reference, or of the nearest located one outward (lower index first)."""
    size = ds.way_nodes.groupBy("way_id").agg(F.count("*").alias("_n"))
    at = G.located_refs(ds.way_nodes, ds.nodes).join(size, "way_id")
    off = F.col("seq") - F.floor(F.col("_n") / 2)
    return at.groupBy("way_id").agg(F.min(F.struct(F.abs(off).alias("d"), "seq", "lat", "lon")).alias("a")).select(
        "way_id", F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"))


def tile_cut(ds: OsmDataset, rects: list[Rect]) -> dict[str, DataFrame]:
    """Every node to its own tile, every way to the tile of its middle node; nodes that a tile's ways need but that lie
    elsewhere are copied as support."""
    own = assign_tile(ds.nodes, rects).withColumn("support", F.lit(False))
    way_tile = assign_tile(way_anchor(ds), rects).select("way_id", "tile", "fallback")
    ways = ds.ways.join(way_tile.withColumnRenamed("way_id", "id"), "id")
    refs = ds.way_nodes.join(way_tile.select("way_id", "tile"), "way_id")
    needed = refs.select("tile", F.col("node_id").alias("id")).distinct()
    missing = needed.join(own.select("tile", "id"), ["tile", "id"], "left_anti")
    support = ds.nodes.join(missing, "id").withColumn("fallback", F.lit(False)).withColumn("support", F.lit(True))
    return {"nodes": own.unionByName(support.select(*own.columns)), "ways": ways, "way_nodes": refs}


def relation_tile(ds: OsmDataset, rects: list[Rect], extents: DataFrame | None = None) -> DataFrame:
    """Tile of each relation: first way member that can be located, else first node member, else the centre of its
    extent; relations with none are left out."""
    m = ds.relation_members
    anchor = way_anchor(ds).withColumnRenamed("way_id", "member_ref")
    ways = m.where("member_type = 'way'").join(ds.ways.select(F.col("id").alias("member_ref")), "member_ref", "left_semi").join(
        anchor, "member_ref").select("relation_id", F.lit(0).alias("rank"), "seq", "lat", "lon")
    nodes = m.where("member_type = 'node'").join(ds.nodes.select(F.col("id").alias("member_ref"), "lat", "lon"), "member_ref").select(
        "relation_id", F.lit(1).alias("rank"), "seq", "lat", "lon")
    cands = ways.unionByName(nodes)
    if extents is not None:
        mid = extents.where(F.col("min_lat").isNotNull()).select(
            "relation_id", F.lit(2).alias("rank"), F.lit(0).cast(m.schema["seq"].dataType).alias("seq"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"),
            ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"))
        cands = cands.unionByName(mid)
    first = cands.groupBy("relation_id").agg(F.min(F.struct("rank", "seq", "lat", "lon")).alias("a")).select(
        "relation_id", F.col("a.rank").alias("rank"), F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"))
    return assign_tile(first, rects)


def dedup_relations(copies: DataFrame, content: list[str]) -> DataFrame:
    """Relations seen in several sources: the first source fixes the tile, the fullest member list (earliest among
    equals) gives the content. ``copies``: relation_id, source_order, tile, member_count and ``content`` columns."""
    fullest = F.max_by(F.struct("source_order", "member_count", *content), F.struct(F.col("member_count"), -F.col("source_order")))
    return copies.groupBy("relation_id").agg(F.min_by("tile", "source_order").alias("tile"), fullest.alias("w"), F.count("*").alias("copies")).select(
        "relation_id", "tile", "copies", F.col("w.source_order").alias("from_source"), F.col("w.member_count").alias("member_count"),
        *[F.col(f"w.{c}").alias(c) for c in content])


def replicate_relations(copies: DataFrame, extents: DataFrame, rects: list[Rect]) -> DataFrame:
    """A row per (relation, tile) for every tile its extent touches or that already has a copy. ``owner`` is the tile
    whose copy has most members (first in tile order among equals). Relations without extent are left out."""
    owner = copies.groupBy("relation_id").agg(F.max_by("tile", F.struct("member_count", F.negative(F.col("tile_order")))).alias("owner"),
                                              F.collect_set("tile").alias("_have"))
    wide = extents.where(F.col("min_lat").isNotNull()).join(owner, "relation_id")
    tiles = F.array_distinct(F.concat(touched(rects), F.col("_have")))
    return wide.withColumn("_tiles", tiles).select(
        "relation_id", "owner", "min_lat", "max_lat", "min_lon", "max_lon", F.size("_tiles").alias("fanout"), F.explode("_tiles").alias("tile"))


# ---- crop of relation members --------------------------------------------------------------------------------

def crop_members(ds: OsmDataset, views: DataFrame, pad: float = 0.25, min_members: int = 64) -> DataFrame:
    """Members of each view's relations with ``kept``. Large relations without ring meaning that reach beyond the padded
    box keep the members that meet it; a way without extent counts as meeting it; nested relations stay; one kept inner
    ring keeps all inner rings.

    Members are placed once. Pairs of relation and view, and members times views, are by far the most rows: pairs are shuffled once, to
    the members of their relation, and what comes of them is not shuffled. Which views keep an inner ring is found first, from
    the places of inner rings alone, and lies with its relation before that meets the views."""
    nodes = cut_lineage(ds.nodes.select("id", "lat", "lon"))
    ext = cut_lineage(G.way_bbox(ds.way_nodes, nodes))
    corners = ("y1", "y2", "x1", "x2")
    m = ds.relation_members
    ways = m.where("member_type = 'way'").join(
        ext.select(F.col("way_id").alias("member_ref"), *[F.col(c).alias(k) for c, k in zip(("min_lat", "max_lat", "min_lon", "max_lon"), corners)]), "member_ref", "left")
    points = m.where("member_type = 'node'").join(
        nodes.select(F.col("id").alias("member_ref"), *[F.col(c).alias(k) for c, k in zip(("lat", "lat", "lon", "lon"), corners)]), "member_ref", "left")
    other = m.where("member_type IS NULL OR member_type NOT IN ('way', 'node')").select(*m.columns, *[F.lit(None).cast("double").alias(k) for k in corners])
    placed = cut_lineage(ways.select(*m.columns, *corners).unionByName(points.select(*m.columns, *corners)).unionByName(other))
    drop_cut(nodes, ext)

    is_way, is_inner = F.col("member_type") == "way", F.col("role") == "inner"
    nowhere = F.coalesce(*corners).isNull()
    per = placed.groupBy(F.col("relation_id").alias("id")).agg(
        F.min("y1").alias("min_lat"), F.max("y2").alias("max_lat"), F.min("x1").alias("min_lon"), F.max("x2").alias("max_lon"),
        F.bool_or(is_inner & ((F.col("member_type") == "relation") | (is_way & nowhere))).alias("_always")).where("min_lat IS NOT NULL")
    box = views.select("view_id", "min_lat", "max_lat", "min_lon", "max_lon")
    py, px = (F.col("max_lat") - F.col("min_lat")) * pad, (F.col("max_lon") - F.col("min_lon")) * pad
    padded = box.select("view_id", (F.col("min_lat") - py).alias("min_lat"), (F.col("max_lat") + py).alias("max_lat"),
                        (F.col("min_lon") - px).alias("min_lon"), (F.col("max_lon") + px).alias("max_lon"))
    # Of a way that is placed in part, what is not known meets any box; a node meets none then.
    wide = [F.when(is_way, F.coalesce(k, F.lit(far))).otherwise(F.col(k)).alias(c)
            for k, far, c in zip(corners, (-1000.0, 1000.0, -1000.0, 1000.0), ("min_lat", "max_lat", "min_lon", "max_lon"))]
    rings = placed.where(is_inner & ~nowhere & F.col("member_type").isin("way", "node")).select("relation_id", *wide).where(
        "min_lat IS NOT NULL AND min_lon IS NOT NULL")
    inner = box_join(rings, padded).groupBy(F.col("relation_id").alias("id")).agg(F.collect_set("view_id").alias("_views"))

    t = F.col("tags")
    area_like = any_of(t, "building", "building:part", "landuse", "leisure", "natural", "water", "wetland")
    ringed = eq(t, "type", "multipolygon") | ((eq(t, "type", "boundary") | has(t, "boundary")) & area_like)
    rel = ds.relations.select("id", ringed.alias("rings"), (F.col("member_count") > min_members).alias("large")).join(per, "id").join(inner, "id", "left")
    py, px = (F.col("box_max_lat") - F.col("box_min_lat")) * pad, (F.col("box_max_lon") - F.col("box_min_lon")) * pad
    cut = {"c_y1": F.col("box_min_lat") - py, "c_y2": F.col("box_max_lat") + py, "c_x1": F.col("box_min_lon") - px, "c_x2": F.col("box_max_lon") + px}
    inside = (F.col("min_lon") >= cut["c_x1"]) & (F.col("max_lon") <= cut["c_x2"]) & (F.col("min_lat") >= cut["c_y1"]) & (F.col("max_lat") <= cut["c_y2"])
    crop = ~F.col("rings") & ~inside & F.col("large")
    # Only where members are cropped does the box matter.
    maybe = F.coalesce(crop, F.lit(True))
    c = box_join(rel, box).select(
        "view_id", F.col("id").alias("relation_id"), crop.alias("crop"), (F.col("_always") | F.array_contains("_views", F.col("view_id"))).alias("_inner"),
        *[F.when(maybe, v).alias(k) for k, v in cut.items()])
    meets = (F.col("x2") >= F.col("c_x1")) & (F.col("x1") <= F.col("c_x2")) & (F.col("y2") >= F.col("c_y1")) & (F.col("y1") <= F.col("c_y2"))
    hit = (F.when(~F.col("crop") | (F.col("member_type") == "relation"), True)
           .when(is_way, F.coalesce(meets, F.lit(True))).otherwise(F.coalesce(meets, F.lit(False))))
    return placed.join(c, "relation_id").withColumn("kept", hit | (F.coalesce("_inner", F.lit(False)) & is_inner)).select(
        "view_id", "relation_id", "seq", "member_type", "member_ref", "role", "crop", "kept")


# ---- comparison and merging ------------------------------------------------------------------------------------

def tags_text(tags: Column) -> Column:
    """Order-free text of a tag map, for equality."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags)))), F.lit(""))


def dataset_overlap(a: OsmDataset, b: OsmDataset) -> DataFrame:
    """Elements with the same id in both: how many, and how many differ in place, node count, version or tags."""
    def differ(*pairs: tuple[Column, Column]) -> Column:
        out = F.lit(False)
        for x, y in pairs:
            out = out | ~x.eqNullSafe(y)
        return F.count_if(out)

    out = None
    for kind, table in KINDS.items():
        extra = {"node": ["lat", "lon"], "way": ["node_count"], "relation": ["member_count"]}[kind]
        def side(ds: OsmDataset, p: str) -> DataFrame:
            return getattr(ds, table).select("id", F.col("version").alias(f"{p}_version"), tags_text(F.col("tags")).alias(f"{p}_tags"),
                                             *[F.col(c).alias(f"{p}_{c}") for c in extra])
        j = side(a, "a").join(side(b, "b"), "id")
        row = j.agg(F.count("*").alias("shared"), differ(*[(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in extra]).alias("shape_differs"),
                    differ((F.col("a_version"), F.col("b_version")), (F.col("a_tags"), F.col("b_tags"))).alias("content_differs")).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def dataset_diff(a: OsmDataset, b: OsmDataset) -> DataFrame:
    """Added, removed and changed elements from a to b: (kind, id, change)."""
    out = None
    for kind, table in KINDS.items():
        extra = {"node": ["lat", "lon"], "way": ["node_count"], "relation": ["member_count"]}[kind]
        def side(ds: OsmDataset, p: str) -> DataFrame:
            content = F.struct("version", *extra, tags_text(F.col("tags")).alias("t"))
            return getattr(ds, table).select("id", content.alias(p))
        j = side(a, "a").join(side(b, "b"), "id", "full_outer")
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
        rows = j.select(F.lit(kind).alias("kind"), "id", change.alias("change")).where("change IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_append(target: OsmDataset, source: OsmDataset) -> tuple[OsmDataset, DataFrame]:
    """Insert what is new by id and never overwrite. Returns the merged dataset and the counts of inserted rows."""
    keys = {"nodes": ["id"], "ways": ["id"], "relations": ["id"], "way_nodes": ["way_id", "seq"], "relation_members": ["relation_id", "seq"]}
    merged, counts = {}, None
    for name, cols in keys.items():
        old = getattr(target, name)
        new = getattr(source, name).join(old.select(*cols), cols, "left_anti")
        merged[name] = old.unionByName(new, allowMissingColumns=True)
        row = new.agg(F.count("*").alias("inserted")).withColumn("table_name", F.lit(name))
        counts = row if counts is None else counts.unionByName(row)
    return OsmDataset(**merged), counts


def merge_parts(parts: DataFrame, content: list[str], primary: str) -> DataFrame:
    """One row per id over several parts: newest version wins, then the primary part, then the part name; when any copy
    lacks a version, only part order decides. ``kind`` and ``reason`` are set where contents differ.

    Everything is a mergeable aggregate, so copies of a popular id are combined before the shuffle.
    """
    order = F.struct((F.col("part") != primary).alias("late"), F.col("part"))
    newest = F.min_by(F.struct("part", "version", *content), F.struct((-F.col("version")).alias("v"), order.alias("o")))
    first = F.min_by(F.struct("part", "version", *content), order)
    text = F.to_json(F.struct(*content))
    versions_differ = F.min("version") != F.max("version")
    unknown = F.bool_or(F.col("version").isNull())
    g = parts.groupBy("id").agg(
        F.when(unknown, first).otherwise(newest).alias("w"), F.count("*").alias("holders"),
        (F.min(text) != F.max(text)).alias("_differs"), F.coalesce(versions_differ, F.lit(False)).alias("_vd"))
    kind = F.when(F.col("_differs"), F.when(F.col("_vd"), "version").otherwise("same-version"))
    reason = F.when(F.col("_differs"), F.when(F.col("_vd"), "version-newer-wins").otherwise("content-differs"))
    return g.select("id", F.col("w.part").alias("picked"), F.col("w.version").alias("version"), *[F.col(f"w.{c}").alias(c) for c in content],
                    "holders", kind.alias("kind"), reason.alias("reason"))


def pick_relation(parts: DataFrame, primary: str) -> DataFrame:
    """Which copy of a relation to keep: newest version, known extent, larger extent, more members, more kept members,
    primary part, part name. ``parts``: id, part, version, extent columns, member_total, kept."""
    known = F.col("min_lat").isNotNull() & F.col("max_lat").isNotNull() & F.col("min_lon").isNotNull() & F.col("max_lon").isNotNull()
    area = F.greatest(F.lit(0.0), F.col("max_lon") - F.col("min_lon")) * F.greatest(F.lit(0.0), F.col("max_lat") - F.col("min_lat"))
    rank = F.struct((-F.col("version")).alias("a"), (~known).alias("b"), F.when(known, -area).otherwise(0.0).alias("c"),
                    (-F.coalesce("member_total", F.lit(0))).alias("d"), (-F.coalesce("kept", F.lit(0))).alias("e"),
                    (F.col("part") != primary).alias("f"), F.col("part").alias("g"))
    newest_known = F.max(F.struct("version", known.alias("k")))
    g = parts.groupBy("id").agg(F.min_by("part", rank).alias("picked"), F.count("*").alias("holders"), F.min("version").alias("lo"),
                                newest_known.alias("top"))
    differ = F.col("lo") != F.col("top.version")
    return g.select("id", "picked", "holders", F.when(differ, "version").when(~F.col("top.k"), "same-version").otherwise("derived-bbox").alias("kind"),
                    F.when(differ, "version-newer-wins").when(~F.col("top.k"), "content-differs").otherwise("derived-bbox-extent-wins").alias("reason"))


# ---- audits ------------------------------------------------------------------------------------------------------

def bounds_audit(ds: OsmDataset, bounds: dict) -> DataFrame:
    """Nodes outside the declared bounds per whole degree of latitude, and how many of them some way uses."""
    out = ds.nodes.where((F.col("lat") < bounds["min_lat"]) | (F.col("lat") > bounds["max_lat"])
                         | (F.col("lon") < bounds["min_lon"]) | (F.col("lon") > bounds["max_lon"]))
    used = ds.way_nodes.select(F.col("node_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    return (out.join(used, "id", "left").groupBy(F.col("lat").cast("int").alias("lat_band"))
            .agg(F.count("*").alias("outside"), F.count_if(F.col("_used")).alias("referenced")))


def tile_audit(nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """Checks of a cut: ways in more than one tile, nodes whose copies differ, references without node in their tile."""
    shared = ways.groupBy("id").agg(F.countDistinct("tile").alias("n")).where("n > 1").agg(F.count("*").alias("n")).withColumn("check_name", F.lit("ways_in_many_tiles"))
    text = F.to_json(F.struct("lat", "lon", "version", tags_text(F.col("tags")).alias("t")))
    differ = nodes.groupBy("id").agg((F.min(text) != F.max(text)).alias("d")).where("d").agg(F.count("*").alias("n")).withColumn("check_name", F.lit("node_copies_differ"))
    lost = way_nodes.join(nodes.select("tile", F.col("id").alias("node_id")), ["tile", "node_id"], "left_anti").agg(
        F.count("*").alias("n")).withColumn("check_name", F.lit("dangling_in_tile"))
    copies = nodes.where("support").agg(F.count("*").alias("n")).withColumn("check_name", F.lit("support_copies"))
    return shared.unionByName(differ).unionByName(lost).unionByName(copies)


def id_ranges(datasets: dict[str, OsmDataset]) -> DataFrame:
    """Largest and next id per dataset and kind, and whether another dataset's ids already reach into its new ones."""
    out = None
    for name, ds in datasets.items():
        for kind, table in KINDS.items():
            row = getattr(ds, table).agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id")).select(
                F.lit(name).alias("dataset"), F.lit(kind).alias("kind"), "max_id", (F.col("max_id") + 1).alias("next_id"))
            out = row if out is None else out.unionByName(row)
    # Two rows of the same kind clash when one's next id is not above the other's largest; the table has a few rows.
    o = out.select(F.col("dataset").alias("o_dataset"), "kind", F.col("max_id").alias("o_max"))
    clash = out.join(o, "kind").where("dataset <> o_dataset AND next_id <= o_max").groupBy("dataset", "kind").agg(
        F.array_join(F.array_sort(F.collect_set("o_dataset")), ",").alias("clashes_with"))
    return out.join(clash, ["dataset", "kind"], "left").na.fill("", ["clashes_with"])


def allocate_ids(df: DataFrame, start: int | Column, order: str, name: str = "new_id", then: list[str] | None = None) -> DataFrame:
    """Consecutive new ids from ``start`` in the order of a numeric column (ties: ``then``), without a counter and without one
    big sort: rows are numbered inside chunks of the column of about equal size, and chunk counts give the offsets."""
    start = start if isinstance(start, Column) else F.lit(start)
    one = df.withColumn("_all", F.lit(0))
    return numbered(one, ["_all"], even_chunk(df, order), [F.col(order), *map(F.col, then or [])], "_rn").withColumn(
        name, start + F.col("_rn") - 1).drop("_all", "_rn")
