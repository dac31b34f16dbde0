"""Box queries: candidates, visibility, withholding, ledgers, statistics and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetloom.functions import tags as TG
from streetloom.functions.geo import M_PER_DEG_LAT, M_PER_DEG_LON_EQUATOR, RAD, bbox_area_m2
from streetloom.model import OsmDataset
from streetloom.operators import geometry as G
from streetloom.operators.ordered import running_sum
from streetloom.operators.spatial import box_join, point_box_join
from streetloom.session import cut_lineage

WITHHELD = ["neverSend", "roadClass", "railMinor", "landuse", "building"]


def dataset_info(ds: OsmDataset) -> DataFrame:
    """One row: counts, extent of the nodes, next free ids. Each table is read once."""
    n = ds.nodes.agg(F.count("*").alias("nodes"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
                     F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
                     (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_node_id"))
    w = ds.ways.agg(F.count("*").alias("ways"), (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_way_id"))
    r = ds.relations.agg(F.count("*").alias("relations"), (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_relation_id"))
    wn = ds.way_nodes.agg(F.count("*").alias("way_nodes"))
    m = ds.relation_members.agg(F.count("*").alias("relation_members"))
    # Five one-row aggregates side by side.
    out = n
    for one in (w, r, wn, m):
        out = out.join(one, F.lit(True))
    return out


def boxed_ways(ways_with_extent: DataFrame, views: DataFrame) -> DataFrame:
    """Ways that touch each view's box. ``views``: view_id, zoom, min_lat..max_lon."""
    return box_join(ways_with_extent, views)


def with_status(candidates: DataFrame, detail: int, limit: int, geometry: str = "line") -> DataFrame:
    """Status of every candidate of every view: invisible, one of the withheld classes, returned or dropped.

    Only rows beyond ``limit`` in id order are dropped. The cut-off id per view comes from a rank filter that is applied
    before the shuffle, so a view over everything does not put its ways in one task.
    """
    return cut_off(stage(candidates, detail, geometry), limit)


def stage(candidates: DataFrame, detail: int, geometry: str = "line") -> DataFrame:
    """Status before the limit. ``_least``, the zoom from which on an element is visible, and ``_traits``, what else its tags say, are taken where they are known."""
    area = bbox_area_m2(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
    zoom = F.col("zoom")
    visible = zoom >= F.col("_least") if "_least" in candidates.columns else TG.lod_visible(F.col("tags"), zoom, geometry)
    if "_traits" in candidates.columns:
        withheld = TG.lod_withheld({k: F.col("_traits")[k] for k in TG.lod_traits(F.lit(None), detail)}, zoom, area, F.col("closed"), detail)
    else:
        withheld = TG.lod_withhold(F.col("tags"), zoom, area, F.col("closed"), detail)
    return candidates.withColumn("status", F.when(~visible, "invisible").otherwise(F.coalesce(withheld, F.lit("returned"))))


def cut_off(staged: DataFrame, limit: int) -> DataFrame:
    """Rows of ``stage`` beyond ``limit`` in id order become dropped."""
    first = Window.partitionBy("view_id").orderBy("id")
    cut = (staged.where("status = 'returned'").select("view_id", "id").withColumn("_n", F.row_number().over(first))
           .where(F.col("_n") <= limit).groupBy("view_id").agg(F.max("id").alias("_last"), F.max("_n").alias("_kept"))
           .where(F.col("_kept") == limit))
    return (staged.join(cut, "view_id", "left")
            .withColumn("status", F.when((F.col("status") == "returned") & (F.col("id") > F.col("_last")), "dropped").otherwise(F.col("status")))
            .drop("_last", "_kept"))


def selection_ledger(status: DataFrame, kind: str) -> DataFrame:
    """Exact counts per view: candidates, visible (after withholding), returned, dropped, withheld by class."""
    def n(cond: Column) -> Column:
        return F.count_if(cond)
    s = F.col("status")
    by_class = [n(s == c).alias(f"withheld_{TG_NAMES[c]}") for c in WITHHELD]
    return status.groupBy("view_id", "zoom").agg(
        F.count("*").alias("candidates"), n(s.isin("returned", "dropped")).alias("visible"),
        n(s == "returned").alias("returned"), n(s == "dropped").alias("dropped"), n(s == "invisible").alias("invisible"),
        *by_class, (n(s == "dropped") == 0).alias("complete")).withColumn("kind", F.lit(kind))


TG_NAMES = {"neverSend": "never_send", "roadClass": "road_class", "railMinor": "rail_minor", "landuse": "landuse",
            "building": "building"}


def viewport(ds: OsmDataset, views: DataFrame, detail: int = 4, limit: int = 15000) -> dict[str, DataFrame]:
    """Many box-and-zoom queries in one job: ways, tagged nodes and relations with the ledger of each view."""
    # What an element's tags say is worked out once per element, before it meets places and views; the ledger needs neither tags nor lengths of ways.
    ds = ds.with_(nodes=cut_lineage(ds.nodes.select("id", "lat", "lon", "tags")))
    tags = F.col("tags")
    traits = F.struct(*[c.alias(k) for k, c in TG.lod_traits(tags, detail).items()])
    said = ds.ways.select("id", "closed", TG.read_once(tags).alias("tags")).select("id", "closed", TG.min_zoom_line(tags).alias("_least"), traits.alias("_traits"))
    placed = cut_lineage(said.join(G.way_bbox(ds.way_nodes, ds.nodes).withColumnRenamed("way_id", "id"), "id"))
    staged = stage(boxed_ways(G.with_extents(ds).withColumn("_least", TG.min_zoom_line(tags)), views), detail)
    way_status = cut_off(staged, limit).drop("_least")
    tagged = ds.nodes.where(tags.isNotNull()).withColumn("_least", TG.min_zoom_point(tags)).withColumn("_never", TG.never_send_class(tags).isNotNull())
    node_status = point_box_join(tagged, views).withColumn("status", F.when(F.col("zoom") < F.col("_least"), "invisible").when(F.col("_never"), "neverSend").otherwise(
        "returned")).drop("_least", "_never")
    located = placed.where("min_lat IS NOT NULL").select(F.col("id").alias("way_id"), "min_lat", "max_lat", "min_lon", "max_lon")
    rels = ds.relations.join(G.relation_bbox(ds, located).withColumnRenamed("relation_id", "id"), "id").withColumn(
        "_least", F.when(tags.isNotNull(), TG.min_zoom_line(tags)))
    rel_status = box_join(rels, views).withColumn("status", F.when(F.col("zoom") >= F.col("_least"), "returned").otherwise("invisible")).drop("_least")
    # What the ledger counts is written once, and the cut-off ids are found from that.
    counted = cut_lineage(stage(boxed_ways(placed, views), detail).select("view_id", "zoom", "id", "status"))
    ledger = (selection_ledger(cut_off(counted, limit), "way").unionByName(selection_ledger(node_status, "node"))
              .unionByName(selection_ledger(rel_status, "relation")))
    keep = F.col("status") == "returned"
    return {"ways": way_status.where(keep), "nodes": node_status.where(keep), "relations": rel_status.where(keep), "ledger": ledger}


def merge_ledgers(parts: DataFrame, keys: list[str], echo: list[str] = ()) -> DataFrame:
    """Fold the ledgers of several parts: numbers add up, booleans must all hold, string lists are united, columns in
    ``echo`` repeat the first part's value; a number that one part does not know is unknown in the sum."""
    aggs = []
    for f in parts.schema.fields:
        c = F.col(f.name)
        if f.name in keys or f.name == "part":
            continue
        if f.name in echo:
            aggs.append(F.min_by(c, F.col("part")).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            aggs.append(F.bool_and(c).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(f.name))
        else:
            aggs.append(F.when(F.bool_or(c.isNull()), F.lit(None)).otherwise(F.sum(c)).alias(f.name))
    return parts.groupBy(*keys).agg(*aggs)


# ---- statistics ---------------------------------------------------------------------------------------

def tag_stats(ways: DataFrame, n: int | None = None, approximate: bool = False) -> DataFrame:
    """Ways per tag key, most frequent first. A way has a key once, so a plain count equals the distinct count."""
    keys = ways.where(F.col("tags").isNotNull()).select("id", F.explode(F.map_keys("tags")).alias("key"))
    count = F.approx_count_distinct("id") if approximate else F.count("*")
    out = keys.groupBy("key").agg(count.alias("ways"))
    return out if n is None else out.orderBy(F.col("ways").desc(), "key").limit(n)


def bbox_stats(extents: DataFrame, nodes: DataFrame, views: DataFrame) -> DataFrame:
    """Buildings, highways, waterways, land use, railways and tagged nodes per view."""
    hits = box_join(extents.select("id", "tags", "min_lat", "max_lat", "min_lon", "max_lon"), views.select("view_id", "min_lat", "max_lat", "min_lon", "max_lon"))
    def has(*keys: str) -> Column:
        cond = F.lit(False)
        for k in keys:
            cond = cond | F.coalesce(F.map_contains_key("tags", k), F.lit(False))
        return cond
    per_way = hits.groupBy("view_id").agg(
        F.count_if(has("building")).alias("buildings"), F.count_if(has("highway")).alias("highways"),
        F.count_if(has("waterway") | TG.eq(F.col("tags"), "natural", "water")).alias("waterways"),
        F.count_if(has("landuse", "leisure", "natural")).alias("landuse"), F.count_if(has("railway")).alias("railways"))
    pois = point_box_join(nodes.where(F.col("tags").isNotNull()).select("id", "lat", "lon"),
                          views.select("view_id", "min_lat", "max_lat", "min_lon", "max_lon")).groupBy("view_id").agg(F.count("*").alias("pois"))
    zero = ["buildings", "highways", "waterways", "landuse", "railways", "pois"]
    return views.select("view_id").join(per_way, "view_id", "left").join(pois, "view_id", "left").na.fill(0, zero)


def class_counts(ways: DataFrame) -> DataFrame:
    cls = TG.line_class(F.col("tags"))
    return ways.select(cls.alias("cls")).where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("ways"))


def choose_classes(counts: DataFrame, picked: int | None = None, limit: int = 15000, budget: float = 0.5,
                   min_ways: int = 200) -> DataFrame:
    """Which line classes to generalise: the fixed ones and the large ones, then the largest others until what remains
    fits the budget. ``counts`` holds one row per class (cls, ways), which is small after aggregation.

    Without ``picked`` every counted way is taken to be picked.
    """
    room = max(1, int(limit * budget))
    every = Window.partitionBy()
    marked = counts.withColumn("family", TG.line_family(F.col("cls"))).withColumn("always", TG.line_always(F.col("cls")))
    marked = marked.withColumn("_first", F.col("always") | (F.col("ways") >= min_ways))
    total = F.lit(picked) if picked is not None else F.sum("ways").over(every)
    marked = marked.withColumn("_left", total - F.coalesce(F.sum(F.when(F.col("_first"), F.col("ways"))).over(every), F.lit(0)))
    order = Window.partitionBy("_first").orderBy(F.col("ways").desc(), "cls").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("ways").over(order), F.lit(0))
    return (marked.withColumn("chosen", F.col("_first") | (F.col("_left") - before > room))
            .select("cls", "family", "ways", "always", "chosen"))


def category_counts(features: DataFrame, by: list[str]) -> DataFrame:
    """Counts per ``by`` and category with subtotals; ``level`` is the grouping id (0 = finest)."""
    c = features.withColumn("category", TG.category_of(F.col("tags")))
    return c.rollup(*by, "category").agg(F.count("*").alias("features"), F.grouping_id().alias("level"))


def audit_lod(ways: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Stored road_class and lod_zoom against recomputed ones, over all rows."""
    cls, zoom = TG.lod_keys(F.col("tags"))
    bad = ~(F.col("road_class").eqNullSafe(cls) & F.col("lod_zoom").eqNullSafe(zoom))
    out = ways.agg(F.count("*").alias("checked"), F.count_if(bad).alias("bad"))
    return out.withColumn("ok", (F.col("checked") > 0) & (F.col("bad") / F.greatest(F.col("checked"), F.lit(1)) <= threshold))


# ---- payload ---------------------------------------------------------------------------------------------

def pack_deltas(df: DataFrame, column: str = "coords", scale: float = 1e6) -> DataFrame:
    """Quantise ``ARRAY<STRUCT<lat,lon>>`` and keep first values and differences as integer arrays dlat, dlon."""
    def deltas(field: str) -> Column:
        q = F.transform(column, lambda p: F.floor(p[field] * scale + 0.5))
        return F.transform(q, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(q, i - 1)))
    return df.withColumn("dlat", deltas("lat")).withColumn("dlon", deltas("lon"))


def unpack_deltas(df: DataFrame, scale: float = 1e6) -> DataFrame:
    """The inverse: prefix sums of dlat and dlon back to ``coords`` on the quantised grid."""
    def sums(c: str) -> Column:
        start = F.array().cast("array<bigint>")
        return F.aggregate(c, start, lambda acc, x: F.concat(acc, F.array(x + F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0)))))
    return df.withColumn("coords", F.zip_with(sums("dlat"), sums("dlon"), lambda a, b: F.struct(
        (a.cast("double") / scale).alias("lat"), (b.cast("double") / scale).alias("lon"))))


def payload_sizes(features: DataFrame, zooms: list[int], encodings: dict[str, Column]) -> DataFrame:
    """Bytes per zoom and encoding, in wide form: every feature counts at each zoom from its least visible one on."""
    least = TG.min_zoom_line(F.col("tags"))
    sized = features.select(least.alias("_z"), *[F.octet_length(F.to_json(c)).alias(n) for n, c in encodings.items()])
    # Aggregate per least zoom first: 19 rows instead of one row per feature and zoom.
    per = sized.groupBy("_z").agg(F.count("*").alias("features"), *[F.sum(n).alias(n) for n in encodings])
    at = per.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms]))).where("zoom >= _z")
    return at.groupBy("zoom").agg(F.sum("features").alias("features"), *[F.sum(n).alias(f"{n}_bytes") for n in encodings])


def payload_change(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    b = before.select("zoom", F.col(column).alias("before_bytes"))
    a = after.select("zoom", F.col(column).alias("after_bytes"))
    return b.join(a, "zoom").withColumn("saved_pct", F.floor((F.col("before_bytes") - F.col("after_bytes")) * 1000.0
                                                             / F.col("before_bytes") + 0.5) / 10)


# ---- search and lookup -------------------------------------------------------------------------------------

def _ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(ds: OsmDataset, name: str | None = None, key: str | None = None, value: str | None = None,
           limit: int = 100) -> DataFrame:
    """Elements by part of their name, by key and value, or by key; ways first, then nodes, then relations, by id.

    ``center`` is the middle vertex of a way or the node itself. Only the hits are joined with geometry.
    """
    def hit(df: DataFrame, kind: str, rank: int, cond: Column) -> DataFrame:
        found = df.where(F.coalesce(cond, F.lit(False))).select(F.lit(rank).alias("_rank"), F.lit(kind).alias("type"), "id", "tags")
        return found.orderBy("id").limit(limit)

    t = F.col("tags")
    if name:
        needle = _ascii_fold(F.lit(name.replace("%", "").replace("_", "")))
        def named(*keys: str) -> Column:
            cond = F.lit(False)
            for k in keys:
                cond = cond | F.coalesce(_ascii_fold(t[k]).contains(needle), F.lit(False))
            return cond
        parts = [hit(ds.ways, "way", 0, named("name", "name:zh", "ref")), hit(ds.nodes, "node", 1, named("name", "name:zh")),
                 hit(ds.relations, "relation", 2, named("name", "name:zh"))]
    elif key and value:
        parts = [hit(ds.ways, "way", 0, t[key] == value), hit(ds.nodes, "node", 1, t[key] == value)]
    else:
        parts = [hit(ds.ways, "way", 0, F.map_contains_key(t, F.lit(key)))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.orderBy("_rank", "id").limit(limit)
    wanted = found.where("type = 'way'").select(F.col("id").alias("way_id"))
    refs = ds.way_nodes.join(wanted, "way_id", "left_semi")
    coords = G.way_geometry(refs, ds.nodes)
    mid = F.get("coords", F.floor(F.size("coords") / 2).cast("int"))
    way_mid = coords.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), mid.alias("center"))
    node_at = ds.nodes.join(found.where("type = 'node'").select("id"), "id", "left_semi").select(
        F.lit("node").alias("type"), "id", F.struct("lat", "lon").alias("center"))
    return found.join(way_mid.unionByName(node_at), ["type", "id"], "left").drop("_rank")


def lookup(ds: OsmDataset, changes: DataFrame, wanted: DataFrame, history: int = 5) -> DataFrame:
    """For many (type, id): the element's version and tags, its coordinates, its latest changes and parent relations."""
    base = None
    for kind, df in (("way", ds.ways), ("node", ds.nodes), ("relation", ds.relations)):
        part = df.join(wanted.where(F.col("type") == kind), "id", "left_semi").select(F.lit(kind).alias("type"), "id", "version", "tags")
        base = part if base is None else base.unionByName(part)
    way_ids = wanted.where("type = 'way'").select(F.col("id").alias("way_id"))
    members = ds.relation_members.join(wanted.where("type = 'relation'").select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    member_ways = members.where("member_type = 'way'").select(F.col("member_ref").alias("way_id"))
    geo = G.way_geometry(ds.way_nodes.join(way_ids.unionByName(member_ways).distinct(), "way_id", "left_semi"), ds.nodes)
    way_xy = geo.join(way_ids, "way_id", "left_semi").select(F.lit("way").alias("type"), F.col("way_id").alias("id"), "coords")
    node_xy = ds.nodes.join(wanted.where("type = 'node'"), "id", "left_semi").select(
        F.lit("node").alias("type"), "id", F.array(F.struct("lat", "lon")).alias("coords"))
    rel_pts = (members.where("member_type = 'way'").join(geo, F.col("member_ref") == F.col("way_id"))
               .groupBy("relation_id").agg(F.sum(F.size("coords")).alias("member_points"), F.count("*").alias("member_ways")))
    recent = Window.partitionBy("elem_type", "elem_id").orderBy(F.col("id").desc())
    hist = (changes.join(wanted, (F.col("elem_type") == wanted["type"]) & (F.col("elem_id") == wanted["id"]), "left_semi")
            .withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= history)
            .groupBy(F.col("elem_type").alias("type"), F.col("elem_id").alias("id"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("id").alias("change_id"), "action"))).alias("history")))
    parents = (ds.relation_members.join(wanted, (F.col("member_type") == wanted["type"]) & (F.col("member_ref") == wanted["id"]), "left_semi")
               .groupBy(F.col("member_type").alias("type"), F.col("member_ref").alias("id"))
               .agg(F.array_sort(F.collect_set("relation_id")).alias("parents")))
    return (base.join(way_xy.unionByName(node_xy), ["type", "id"], "left").join(hist, ["type", "id"], "left")
            .join(parents, ["type", "id"], "left")
            .join(rel_pts.select(F.lit("relation").alias("type"), F.col("relation_id").alias("id"), "member_points", "member_ways"), ["type", "id"], "left"))


# ---- dense blocks -----------------------------------------------------------------------------------------

BLOCK_M = 300.0


def block_key(lat: Column, lon: Column, center_lat: Column) -> tuple[Column, Column]:
    lat0 = F.floor(center_lat + 0.5)
    step_lon = F.lit(BLOCK_M) / (F.lit(M_PER_DEG_LON_EQUATOR) * F.greatest(F.lit(0.15), F.cos(lat0 * RAD)))
    return F.floor(lat / (BLOCK_M / M_PER_DEG_LAT)), F.floor(lon / step_lon)


def dense_blocks(features: DataFrame, view: dict, threshold: int, budget: int, min_count: int = 3) -> DataFrame:
    """300 m blocks that are drawn in short form: those over the threshold (if at least a sixth of the block is in view),
    then the densest others until the total left over fits the budget. ``features``: lat, lon, drawn BOOLEAN.

    Blocks are few once counted, but a view over everything still has many, so the running total is chunked by excess.
    """
    center = F.lit((view["min_lat"] + view["max_lat"]) / 2)
    row, col = block_key(F.col("lat"), F.col("lon"), center)
    counts = features.select(row.alias("b_row"), col.alias("b_col"), "drawn").groupBy("b_row", "b_col").agg(
        F.count("*").alias("n"), F.count_if("drawn").alias("n_drawn"))
    step_lat = F.lit(BLOCK_M / M_PER_DEG_LAT)
    step_lon = F.lit(BLOCK_M) / (F.lit(M_PER_DEG_LON_EQUATOR) * F.greatest(F.lit(0.15), F.cos(F.floor(center + 0.5) * RAD)))
    def part_in(lo: Column, size: Column, a: float, b: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(lo + size, F.lit(b)) - F.greatest(lo, F.lit(a))) / size
    frac = part_in(F.col("b_row") * step_lat, step_lat, view["min_lat"], view["max_lat"]) * part_in(
        F.col("b_col") * step_lon, step_lon, view["min_lon"], view["max_lon"])
    b = counts.withColumn("over", F.col("n_drawn") - threshold).withColumn("frac", frac)
    hot = (F.col("over") > 0) & (F.col("n_drawn") >= min_count) & (F.col("frac") >= 1 / 6)
    b = b.withColumn("hot", hot)
    sums = b.agg(F.sum("n_drawn").alias("_total"), F.sum(F.when(F.col("hot"), F.col("n_drawn")).otherwise(0)).alias("_hot"))
    rest = running_sum(b.where("NOT hot").withColumn("_k", F.lit(0)), ["_k"], -F.col("over"),
                       [F.col("over").desc(), F.col("b_row"), F.col("b_col")], "n_drawn", "_upto").drop("_k")
    # The sums are one row; attach them without a shuffle.
    chosen = rest.join(F.broadcast(sums), F.lit(True)).where(
        (F.col("n_drawn") >= min_count) & (F.col("_total") - F.col("_hot") - (F.col("_upto") - F.col("n_drawn")) > budget))
    kept = ["b_row", "b_col", "n", "n_drawn", "over"]
    return (b.where("hot").select(*kept, F.lit(False).alias("by_budget"))
            .unionByName(chosen.select(*kept, F.lit(True).alias("by_budget"))))
