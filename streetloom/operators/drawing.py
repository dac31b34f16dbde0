"""Generalised lines and areas, display tiles, their coverage and their upkeep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions import shapes as S, tags as T
from streetloom.functions.geo import bbox_area_m2, meters_per_pixel, ring_area_m2
from streetloom.model import OsmDataset
from streetloom.operators import geometry as G
from streetloom.operators.chains import chained_arrays
from streetloom.session import cut_lineage


# ---- Fixed values --------------------------------------------------------------------------------------
BANDS = [8, 9, 10, 11, 12, 13, 14]
TOLERANCE_PX, DIGITS, LIMIT, BUDGET, LEAST_WAYS = 1.0, 5, 15000, 0.5, 200
STATUS_ORDER = ["line", "area", "way", "nogfx", "invisible", "lod"]
# -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TileGrid:
    """n x n tiles over an extent, numbered from 1, row by row from the south-west."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float
    n: int

    @staticmethod
    def over(nodes: DataFrame, n: int) -> TileGrid:
        """The grid over the extent of all nodes (four numbers for the driver)."""
        e = nodes.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
        return TileGrid(*(e if e[0] is not None else (0.0, 1.0, 0.0, 1.0)), n)

    def _step(self, v: Column, lo: float, hi: float) -> Column:
        return F.least(F.lit(self.n - 1), F.greatest(F.lit(0), F.floor((v - lo) / ((hi - lo) / self.n))))

    def tile_of(self, lat: Column, lon: Column) -> Column:
        """0 outside of the extent."""
        inside = lat.between(self.min_lat, self.max_lat) & lon.between(self.min_lon, self.max_lon)
        return F.when(inside, self._step(lat, self.min_lat, self.max_lat) * self.n + self._step(lon, self.min_lon, self.max_lon) + 1).otherwise(0).cast("int")

    def tiles_of_box(self, min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
        """Array of the tiles that a box touches (empty outside of the extent)."""
        a, b = F.greatest(min_lat, F.lit(self.min_lat)), F.least(max_lat, F.lit(self.max_lat))
        c, d = F.greatest(min_lon, F.lit(self.min_lon)), F.least(max_lon, F.lit(self.max_lon))
        rows = F.sequence(self._step(a, self.min_lat, self.max_lat), self._step(b, self.min_lat, self.max_lat))
        cols = F.sequence(self._step(c, self.min_lon, self.max_lon), self._step(d, self.min_lon, self.max_lon))
        tiles = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda q: (r * self.n + q + 1).cast("int"))))
        return F.when((b >= a) & (d >= c), tiles).otherwise(F.array().cast("array<int>"))

    def contains(self, min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
        e = 1e-9
        return (min_lon >= self.min_lon - e) & (max_lon <= self.max_lon + e) & (min_lat >= self.min_lat - e) & (max_lat <= self.max_lat + e)

    @property
    def lat0(self) -> float:
        return (self.min_lat + self.max_lat) / 2


# ---- lines and areas -----------------------------------------------------------------------------------------

def chain_ways(ways: DataFrame, keys: list[str]) -> DataFrame:
    """Trails per group: (keys, trail). ``ways``: keys, way_id, node_ids."""
    return chained_arrays(ways.select(*keys, "way_id", "node_ids"), keys, ["node_ids"]).select(*keys, F.col("node_ids").alias("trail"))


def _entries(paths: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Display entries from one thinned path per row."""
    lat, lon = F.transform("path", lambda q: q["lat"]), F.transform("path", lambda q: q["lon"])
    return paths.select(
        *keys, F.lit(kind).alias("kind"), "part", "cls", "name", "tags", "ways", F.size("path").alias("npts"), "rawnpts", F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"),
        F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"), F.array("path").alias("geom"))


def zoom_classes(ways: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, zoom, rep): zooms at which a group has the same ways share their lowest one, ``rep``. ``ways``: keys, zooms (array). Two zooms are alike if
    every zoom set that occurs in the group has both or neither."""
    g = ways.groupBy(*keys).agg(F.collect_set("zooms").alias("sets")).withColumn("all", F.array_distinct(F.flatten("sets")))
    alike = lambda y, z: F.forall("sets", lambda s: F.array_contains(s, y) == F.array_contains(s, z))
    pairs = F.transform("all", lambda z: F.struct(z.alias("zoom"), F.array_min(F.filter("all", lambda y: alike(y, z))).alias("rep")))
    return g.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.zoom", "p.rep")


def line_entries(ways: DataFrame, units: list[str], lat0: Column) -> DataFrame:
    """Display lines, one row per chain of ways with the same group key at each zoom; ``part`` is the way the chain starts with, and tags and name are those of its
    lowest way. ``ways``: units, way_id, tags, cls, zooms, node_ids, coords (open, classed, chosen). Chains are made once for all zooms at which a
    group has the same ways, and thinned for each zoom."""
    group = [*units, "group_key"]
    keyed = ways.withColumn("group_key", T.line_group_key(F.col("cls"), F.col("tags"))).withColumn(
        "_head", F.struct("cls", T.line_tags(F.col("tags")).alias("tags"), F.col("tags")["name"].alias("name"))).drop("tags")
    classes = cut_lineage(zoom_classes(keyed.select(*group, "zooms"), group))
    members = keyed.join(classes.where("zoom = rep").drop("zoom"), group).where(F.array_contains("zooms", F.col("rep")))
    g = chained_arrays(members, [*group, "rep"], ["coords"], F.min_by("_head", "way_id").alias("h"), F.count("*").alias("ways"), F.sum(F.size("coords")).alias("rawnpts"))
    g = g.join(classes, [*group, "rep"])
    tol = meters_per_pixel(F.col("zoom"), lat0) * TOLERANCE_PX
    keys = [*units, "zoom", "group_key"]
    g = g.select(*keys, F.col("chain").alias("part"), F.explode(S.generalised(F.col("coords"), tol, lat0, DIGITS)).alias("path"), "ways", "rawnpts", "h.*")
    return _entries(g, keys, "line").withColumn("family", T.line_family(F.col("cls")))


def area_entries(ways: DataFrame, units: list[str], lat0: Column) -> DataFrame:
    """Display areas, one row per closed way with an area class at each zoom; ``part`` is the way. ``units`` are columns that a way may have as well."""
    keys = [*units, "zoom", "group_key"]
    keyed = ways.withColumn("cls", T.area_class(F.col("tags"))).where("cls IS NOT NULL").withColumn("group_key", T.area_group_key(F.col("cls"), F.col("tags"))).withColumn("zoom", F.explode("zooms"))
    tol = meters_per_pixel(F.col("zoom"), lat0) * TOLERANCE_PX
    g = keyed.select(*keys, F.col("way_id").alias("part"), "cls", T.area_tags(F.col("tags")).alias("tags"), F.col("tags")["name"].alias("name"), F.lit(1).cast("long").alias("ways"),
                     F.size("coords").cast("long").alias("rawnpts"), F.explode(S.generalised(F.col("coords"), tol, lat0, DIGITS, ring=True)).alias("path"))
    return _entries(g, keys, "area").withColumn("family", T.area_family(F.col("cls")))


BOX = ["min_lat", "max_lat", "min_lon", "max_lon"]


def _classed(ds: OsmDataset, detail: int) -> DataFrame:
    """Ways with extent, classes and all that their tags say about any zoom, one row per way; its tags stay behind."""
    t = F.col("tags")
    traits = F.struct(*[c.alias(k) for k, c in T.lod_traits(t, detail).items()], T.min_zoom_line(t).alias("least"))
    return G.with_extents(ds).select("id", "closed", T.line_class(t).alias("cls"), T.area_class(t).alias("a_cls"), *BOX, bbox_area_m2(*map(F.col, BOX)).alias("_area"), traits.alias("_t"))


def _shown(classed: DataFrame, zooms: list[int], detail: int) -> DataFrame:
    """The status that ways have at each zoom: invisible, lod with the reason, nogfx or way. Each way meets only the zooms of a short constant list."""
    w = classed.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    of = lambda k: F.col(f"_t.{k}")
    held = T.lod_withheld({k: of(k) for k in T.lod_traits(F.lit(None), detail)}, F.col("zoom"), F.col("_area"), F.col("closed"), detail)
    status = (F.when(F.col("zoom") < of("least"), "invisible").when(F.col("_held").isNotNull(), "lod")
              .when(F.col("min_lat").isNull(), "nogfx").otherwise("way"))
    sub = (F.when(F.col("_held") == "neverSend", F.concat(F.lit("neverSend:"), of("never")))
           .when(F.col("_held") == "roadClass", F.concat(F.lit("roadClass:"), of("rank").cast("string"))).otherwise(F.col("_held")))
    return w.withColumn("_held", held).withColumn("status", status).withColumn("sub", F.when(F.col("status") == "lod", sub)).drop("_held", "_t", "_area")


def chosen_classes(shown: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Classes to generalise at each zoom, decided once for the whole extent: (zoom, cls). The counts have a few rows per
    zoom, so the running totals are small."""

    drawn = shown.where("status = 'way'")
    counts = drawn.where(~F.col("closed")).select("zoom", "cls").where("cls IS NOT NULL").groupBy("zoom", "cls").agg(F.count("*").alias("ways"))
    picked = drawn.groupBy("zoom").agg(F.count("*").alias("picked"))
    room = max(1, int(limit * BUDGET))
    c = counts.join(picked, "zoom").withColumn("_first", T.line_always(F.col("cls")) | (F.col("ways") >= LEAST_WAYS))
    left = F.col("picked") - F.coalesce(F.sum(F.when(F.col("_first"), F.col("ways"))).over(Window.partitionBy("zoom")), F.lit(0))
    order = Window.partitionBy("zoom", "_first").orderBy(F.col("ways").desc(), "cls").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_left", left).withColumn("_before", F.coalesce(F.sum("ways").over(order), F.lit(0)))
    return c.where(F.col("_first") | (F.col("_left") - F.col("_before") > room)).select("zoom", "cls")


def coverage(ds: OsmDataset, zooms: list[int], detail: int = 4, limit: int = LIMIT) -> DataFrame:
    """Status of every way at every zoom: line, area, way, nogfx, invisible or lod (with the reason in ``sub``)."""
    classed = cut_lineage(_classed(ds, detail))
    # Ways meet the chosen classes before they are spread over the zooms.
    picked = chosen_classes(_shown(classed, zooms, detail), limit).groupBy("cls").agg(F.collect_set("zoom").alias("_chosen"))
    c = _shown(classed.join(picked, "cls", "left"), zooms, detail)
    line = (F.col("status") == "way") & ~F.col("closed") & F.coalesce(F.array_contains("_chosen", F.col("zoom")), F.lit(False))
    area = (F.col("status") == "way") & F.col("closed") & F.col("a_cls").isNotNull()
    return c.withColumn("sub", F.when(line, F.col("cls")).when(area, F.col("a_cls")).otherwise(F.col("sub"))).withColumn(
        "status", F.when(line, "line").when(area, "area").otherwise(F.col("status"))).drop("cls", "a_cls", "_chosen")


def tile_coverage(ds: OsmDataset, grid: TileGrid, zooms: list[int] = BANDS, detail: int = 4) -> DataFrame:
    """Coverage per (zoom, tile, way) with the extent in 1e-5 degrees, one unit wider on each side."""
    cov = coverage(ds, zooms, detail).where(F.col("min_lat").isNotNull())
    def q(c: str, d: int) -> Column:
        return (F.floor(F.col(c) * 1e5 + 0.5) + d).alias(f"q_{c}")
    tiles = grid.tiles_of_box(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
    return cov.withColumn("tile", F.explode(tiles)).select("zoom", "tile", F.col("id").alias("way_id"), "status", "sub",
                                                           q("min_lat", -1), q("max_lat", 1), q("min_lon", -1), q("max_lon", 1))


def display_ways(ds: OsmDataset, zooms: list[int], detail: int = 4, only: DataFrame | None = None) -> DataFrame:
    """Ways to be drawn as lines or areas, with geometry: way_id, tags, status, cls, zooms (those where it is drawn), extent, node_ids, coords. ``only`` (way_id, zoom)
    names the ways wanted at each zoom; no geometry is made of others.

    The coverage picks the geometry to fetch and is joined with it; the result feeds group sizes and groups of lines and of
    areas. Both are written once, because each would otherwise be computed several times.
    """
    drawn = coverage(ds, zooms, detail).where(F.col("status").isin("line", "area"))
    if only is not None:
        drawn = drawn.join(only.withColumnRenamed("way_id", "id"), ["id", "zoom"], "left_semi")
    box = ["min_lat", "max_lat", "min_lon", "max_lon"]
    cov = cut_lineage(drawn.groupBy("id").agg(F.array_sort(F.collect_list("zoom")).alias("zooms"), *[F.first(c).alias(c) for c in ("status", "sub", *box)]))
    wanted = cov.select(F.col("id").alias("way_id"))
    geo = G.way_geometry(ds.way_nodes.join(wanted, "way_id", "left_semi"), ds.nodes)
    return cut_lineage(cov.join(ds.ways.select("id", "tags"), "id").withColumnRenamed("id", "way_id").withColumnRenamed("sub", "cls").join(geo, "way_id").where(F.size("coords") >= 2))


def display_lines(ds: OsmDataset, zoom: int, lat0: float, detail: int = 4, members: bool = True) -> DataFrame:
    """Display lines of the whole extent. ``members=False`` leaves out ways that belong to a relation, which stay single ways."""
    w = display_ways(ds, [zoom], detail).where("status = 'line'")
    if not members:
        w = w.join(ds.relation_members.where("member_type = 'way'").select(F.col("member_ref").alias("way_id")), "way_id", "left_anti")
    return line_entries(w, [], F.lit(lat0))


def relation_areas(ds: OsmDataset, zooms: list[int], lat0: Column) -> DataFrame:
    """Display areas of area relations, one row per ring at each zoom where they show; group key ``rel:`` and the id, ``part`` twice the ring's number in
    its role, one more for an inner ring."""
    rels = ds.relations.where(T.relation_area_like(F.col("tags"))).withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms]))).where(T.lod_visible(F.col("tags"), F.col("zoom"), "area"))
    rings = relation_rings(ds.with_(relations=ds.relations.where(T.relation_area_like(F.col("tags"))))).where("status = 'ring'")
    r = rings.join(rels.select(F.col("id").alias("relation_id"), "tags", "zoom"), "relation_id").withColumn("cls", T.area_class(F.col("tags")))
    tol = meters_per_pixel(F.col("zoom"), lat0) * TOLERANCE_PX
    g = r.select("zoom", F.concat(F.lit("rel:"), F.col("relation_id").cast("string")).alias("group_key"), (2 * F.col("ring_no") + F.when(F.col("role") == "inner", 1).otherwise(0)).cast("long").alias("part"), "cls", T.area_tags(F.col("tags")).alias("tags"),
                 F.col("tags")["name"].alias("name"), F.lit(1).cast("long").alias("ways"), F.size("coords").cast("long").alias("rawnpts"),
                 F.explode(S.generalised(F.col("coords"), tol, lat0, DIGITS, ring=True)).alias("path"))
    return _entries(g, ["zoom", "group_key"], "area").withColumn("family", T.area_family(F.col("cls")))


def display_areas(ds: OsmDataset, zoom: int, lat0: float, detail: int = 4) -> DataFrame:
    """Areas from closed ways and from area relations (their ways joined to rings)."""
    ways = area_entries(display_ways(ds, [zoom], detail).where("status = 'area'"), [], F.lit(lat0))
    return ways.unionByName(relation_areas(ds, [zoom], F.lit(lat0)))


# ---- tiles -----------------------------------------------------------------------------------------------------

def stable_id(kind: Column, zoom: Column, tile: Column, key: Column) -> Column:
    """53 bits of a SHA-1 over the parts, so that the same entry has the same id in every bake."""
    text = F.concat_ws("\u0000", kind, zoom.cast("string"), tile.cast("string"), key)
    return F.shiftright(F.conv(F.substring(F.sha1(text), 1, 14), 16, 10).cast("long"), 3)


def tile_index(ds: OsmDataset, grid: TileGrid, zooms: list[int] = BANDS, detail: int = 4) -> DataFrame:
    """(zoom, tile, way_id) of the ways drawn in each tile, to be stored beside the tiles: a rebake finds its ways here."""
    cov = coverage(ds, zooms, detail).where(F.col("status").isin("line", "area"))
    return cov.select("zoom", F.explode(grid.tiles_of_box(*[F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])).alias("tile"), F.col("id").alias("way_id"))


def write_tile_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    index.repartition("zoom", "tile").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("zoom", "tile").parquet(path)


def bake_tiles(ds: OsmDataset, grid: TileGrid, zooms: list[int] = BANDS, detail: int = 4, only: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Display entries of every (zoom, tile). Classes are chosen once for the whole extent; a way goes to every tile its
    extent touches. ``only`` (zoom, tile) limits the bake to some tiles; with ``index`` (``tile_index``) only the ways of those tiles get geometry."""
    box = ["min_lat", "max_lat", "min_lon", "max_lon"]
    tiles = F.explode(grid.tiles_of_box(*map(F.col, box)))
    ways = index.join(only, ["zoom", "tile"], "left_semi").select("way_id", "zoom").distinct() if only is not None and index is not None else None
    w = display_ways(ds, zooms, detail, ways)
    lat0 = F.lit(grid.lat0)
    lines = w.where("status = 'line'").withColumn("tile", tiles).drop(*box)
    areas = w.where("status = 'area'").withColumn("_tiles", grid.tiles_of_box(*map(F.col, box))).drop(*box)
    if only is not None:
        here = only.groupBy("tile").agg(F.collect_set("zoom").alias("_only"))
        lines = lines.join(here, "tile").withColumn("zooms", F.array_intersect("zooms", "_only")).where(F.size("zooms") > 0).drop("_only")
    line = line_entries(lines, ["tile"], lat0)
    # An area is thinned once per zoom, and its entry goes to all its tiles.
    area = area_entries(areas, ["_tiles"], lat0).withColumn("tile", F.explode("_tiles")).drop("_tiles")
    rel = relation_areas(ds, zooms, lat0).withColumn("tile", tiles)
    area = area.unionByName(rel)
    if only is not None:
        area = area.join(only, ["zoom", "tile"], "left_semi")
    key = F.concat_ws("\u0001", "group_key", F.col("part").cast("string"))
    return line.unionByName(area).withColumn("id", stable_id(F.col("kind"), F.col("zoom"), F.col("tile"), key))


def write_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per (zoom, tile), so that a view reads only its tiles and a rebake replaces only dirty ones."""
    (tiles.repartition("zoom", "tile").sortWithinPartitions("zoom", "tile", "id").write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("zoom", "tile").parquet(path))


def read_tiles(tiles: DataFrame, views: DataFrame, grid: TileGrid, clip: bool = True) -> DataFrame:
    """Entries of the tiles that each view touches, each entry once, cut to the view's box. ``views``: view_id, zoom,
    extent. The join on (zoom, tile) prunes the folders that are read."""
    v = views.withColumn("tile", F.explode(grid.tiles_of_box(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))))
    v = v.select("view_id", "zoom", "tile", *[F.col(c).alias(f"box_{c}") for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    hits = tiles.join(v, ["zoom", "tile"]).where(
        (F.col("max_lon") >= F.col("box_min_lon")) & (F.col("min_lon") <= F.col("box_max_lon")) & (F.col("max_lat") >= F.col("box_min_lat")) & (F.col("min_lat") <= F.col("box_max_lat")))
    hits = hits.dropDuplicates(["view_id", "id"])
    if clip:
        cut = S.clipped(F.col("kind"), F.col("geom"), F.col("box_min_lat"), F.col("box_max_lat"), F.col("box_min_lon"), F.col("box_max_lon"))
        hits = hits.withColumn("geom", cut).where(F.size("geom") > 0)
    return hits.drop("box_min_lat", "box_max_lat", "box_min_lon", "box_max_lon")


def tile_ledger(cov: DataFrame, views: DataFrame, grid: TileGrid) -> DataFrame:
    """Ways per view and status from the coverage of its tiles; a way in several tiles counts once, with its best status."""
    v = views.withColumn("tile", F.explode(grid.tiles_of_box(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))))
    hit = cov.join(v.select("view_id", "zoom", "tile", "min_lat", "max_lat", "min_lon", "max_lon"), ["zoom", "tile"]).where(
        (F.col("q_max_lon") >= F.col("min_lon") * 1e5) & (F.col("q_min_lon") <= F.col("max_lon") * 1e5) & (F.col("q_max_lat") >= F.col("min_lat") * 1e5) & (F.col("q_min_lat") <= F.col("max_lat") * 1e5))
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    best = hit.groupBy("view_id", "way_id").agg(F.min_by("status", rank).alias("status"))
    return best.groupBy("view_id", "status").agg(F.count("*").alias("ways"))


def dirty_tiles(changes: DataFrame, grid: TileGrid, zooms: list[int] = BANDS) -> DataFrame:
    """(zoom, tile) that must be baked again. ``changes``: lod_zoom and an extent per row (old and new extent are two rows).
    Zooms below the way's least one are not touched; an extent beyond the grid dirties everything."""
    box = [F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    inside = grid.contains(*box)
    c = changes.select("lod_zoom", inside.alias("_in"), F.when(inside, grid.tiles_of_box(*box)).otherwise(F.sequence(F.lit(1), F.lit(grid.n * grid.n))).alias("tiles"))
    # Collapse to distinct (tile set, zoom) before the tiles are spread out.
    c = c.distinct().withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    return c.where(~F.col("_in") | (F.col("zoom") >= F.col("lod_zoom"))).select("zoom", F.explode("tiles").alias("tile")).distinct()


def rebake(ds: OsmDataset, dirty: DataFrame, grid: TileGrid, path: str, zooms: list[int] = BANDS, index_path: str | None = None) -> None:
    """Bakes the dirty tiles again. With ``index_path``, where ``write_tile_index`` wrote, the index of those tiles is renewed first, from the coverage alone, and
    geometry is made of their ways only."""
    index = None
    if index_path is not None:
        write_tile_index(tile_index(ds, grid, zooms).join(dirty, ["zoom", "tile"], "left_semi"), index_path, mode="overwrite")
        index = ds.ways.sparkSession.read.parquet(index_path)
    write_tiles(bake_tiles(ds, grid, zooms, only=dirty, index=index), path, mode="overwrite")


# ---- rings of relations --------------------------------------------------------------------------------------------

def relation_rings(ds: OsmDataset) -> DataFrame:
    """Rings of multipolygon and boundary relations: (relation_id, role, ring_no, coords, status). Member ways of a role
    are joined where exactly two ends meet; ``status`` is ring, open (not closed), missing (a node is unknown) or degenerate (no
    area). Rings and open chains are numbered by their first member."""
    rel = ds.relations.where(T.is_in(F.col("tags"), "type", ["multipolygon", "boundary"])).select(F.col("id").alias("relation_id"))
    m = ds.relation_members.where("member_type = 'way'").join(rel, "relation_id", "left_semi").select(
        "relation_id", F.when(F.col("role") == "inner", "inner").otherwise("outer").alias("role"), F.col("seq").cast("long").alias("seq"), F.col("member_ref").alias("way_id"))
    refs = ds.way_nodes.join(m.select("way_id").distinct(), "way_id", "left_semi").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("p"))
    ids = refs.select("way_id", F.transform("p", lambda x: x["node_id"]).alias("node_ids")).where(F.size("node_ids") >= 2)
    # A member is known by its place in the relation, as a way may be listed twice.
    g = m.join(ids, "way_id").select("relation_id", "role", F.col("seq").alias("way_id"), "node_ids")
    st = chained_arrays(g, ["relation_id", "role"], ["node_ids"])
    number = F.row_number().over(Window.partitionBy("relation_id", "role", "round").orderBy("chain")) - 1
    st = st.select("relation_id", "role", "chain", F.col("node_ids").alias("ids"), ((F.size("node_ids") >= 4) & (F.get("node_ids", F.lit(0)) == F.element_at("node_ids", -1))).alias("round")).withColumn("ring_no", number)
    closed, open_ = st.where("round"), st.where("NOT round")
    pts = closed.select("relation_id", "role", "ring_no", F.size("ids").alias("n"), F.posexplode("ids").alias("i", "node_id")).join(
        ds.nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id", "left")
    rings = pts.groupBy("relation_id", "role", "ring_no").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("lat").isNotNull(), F.struct("i", "lat", "lon")))).alias("p"))
    rings = rings.withColumn("coords", F.transform("p", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))))
    status = F.when(F.size("coords") < F.col("n"), "missing").when(ring_area_m2(F.col("coords")) > 1e-9, "ring").otherwise("degenerate")
    return rings.select("relation_id", "role", "ring_no", "coords", status.alias("status")).unionByName(
        open_.select("relation_id", "role", "ring_no", F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("coords"), F.lit("open").alias("status")))
