"""Spatial joins as equi-joins on grid cells. No theta joins: each side is exploded to the few cells it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions.geo import M_PER_DEG_LAT, M_PER_DEG_LON_EQUATOR, RAD, meters_between, segment_distance_m, segment_t
from streetloom.session import cut_lineage

MAX_LEVEL = 12


def spread_out(df: DataFrame) -> DataFrame:
    """For a side exploded to cells: Spark guesses its size as if it had not been, and would send it to all executors through the driver, however large it is."""
    return df.hint("merge")


def _cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size)


def box_join(features: DataFrame, boxes: DataFrame, base_deg: float = 0.1) -> DataFrame:
    """Pairs whose closed extents intersect. Both sides have min_lat..max_lon; those of ``boxes`` are renamed ``box_*``.

    Every extent has a level of its own, that whose cells are at least as large as itself, so it touches at most four cells there, and
    no more on any coarser level. A pair meets on the coarser one of its two levels: boxes are filed on their own level and all above, features on
    their own and on those above that are some box's own (a few numbers, read first). A view of the whole world is a few rows, and a small feature
    is not spread for boxes that are small as well. A pair that shares several cells is kept only in the cell of the corner of its
    intersection, so no distinct is needed. Hot cells are split by adaptive skew join.
    """
    coords = ["min_lat", "max_lat", "min_lon", "max_lon"]

    def own(p: str) -> Column:
        extent = F.greatest(F.col(f"{p}max_lat") - F.col(f"{p}min_lat"), F.col(f"{p}max_lon") - F.col(f"{p}min_lon"))
        return F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / base_deg)))).cast("int")

    def spread(df: DataFrame, p: str) -> DataFrame:
        size = F.lit(base_deg) * F.pow(F.lit(2.0), F.col("_level"))
        return (df.withColumn("_size", size)
                .withColumn("_y", F.explode(F.sequence(_cell(F.col(f"{p}min_lat"), F.col("_size")), _cell(F.col(f"{p}max_lat"), F.col("_size")))))
                .withColumn("_x", F.explode(F.sequence(_cell(F.col(f"{p}min_lon"), F.col("_size")), _cell(F.col(f"{p}max_lon"), F.col("_size"))))))

    b = boxes.where(F.col("min_lat").isNotNull()).select(*[F.col(c).alias(f"box_{c}") if c in coords else F.col(c) for c in boxes.columns]).withColumn("_box_own", own("box_"))
    levels = sorted(r[0] for r in b.select("_box_own").distinct().collect())
    right = spread(b.withColumn("_level", F.explode(F.sequence("_box_own", F.lit(MAX_LEVEL)))), "box_").drop("_size")
    left = features.where(F.col("min_lat").isNotNull()).withColumn("_own", own(""))
    filed = F.array_distinct(F.concat(F.array("_own"), F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col("_own"))))
    pairs = spread(left.withColumn("_level", F.explode(filed)), "").join(right, ["_level", "_y", "_x"])
    touch = ((F.col("max_lon") >= F.col("box_min_lon")) & (F.col("min_lon") <= F.col("box_max_lon"))
             & (F.col("max_lat") >= F.col("box_min_lat")) & (F.col("min_lat") <= F.col("box_max_lat")))
    home = ((_cell(F.greatest("min_lat", "box_min_lat"), F.col("_size")) == F.col("_y"))
            & (_cell(F.greatest("min_lon", "box_min_lon"), F.col("_size")) == F.col("_x")))
    meeting = F.col("_level") == F.greatest("_own", "_box_own")
    return pairs.where(meeting & touch & home).drop("_level", "_y", "_x", "_size", "_own", "_box_own")


def point_box_join(points: DataFrame, boxes: DataFrame, base_deg: float = 0.1) -> DataFrame:
    """Points (lat, lon) inside closed boxes; the box columns are renamed ``box_*``."""
    coords = ["min_lat", "max_lat", "min_lon", "max_lon"]
    b = boxes.select(*[F.col(c).alias(f"box_{c}") if c in coords else F.col(c) for c in boxes.columns])
    right = (b.withColumn("_y", F.explode(F.sequence(_cell(F.col("box_min_lat"), base_deg), _cell(F.col("box_max_lat"), base_deg))))
             .withColumn("_x", F.explode(F.sequence(_cell(F.col("box_min_lon"), base_deg), _cell(F.col("box_max_lon"), base_deg)))))
    left = points.withColumn("_y", _cell(F.col("lat"), base_deg)).withColumn("_x", _cell(F.col("lon"), base_deg))
    inside = (F.col("lat").between(F.col("box_min_lat"), F.col("box_max_lat"))
              & F.col("lon").between(F.col("box_min_lon"), F.col("box_max_lon")))
    return left.join(right, ["_y", "_x"]).where(inside).drop("_y", "_x")


def radius_join(points: DataFrame, cells: DataFrame, radius: str, cell_m: float, m_per_deg_lat: float,
                m_per_deg_lon: float) -> DataFrame:
    """Every (point, cell) whose cell centre lies within the point's radius, with planar distance ``d`` and weight
    ``w`` = max(0.25, 1 - 0.75 d / r). Points are exploded to the cells their circle may touch."""
    r = F.greatest(F.lit(1.0), F.col(radius).cast("double"))
    reach = F.ceil(r / cell_m)
    x0, y0 = F.floor(F.col("lon") * m_per_deg_lon / cell_m), F.floor(F.col("lat") * m_per_deg_lat / cell_m)
    spread = (points.withColumn("_r", r)
              .withColumn("cell_x", F.explode(F.sequence(x0 - reach, x0 + reach)))
              .withColumn("cell_y", F.explode(F.sequence(y0 - reach, y0 + reach))))
    c_lat = (F.col("cell_y") + 0.5) * cell_m / m_per_deg_lat
    c_lon = (F.col("cell_x") + 0.5) * cell_m / m_per_deg_lon
    dy, dx = (c_lat - F.col("lat")) * m_per_deg_lat, (c_lon - F.col("lon")) * m_per_deg_lon
    near = spread.withColumn("d", F.sqrt(dy * dy + dx * dx)).where("d <= _r")
    return spread_out(near).join(cells, ["cell_x", "cell_y"]).withColumn(
        "w", F.greatest(F.lit(0.25), 1 - F.col("d") / F.col("_r") * 0.75)).drop("_r")


def neighbour_pairs(points: DataFrame, max_m: float, columns: list[str]) -> DataFrame:
    """Ordered pairs (a, b), a <> b, at most ``max_m`` apart, with ``meters``. ``points``: id, lat, lon and ``columns``.

    Rows of latitude are ``max_m`` high; columns of longitude are sized per row of latitude (by the cosine at the row's
    far edge), so that three columns of three rows always hold the whole circle, at any latitude.
    """
    step = max_m / 110574.0
    row = F.floor(F.col("lat") / step)

    def lon_step(r: Column) -> Column:
        edge = F.least(F.lit(89.0), F.greatest(F.abs(r * step), F.abs((r + 1) * step)))
        return max_m / (F.lit(110574.0) * F.cos(edge * RAD))

    kept = ["id", "lat", "lon", *columns]
    right = points.select(*[F.col(c).alias(f"b_{c}") for c in kept]).withColumn("_row", F.floor(F.col("b_lat") / step)) \
        .withColumn("_col", F.floor(F.col("b_lon") / lon_step(F.col("_row"))))
    left = (points.select(*[F.col(c).alias(f"a_{c}") for c in kept])
            .withColumn("_row", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]),
                                                      lambda i: F.floor(F.col("a_lat") / step) + i)))
            .withColumn("_c0", F.floor(F.col("a_lon") / lon_step(F.col("_row"))))
            .withColumn("_col", F.explode(F.array(F.col("_c0") - 1, F.col("_c0"), F.col("_c0") + 1))).drop("_c0"))
    m = meters_between(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return (spread_out(left).join(right, ["_row", "_col"]).where("a_id <> b_id").withColumn("meters", m)
            .where(F.col("meters") <= max_m).drop("_row", "_col"))


def snap_to_node(points: DataFrame, nodes: DataFrame, max_m: float) -> DataFrame:
    """Nearest node within ``max_m`` of each point (ties by node id): (id, node_id, distance_m)."""
    step = max_m / 110000.0

    def lon_step(r: Column) -> Column:
        edge = F.least(F.lit(89.0), F.greatest(F.abs(r * step), F.abs((r + 1) * step)))
        return max_m / (F.lit(110000.0) * F.cos(edge * RAD))

    n = nodes.select(F.col("id").alias("node_id"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")) \
        .withColumn("_row", F.floor(F.col("n_lat") / step)).withColumn("_col", F.floor(F.col("n_lon") / lon_step(F.col("_row"))))
    p = (points.select("id", "lat", "lon")
         .withColumn("_row", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(F.col("lat") / step) + i)))
         .withColumn("_c0", F.floor(F.col("lon") / lon_step(F.col("_row"))))
         .withColumn("_col", F.explode(F.array(F.col("_c0") - 1, F.col("_c0"), F.col("_c0") + 1))))
    m = meters_between(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))
    near = spread_out(p).join(n, ["_row", "_col"]).withColumn("m", m).where(F.col("m") <= max_m)
    best = F.min(F.struct("m", "node_id", "n_lat", "n_lon"))
    return near.groupBy("id").agg(best.alias("b")).select(
        "id", F.col("b.node_id").alias("node_id"), F.col("b.n_lat").alias("node_lat"), F.col("b.n_lon").alias("node_lon"),
        F.col("b.m").alias("distance_m"))


def segment_cells(segs: DataFrame, cell_m: float, pad_m: float = 0.0) -> DataFrame:
    """Segments exploded to the cells of a fixed grid within ``pad_m`` of them. The grid uses one longitude scale per row of latitude, so cells stay
    about square everywhere. In each row only the columns count between the places where the segment enters and leaves the padded row, so
    a diagonal covers the cells it runs through and not its whole extent."""
    step = cell_m / M_PER_DEG_LAT
    pad = pad_m / M_PER_DEG_LAT
    lo, hi = F.least("a_lat", "b_lat") - pad, F.greatest("a_lat", "b_lat") + pad
    rows = F.sequence(F.floor(lo / step), F.floor(hi / step))
    row = F.col("cell_row")
    rise = F.nullif(F.col("b_lat") - F.col("a_lat"), F.lit(0.0))

    def lon_at(lat: Column, level: str) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - F.col("a_lat")) / rise))
        return F.when(rise.isNull(), F.col(level)).otherwise(F.col("a_lon") + t * (F.col("b_lon") - F.col("a_lon")))

    below, above = lon_at(row * step - pad, "a_lon"), lon_at((row + 1) * step + pad, "b_lon")
    lon_pad = F.lit(pad_m) / (F.lit(M_PER_DEG_LON_EQUATOR) * F.cos(F.least(F.lit(89.0), F.abs(row * step) + step) * RAD))
    lon_step = row_lon_step(row, cell_m)
    left, right = F.least(below, above) - lon_pad, F.greatest(below, above) + lon_pad
    return (segs.withColumn("cell_row", F.explode(rows))
            .withColumn("cell_col", F.explode(F.sequence(F.floor(left / lon_step), F.floor(right / lon_step)))))


def row_lon_step(row: Column, cell_m: float) -> Column:
    step = cell_m / M_PER_DEG_LAT
    mid = F.least(F.lit(89.0), F.abs((row + 0.5) * step))
    return F.lit(cell_m) / (F.lit(M_PER_DEG_LON_EQUATOR) * F.cos(mid * RAD))


def near_segments(points: DataFrame, segs: DataFrame, max_m: float) -> DataFrame:
    """Every segment within ``max_m`` of each point: columns of both, t (the nearest place on it) and m.

    ``segs``: way_id, seq, a, a_lat, a_lon, b, b_lat, b_lon. Segments are filed in every cell within ``max_m`` of their
    extent, points in their own cell only. Cells are four times as wide, so that a short segment is filed two or three times. Distances are worked out for points within ``max_m`` of the segment's extent alone, and once: they come
    out of an explode, which no filter passes.
    """
    cell, reach = 4.0 * max_m, max_m / M_PER_DEG_LAT
    filed = segment_cells(segs.select("way_id", "seq", "a", "a_lat", "a_lon", "b", "b_lat", "b_lon"), cell, pad_m=max_m * 1.02)
    p = points.select("id", "lat", "lon").withColumn("cell_row", F.floor(F.col("lat") / (cell / M_PER_DEG_LAT))) \
        .withColumn("cell_col", F.floor(F.col("lon") / row_lon_step(F.col("cell_row"), cell))) \
        .withColumn("_wide", F.lit(reach) / F.cos(F.col("lat") * RAD))

    def beside(k: str, pad: Column) -> Column:
        return (F.col(k) >= F.least(f"a_{k}", f"b_{k}") - pad) & (F.col(k) <= F.greatest(f"a_{k}", f"b_{k}") + pad)
    args = [F.col(c) for c in ("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon")]
    t = segment_t(*args)
    d = segment_distance_m(*args, t=F.col("t"))
    pairs = p.join(filed, ["cell_row", "cell_col"]).where(beside("lat", F.lit(reach)) & beside("lon", F.col("_wide"))).drop("_wide")
    solved = pairs.withColumn("t", t).withColumn("m", d).withColumn("_at", F.explode(F.array(F.struct("t", "m")))).drop("t", "m")
    return solved.select("*", "_at.t", "_at.m").drop("_at").where(F.col("m") <= max_m)


def snap_to_segment(points: DataFrame, segs: DataFrame, max_m: float) -> DataFrame:
    """Nearest point on a segment within ``max_m``: (id, way_id, seq, t, end_node, distance_m). ``segs`` as in ``near_segments``."""
    near = near_segments(points, segs, max_m)
    best = F.min(F.struct("m", "way_id", "seq", "t", F.when(F.col("t") <= 0.5, F.col("a")).otherwise(F.col("b")).alias("end_node")))
    return near.groupBy("id").agg(best.alias("s")).select(
        "id", F.col("s.way_id").alias("way_id"), F.col("s.seq").alias("seq"), F.col("s.t").alias("t"),
        F.col("s.end_node").alias("end_node"), F.col("s.m").alias("distance_m"))


#: Cell borders lie beside the places that coordinates of up to nine digits can have, so no corner of an area is on one.
OFF_GRID = 0.00000000037
RUN_LEVELS = 22


def edge_cells(edges: DataFrame, step: float) -> DataFrame:
    """Edges (x1, y1, x2, y2) exploded to the cells they run through: ``_y``, ``_x``. A cell that is only touched may come along."""
    spare = step * 1e-7
    number = lambda v: F.floor((v - OFF_GRID) / step)
    rise = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))

    def x_at(lat: Column, level: str) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - F.col("y1")) / rise))
        return F.when(rise.isNull(), F.col(level)).otherwise(F.col("x1") + t * (F.col("x2") - F.col("x1")))

    low, high = x_at(F.col("_y") * step + OFF_GRID - spare, "x1"), x_at((F.col("_y") + 1) * step + OFF_GRID + spare, "x2")
    return (edges.withColumn("_y", F.explode(F.sequence(number(F.least("y1", "y2")), number(F.greatest("y1", "y2")))))
            .withColumn("_x", F.explode(F.sequence(number(F.least(low, high) - spare), number(F.greatest(low, high) + spare)))))


def run_blocks(first: Column, last: Column) -> Column:
    """A run of columns as aligned blocks: level and number of blocks of 2^level columns, two per level at most."""
    lo = [F.ceil(first / (1 << k)).cast("long") for k in range(RUN_LEVELS + 1)]
    hi = [F.floor((last + 1) / (1 << k)).cast("long") for k in range(RUN_LEVELS + 1)]  # blocks lo .. hi - 1 lie in the run
    block = lambda k, n: F.struct(F.lit(k).alias("level"), n.alias("block"))
    out = []
    for k in range(RUN_LEVELS):
        more = lo[k + 1] < hi[k + 1]
        out += [F.when((lo[k] < hi[k]) & (~more | (lo[k] < 2 * lo[k + 1])), block(k, lo[k])), F.when((lo[k] < hi[k]) & ((~more & (hi[k] - 1 > lo[k])) | (more & (hi[k] > 2 * hi[k + 1]))), block(k, hi[k] - 1))]
    return F.array_compact(F.array(*out))


def area_cover(rings: DataFrame, step: float) -> tuple[DataFrame, DataFrame]:
    """Cells of areas, (border, inner). ``border``: area_id, _y, _x, the edges that run through the cell (x1 to y2), and ``inside``, whether the
    cell's lower right corner is. ``inner``: area_id, _y, level, block: whole cells inside, as runs between border cells of a row.

    The corner's parity comes from the places where edges cross the lower line of the row, in order from east to west; the same
    parity holds for all cells up to the next border cell. So an area has as many rows as its edges run through cells, however large it is."""
    n = F.size("coords")
    edges = rings.select("area_id", F.explode(F.filter(F.zip_with(
        "coords", F.concat(F.slice("coords", 2, F.greatest(n - 1, F.lit(0))), F.slice("coords", 1, 1)),
        lambda p, q: F.struct(p["lat"].alias("y1"), p["lon"].alias("x1"), q["lat"].alias("y2"), q["lon"].alias("x2"))),
        lambda e: (e["y1"] != e["y2"]) | (e["x1"] != e["x2"]))).alias("e")).select("area_id", "e.*")
    filed = cut_lineage(edge_cells(edges, step))
    line = F.col("_y") * step + OFF_GRID
    meets = (F.col("y1") > line) != (F.col("y2") > line)
    crossings = filed.where(meets).select("area_id", "_y", "x1", "y1", "x2", "y2").distinct().select(
        "area_id", "_y", ((F.col("x1") - F.col("x2")) * (line - F.col("y2")) / (F.col("y1") - F.col("y2")) + F.col("x2")).alias("x"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("_x"))
    cells = filed.select("area_id", "_y", "_x").distinct().select("area_id", "_y", ((F.col("_x") + 1) * step + OFF_GRID).alias("x"), F.lit(0).alias("one"), "_x")
    row = Window.partitionBy("area_id", "_y")
    marked = crossings.unionByName(cells).withColumn("inside", F.sum("one").over(row.orderBy(F.desc("x"))) % 2 == 1).where("_x IS NOT NULL")
    marked = cut_lineage(marked.withColumn("_next", F.lead("_x").over(row.orderBy("_x"))).select("area_id", "_y", "_x", "inside", "_next"))
    border = filed.join(marked.drop("_next"), ["area_id", "_y", "_x"])
    shift = 1 << RUN_LEVELS - 1  # columns are counted from far west, so that none is negative
    runs = marked.where("inside AND _next > _x + 1").select("area_id", "_y", F.explode(run_blocks(F.col("_x") + 1 + shift, F.col("_next") - 1 + shift)).alias("b"))
    return border, runs.select("area_id", "_y", "b.level", "b.block")


def points_in_areas(points: DataFrame, rings: DataFrame, base_deg: float = 0.02) -> DataFrame:
    """Even-odd point in polygon: (point_id, area_id) where the eastward ray of the point crosses an odd number of edges over all rings of
    the area, so holes count. ``points``: id, lat, lon; ``rings``: area_id, ring_no, coords ARRAY<STRUCT<lat,lon>>.

    In a border cell the way goes east to the cell's side and down to its corner; the parity of the edges met, all of them edges of the cell, and that of the corner make the
    parity of the point. Points in inner cells are inside without a look at an edge. An area meets the points in its extent alone: the ray of any other crosses an even
    number of its edges.
    """
    rings = cut_lineage(rings)
    border, inner = area_cover(rings, base_deg)
    inner = cut_lineage(inner)
    # Rings of an area are few rows each, so their extents are taken without a look at single points. Crossings are rounded, so longitudes have some room.
    end = lambda f, k: f(F.transform("coords", lambda c: c[k]))
    extent = rings.groupBy("area_id").agg(F.min(end(F.array_min, "lat")).alias("_s"), F.max(end(F.array_max, "lat")).alias("_n"),
                                          (F.min(end(F.array_min, "lon")) - OFF_GRID).alias("_w"), (F.max(end(F.array_max, "lon")) + OFF_GRID).alias("_e"))
    border = border.join(extent, "area_id")
    levels = sorted(r[0] for r in inner.select("level").distinct().collect())
    number = lambda c: F.floor((F.col(c) - OFF_GRID) / base_deg)
    p = points.select(F.col("id").alias("point_id"), "lat", "lon", number("lat").alias("_y"), number("lon").alias("_x"))
    right, bottom = (F.col("_x") + 1) * base_deg + OFF_GRID, F.col("_y") * base_deg + OFF_GRID
    lat, lon, x1, y1, x2, y2 = (F.col(c) for c in ("lat", "lon", "x1", "y1", "x2", "y2"))
    x_cross = (x1 - x2) * (lat - y2) / F.nullif(y1 - y2, F.lit(0.0)) + x2
    y_cross = (y1 - y2) * (right - x2) / F.nullif(x1 - x2, F.lit(0.0)) + y2
    east = ((y1 > lat) != (y2 > lat)) & (lon < x_cross) & (x_cross <= right)
    down = ((x1 > right) != (x2 > right)) & (y_cross > bottom) & (y_cross <= lat)
    within = (lat >= F.col("_s")) & (lat <= F.col("_n")) & (lon >= F.col("_w")) & (lon <= F.col("_e"))
    met = p.join(border, ["_y", "_x"]).where(within).groupBy("point_id", "area_id").agg((F.count_if(east) + F.count_if(down) + F.max(F.col("inside").cast("int"))).alias("_n")).where("_n % 2 = 1").drop("_n")
    if not levels:
        return met
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright((F.col("_x") + (1 << RUN_LEVELS - 1)).cast("long"), k).alias("block")) for k in levels]))
    return met.unionByName(p.select("point_id", "_y", at.alias("b")).select("point_id", "_y", "b.level", "b.block").join(inner, ["_y", "level", "block"]).select("point_id", "area_id"))


def nearest_rank(pairs: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows per key. The rank filter is pushed below the shuffle (at most ``n`` rows per key and task)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
