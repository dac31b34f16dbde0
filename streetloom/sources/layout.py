"""Files on shared storage: a layout for box reads, copies with a check, archives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.functions.geo import boxes_touch, in_box
from streetloom.model import OsmDataset
from streetloom.operators import geometry as G

#: Levels of the cell pyramid (the cells of each are twice as large as those below), bits of a row or column number, and bits that a zone leaves out.
LEVELS, AXIS_BITS, ZONE_BITS = 14, 16, 4
#: A box is covered by at most this many runs of the key per level; what they hold beyond the box is filtered by row.
RUNS = 32


def spread_bits(x: Column) -> Column:
    """The 16 bits of a number with a zero bit before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(row: Column, col: Column) -> Column:
    """Bits of row and column in turn: cells with near numbers lie near each other."""
    return F.shiftleft(spread_bits(row), 1).bitwiseOR(spread_bits(col))


def filed(df: DataFrame, cell_deg: float) -> DataFrame:
    """Adds ``zone`` and ``key`` to rows with an extent. A row belongs to the level whose cells are at least as large as itself, and there to
    the cell of its lower left corner, so it reaches into the next cells at most. ``key``: level, then the cell in Morton order; ``zone``: the
    key without its last bits, a square of 16 by 16 cells, which names the folder."""
    extent = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"), F.lit(1e-12))
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log2(extent / cell_deg)))).cast("int")
    size = F.lit(cell_deg) * F.pow(F.lit(2.0), F.col("_level"))
    number = lambda x, shift: F.floor((F.col(x) + shift) / size).cast("long")
    key = F.col("_level").cast("long") * (1 << 2 * AXIS_BITS) + morton(number("min_lat", 90), number("min_lon", 180))
    return df.withColumn("_level", level).withColumn("key", key).withColumn("zone", F.shiftright("key", 2 * ZONE_BITS)).drop("_level")


def runs_of(lo: tuple[int, int], hi: tuple[int, int], bits: int, most: int = RUNS) -> list[tuple[int, int]]:
    """Runs of Morton numbers that together hold every cell of a rectangle of rows and columns (ends included): squares of the quadtree that lie in it,
    or touch it once going on would take more than ``most`` runs."""
    squares, done = [(0, 0, bits)], []
    while squares:
        below = []
        for row, col, size in squares:
            r0, c0, r1, c1 = row << size, col << size, (row + 1 << size) - 1, (col + 1 << size) - 1
            if r1 < lo[0] or r0 > hi[0] or c1 < lo[1] or c0 > hi[1]:
                continue
            if lo[0] <= r0 and r1 <= hi[0] and lo[1] <= c0 and c1 <= hi[1]:
                done.append((row, col, size))
            else:
                below += [(2 * row + i, 2 * col + j, size - 1) for i in (0, 1) for j in (0, 1)]
        if len(done) + len(below) > 4 * most:
            done += [(r >> 1, c >> 1, s + 1) for r, c, s in below]
            below = []
        squares = below
    weave = lambda r, c: sum((r >> k & 1) << 2 * k + 1 | (c >> k & 1) << 2 * k for k in range(bits))
    out: list[tuple[int, int]] = []
    for first, last in sorted((weave(r, c) << 2 * s, (weave(r, c) + 1 << 2 * s) - 1) for r, c, s in set(done)):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    while len(out) > most:  # the two runs with the smallest gap become one
        k = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[k : k + 2] = [(out[k][0], out[k + 1][1])]
    return out


def key_runs(box: dict, cell_deg: float, levels: int = LEVELS) -> list[tuple[int, int]]:
    """Runs of ``key`` in which every row lies that touches the box: per level the cells of the box, and one more to the left and below."""
    out, most = [], (1 << AXIS_BITS) - 1
    for level in range(levels):
        size, at = cell_deg * 2**level, level << 2 * AXIS_BITS
        number = lambda x, shift, more: max(0, min(most, math.floor((x + shift) / size) - more))
        spare = 1 if levels > 1 else 0  # points do not reach into the next cell
        lo = number(box["min_lat"], 90, spare), number(box["min_lon"], 180, spare)
        hi = number(box["max_lat"], 90, 0), number(box["max_lon"], 180, 0)
        out += [(at + a, at + b) for a, b in runs_of(lo, hi, AXIS_BITS)]
    return out


def in_runs(column: str, runs: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in runs:
        out = out | (F.col(column) == a if a == b else F.col(column).between(a, b))
    return out


def within(df: DataFrame, box: dict, cell_deg: float, levels: int) -> DataFrame:
    """Partition filter on ``zone``, row-group filter on ``key``."""
    runs = key_runs(box, cell_deg, levels)
    zones = sorted({(a >> 2 * ZONE_BITS, b >> 2 * ZONE_BITS) for a, b in runs})
    return df.where(in_runs("zone", zones) & in_runs("key", runs))


def write_dataset(ds: OsmDataset, path: str, cell_deg: float = 0.05, mode: str = "errorifexists", salt: int = 8) -> None:
    """Parquet in folders by zone and in order of the key, so that a box reads few files and few row groups. Ways carry extent, length and their
    points (``coords``, ``node_ids``): a box read needs no join. Nodes are filed like ways without extent.

    A city zone can hold half of all rows; range partitioning on (key, salt) spreads it over several tasks, each writing its own file. ``cell_deg`` is
    0.0055 at least, so that rows and columns have 16 bits."""
    if cell_deg * (1 << AXIS_BITS) < 360:
        raise ValueError("cells are too small for 16 bits")
    nodes = filed(ds.nodes.withColumns({"min_lat": F.col("lat"), "max_lat": F.col("lat"), "min_lon": F.col("lon"), "max_lon": F.col("lon")}), cell_deg).drop("min_lat", "max_lat", "min_lon", "max_lon")
    shapes = G.way_geometry(ds.way_nodes, ds.nodes).withColumnRenamed("way_id", "id")
    # A way without located nodes has no place; its row is kept apart, in zone -1.
    ways = filed(G.with_extents(ds).join(shapes, "id", "left"), cell_deg).withColumns({"key": F.coalesce("key", F.lit(-1)), "zone": F.coalesce("zone", F.lit(-1))})
    for name, df in (("nodes", nodes), ("ways", ways)):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salt)))
        (salted.repartitionByRange("key", "_salt").sortWithinPartitions("zone", "key", "id").drop("_salt")
         .write.mode(mode).partitionBy("zone").parquet(f"{path}/{name}"))
    for name, key in (("way_nodes", "way_id"), ("relations", "id"), ("relation_members", "relation_id")):
        df = getattr(ds, name)
        order = [key, "seq"] if "seq" in df.columns else [key]
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str) -> OsmDataset:
    return OsmDataset(**{n: spark.read.parquet(f"{path}/{n}") for n in ("nodes", "ways", "way_nodes", "relations", "relation_members")})


def read_nodes_in_box(spark: SparkSession, path: str, box: dict, cell_deg: float = 0.05) -> DataFrame:
    """Nodes of a box: partition pruning on the zone, row-group pruning on the key."""
    return within(spark.read.parquet(f"{path}/nodes"), box, cell_deg, 1).where(in_box(F.col("lat"), F.col("lon"), box))


def read_ways_in_box(spark: SparkSession, path: str, box: dict, cell_deg: float = 0.05) -> DataFrame:
    """Ways whose extent touches a box, with their points: only the zones of each level around the box are opened."""
    return within(spark.read.parquet(f"{path}/ways"), box, cell_deg, LEVELS).where(
        boxes_touch(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"), box))


def read_relations_in_box(spark: SparkSession, path: str, box: dict, cell_deg: float = 0.05) -> DataFrame:
    """Relations with a node in the box or a way that touches it among their members."""
    hit = read_nodes_in_box(spark, path, box, cell_deg).select(F.lit("node").alias("member_type"), F.col("id").alias("member_ref")).unionByName(
        read_ways_in_box(spark, path, box, cell_deg).select(F.lit("way").alias("member_type"), F.col("id").alias("member_ref")))
    ids = spark.read.parquet(f"{path}/relation_members").join(hit, ["member_type", "member_ref"], "left_semi").select(F.col("relation_id").alias("id"))
    return spark.read.parquet(f"{path}/relations").join(ids, "id", "left_semi")


def snapshot_dataset(ds: OsmDataset, path: str) -> DataFrame:
    """Copy every table to a folder that must not exist yet and compare the row counts: (table_name, source, copy, ok)."""
    out = None
    for name, df in ds.tables().items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        copy = df.sparkSession.read.parquet(f"{path}/{name}")
        row = df.agg(F.count("*").alias("source")).join(copy.agg(F.count("*").alias("copy")), F.lit(True)).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("source") == F.col("copy"))


def archive_and_delete(df: DataFrame, predicate: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the rows that match as JSON, then return (rows left, rows read back from the archive). Rows for which the
    predicate is unknown stay."""
    hit = F.coalesce(predicate, F.lit(False))
    df.where(hit).write.mode("errorifexists").json(path)
    return df.where(~hit), df.sparkSession.read.schema(df.schema).json(path)
