"""Embedding near-duplicates by a tiled comparison in the order of principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.llm.common import stored
from streetloom.operators.network import components

THRESHOLD = 0.95
BLOCK = 8192
TILE = 1024
STEPS = (16, 32)
#: What sums in single precision, of vectors of length 1, can be wrong by at most.
SLACK = 1e-5


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest entry so that tiny and huge vectors keep their precision."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: the eigenvectors of the second moments of all unit vectors, largest first. Each task adds up its rows; the
    driver gets width * width sums, whatever the number of rows."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(matrix(batch.column(0), width))
                total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "x"])
    sums = vectors.select("v").mapInArrow(moments, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    moment = np.zeros(width * width)
    for r in sums:
        moment[r["at"]] = r["x"]
    return np.linalg.eigh(moment.reshape(width, width))[1][:, ::-1].copy()


def join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the classes of i and j, element by element, in place; every entry points at the smallest of its class."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent[:] = up


class Side:
    """One block of vectors: plain unit rows for the deciding product; for the bounds, in single precision, the leading components of rotated rows with the norm of the others behind them."""

    def __init__(self, values: np.ndarray, axes: np.ndarray, steps: tuple[int, ...]):
        self.unit = unit_rows(values)
        turned = self.unit @ axes
        squares = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.bounds = {k: np.column_stack((turned[:, :k], np.sqrt(squares[:, k]) if k < squares.shape[1] else np.zeros(len(values)))).astype(np.float32) for k in steps}


def tile_hits(a: Side, ra: slice, b: Side, rb: slice, steps: tuple[int, ...], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile with cosine at the threshold or above. What the components behind the leading ones can add is at most the product
    of their norms (Cauchy-Schwarz), so one product of the leading ones and those norms bounds the cosine; pairs that cannot reach the threshold stop there. The whole tile
    goes on to more components while many pairs are open; else only the open ones do. The product of the plain unit vectors, in double precision, decides."""
    for k in steps:
        open_ = np.flatnonzero(a.bounds[k][ra] @ b.bounds[k][rb].T >= np.float32(threshold - SLACK))
        if len(open_) < (ra.stop - ra.start) * (rb.stop - rb.start) // 64:
            break
    else:
        i, j = np.nonzero(a.unit[ra] @ b.unit[rb].T >= threshold)
        return i + ra.start, j + rb.start
    i, j = np.divmod(open_, rb.stop - rb.start)
    hits = [np.empty(0, dtype=bool)]
    for s in range(0, len(i), 1 << 16):
        x, y = i[s : s + (1 << 16)] + ra.start, j[s : s + (1 << 16)] + rb.start
        hits.append(np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= threshold)
    hit = np.concatenate(hits)
    return i[hit] + ra.start, j[hit] + rb.start


def block_links(cids: np.ndarray, values: np.ndarray, copies: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, axes: np.ndarray, threshold: float,
                steps: tuple[int, ...] = STEPS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two blocks of vectors (or one with itself): the ids with a link, the vectors each is linked to here, and the
    smallest id of its class here. Only these are returned, never pairs."""
    steps = tuple(k for k in steps if k < axes.shape[0])
    parent, links = np.arange(len(cids)), np.zeros(len(cids), dtype=np.int64)
    same = np.array_equal(in_a, in_b)
    a = Side(values[in_a], axes, steps)
    b = a if same else Side(values[in_b], axes, steps)
    for s in range(0, len(in_a), tile):
        for t in range(s if same else 0, len(in_b), tile):
            i, j = tile_hits(a, slice(s, min(s + tile, len(in_a))), b, slice(t, min(t + tile, len(in_b))), steps, threshold)
            if same and s == t:
                i, j = i[i < j], j[i < j]
            if len(i):
                x, y = in_a[i], in_b[j]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                join_roots(parent, x, y)
    met = np.nonzero(links)[0]
    return cids[met], links[met], cids[parent[met]]


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows at cosine >= ``threshold``), component_id (the smallest vec_id reachable
    by links, itself included), kept (vec_id = component_id).

    Equal vectors are compared once and counted as often as they occur. The others are dealt by hash into blocks of about
    ``block`` rows; each two blocks meet in one task, which returns counts and the roots of its classes, at most one row per vector. The work grows with
    the square of the distinct vectors, as the method has it; a task holds two blocks.

    Null, empty and zero vectors, those with null or non-finite components, and rows without id link with nothing; vectors of different
    length do not link. Rows with the same id are vectors of their own. ``threshold`` must be above 0."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    classes = stored(good.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")).withColumn(
        "cid", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "vectors")
    found = [links_of_width(classes.where(F.col("width") == r["width"]), r["width"], r["n"], threshold, block)
             for r in classes.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect()]
    if found:
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        out = stored(out, "vector-links")
        counts = out.groupBy("cid").agg(F.sum("links").alias("links"))
        roots = components(out.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node_id").alias("cid"), F.col("component").alias("root"))
        known = classes.join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    else:
        known = classes.withColumns({"links": F.lit(0).cast("long"), "root": F.col("cid")})
    least = known.groupBy("root").agg(F.min("first_id").alias("component"))
    named = stored(known.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component"), "vector-classes")
    linked = good.join(named, "v").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(F.col("vec_id").isNull() | v.isNull() | ~(finite & F.exists("v", lambda x: x != 0))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def links_of_width(classes: DataFrame, width: int, n: int, threshold: float, block: int) -> DataFrame:
    axes = principal_axes(classes, width)
    groups = -(-n // block)
    group = F.pmod(F.xxhash64("cid"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = classes.select("cid", "n", "v", group.alias("g")).withColumn("h", other).select(
        "cid", "n", "v", "g", F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cid").combine_chunks()
        g, low, high = rows["g"].to_numpy(), *(k.as_py() for k in key)
        cid, links, root = block_links(rows["cid"].to_numpy(), matrix(rows["v"].chunk(0), width), rows["n"].to_numpy(), np.nonzero(g == low)[0], np.nonzero(g == high)[0],
                                       axes, threshold)
        return pa.table({"cid": cid, "links": links, "root": root})

    return dealt.groupBy("low", "high").applyInArrow(compare, "cid long, links long, root long")
