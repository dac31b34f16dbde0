"""k-means on integer vectors with Shallot's bounded search (Borgelt, 2020)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.llm.common import stored

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = "1"
MOST = 1 << 27
SLACK = 1e-9


@dataclass
class Centroids:
    """Integer centroids, how far each is from each other, and for each the others by that distance (itself first)."""

    at: np.ndarray

    def __post_init__(self) -> None:
        apart = self.at[:, None, :] - self.at[None, :, :]
        self.apart = np.sqrt((apart * apart).sum(axis=2).astype(np.float64))
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        k = len(self.at)
        for i in range(k):  # equal centroids: itself first all the same
            row = self.order[i]
            self.order[i] = np.concatenate(([i], row[row != i]))
        self.alone = self.apart[np.arange(k), self.order[:, 1]] / 2 if k > 1 else np.full(k, np.inf)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = rows - centroids
    return np.einsum("ij,ij->i", d, d)


def closer(d1: np.ndarray, c1: np.ndarray, d2: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Whether (d1, c1) comes before (d2, c2): by integer distance, ties by number."""
    return (d1 < d2) | ((d1 == d2) & (c1 < c2))


def search(rows: np.ndarray, near: np.ndarray, second: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second-nearest centroid of each row and their squared distances, in integers.

    The scan runs over the sorted neighbours of the closer one of the two centroids that the row had before. A centroid farther from there than the row's distance to
    it plus the distance to the second-best so far cannot be one of the two nearest; that ball shrinks whenever the second-best improves, and rows whose next
    neighbour lies outside of it are done."""
    d1, d2 = squared(rows, c.at[near]), squared(rows, c.at[second])
    swap = closer(d2, second, d1, near)
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, other = near.copy(), second.copy()
    reach = np.sqrt(d1.astype(np.float64))
    open_ = np.arange(len(rows))
    for rank in range(1, len(c.at)):
        ball = (reach[open_] + np.sqrt(d2[open_].astype(np.float64))) * (1 + SLACK)
        next_ = c.order[start[open_], rank]
        inside = c.apart[start[open_], next_] <= ball
        open_, next_ = open_[inside], next_[inside]
        if not len(open_):
            break
        fresh = next_ != other[open_]
        x, j = open_[fresh], next_[fresh]
        d = squared(rows[x], c.at[j])
        first = closer(d, j, d1[x], near[x])
        behind = ~first & closer(d, j, d2[x], second[x])
        d2[x[first]], second[x[first]] = d1[x[first]], near[x[first]]
        d1[x[first]], near[x[first]] = d[first], j[first]
        d2[x[behind]], second[x[behind]] = d[behind], j[behind]
    return near, second, d1, d2


def reassign(rows: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids,
             moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One assignment. ``upper`` bounds the distance to ``near`` from above, ``lower`` that to every other centroid from below; both are loosened by what the centroids
    ``moved``. A row whose upper bound is under its lower bound, or under half the way from its centroid to the next one, keeps its centroid, first by the loose bound
    and then by the exact distance. Only the others are searched."""
    if len(c.at) == 1:
        return near, second, np.sqrt(squared(rows, c.at[near]).astype(np.float64)), lower
    far = np.argsort(-moved, kind="stable")[:2]
    most_of_others = np.where(near == far[0], moved[far[1]], moved[far[0]])
    upper, lower = (upper + moved[near]) * (1 + SLACK), np.maximum(0.0, (lower - most_of_others) * (1 - SLACK))
    bound = np.maximum(lower, c.alone[near]) * (1 - SLACK)
    loose = np.nonzero(upper >= bound)[0]
    upper[loose] = np.sqrt(squared(rows[loose], c.at[near[loose]]).astype(np.float64)) * (1 + SLACK)
    left = loose[upper[loose] >= bound[loose]]
    if len(left):
        near, second = near.copy(), second.copy()
        near[left], second[left], d1, d2 = search(rows[left], near[left], second[left], c)
        upper[left], lower[left] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
    return near, second, upper, lower


STATE = "vec_id long, v array<int>, near int, second int, upper double, lower double"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assign_all(state: DataFrame, c: Centroids, moved: np.ndarray, width: int) -> DataFrame:
    """``state`` after one assignment, to be written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, second, upper, lower = reassign(
                    matrix(batch.column("v"), width), *(batch.column(x).to_numpy() for x in ("near", "second")), *(batch.column(x).to_numpy().copy() for x in ("upper", "lower")), c, moved)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)],
                    names=["vec_id", "v", "near", "second", "upper", "lower"])
    return state.mapInArrow(run, STATE)


def new_centroids(state: DataFrame, c: Centroids, width: int) -> np.ndarray:
    """Componentwise floor of sum by count of every cluster that has vectors. Tasks add up their rows; the driver gets one row per centroid and component."""
    k = len(c.at)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows, near = matrix(batch.column("v"), width), batch.column("near").to_numpy()
                order = np.argsort(near, kind="stable")
                found, first = np.unique(near[order], return_index=True)
                total[found, :width] += np.add.reduceat(rows[order], first, axis=0)
                total[found, width] += np.diff(np.append(first, len(near)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), width + 1)), pa.array(np.tile(np.arange(width + 1), k)), pa.array(total.ravel())], names=["c", "at", "x"])

    sums = state.select("v", "near").mapInArrow(add, "c long, at long, x long").groupBy("c", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    found = {(r["c"], r["at"]): int(r["x"]) for r in sums}
    out = c.at.copy()
    for i in range(k):
        if n := found.get((i, width), 0):
            out[i] = [found[i, j] // n for j in range(width)]
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE,
                    seed: str = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``width`` components, none null or non-finite; the others have no row. Components become floor(``scale`` * x), those beyond 2^27 in size
    are taken as 2^27, so that a squared distance fits a long. The first centroids are the ``k`` vectors with the smallest sha256 of "``seed``:id" (equal hashes by vector; rows
    without id last), fewer if there are fewer vectors; equal centroids stay apart, and the smaller number takes their vectors. Rows with equal ids are vectors of their own.

    Each round is written: vector, nearest and second-nearest centroid and two bounds. Only centroids (``k`` of them) go to the tasks and come back to the driver."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    good = rows.where((F.size("x") == width) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = F.transform("x", lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x)) * scale))).cast("int"))
    vecs = stored(good.select("vec_id", whole.alias("v")), "cluster-vectors")
    first = vecs.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("mark")).orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], kind)
    c = Centroids(np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), width))
    # Nothing is known at first: bounds that hold nobody back, so the first assignment searches for every row.
    state, moved = vecs.select("vec_id", "v", F.lit(0).alias("near"), F.lit(min(1, len(first) - 1)).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")), np.zeros(len(first))
    for _ in range(rounds):
        state = stored(assign_all(state, c, moved, width), "cluster-state")
        following = Centroids(new_centroids(state, c, width))
        moved, c = np.sqrt(squared(following.at, c.at).astype(np.float64)), following

    centroids = c

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near), pa.array(squared(matrix(batch.column("v"), width), centroids.at[near]))],
                                             names=["vec_id", "cluster", "distance"])

    final = stored(assign_all(state, c, moved, width).mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per = vectors.sparkSession.createDataFrame(
        [(i, Decimal(inertia.get(i, 0)), Decimal(sum(inertia.values())), ",".join(map(str, x))) for i, x in enumerate(c.at.tolist())], "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), at string")
    return final.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", F.col("cluster_inertia").cast("long"), F.col("inertia").cast("long"), F.sha2(F.col("at").cast("binary"), 256).alias("centroid_sha256"))
