"""Shapes: thinning points (a small kernel in Arrow UDFs), clipping to boxes (expressions)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type objects, not DDL text: this module is also imported by workers, which have no session to parse text with.
POINTS = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
PATHS = T.ArrayType(POINTS)

def thin(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept by Douglas-Peucker, with distances to segments (not to endless lines). All stretches of a level are measured
    together; each that has a point beyond the tolerance is split at its farthest one, the first of equals."""
    n = len(xy)
    if n <= 2 or tolerance <= 0:
        return np.arange(n)
    kept = np.array([0, n - 1])
    while True:
        inner = np.setdiff1d(np.arange(n), kept, assume_unique=True)
        if not len(inner):
            return kept
        part = np.searchsorted(kept, inner) - 1
        a, along = xy[kept[part]], xy[kept[part + 1]] - xy[kept[part]]
        length = np.einsum("ij,ij->i", along, along)
        share = np.divide(np.einsum("ij,ij->i", xy[inner] - a, along), length, out=np.zeros(len(inner)), where=length > 0)
        off = np.hypot(*(xy[inner] - a - np.clip(share, 0.0, 1.0)[:, None] * along).T)
        order = np.lexsort((inner, -off, part))
        farthest = order[np.r_[True, np.diff(part[order]) != 0]]
        split = inner[farthest[off[farthest] > tolerance]]
        if not len(split):
            return kept
        kept = np.union1d(kept, split)


def _without_repeats(pts: np.ndarray) -> np.ndarray:
    return pts[np.r_[True, (np.diff(pts, axis=0) != 0).any(axis=1)]] if len(pts) else pts


def generalise(pts: np.ndarray, zoom_tol_m: float, lat0: float, digits: int, ring: bool) -> np.ndarray | None:
    """Drop repeats, thin in local metres, round. None when fewer than two points (three different ones for a ring) stay."""
    pts = _without_repeats(pts)
    if len(pts) < (3 if ring else 2):
        return None
    scale = np.array([110574.0, 111320.0 * np.cos(np.radians(lat0))])
    kept = pts[thin(pts * scale, zoom_tol_m)]
    if ring:
        distinct = len(kept) - 1 if len(kept) > 1 and (kept[0] == kept[-1]).all() else len(kept)
        if distinct < 3:
            return None
    f = 10.0 ** digits
    return np.floor(kept * f + 0.5) / f


# ---- the same as columns ---------------------------------------------------------------------------------------

def thin_all(xy: np.ndarray, first: np.ndarray, size: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """``thin`` of many lines at once, laid one after the other: a mask of the points kept. ``first``, ``size``, ``tolerance``: per line. Ends of lines are kept, so no stretch runs over
    the border of two; each round measures only the stretches that were split last."""
    keep = np.ones(len(xy), bool)
    work = (size > 2) & (tolerance > 0)
    limit = np.repeat(tolerance, size)
    inner = np.repeat(work, size)
    inner[first[size > 0]] = False
    inner[(first + size - 1)[size > 0]] = False
    keep[inner] = False
    inner = np.flatnonzero(inner)
    while len(inner):
        kept = np.flatnonzero(keep)
        part = np.searchsorted(kept, inner) - 1
        a = xy[kept[part]]
        along = xy[kept[part + 1]] - a
        length = np.einsum("ij,ij->i", along, along)
        share = np.divide(np.einsum("ij,ij->i", xy[inner] - a, along), length, out=np.zeros(len(inner)), where=length > 0)
        off = np.hypot(*(xy[inner] - a - np.clip(share, 0.0, 1.0)[:, None] * along).T)
        order = np.lexsort((inner, -off, part))
        farthest = order[np.r_[True, np.diff(part[order]) != 0]]
        split = farthest[off[farthest] > limit[inner[farthest]]]
        keep[inner[split]] = True
        again = np.zeros(len(kept), bool)
        again[part[split]] = True
        inner = inner[again[part] & ~keep[inner]]
    return keep


def _flat(coords: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points of a column of lines, one after the other, and their number per line (null: none)."""
    size = np.asarray(pc.fill_null(pc.list_value_length(coords), 0)).astype(np.int64)
    points = coords.flatten()
    return np.column_stack([np.asarray(pc.fill_null(points.field(k), np.nan), float) for k in (0, 1)]).reshape(-1, 2), size


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _lists(pts: np.ndarray, size: np.ndarray) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(pts[:, 0]), pa.array(pts[:, 1])], names=["lat", "lon"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), points)


def _counts(mask: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(line[mask], minlength=n)


def simplify_all(pts: np.ndarray, size: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, line = _starts(size), np.repeat(np.arange(len(size)), size)
    mean = np.zeros(len(size))
    few = (size > 0) & (size < 8)  # numpy adds fewer than eight one by one
    total = np.zeros(len(size))
    for k in range(7):
        more = few & (size > k)
        total[more] += pts[first[more] + k, 0]
    mean[few] = total[few] / size[few]
    for i in np.flatnonzero(size >= 8):
        mean[i] = pts[first[i]:first[i] + size[i], 0].mean()
    scale = np.column_stack([np.full(len(pts), 110574.0), (111320.0 * np.cos(np.radians(mean)))[line]])
    keep = thin_all(pts * scale, first, size, tol)
    return pts[keep], _counts(keep, line, len(size))


def generalise_all(pts: np.ndarray, size: np.ndarray, tol: np.ndarray, lat0: np.ndarray, digits: int, ring: bool) -> tuple[np.ndarray, np.ndarray]:
    """``generalise`` of many lines: points left and their number per line, 0 where less than a line (or ring) is left."""
    n, first, line = len(size), _starts(size), np.repeat(np.arange(len(size)), size)
    new = np.ones(len(pts), bool)
    new[1:] = (np.diff(pts, axis=0) != 0).any(axis=1)
    new[first[size > 0]] = True
    pts, line, size = pts[new], line[new], _counts(new, line, n)
    scale = np.column_stack([np.full(len(pts), 110574.0), (111320.0 * np.cos(np.radians(lat0)))[line]])
    keep = thin_all(pts * scale, _starts(size), size, tol)
    good = size >= (3 if ring else 2)
    pts, line, size = pts[keep], line[keep], _counts(keep, line, n)
    if ring:
        first = np.minimum(_starts(size), max(0, len(pts) - 1))
        last = np.maximum(first + size - 1, 0)
        closed = (size > 1) & (pts[first] == pts[last]).all(axis=1) if len(pts) else np.zeros(n, bool)
        good &= size - closed >= 3
    good &= size >= 2
    f = 10.0 ** digits
    return np.floor(pts[good[line]] * f + 0.5) / f, np.where(good, size, 0)


def _kernel(returns: T.DataType):
    """Arrow UDF that the optimiser must not repeat: a filter on its result would otherwise run it a second time."""
    return lambda fn: F.arrow_udf(fn, returns).asNondeterministic()


@_kernel(POINTS)
def _simplified(coords: pa.Array, tol: pa.Array) -> pa.Array:
    return _lists(*simplify_all(*_flat(coords), np.asarray(tol, float)))


def simplified(coords: Column, tol_m: Column) -> Column:
    return _simplified(coords, tol_m.cast("double"))


@_kernel(PATHS)
def _generalised(coords: pa.Array, tol: pa.Array, lat0: pa.Array, digits: pa.Array, ring: pa.Array) -> pa.Array:
    pts, size = _flat(coords)
    if not len(size):
        return pa.array([], pa.list_(pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))))
    pts, size = generalise_all(pts, size, np.asarray(tol, float), np.asarray(lat0, float), digits[0].as_py(), ring[0].as_py())
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size > 0)], pa.int32()), _lists(pts, size[size > 0]))


def generalised(coords: Column, tol_m: Column, lat0: Column, digits: int = 5, ring: bool = False) -> Column:
    """One line (or ring) without repeats, thinned and rounded, as an array to explode: empty if less than a line (or ring) is left."""
    return _generalised(coords, tol_m.cast("double"), lat0.cast("double"), F.lit(digits), F.lit(ring))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def clipped_line(coords: Column, min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Parts of a line inside a box. Each segment keeps the stretch [t0, t1] of its parameter that lies between both pairs of borders; a
    part goes on while a segment is kept to its end and the next from its start."""
    never, always = F.lit(float("inf")), F.lit(float("-inf"))

    def reach(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        still, inside = b == a, a.between(low, high)
        near, far = (low - a) / F.nullif(b - a, F.lit(0.0)), (high - a) / F.nullif(b - a, F.lit(0.0))
        return F.when(still, F.when(inside, always).otherwise(never)).otherwise(F.least(near, far)), F.when(still, F.when(inside, never).otherwise(always)).otherwise(F.greatest(near, far))

    def segment(a: Column, b: Column) -> Column:
        y, x = reach(a["lat"], b["lat"], min_lat, max_lat), reach(a["lon"], b["lon"], min_lon, max_lon)
        return F.struct(a.alias("a"), b.alias("b"), F.greatest(F.lit(0.0), y[0], x[0]).alias("t0"), F.least(F.lit(1.0), y[1], x[1]).alias("t1"))

    def at(s: Column, t: str) -> Column:
        go = lambda c: F.when(s[t] == 1, s["b"][c]).otherwise(s["a"][c] + s[t] * (s["b"][c] - s["a"][c]))
        return _point(go("lat"), go("lon"))

    def parts(segments: Column) -> Column:
        seen = F.filter(F.transform(segments, lambda s, i: F.struct(s.alias("s"), i.alias("i"), ((i == 0) | (s["t0"] > 0) | (F.get(segments, i - 1)["t0"] > F.get(segments, i - 1)["t1"])
                                                                                       | (F.get(segments, i - 1)["t1"] < 1)).alias("first"))), lambda x: x["s"]["t0"] <= x["s"]["t1"])
        return _with(seen, lambda v: _with(F.filter(F.transform(v, lambda x, i: F.when(x["first"], i)), lambda i: i.isNotNull()), lambda starts: F.transform(
            starts, lambda i, k: F.concat(F.array(at(F.get(v, i)["s"], "t0")), F.transform(F.slice(v, i + 1, F.coalesce(F.get(starts, k + 1), F.size(v)) - i), lambda x: at(x["s"], "t1"))))))

    n = F.size(coords)
    segments = F.transform(F.slice(coords, 1, F.greatest(n - 1, F.lit(0))), lambda a, i: segment(a, F.get(coords, i + 1)))
    return F.when(n < 2, F.array().cast(PATHS)).otherwise(_with(segments, parts))


def clipped_ring(coords: Column, min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """A ring cut to a box, one border after the other; closed again. Null if no area is left."""
    def beyond(points: Column, axis: str, other: str, limit: Column, sign: int) -> Column:
        inside = lambda p: sign * (p[axis] - limit) >= 0

        def crossing(p: Column, q: Column) -> Column:
            held = p[other] + (limit - p[axis]) / F.nullif(q[axis] - p[axis], F.lit(0.0)) * (q[other] - p[other])
            return _point(limit, held) if axis == "lat" else _point(held, limit)

        def kept(q: Column, p: Column) -> Column:
            none = F.array().cast(POINTS)
            return F.concat(F.when(inside(p) != inside(q), F.array(crossing(p, q))).otherwise(none), F.when(inside(q), F.array(q)).otherwise(none))

        return _with(points, lambda ps: F.flatten(F.transform(ps, lambda q, i: kept(q, F.get(ps, F.when(i == 0, F.size(ps) - 1).otherwise(i - 1))))))

    ring = F.transform(coords, lambda p: _point(p["lat"], p["lon"]))
    ring = F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    for axis, other, limit, sign in (("lat", "lon", min_lat, 1), ("lat", "lon", max_lat, -1), ("lon", "lat", min_lon, 1), ("lon", "lat", max_lon, -1)):
        ring = beyond(ring, axis, other, limit, sign)
    return _with(ring, lambda r: F.when(F.size(r) >= 3, F.concat(r, F.slice(r, 1, 1))))


def clipped(kind: Column, paths: Column, min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    box = (min_lat, max_lat, min_lon, max_lon)
    rings = F.filter(F.transform(paths, lambda p: clipped_ring(p, *box)), lambda r: r.isNotNull())
    return F.when(kind == "area", rings).otherwise(F.flatten(F.transform(paths, lambda p: clipped_line(p, *box))))
