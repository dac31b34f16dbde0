"""Arrow kernel of the journey search: labels of some origins over the rides and walks they can reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

NEVER = np.iinfo(np.int64).max
#: Hops times origins worked on at once; bounds the rows of one step.
BATCH = 300_000
LABEL = ["ms", "walk_first", "first_line", "first_stop", "by_line", "prev", "leg_m", "leg_ms"]


def least_of(key: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Row of the least ``order`` of each key."""
    by = np.lexsort((*reversed(order), key))
    new = np.ones(len(by), bool)
    new[1:] = key[by[1:]] != key[by[:-1]]
    return by[new]


def labels_of(hops: pd.DataFrame, max_rides: int, max_walks: int, max_ms: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Batches of (station ids, origins as places among them, labels). ``hops``: own (whether src is an origin), src, dst, line_id (-1: a walk), meters, ms. Labels hold places of
    origin and station, rides, walks, LABEL, and ``row``, the label they come from (-1: the origin). One that another label of its station, with no more rides, walks and time, has reached
    with fewer legs is left out."""
    ids, place = np.unique(np.concatenate([hops["src"].to_numpy(), hops["dst"].to_numpy()]), return_inverse=True)
    src = place[:len(hops)]
    by = np.argsort(src, kind="stable")
    src, dst = src[by], place[len(hops):][by]
    own, line, meters, ms = (hops[c].to_numpy()[by] for c in ("own", "line_id", "meters", "ms"))
    start = np.searchsorted(src, np.arange(len(ids) + 1))
    ride = line >= 0
    served = np.bincount(src, weights=ride, minlength=len(ids)) > 0
    origins = np.unique(src[own])
    size = max(1, BATCH // max(1, len(hops)))
    for first in range(0, len(origins), size):
        at_first = origins[first:first + size]
        span = len(at_first) * len(ids)  # a key is walks * span + origin * stations + station
        seen = np.full((max_walks + 1, max_rides + max_walks + 1, span), NEVER)  # least time with so many walks and at most so many rides
        last = {"key": np.arange(len(at_first)) * len(ids) + at_first, "ms": np.zeros(len(at_first), np.int64), "walk_first": np.zeros(len(at_first), np.int64),
                "first_line": np.full(len(at_first), -1), "first_stop": np.full(len(at_first), -1)}
        row = np.full(len(at_first), -1)
        made, count = [], 0
        for legs in range(1, max_rides + max_walks + 1):
            walks, rest = last["key"] // span, last["key"] % span
            at = rest % len(ids)
            degree = start[at + 1] - start[at]
            come = np.repeat(np.arange(len(at)), degree)
            hop = np.arange(len(come)) - np.repeat(np.cumsum(degree) - degree - start[at], degree)
            r, w, t = legs - 1 - walks[come], walks[come], last["ms"][come] + ms[hop]
            ok = np.where(ride[hop], r < max_rides, (w < max_walks) & (~served[at[come]] if legs == 1 else True)) & (t <= max_ms)
            come, hop, t, w = come[ok], hop[ok], t[ok], w[ok] + ~ride[hop[ok]]
            cell = rest[come] - at[come] + dst[hop]
            beaten = np.zeros(len(t), bool)
            for less in range(max_walks + 1):
                fits = w >= less
                beaten[fits] |= seen[less, legs - w[fits], cell[fits]] <= t[fits]
            come, hop, t, key = come[~beaten], hop[~beaten], t[~beaten], (w * span + cell)[~beaten]
            least = np.full((max_walks + 1) * span, NEVER)
            np.minimum.at(least, key, t)
            ok = t == least[key]
            come, hop, t, key = come[ok], hop[ok], t[ok], key[ok]
            boards = ride[hop] & (last["first_line"][come] < 0)
            new = {"key": key, "ms": t, "walk_first": (~ride[hop]).astype(np.int64) if legs == 1 else last["walk_first"][come],
                   "first_line": np.where(boards, line[hop], last["first_line"][come]), "first_stop": np.where(boards, ids[src[hop]], last["first_stop"][come]),
                   "by_line": line[hop], "prev": ids[src[hop]], "leg_m": meters[hop], "leg_ms": ms[hop], "row": row[come]}
            pick = least_of(key, *[new[c] for c in LABEL[1:]])
            last = {c: v[pick] for c, v in new.items()}
            w, cell = last["key"] // span, last["key"] % span
            for rides in range(max_rides + max_walks + 1):
                more = legs - w <= rides
                seen[w[more], rides, cell[more]] = np.minimum(seen[w[more], rides, cell[more]], last["ms"][more])
            row = count + np.arange(len(pick))
            count += len(pick)
            made.append({"origin": at_first[cell // len(ids)], "station": cell % len(ids), "rides": legs - w, "walks": w, **{c: last[c] for c in [*LABEL, "row"]}})
        yield ids, at_first, {c: np.concatenate([m[c] for m in made]) for c in made[0]}


def best_of(n: int, x: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of the best label of each pair: fastest, then with the fewest rides, then walks. The origin itself is no destination."""
    pick = least_of(x["origin"] * n + x["station"], x["ms"], x["rides"], x["walks"])
    return pick[x["origin"][pick] != x["station"][pick]]


def journey_rows(hops: pd.DataFrame, max_rides: int, max_walks: int, max_ms: int, best_only: bool) -> pd.DataFrame:
    """All labels, or the best ones that ride."""
    out = []
    for ids, _, x in labels_of(hops, max_rides, max_walks, max_ms):
        pick = best_of(len(ids), x)
        x["best"] = np.zeros(len(x["ms"]), bool)
        x["best"][pick] = True
        if best_only:
            x = {c: v[pick[x["rides"][pick] > 0]] for c, v in x.items()}
        del x["row"]
        out.append(pd.DataFrame({**x, "origin": ids[x["origin"]], "station": ids[x["station"]]}))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ["origin", "station", "rides", "walks", *LABEL, "best"]})


def leg_rows(hops: pd.DataFrame, max_rides: int, max_walks: int, max_ms: int) -> pd.DataFrame:
    """Legs of the best journeys that ride, from the labels each has come by."""
    out = []
    for ids, _, x in labels_of(hops, max_rides, max_walks, max_ms):
        row = best_of(len(ids), x)
        row = row[x["rides"][row] > 0]
        dest = x["station"][row]
        while len(row):
            out.append(pd.DataFrame({"origin": ids[x["origin"][row]], "dest": ids[dest], "leg": x["rides"][row] + x["walks"][row], "line_id": x["by_line"][row], "src": x["prev"][row],
                                     "dst": ids[x["station"][row]], "meters": x["leg_m"][row], "ms": x["leg_ms"][row]}))
            row = x["row"][row]
            dest, row = dest[row >= 0], row[row >= 0]
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ["origin", "dest", "leg", "line_id", "src", "dst", "meters", "ms"]})
