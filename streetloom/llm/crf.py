"""Linear-chain conditional random fields over many short and long sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 64
#: Messages are scaled at every RESCALE-th step; log-potentials of a place must not lie more than about 80 apart.
RESCALE = 8


@dataclass
class Layout:
    """Sequences laid one after the other, cut into pieces of at most PIECE positions. ``at[p, t]`` is the place of step t of
    piece p, ``live`` says whether there is one, ``rank`` is the piece's number within its sequence."""

    at: np.ndarray
    live: np.ndarray
    rank: np.ndarray
    last: np.ndarray


def layout(lengths: np.ndarray) -> Layout:
    lengths = lengths[lengths > 0]
    count = -(-lengths // PIECE)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(lengths) - lengths, count) + rank * PIECE
    size = np.minimum(np.repeat(lengths, count) - rank * PIECE, PIECE)
    steps = np.arange(size.max() if len(size) else 0)
    return Layout(begin[:, None] + np.minimum(steps, size[:, None] - 1), steps < size[:, None], rank, rank == np.repeat(count, count) - 1)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(label) at each place, and the expected number of each transition if ``pairs``. ``scores`` (places x labels) are log-potentials of sequences
    of the given lengths one after the other.

    Pieces of a sequence are worked side by side: the product of a piece's transfer matrices carries messages over it, so
    a sequence of n places takes PIECE + n / PIECE steps of array operations and no more."""
    n, k = scores.shape
    if not n:
        return np.empty((0, k)), np.zeros((k, k)) if pairs else None
    lay = layout(np.asarray(lengths))
    a = np.exp(transitions - transitions.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True))[lay.at.T]
    live = lay.live.T[:, :, None]
    full = lay.live.all(axis=0)  # steps that every piece has
    pieces, steps = lay.live.shape
    first = lay.rank == 0
    into, back = np.full((pieces, k), 1.0 / k), np.full((pieces, k), 1.0 / k)
    if lay.rank.max() > 0:
        carry = np.broadcast_to(np.eye(k), (pieces, k, k)).copy()
        for t in range(steps):
            move = (carry.reshape(-1, k) @ a).reshape(pieces, k, k)
            if t == 0:
                move[first] = carry[first]
            move *= e[t][:, None, :]
            if t % RESCALE == 0:
                move = scaled(move)
            carry = move if full[t] else np.where(live[t][:, :, None], move, carry)
        carry = scaled(carry)
        for r in range(1, lay.rank.max() + 1):
            p = np.nonzero(lay.rank == r)[0]
            into[p] = scaled(np.einsum("pi,pij->pj", into[p - 1], carry[p - 1]))
        for r in range(lay.rank.max() - 1, -1, -1):
            p = np.nonzero((lay.rank == r) & ~lay.last)[0]
            back[p] = scaled(np.einsum("pij,pj->pi", carry[p + 1], back[p + 1]))
    ahead = np.empty((steps, pieces, k))
    now = into
    for t in range(steps):
        move = now @ a
        if t == 0:
            move[first] = now[first]
        move *= e[t]
        if t % RESCALE == 0:
            move = scaled(move)
        now = move if full[t] else np.where(live[t], move, now)
        ahead[t] = now
    behind = np.empty((steps, pieces, k))
    now = back
    for t in range(steps - 1, -1, -1):
        behind[t] = now
        if t:
            move = (e[t] * now) @ a.T
            if t % RESCALE == 0:
                move = scaled(move)
            now = move if full[t] else np.where(live[t], move, now)
    joint = ahead * behind
    joint /= joint.sum(axis=2, keepdims=True)
    out = np.empty((n, k))
    use = lay.live.T.copy()
    out[lay.at.T[use]] = joint[use]
    if not pairs:
        return out, None
    before = np.concatenate((into[None], ahead[:-1]))
    use[0, first] = False
    left, right = before[use], (e * behind)[use]
    both = left[:, :, None] * a * right[:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    return out, both.sum(axis=0)


def viterbi(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best label of each place. Sequences are worked side by side, the longest first; ties go to the lower label."""
    n, k = scores.shape
    lengths = np.asarray(lengths)
    begin, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    out, from_ = np.zeros(n, dtype=np.int64), np.zeros((n, k), dtype=np.int8)
    if not len(order):
        return out
    best = scores[begin[order]].copy()
    alive = len(order)
    steps = int(lengths[order[0]])
    counts = np.searchsorted(-lengths[order], -np.arange(steps), side="left")  # sequences longer than t
    for t in range(1, steps):
        alive = counts[t]
        reach = best[:alive, :, None] + transitions
        place = begin[order[:alive]] + t
        from_[place] = reach.argmax(axis=1)
        best[:alive] = reach.max(axis=1) + scores[place]
    label = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        place = begin[order[: counts[t]]] + t
        out[place] = label[: counts[t]]
        if t:
            label[: counts[t]] = from_[place, label[: counts[t]]]
    return out
