"""Maximum-scoring segments of a sequence of word scores, and how likely such scores are by chance."""

from __future__ import annotations

import math

import numpy as np


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score), by Ruzzo and Tompa (1999), in linear time.

    Each candidate keeps the running sum before it (low) and at its end (high). A new positive score joins the nearest
    candidate to the left with a smaller low, if that one's high is smaller than its own; all between are swallowed."""
    found: list[list] = []  # first, end, low, high, index of the nearest candidate to the left with a smaller low
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def runs(positive: list[tuple[int, float]], n: int, rest: float) -> list[tuple[int, int, float]]:
    """The same for ``n`` scores that are ``rest`` (below 0) but at the given places: the scores between two places count as one."""
    scores, places, at = [], [], 0
    for i, s in positive:
        if i > at:
            scores.append(rest * (i - at))
            places.append(at)
        scores.append(s)
        places.append(i)
        at = i + 1
    ends = [*places[1:], at]
    return [(places[a], ends[b - 1], s) for a, b, s in maximal_segments(scores)]


def decay_rate(positive: np.ndarray, n: int, rest: float) -> float:
    """The lambda > 0 at which the mean of exp(lambda * score) is 1 (Karlin and Altschul, 1990), over ``n`` scores of clean text that
    are ``rest`` but for ``positive``. One score of the largest size is added, so that lambda is finite if none was seen."""
    tops = np.append(positive, positive.max() if len(positive) else -rest * 4)
    n = n + 1

    def excess(lam: float) -> float:
        return float(np.exp(lam * tops).sum() + (n - len(tops)) * math.exp(lam * rest)) / n - 1

    low, high = 1e-6, 1.0
    if excess(low) >= 0:
        return low
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def chance_factor(best: np.ndarray, lengths: np.ndarray, lam: float) -> float:
    """K of the extreme-value law P(best <= x) = exp(-K n e^(-lambda x)): its maximum-likelihood value for known lambda."""
    total = float((lengths * np.exp(-lam * best)).sum())
    return len(best) / total if total > 0 else 1.0
