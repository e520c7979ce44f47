"""The sequential parts of binning, over counts of distinct values or of bins in numpy."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np


def chi2_threshold(alpha: float) -> float:
    """Quantile 1 - alpha of chi-squared with one degree of freedom."""
    return NormalDist().inv_cdf(1 - alpha / 2) ** 2


def least_rows(value: int | float | None, total: int) -> int | None:
    """min_samples as a number of rows: an int above 0, or a share in (0, 1]."""
    if value is None:
        return None
    if isinstance(value, (bool, np.bool_)):
        raise TypeError("min_samples must be an int, a float or None, not a bool")
    if isinstance(value, (int, np.integer)):
        if value <= 0:
            raise ValueError("min_samples as an int must be above 0")
        if value > total:
            raise ValueError(f"min_samples ({value}) exceeds the number of rows ({total})")
        return int(value)
    if not 0 < value <= 1:
        raise ValueError("min_samples as a float must lie in (0, 1]")
    return max(1, math.ceil(value * total))


def equal_width(low: float, high: float, bins: int) -> list[float]:
    if low == high:
        pad = abs(low) * 0.001 if low else 0.001
        low, high = low - pad, high + pad
    return [float(x) for x in np.linspace(low, high, bins + 1)[1:-1]]


#: Costs that k-means holds at a time.
BLOCK = 1 << 20


def _least_at(cost, j: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least cost(i, j) of a <= i <= z, and its first i; BLOCK costs are held at a time."""
    parts = (z - a) // BLOCK + 1
    first = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(j)), parts)
    start = a[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
    size = np.minimum(BLOCK, z[owner] + 1 - start)
    block = (np.cumsum(size) - 1) // BLOCK
    lows, places = [], []
    for own in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(block)) + 1):
        n, at = size[own], np.cumsum(size[own]) - size[own]
        i = np.repeat(start[own] - at, n) + np.arange(n.sum())
        total = cost(i, np.repeat(j[owner[own]], n))
        low = np.minimum.reduceat(total, at)
        hits = np.flatnonzero(total == np.repeat(low, n))
        lows.append(low)
        places.append(i[hits[np.searchsorted(hits, at)]])
    low, place = np.concatenate(lows), np.concatenate(places)
    best = np.minimum.reduceat(low, first)
    hits = np.flatnonzero(low == np.repeat(best, parts))
    return best, place[hits[np.searchsorted(hits, first)]]


def kmeans_splits(x: np.ndarray, n: np.ndarray, k: int) -> list[float]:
    """Midpoints between the centres of the partition into k intervals with the least squared error, by dynamic programming over all distinct values.

    The best last cut never moves left as values are added, so each layer halves the range of ends and of cuts in turns: O(k m log m). Infinite values have no centre; they fall into the outermost bins.
    """
    finite = np.isfinite(x)
    x, n = np.asarray(x, float)[finite], np.asarray(n, float)[finite]
    m = len(x)
    if m < k or k < 2:
        return []
    middle = int(np.searchsorted(np.cumsum(n), n.sum() / 2))
    d, rows = x.astype(np.longdouble) - x[middle], n.astype(np.longdouble)

    def sums(v):  # outward from the median, so that far values don't blur the sums of near ones
        return np.concatenate([-np.cumsum(v[:middle][::-1])[::-1], [np.longdouble(0)], np.cumsum(v[middle:])])

    w, wx, wxx = sums(rows), sums(rows * d), sums(rows * d * d)

    def cost(i, j):  # of x[i:j]
        s = wx[j] - wx[i]
        return np.maximum(wxx[j] - wxx[i] - s * s / (w[j] - w[i]), 0)

    best = np.concatenate([[np.longdouble(0)], cost(np.zeros(m, int), np.arange(1, m + 1))])
    cuts = []
    for c in range(1, k):  # x[:j] in c + 1 intervals, the last of them x[i:j]
        new, cut = np.full(m + 1, np.inf, np.longdouble), np.zeros(m + 1, np.int64)
        low, high = np.array([c + 1 if c < k - 1 else m]), np.array([m])
        a, z = np.array([c]), np.array([m - 1])
        while len(low):
            j = (low + high) // 2
            new[j], at = _least_at(lambda i, j: best[i] + cost(i, j), j, a, np.minimum(z, j - 1))
            cut[j] = at
            low, high = np.concatenate([low, j + 1]), np.concatenate([j - 1, high])
            a, z = np.concatenate([a, at]), np.concatenate([at, z])
            some = low <= high
            low, high, a, z = low[some], high[some], a[some], z[some]
        cuts.append(cut)
        best = new
    ends = [m]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    ends = [0, *reversed(ends)]
    centres = [x[middle] + (rows[a:b] * d[a:b]).sum() / rows[a:b].sum() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [float((a + b) / 2) for a, b in zip(centres[:-1], centres[1:], strict=True)]


def tree_splits(x: np.ndarray, n: np.ndarray, bad: np.ndarray, leaves: int, least: int) -> list[float]:
    """Thresholds of a best-first tree by Gini impurity with at most `leaves` leaves of at least `least` rows."""
    cn, cb = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(bad)]

    def impurity(rows, bads):
        p = bads / np.maximum(rows, 1)
        return 2 * p * (1 - p) * rows

    def best(a: int, b: int):
        """Gain and place of the best split of x[a:b]."""
        if b - a < 2:
            return 0.0, -1
        at = np.arange(a + 1, b)
        left_n, left_b = cn[at] - cn[a], cb[at] - cb[a]
        right_n, right_b = cn[b] - cn[at], cb[b] - cb[at]
        gain = impurity(cn[b] - cn[a], cb[b] - cb[a]) - impurity(left_n, left_b) - impurity(right_n, right_b)
        gain = np.where((left_n >= least) & (right_n >= least), gain, -np.inf)
        i = int(gain.argmax())
        return (float(gain[i]), int(at[i])) if gain[i] > 1e-12 else (0.0, -1)

    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int, b: int):
        gain, at = best(a, b)
        if at >= 0:
            heapq.heappush(heap, (-gain, a, b, at))

    offer(0, len(x))
    cuts: list[int] = []
    while heap and len(cuts) < leaves - 1:
        _, a, b, at = heapq.heappop(heap)
        cuts.append(at)
        offer(a, at)
        offer(at, b)
    return sorted(float((x[i - 1] + x[i]) / 2) for i in cuts)


def pair_chi2(n1: float, b1: float, n2: float, b2: float) -> float:
    """Chi-squared of two bins with Yates' correction, subtracted whatever the difference."""
    n = n1 + n2
    if not n:
        return 0.0
    b = b1 + b2
    bad, good = b / n, (n - b) / n
    # the four cells, spelled out: this runs for every merge
    e, f, g, h = n1 * bad, n1 * good, n2 * bad, n2 * good
    return (
        (abs(b1 - e) - 0.5) ** 2 / (e if e > 1e-9 else 1e-9)
        + (abs(n1 - b1 - f) - 0.5) ** 2 / (f if f > 1e-9 else 1e-9)
        + (abs(b2 - g) - 0.5) ** 2 / (g if g > 1e-9 else 1e-9)
        + (abs(n2 - b2 - h) - 0.5) ** 2 / (h if h > 1e-9 else 1e-9)
    )


def chimerge_splits(x: np.ndarray, n: np.ndarray, bad: np.ndarray, bins: int, alpha: float, least: int | None) -> list[float]:
    """Merges neighbours of the smallest chi-squared: down to `bins`, then while below the threshold of alpha, then bins of fewer than `least` rows. Splits lie midway between bins' first values."""
    m = len(x)
    if m < 2:
        return []
    rows, bads = np.asarray(n, float).tolist(), np.asarray(bad, float).tolist()
    after, before = list(range(1, m + 1)), list(range(-1, m - 1))
    # a pair goes by its left bin; it counts as it did at `turn`, -1 once its left bin is gone
    turn = [0] * m
    turn[-1] = -1
    first_chi = np.fromiter(map(pair_chi2, rows, bads, rows[1:], bads[1:]), float, m - 1)
    order = array("q", np.argsort(first_chi, kind="stable").tobytes())
    first_chi = array("d", first_chi.tobytes())
    # a heap of new pairs only, beside the sorted first ones
    heap: list[tuple[float, int, int]] = []
    at, full, left, most, threshold = 0, 1000, m, max(bins, 1), chi2_threshold(alpha)
    push, pop = heapq.heappush, heapq.heappop
    while left > 1:
        while heap and turn[heap[0][1]] != heap[0][2]:
            pop(heap)
        while at < m - 1 and turn[order[at]]:
            at += 1
        i = order[at] if at < m - 1 else -1
        chi = first_chi[i] if i >= 0 else math.inf
        if heap and (i < 0 or heap[0][0] < chi or (heap[0][0] == chi and heap[0][1] < i)):
            chi, i, _ = heap[0]
        if left <= most and not chi < threshold:
            break
        j = after[i]
        rows[i] += rows[j]
        bads[i] += bads[j]
        turn[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k < m:
            before[k] = i
            now = turn[i] = turn[i] + 1
            push(heap, (pair_chi2(rows[i], bads[i], rows[k], bads[k]), i, now))
        else:
            turn[i] = -1
        h = before[i]
        if h >= 0:
            now = turn[h] = turn[h] + 1
            push(heap, (pair_chi2(rows[h], bads[h], rows[i], bads[i]), h, now))
        if len(heap) > full:
            heap = [e for e in heap if turn[e[1]] == e[2]]
            heapq.heapify(heap)
            full = len(heap) * 3 // 2 + 1000
    starts, i = [], 0
    while i < m:
        starts.append(i)
        i = after[i]
    if least:
        sizes, hits, first = [rows[i] for i in starts], [bads[i] for i in starts], [x[i] for i in starts]
        while len(sizes) > 1 and min(sizes) < least:
            edges = [i for i in range(len(sizes) - 1) if sizes[i] < least or sizes[i + 1] < least]
            i = min(edges, key=lambda i: (pair_chi2(sizes[i], hits[i], sizes[i + 1], hits[i + 1]), i))
            sizes[i : i + 2], hits[i : i + 2] = [sizes[i] + sizes[i + 1]], [hits[i] + hits[i + 1]]
            del first[i + 1]
    else:
        first = [x[i] for i in starts]
    return sorted({float((a + b) / 2) for a, b in zip(first[:-1], first[1:], strict=True)})


def optimal_splits(x: np.ndarray, n: np.ndarray, bad: np.ndarray, bins: int, least: int, trend: str | bool | None, fine: int = 40) -> list[float]:
    """The partition into at most `bins` bins of the largest information value whose bad rates follow the trend, by dynamic programming over at most `fine` cells of equal counts.

    trend: "ascending", "descending", "auto_asc_desc" (also True and "auto"): the better one; None or False: any.
    """
    if len(x) < 2:
        return []
    if len(x) > fine:
        cell = np.minimum((np.cumsum(n) - 1) * fine // n.sum(), fine - 1).astype(int)
        last = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True])
    else:
        last = np.arange(len(x))
    cn, cb = np.r_[0, np.cumsum(n)[last]], np.r_[0, np.cumsum(bad)[last]]
    cg, m = cn - cb, len(last)
    all_b, all_g = max(cb[-1], 1), max(cg[-1], 1)

    def worth(a: int, b: int) -> float:
        bads, goods = max(cb[b] - cb[a], 0.5) / all_b, max(cg[b] - cg[a], 0.5) / all_g
        return (goods - bads) * math.log(goods / bads)

    def rate(a: int, b: int) -> float:
        return (cb[b] - cb[a]) / (cn[b] - cn[a])

    def solve(sign: int) -> tuple[float, list[int]]:
        # state: last bin (a, b) and number of bins
        table: dict[tuple[int, int], dict[int, tuple[float, tuple]]] = {}
        for b in range(1, m + 1):
            for a in range(b):
                if cn[b] - cn[a] < least:
                    continue
                own = worth(a, b)
                here: dict[int, tuple[float, tuple]] = {1: (own, ())} if a == 0 else {}
                for z in range(a):
                    for k, (value, _) in table.get((z, a), {}).items():
                        if k < bins and (sign == 0 or sign * (rate(a, b) - rate(z, a)) > 0) and value + own > here.get(k + 1, (-1.0,))[0]:
                            here[k + 1] = (value + own, (z, a, k))
                if here:
                    table[(a, b)] = here
        ends = [(v, (a, b, k)) for (a, b), d in table.items() if b == m for k, (v, _) in d.items()]
        if not ends:
            return -1.0, []
        value, at = max(ends, key=lambda e: (e[0], -e[1][2]))
        cuts = []
        while at:
            a, b, k = at
            if a:
                cuts.append(a)
            at = table[(a, b)][k][1]
        return value, sorted(cuts)

    if trend in (None, False):
        _, cuts = solve(0)
    elif trend in (True, "auto", "auto_asc_desc"):
        _, cuts = max((solve(s) for s in (1, -1)), key=lambda r: r[0])
    else:
        _, cuts = solve({"ascending": 1, "descending": -1}[trend])
    return [float((x[last[c - 1]] + x[last[c - 1] + 1]) / 2) for c in cuts]


def bin_counts(x: np.ndarray, n: np.ndarray, bad: np.ndarray, splits: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bads of the bins (a, b]."""
    code = np.searchsorted(np.asarray(splits, float), x, side="left")
    return np.bincount(code, n, len(splits) + 1), np.bincount(code, bad, len(splits) + 1)


def monotone(splits: Sequence[float], n: np.ndarray, bad: np.ndarray, trend: str | bool | None) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Removes splits until the bad rates of non-empty bins run in one direction; any direction that already holds is left."""
    splits, n, bad = list(splits), np.asarray(n, float), np.asarray(bad, float)
    while len(splits):
        seen = np.flatnonzero(n > 0)
        rate = bad[seen] / n[seen]
        step = np.diff(rate)
        if len(seen) < 2 or (step >= 0).all() or (step <= 0).all():
            break
        sign = {"ascending": 1, "descending": -1}.get(trend, 1 if rate[-1] > rate[0] else -1)
        at = int(seen[int(np.flatnonzero(sign * step < 0)[0])])
        splits, n, bad = _without(splits, n, bad, at)
    return splits, n, bad


def _without(splits: list[float], n: np.ndarray, bad: np.ndarray, at: int) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Bins at and at + 1 become one."""
    del splits[at]
    n[at + 1] += n[at]
    bad[at + 1] += bad[at]
    return splits, np.delete(n, at), np.delete(bad, at)


def repaired(splits: Sequence[float], n: np.ndarray, bad: np.ndarray, trend: str | bool | None, least: int | None) -> list[float]:
    """Monotone repair (if a trend is asked for), and merges of bins with fewer than `least` rows into the smaller neighbour, in turns."""
    splits, n, bad = list(splits), np.asarray(n, float), np.asarray(bad, float)
    while True:
        if trend:
            splits, n, bad = monotone(splits, n, bad, trend)
        small = np.flatnonzero(n < least) if least else []
        if not len(splits) or not len(small):
            return splits
        i = int(small[0])
        if i == 0:
            at = 0
        elif i == len(n) - 1:
            at = i - 1
        else:
            at = i - 1 if n[i - 1] <= n[i + 1] else i
        splits, n, bad = _without(splits, n, bad, at)
