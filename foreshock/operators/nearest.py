"""The k nearest of one block of vectors for another, inside a task.

A matrix product of 4-byte numbers bounds every distance from below; only pairs
whose bound does not exceed the k-th distance found are measured exactly.  For
p = 1 the bound is ``|d| >= sum of A (1 - cos(w d))`` over a few waves, an inner
product of cosines and sines.  For other p it is the Euclidean distance times a
constant.
"""

from __future__ import annotations

import numpy as np

#: Rows of queries whose bounds are held at once, columns that give the first limit, pairs measured at once.
ROWS, PILOT, PAIRS = 128, 2048, 1 << 11
#: Rows and columns of bounds held at once between two blocks, pairs found there before all but the nearest are dropped.
TILE, FOUND = 512, 1 << 21
#: W and A of the waves whose sum stays below |d| and comes nearest to it on average over normal d of deviation 1.
WAVES = ((1.36177, 0.98032), (3.90384, 0.128936))
#: Deviation of the difference of two normal values, by the median distance of one from its middle.
NORMAL = 2.0968


def measured(q: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray, p: float) -> np.ndarray:
    """Distances of rows ``i`` of ``q`` to rows ``j`` of ``t``, at 9 places."""
    out = np.empty(len(i))
    for a in range(0, len(i), PAIRS):
        b = a + PAIRS
        d = t[j[a:b]]
        d -= q[i[a:b]]
        np.abs(d, out=d)
        out[a:b] = np.round(d.sum(axis=1) if p == 1 else (d**p).sum(axis=1) ** (1.0 / p), 9)
    return out


class Bounds:
    """``left @ right.T`` exceeds ``limit(dist)`` only for pairs farther apart than ``dist``."""

    def __init__(self, q: np.ndarray, t: np.ndarray, p: float):
        # Medians: a few vectors far out must not blur the bounds of the others.
        middle = np.median(t, axis=0)
        q, t = q - middle, t - middle
        self.p, size = p, q.shape[1]
        # What sums of 4-byte numbers may be wrong by, as a share of the sum of their sizes.
        self.loss = (4 * size + 16) * 2.0**-22
        if p == 1:
            spread = np.median(np.abs(t), axis=0)
            spread = NORMAL * np.where(spread > 0, spread, np.abs(t).mean(axis=0))
            used = spread > 0
            spread = spread[used]
            root = np.sqrt(spread)
            code = lambda x: np.concatenate([f(x[:, used] / spread * w) * (root * a**0.5) for w, a in WAVES for f in (np.cos, np.sin)], axis=1).astype(np.float32)
            self.left, self.right, self.total = -code(q), code(t), spread.sum() * sum(a for _, a in WAVES)
            return
        self.scale = max(np.abs(q).max(), np.abs(t).max()) or 1.0
        q, t = q / self.scale, t / self.scale
        self.share = size ** min(0.0, 1.0 / p - 0.5) * (1 - 1e-9)
        norms = lambda x: (x * x).sum(axis=1, keepdims=True) * (1 - self.loss)
        self.left = np.concatenate([-2 * q, np.ones((len(q), 1)), norms(q)], axis=1).astype(np.float32)
        self.right = np.concatenate([t, norms(t), np.ones((len(t), 1))], axis=1).astype(np.float32)

    def limit(self, dist: np.ndarray) -> np.ndarray:
        far = dist * (1 + 1e-9) + 1e-8  # what rounding brings to ``dist``
        if self.p == 1:
            x = far - self.total * (1 - self.loss)
        else:
            x = (far / self.scale / self.share) ** 2
        with np.errstate(over="ignore"):
            return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _pairs(score: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores up to the limit of their row."""
    return np.divmod(np.flatnonzero(score <= limit[:, None]), score.shape[1])


def _kth(row: np.ndarray, d: np.ndarray, k: int, rows: int) -> np.ndarray:
    """The k-th smallest of each row's ``d``; infinite with fewer."""
    order = np.lexsort((d, row))
    first = np.searchsorted(row[order], np.arange(rows)) + k - 1
    inside = first < np.searchsorted(row[order], np.arange(rows), side="right")
    out = np.full(rows, np.inf)
    out[inside] = d[order][first[inside]]
    return out


def nearest(q: np.ndarray, t: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``t``, distance) of the ``k`` nearest, ascending; of equal distances the first rows of ``t``."""
    bounds = Bounds(q, t, p)
    some = min(PILOT, len(t))
    place = min(some, max(4, -(-4 * k * some // len(t)))) - 1
    found = []
    for a in range(0, len(q), ROWS):
        part = slice(a, min(a + ROWS, len(q)))
        score = bounds.left[part] @ bounds.right.T
        rows = len(score)
        cut = np.partition(score[:, :some], place, axis=1)[:, place]
        i, j = _pairs(score, cut)
        few = np.flatnonzero(np.bincount(i, minlength=rows) < min(k, len(t)))
        if len(few):
            cut[few] = np.partition(score[few], min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
            i, j = _pairs(score, cut)
        far = _kth(i, measured(q[part], t, i, j, p), k, rows)
        i, j = _pairs(score, bounds.limit(far))
        d = measured(q[part], t, i, j, p)
        near = d <= far[i]
        i, j, d = i[near], j[near], d[near]
        i, j, d = _first(i, j, d, k)
        found.append((i + a, j, d))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` smallest (d, j) of each i, ascending."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def _set(mask: np.ndarray) -> np.ndarray:
    """Places of the few true entries, eight looked at in one step."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    at = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


class _Few:
    """Pairs that come in parts, of which the ``k`` nearest of every i are kept."""

    def __init__(self, k: int):
        self.k, self.parts, self.rows = k, [], 0

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        self.parts.append((i, j, d))
        self.rows += len(i)
        if self.rows > FOUND:
            self.parts = [self.all()]
            self.rows = len(self.parts[0][0]) // 2  # what stays may be much itself

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _first(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.k)


def within(q: np.ndarray, t: np.ndarray, far_q: np.ndarray, far_t: np.ndarray, k: int, p: float) -> tuple[tuple, tuple]:
    """The ``k`` nearest rows of ``t`` for each of ``q`` up to ``far_q``, and of ``q`` for each of ``t`` up to ``far_t``: one product serves both."""
    bounds = Bounds(q, t, p)
    limit_q, limit_t = bounds.limit(far_q)[:, None], bounds.limit(far_t)
    of_q, of_t = _Few(k), _Few(k)
    space, masks = np.empty(TILE * TILE, np.float32), np.empty((2, TILE * TILE), bool)
    for a in range(0, len(q), TILE):
        left, row = bounds.left[a : a + TILE], []
        for b in range(0, len(t), TILE):
            right = bounds.right[b : b + TILE]
            shape, size = (len(left), len(right)), len(left) * len(right)
            score = np.matmul(left, right.T, out=space[:size].reshape(shape))
            near, other = masks[0, :size].reshape(shape), masks[1, :size].reshape(shape)
            np.less_equal(score, limit_q[a : a + TILE], out=near)
            np.less_equal(score, limit_t[b : b + TILE], out=other)
            i, j = np.divmod(_set(np.logical_or(near, other, out=near)), len(right))
            i, j = i + a, j + b
            d = measured(q, t, i, j, p)
            for keep, x, y, far in ((of_q, i, j, far_q), (of_t, j, i, far_t)):
                some = d <= far[x]
                keep.add(x[some], y[some], d[some])
    return of_q.all(), of_t.all()


def copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the number of its content, and how many equal rows come before it."""
    flat = np.ascontiguousarray(x + 0.0)
    _, same = np.unique(flat.view(f"V{flat.itemsize * flat.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    before = np.empty(len(x), np.int64)
    before[order] = np.arange(len(x)) - np.searchsorted(same[order], same[order])
    return same, before


def nearest_others(qid: np.ndarray, q: np.ndarray, tid: np.ndarray, t: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``t``, distance) of the ``k`` nearest under another id, of equal distances those of small ids.

    Equal queries are searched once, and of equal vectors only those with the
    smallest ids can be among the nearest, so copies cost nothing.  Vectors with
    parts that are missing or not finite are nobody's neighbours.
    """
    qs = np.flatnonzero(np.isfinite(q).all(axis=1))
    ts = np.flatnonzero(np.isfinite(t).all(axis=1))
    ts = ts[np.argsort(tid[ts], kind="stable")]
    if not len(qs) or not len(ts):
        return qs[:0], ts[:0], np.zeros(0)
    # One more than k: a query may be among its own nearest.  An id may be repeated in ``t``.
    most = k + int(np.unique(tid[ts], return_counts=True)[1].max())
    ts = ts[copies(t[ts])[1] < most]
    content, once = _contents(q[qs])
    i, j, d = nearest(q[qs[once]], t[ts], most, p)
    return _spread(qid, qs, content, tid, ts, i, j, d, k)


def _contents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the number of its content, and the first row of each content, ascending."""
    same, before = copies(x)
    once = np.flatnonzero(before == 0)
    number = np.empty(len(once), np.int64)
    number[same[once]] = np.arange(len(once))
    return number[same], once


def _spread(
    qid: np.ndarray, qs: np.ndarray, content: np.ndarray, tid: np.ndarray, ts: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What was found for contents ``i``, ascending, given to each of their rows: the first ``k`` under another id."""
    start, end = np.searchsorted(i, content), np.searchsorted(i, content, side="right")
    each = end - start
    row = np.repeat(np.arange(len(qs)), each)
    at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start, each)
    other = qid[qs[row]] != tid[ts[j[at]]]
    row, at = row[other], at[other]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, at = row[first], at[first]
    finite = np.isfinite(d[at])
    row, at = row[finite], at[finite]
    return qs[row], ts[j[at]], d[at]


def between(
    aid: np.ndarray, a: np.ndarray, far_a: np.ndarray, bid: np.ndarray, b: np.ndarray, far_b: np.ndarray, k: int, p: float
) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As :func:`nearest_others`, of ``a`` in ``b`` and of ``b`` in ``a`` at once, leaving out what is farther than a row's ``far``.

    Equal rows are looked at once on both sides; of those found the smallest ids are kept.
    """
    sides = []
    for ids, x, far in ((aid, a, far_a), (bid, b, far_b)):
        rows = np.flatnonzero(np.isfinite(x).all(axis=1))
        rows = rows[np.argsort(ids[rows], kind="stable")]
        if not len(rows):
            none = (rows, rows, np.zeros(0))
            return none, none
        content, once = _contents(x[rows])
        most = np.zeros(len(once))
        np.maximum.at(most, content, far[rows])
        sides.append((ids, rows, content, x[rows[once]], most))
    most = k + max(int(np.unique(ids[rows], return_counts=True)[1].max()) for ids, rows, *_ in sides)
    for (*_, x, far), (*_, y, _) in (sides, sides[::-1]):
        free = np.flatnonzero(~np.isfinite(far))
        if len(free) and len(y) >= most:  # no limit is known: it is found first, for no matrix of all pairs
            far[free] = nearest(x[free], y, most, p)[2][most - 1 :: most]
    found = within(sides[0][3], sides[1][3], sides[0][4], sides[1][4], most, p)
    out = []
    for (i, j, d), (qid, qs, content, *_), (tid, ts, same, *_) in zip(found, sides, sides[::-1], strict=True):
        order = np.argsort(same, kind="stable")
        count = np.bincount(same)
        start, each = (np.cumsum(count) - count)[j], np.minimum(count, most)[j]
        at = np.arange(each.sum()) + np.repeat(start - np.cumsum(each) + each, each)
        i, j, d = _first(np.repeat(i, each), order[at], np.repeat(d, each), most)
        out.append(_spread(qid, qs, content, tid, ts, i, j, d, k))
    return tuple(out)
