"""Periodic runs of words, found on a Re-Pair grammar of the word ids.

A run is a stretch of words with smallest period q, at least 6 and at least 4 q
words long, that no neighbour extends.  The words of a text are numbered and
compressed by Re-Pair: the most frequent pair of neighbours becomes a new symbol
until no pair occurs twice; what is left is joined by a balanced tree.  Every run
crosses the boundary of the smallest symbol that holds all of it, so each symbol
is searched once, at its boundary: one side of the boundary then holds at least
two periods, which makes squares next to the boundary the only candidates.  The
runs found are moved to every place where the symbol is derived, and intervals of
one period that overlap by a period are merged.

Before that, words that no run can hold are put aside.  Every five words inside
a run occur again at the distance of its period, which is at most a quarter of
the stretch they lie in; stretches without such words are cut until nothing
changes.  The grammar is made of the stretches that are left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.llm.text import mix, rounds, text_bytes, to_batch, words

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
GRAM = 5
_TURN = mix(np.arange(101, 101 + GRAM, dtype=np.uint64)) | np.uint64(1)

Run = tuple[int, int, int]


def repair(ids: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules and the sequence left over: symbol ``max(ids) + 1 + k`` stands for the pair ``rules[k]``."""
    n = len(ids)
    symbol, after, before = [*ids, -1], list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        places.setdefault((symbol[i], symbol[i + 1]), []).append(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapify(heap)
    fresh, rules = max(ids, default=-1) + 1, []
    while heap:
        count, pair = heappop(heap)
        a, b = pair
        valid, blocked = [], -1
        for i in places[pair]:
            if symbol[i] == a and i != blocked and symbol[after[i]] == b:
                valid.append(i)
                blocked = after[i]
        # A pair of older symbols never gains places, so a smaller count is final until its turn comes.
        if len(valid) < -count:
            if len(valid) > 1:
                places[pair] = valid
                heappush(heap, (-len(valid), pair))
            continue
        for i in valid:
            gone = after[i]
            symbol[i], symbol[gone] = fresh, -2
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
        grown: dict[tuple[int, int], list[int]] = {}
        for i in valid:
            if before[i] >= 0 and symbol[before[i]] != fresh:
                grown.setdefault((symbol[before[i]], fresh), []).append(before[i])
            if after[i] < n:
                grown.setdefault((fresh, symbol[after[i]]), []).append(i)
        for new, at in grown.items():
            if len(at) > 1:
                places[new] = at
                heappush(heap, (-len(at), new))
        del places[pair]
        rules.append(pair)
        fresh += 1
    left, i = [], 0
    while i < n:
        left.append(symbol[i])
        i = after[i]
    return rules, left


class _Words:
    """Word ids of a stretch with the longest common extensions in both directions."""

    def __init__(self, ids: list[int]):
        self.ids, self.flat = ids, np.array(ids, np.int64)

    def ahead(self, i: int, j: int, end: int) -> int:
        """How many words from ``i`` equal those from ``j`` (i < j), at most up to ``end`` for j."""
        v, k, most = self.ids, 0, end - j
        while k < min(8, most):
            if v[i + k] != v[j + k]:
                return k
            k += 1
        step = 64
        while k < most:
            to = min(most, k + step)
            same = self.flat[i + k : i + to] == self.flat[j + k : j + to]
            if not same.all():
                return k + int(np.argmin(same))
            k, step = to, step * 2
        return k

    def back(self, i: int, j: int, begin: int) -> int:
        """How many words that end before ``i`` equal those that end before ``j`` (i < j), at most down to ``begin`` for i."""
        v, k, most = self.ids, 0, i - begin
        while k < min(8, most):
            if v[i - 1 - k] != v[j - 1 - k]:
                return k
            k += 1
        step = 64
        while k < most:
            to = min(most, k + step)
            same = self.flat[i - to : i - k] == self.flat[j - to : j - k]
            if not same.all():
                return k + int(np.argmin(same[::-1]))
            k, step = to, step * 2
        return k

    def again(self, at: int, low: int, high: int) -> list[int]:
        """Places in [low, high) with the word of ``at``, ascending."""
        if high - low < 48:
            w = self.ids[at]
            return [k for k in range(low, high) if self.ids[k] == w]
        return (np.flatnonzero(self.flat[low:high] == self.flat[at]) + low).tolist()


def crossing(v: _Words, begin: int, middle: int, end: int) -> list[Run]:
    """Runs (start, end, period) inside [begin, end) that hold the words before and after ``middle``."""
    size, found = end - begin, []
    if size < LEAST_LENGTH:
        return found
    most = size // LEAST_EXPONENT

    def take(start: int, stop: int, q: int) -> None:
        if stop - start >= max(LEAST_LENGTH, LEAST_EXPONENT * q) and start < middle < stop and (start, stop, q) not in found:
            found.append((start, stop, q))

    beyond = 0  # periods up to here are multiples of one already seen
    for k in v.again(middle, middle + 1, middle + min(most, (end - middle) // 2) + 1):
        q = k - middle
        if q > beyond and v.ahead(middle, k, k + q) == q:
            stop = k + v.ahead(middle, k, end)
            take(middle - v.back(middle, k, begin), stop, q)
            beyond = (stop - middle) // 2
    beyond = 0
    for k in reversed(v.again(middle - 1, middle - 1 - min(most, (middle - begin) // 2), middle - 1)):
        q = middle - 1 - k
        if q > beyond and v.back(middle - q, middle, middle - 2 * q) == q:
            start = middle - q - v.back(middle - q, middle, begin)
            take(start, middle + v.ahead(middle - q, middle, end), q)
            beyond = (middle - start) // 2
    return found


def grammar_runs(ids: list[int]) -> list[Run]:
    """All runs (start, length, period) of a sequence, by start and period."""
    if len(ids) < LEAST_LENGTH:
        return []
    rules, level = repair(ids)
    first_rule = max(ids) + 1
    while len(level) > 1:  # a balanced tree over what Re-Pair left
        pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
        names = list(range(first_rule + len(rules), first_rule + len(rules) + len(pairs)))
        rules, level = [*rules, *pairs], [*names, *level[2 * len(pairs) :]]
    length = [1] * first_rule
    for a, b in rules:
        length.append(length[a] + length[b])
    derived: list[list[int]] = [[] for _ in length]
    derived[level[0]].append(0)
    for k in range(len(rules) - 1, -1, -1):
        a, b = rules[k]
        at = derived[first_rule + k]
        derived[a].extend(at)
        derived[b].extend([p + length[a] for p in at])
    v, by_period = _Words(ids), {}
    for k, (a, _) in enumerate(rules):
        at = derived[first_rule + k]
        here = at[0]
        for start, stop, q in crossing(v, here, here + length[a], here + length[first_rule + k]):
            by_period.setdefault(q, []).extend((p + start - here, p + stop - here) for p in at)
    out = []
    for q, spans in by_period.items():
        spans.sort()
        start, stop = spans[0]
        for a, b in spans[1:]:
            if a + q <= stop:
                stop = max(stop, b)
            else:
                out.append((start, stop - start, q))
                start, stop = a, b
        out.append((start, stop - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the parts of the sequences [begin, end) of word hashes outside which no run can lie."""
    while True:
        wide = end - begin >= LEAST_LENGTH
        begin, end = begin[wide], end[wide]
        if not len(begin):
            return begin, end
        size = end - begin
        who = np.repeat(np.arange(len(begin)), size - GRAM + 1)
        head = np.cumsum(size - GRAM + 1) - (size - GRAM + 1)
        at = np.arange(len(who)) - head[who] + begin[who]
        gram = who.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(GRAM):
            gram += h[at + k] * _TURN[k]
        order = np.argsort(gram, kind="stable")
        same = (gram[order[1:]] == gram[order[:-1]]) & (LEAST_EXPONENT * (at[order[1:]] - at[order[:-1]]) <= size[who[order[1:]]])
        near = np.zeros(len(at), bool)
        near[order[1:][same]] = True
        near[order[:-1][same]] = True
        # Words covered by a kept string of five, each stretch with a gap after it.
        shift = begin - (np.cumsum(size + 1) - (size + 1))
        edge = np.zeros(int((size + 1).sum()) + 1, np.int64)
        place = (at - shift[who])[near]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + GRAM, -1)
        covered = np.cumsum(edge) > 0
        flip = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
        first, last = flip[::2], flip[1::2]
        owner = np.searchsorted(np.cumsum(size + 1), first, side="right")
        new_begin, new_end = first + shift[owner], last + shift[owner]
        if len(new_begin) == len(begin) and (new_begin == begin).all() and (new_end == end).all():
            return begin, end
        begin, end = new_begin, new_end


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text whose id asks for a periodic tail, else None; no id counts as empty text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


_RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed of every row of ``docs`` (doc_id, text).

    ``collapsed`` joins by a space the words that no run holds after its first
    period.  Words are runs of bytes that are no ASCII white space; a null, empty
    or blank text has none.  With ``plant`` the texts chosen by :func:`planted`
    get their periodic tail first.  Repeated rows are repeated in the result.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rounds(batches):
            buf, at = text_bytes(b.column("text"))
            w = words(buf, at, lower=False)
            cut = np.searchsorted(w.row, np.arange(b.num_rows + 1))
            ids, h, moved = b.column("doc_id").to_pylist(), w.hash, {}
            if plant:
                for i, doc_id in enumerate(ids):
                    if (place := planted(doc_id, int(cut[i + 1] - cut[i]))) is not None:
                        moved[i] = place.tolist()
                        h[cut[i] : cut[i + 1]] = h[cut[i] : cut[i + 1]][place]
            parts: dict[int, list[tuple[int, int]]] = {}
            begin, end = stretches(h, cut[:-1], cut[1:])
            for i, s, e in zip((np.searchsorted(cut, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
                parts.setdefault(i, []).append((s - int(cut[i]), e - int(cut[i])))
            runs, texts = [], []
            for i in range(b.num_rows):
                own = buf[at[i] : at[i + 1]].tobytes().split()
                if i in moved:
                    own = [own[k] for k in moved[i]]
                found = []
                for s, e in parts.get(i, ()):
                    names: dict[bytes, int] = {}
                    numbered = [names.setdefault(x, len(names)) for x in own[s:e]]
                    found += [(s + start, length, q) for start, length, q in grammar_runs(numbered)]
                if found:
                    drop = np.zeros(len(own), bool)
                    for start, length, q in found:
                        drop[start + q : start + length] = True
                    own = [own[k] for k in np.flatnonzero(~drop)]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(own).decode())
            yield to_batch(out, doc_id=ids, n_words=np.diff(cut), runs=runs, collapsed=texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def digests(docs: DataFrame) -> DataFrame:
    """The planted texts' runs as digests, with the run of the greatest length per period (ties: smallest start, then period)."""
    found = periodic_runs(docs, plant=True)
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    with_best = found.withColumn("best", F.aggregate("runs", none, better))
    return with_best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
