"""Removal of every byte covered by a string of fixed length that starts anywhere else too.

Suffixes are compared on their first ``length`` bytes.  They need not all be sorted:

1.  In every window of ``length`` bytes one anchor is chosen by content alone, so
    equal windows have equal anchors.  A suffix whose anchor string occurs once
    in the corpus cannot repeat; only anchors that occur again go on.
2.  Windows around one anchor are alike in all copies of a passage, except at
    its ends.  Stretches of windows that are equal as a whole repeat; chains
    of neighbouring ones are told apart first, so that a passage found in many
    documents is looked at once from there on.  The others
    are cut into blocks of starts, at fixed distances before the anchor: a block
    repeats if it is equal to another as a whole, and none of its suffixes does
    if the bytes common to all of them occur once.  The suffixes of what is left,
    with one of each kind of the equal blocks, are sorted.
3.  Each task sorts its suffixes into runs and writes them front-coded (length of
    the prefix shared with the one before, and the rest).  Runs are exchanged by
    ranges of the hash of anchor and block; where one such pair has more suffixes
    than a task should merge, they go to several parts by a hash of their own
    bytes.  Runs are merged by a loser tree that keeps, for each run's
    head, how much it shares with the last suffix put out: heads with different
    shares are told apart without looking at a byte, others from there on.
    Neighbours that share everything repeat.

Equal suffixes within a run are one entry, so a passage found everywhere
reaches the merge once per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.llm.base import stored
from foreshock.llm.text import BASE, BYTE_VALUE, grown, mix, powers, rounds, text_bytes, to_batch

#: Bytes of the string that an anchor is.
ANCHOR = 40
#: Windows looked at in one round of array operations; a longer text is several rounds.
ROUND = 1 << 18
#: Runs of stretches in a chain, on average.
CHAIN = 4
#: Suffix starts of a block.
BLOCK = 16
#: Suffixes sorted into one run, and suffixes of all runs merged by one task.
RUN_ROWS = 40_000
MERGE_ROWS = 100_000
KEY_BYTES = 8

_INVERSE = pow(int(BASE), -1, 1 << 64)
_inverses = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        step = np.full(grown(n), np.uint64(_INVERSE), np.uint64)
        step[0] = 1
        _inverses = np.multiply.accumulate(step)
    return _inverses


def _sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of every ``m`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - m + 1
    padded = np.full(-(-len(x) // m) * m, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[m - 1 : m - 1 + n])


def anchors(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows - 1, distance to the anchor, anchor hash, content hash) for each stretch of windows with one anchor.

    ``buf`` holds texts end to end from the places ``at``.
    """
    m = length - ANCHOR + 1
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    ends = np.repeat(at[1:], size)
    out: list[tuple[np.ndarray, ...]] = []
    a = 0
    while a + length <= len(buf):
        b = min(len(buf), a + ROUND + length - 1)
        part = buf[a:b]
        value = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * powers(len(part))[: len(part)], out=value[1:])
        undo = _inverse_powers(len(part) + 1)
        spot = mix((value[ANCHOR:] - value[:-ANCHOR]) * undo[: len(part) - ANCHOR + 1])
        places = np.arange(len(spot), dtype=np.uint64)
        least = _sliding_min((spot & ~np.uint64(0xFFFFFF)) | places, m) & np.uint64(0xFFFFFF)
        first = np.arange(len(least)) + a
        text = owner[a : a + len(least)]
        inside = first + length <= ends[a : a + len(least)]
        first, text, least = first[inside], text[inside], least[inside].astype(np.int64)
        if len(first):
            new = np.ones(len(first), bool)
            new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(first)) - 1
            lo, hi = first[head] - a, first[tail] - a + length
            content = (value[hi] - value[lo]) * undo[lo]
            content = mix(content + (least[head] - lo).astype(np.uint64) + ((hi - lo).astype(np.uint64) << np.uint64(20)))
            out.append((text[head], first[head] - at[text[head]], tail - head, least[head] - lo, spot[least[head]], content))
        a += ROUND
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("tie", pa.int32()), ("at", pa.int32()), ("more", pa.int32()), ("lead", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64())])
        for b in rounds(batches):
            text, at, more, lead, anchor, content = anchors(*text_bytes(b.column("text")), length)
            pick = pa.array(text)
            yield to_batch(out, doc_id=b.column("doc_id").take(pick), tie=b.column("tie").take(pick), at=at, more=more, lead=lead, anchor=_signed(anchor), content=_signed(content))

    return docs.mapInArrow(run, "doc_id long, tie int, at int, more int, lead int, anchor long, content long")


def blocks(buf: np.ndarray, at: np.ndarray, more: np.ndarray, lead: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(stretch, block, first start, starts - 1, hash of the common bytes, hash of all bytes) of each block of the stretches.

    ``at`` are places in ``buf``; a block holds the starts BLOCK * b to
    BLOCK * b + BLOCK - 1 before the anchor, as far as the stretch has them.
    """
    value = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * powers(len(buf))[: len(buf)], out=value[1:])
    undo = _inverse_powers(len(buf) + 1)
    low, high = (lead - more) // BLOCK, lead // BLOCK
    count = high - low + 1
    row = np.repeat(np.arange(len(at)), count)
    b = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
    anchor = (at + lead)[row]
    latest = anchor - BLOCK * b
    p0, p1 = np.maximum(at[row], latest - BLOCK + 1), np.minimum((at + more)[row], latest)
    core = mix((value[latest + length - BLOCK + 1] - value[latest]) * undo[latest] + b.astype(np.uint64))
    span = ((anchor - p0) * BLOCK + (p1 - p0)).astype(np.uint64)
    content = mix((value[p1 + length] - value[p0]) * undo[p0] + span)
    return row, b, p0, p1 - p0, core, content


def _blocks(windows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema(
            [("doc_id", pa.int64()), ("tie", pa.int32()), ("at", pa.int32()), ("more", pa.int32()), ("anchor", pa.int64()), ("block", pa.int32()), ("core", pa.int64()), ("content", pa.int64()), ("n", pa.int64())]
        )
        for b in rounds(batches):
            buf, places = text_bytes(b.column("text"))
            doc = pc.list_parent_indices(b.column("windows")).to_numpy()
            w = b.column("windows").flatten()
            at, more, lead = (w.field(c).to_numpy().astype(np.int64) for c in ("at", "more", "lead"))
            row, block, first, rest, core, content = blocks(buf, at + places[doc], more, lead, length)
            pick = pa.array(doc[row])
            yield to_batch(
                out,
                doc_id=b.column("doc_id").take(pick),
                tie=b.column("tie").take(pick),
                at=first - places[doc[row]],
                more=rest,
                anchor=w.field("anchor").take(pa.array(row)),
                block=block,
                core=_signed(core),
                content=_signed(content),
                n=w.field("n").take(pa.array(row)),
            )

    return windows.mapInArrow(run, "doc_id long, tie int, at int, more int, anchor long, block int, core long, content long, n long")


class SuffixRun:
    """Sorted suffixes of one task, each after its anchor's hash; equal ones are one entry."""

    def __init__(self, length: int):
        self.width = KEY_BYTES + length
        self.length = length
        self.rows: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.spread: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int, raw: bytes, at: int, more: int, anchor: int, known: bool, spread: int = 1) -> None:
        """Suffixes that start at ``at`` to ``at + more``; those of a known window only stand for others, and ``spread`` is how many parts take this anchor's."""
        part = np.frombuffer(raw, np.uint8, more + self.length, at)
        rows = np.empty((more + 1, self.width), np.uint8)
        rows[:, :KEY_BYTES] = np.frombuffer((anchor & (1 << 64) - 1).to_bytes(8, "big"), np.uint8)
        rows[:, KEY_BYTES:] = np.lib.stride_tricks.sliding_window_view(part, self.length)
        owner = np.empty((more + 1, 2), np.int64)
        owner[:, 0], owner[:, 1] = (-1 if known else doc), np.arange(at, at + more + 1)
        self.rows.append(rows)
        self.owner.append(owner)
        self.spread.append(np.full(more + 1, spread, np.int64))
        self.size += more + 1

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entries, shared prefix with the entry before, owner of each entry or -1, owners that repeat within the run, how many parts take an entry's anchor)."""
        rows, owner = np.concatenate(self.rows), np.concatenate(self.owner)
        order = np.argsort(rows.view(f"S{self.width}").ravel(), kind="stable")
        rows, owner = rows[order], owner[order]
        share = np.zeros(len(rows), np.int64)
        differs = rows[1:] != rows[:-1]
        share[1:] = np.where(differs.any(1), differs.argmax(1), self.width)
        new = share < self.width
        group = np.cumsum(new) - 1
        count = np.bincount(group)
        unowned = np.bincount(group, owner[:, 0] < 0) > 0
        repeats = owner[((count > 1) | unowned)[group] & (owner[:, 0] >= 0)]
        keep = owner[new].copy()
        keep[(count > 1) | unowned, 0] = -1
        return rows[new], share[new], keep, repeats, np.concatenate(self.spread)[order][new]


def part_of(rows: np.ndarray, spread: np.ndarray, parts: int) -> np.ndarray:
    """Part of each entry: by range of its anchor's hash, and from there on, for an anchor that takes several, by a hash of all its bytes."""
    part = rows[:, :4].copy().view(">u4").ravel().astype(np.int64) * parts >> 32
    many = np.flatnonzero(spread > 1)
    if len(many):
        h = mix((BYTE_VALUE[rows[many]] * powers(rows.shape[1])[: rows.shape[1]]).sum(1, dtype=np.uint64))
        part[many] = (part[many] + (h % spread[many].astype(np.uint64)).astype(np.int64)) % parts
    return part


def shares_within(rows: np.ndarray) -> np.ndarray:
    """Prefix each of the sorted, different entries shares with the one before."""
    share = np.zeros(len(rows), np.int64)
    share[1:] = (rows[1:] != rows[:-1]).argmax(1)
    return share


def front_code(rows: np.ndarray, share: np.ndarray) -> tuple[bytes, bytes]:
    """Shared prefix lengths and the remaining bytes, end to end."""
    share = share.copy()
    share[0] = 0
    rest = np.arange(rows.shape[1]) >= share[:, None]
    return share.astype(np.uint8).tobytes(), rows[rest].tobytes()


def merge_runs(runs: list[tuple[bytes, bytes]], width: int) -> Iterator[tuple[int, int, int]]:
    """(run, entry, prefix shared with the entry put out before) in sorted order.

    A loser tree over the runs' heads.  Each loser keeps the prefix it shares
    with the winner that passed it, which is the last entry put out, so a replay
    compares bytes only between heads that share equally much with it.
    """
    n = len(runs)
    if not n:
        return
    size = 1 << (n - 1).bit_length()
    shares = [r[0] for r in runs]
    rests = [r[1] for r in runs]
    place, entry = [0] * n, [-1] * n
    head: list[bytes | None] = [b""] * n + [None] * (size - n)
    known = [0] * size  # prefix shared with the last entry put out

    def advance(r: int) -> None:
        e = entry[r] + 1
        entry[r] = e
        if e >= len(shares[r]):
            head[r] = None
            return
        k = shares[r][e]
        to = place[r] + width - k
        head[r] = head[r][:k] + rests[r][place[r] : to]
        place[r], known[r] = to, k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes that with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        k = ka
        while k < width and x[k : k + 16] == y[k : k + 16]:
            k += 16
        if k < width:
            stop = min(width, k + 16)
            while k < stop and x[k] == y[k]:
                k += 1
        k = min(k, width)
        if k == width:
            a, b = (a, b) if a < b else (b, a)
        elif x[k] > y[k]:
            a, b = b, a
        known[b] = k
        return a, b

    for r in range(n):
        advance(r)
        known[r] = 0
    loser = [-1] * size
    level = list(range(size))
    base = size
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[base + i // 2] = lost
            up.append(w)
        level = up
    w = level[0]
    while head[w] is not None:
        yield w, entry[w], known[w]
        advance(w)
        node = (w + size) // 2
        while node:
            w, loser[node] = play(w, loser[node])
            node //= 2


def _intervals(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, last) of runs of neighbouring suffix starts."""
    if not len(owner):
        return owner[:, 0], owner[:, 1], owner[:, 1]
    owner = owner[np.lexsort((owner[:, 1], owner[:, 0]))]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:, 0] != owner[:-1, 0]) | (owner[1:, 1] > owner[:-1, 1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(owner)) - 1
    return owner[head, 0], owner[head, 1], owner[tail, 1]


_RUN_SCHEMA = "part int, share binary, rest binary, owner binary, start binary, doc_ids array<long>, ties array<int>"
_SPAN_SCHEMA = "doc_id long, tie int, first long, last long"


def _runs(windows: DataFrame, length: int, parts: int) -> DataFrame:
    """Front-coded runs by range of the anchor; rows without ``share`` carry suffixes that repeat within their run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema(
            [("part", pa.int32()), ("share", pa.binary()), ("rest", pa.binary()), ("owner", pa.binary()), ("start", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ties", pa.list_(pa.int32()))]
        )

        pack = zstandard.ZstdCompressor(level=1)

        def rows(current: SuffixRun, ids: list[int], ties: list[int]) -> pa.RecordBatch:
            entries, share, owner, repeats, spread = current.close()
            part = part_of(entries, spread, parts)
            columns: dict[str, list] = {f.name: [] for f in out}

            def put(p: int, s: bytes | None, rest: bytes | None, own: np.ndarray) -> None:
                index = np.full(len(own), -1, "<i4")
                docs, index[own[:, 0] >= 0] = np.unique(own[own[:, 0] >= 0, 0], return_inverse=True)
                # Suffixes of one window overlap, which the codec of the shuffle does not see over its short blocks.
                packed = [x if x is None else pack.compress(x) for x in (s, rest, index.tobytes(), own[:, 1].astype("<i8").tobytes())]
                row = (p, *packed, [ids[d] for d in docs], [ties[d] for d in docs])
                for name, v in zip(columns, row, strict=True):
                    columns[name].append(v)

            whole = bool((spread == 1).all())  # neighbours then stay neighbours
            order = np.argsort(part, kind="stable")
            for p in np.unique(part):
                own = order[slice(*np.searchsorted(part[order], [p, p + 1]))]
                put(int(p), *front_code(entries[own], share[own] if whole else shares_within(entries[own])), owner[own])
            if len(repeats):  # no other run has to meet them; the first part of all runs would be the same
                put(int(mix(np.array([ids[0] & (1 << 63) - 1, repeats[0, 1]], np.uint64)).sum() % np.uint64(parts)), None, None, repeats)
            return to_batch(out, **columns)

        current, ids, ties = SuffixRun(length), [], []
        for b in rounds(batches, rows=100):
            for doc_id, tie, text, wins in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "text", "windows")), strict=True):
                raw = text.encode()
                ids.append(doc_id)
                ties.append(tie)
                for w in wins:
                    current.add(len(ids) - 1, raw, w["at"], w["more"], w["anchor"], w["known"], w["spread"])
                    if current.size >= RUN_ROWS:
                        yield rows(current, ids, ties)
                        current, ids, ties = SuffixRun(length), [doc_id], [tie]
        if current.size:
            yield rows(current, ids, ties)

    return windows.select("doc_id", "tie", "text", "windows").mapInArrow(run, _RUN_SCHEMA)


def _merge(runs: DataFrame, length: int) -> DataFrame:
    """Suffix starts that repeat, as runs of neighbours: doc_id, tie, first, last."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        coded = rows["share"].notna().to_numpy()
        owners = []
        docs: dict[tuple, int] = {}
        names: list[tuple] = []
        for own, start, ids, ties in zip(rows["owner"], rows["start"], rows["doc_ids"], rows["ties"], strict=True):
            local = []
            for pair in zip(ids.tolist(), ties.tolist(), strict=True):
                if pair not in docs:
                    docs[pair] = len(names)
                    names.append(pair)
                local.append(docs[pair])
            # Index -1, an entry that only stands for others, reads the last place.
            owners.append((np.array([*local, -1], np.int64)[np.frombuffer(unpack(own), "<i4")], np.frombuffer(unpack(start), "<i8")))
        found = [np.stack(o, 1) for o, c in zip(owners, coded, strict=True) if not c]
        index = np.flatnonzero(coded)
        runs = [(unpack(rows["share"].iloc[i]), unpack(rows["rest"].iloc[i])) for i in index]
        width = KEY_BYTES + length
        pairs, before = [], (0, 0)
        for r, e, k in merge_runs(runs, width):
            if k == width:
                pairs.append(before)
                pairs.append((r, e))
            before = (r, e)
        for r, e in set(pairs):
            o, s = owners[index[r]]
            found.append(np.array([[o[e], s[e]]]))
        own = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        doc, first, last = _intervals(own[own[:, 0] >= 0])
        return pd.DataFrame({"doc_id": [names[d][0] for d in doc], "tie": [names[d][1] for d in doc], "first": first, "last": last}).astype({"doc_id": "int64", "tie": "int32", "first": "int64", "last": "int64"})

    return runs.groupBy("part").applyInPandas(merge, _SPAN_SCHEMA)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with an id and a tie, which tell rows of different ids or texts apart (equal rows may share what is found), and the text.

    The two are 80 bits of independent hashes of the id, whether there is one, and
    the whole text; so no two rows that differ are taken for one, also of those
    without an id.
    """
    text = F.coalesce("text", F.lit(""))
    key = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), text]
    return docs.withColumns({"_repeats_id": F.xxhash64(*key), "_repeats_tie": F.pmod(F.hash(*key), F.lit(1 << 16)), "_repeats_text": text})


def _with_texts(keyed: DataFrame, found: DataFrame, *fields: str) -> DataFrame:
    """doc_id, tie, text and an array ``windows`` of the fields of ``found``, which has its place in ``w``; bounded by the text's length."""
    inside = found.select("w.doc_id", "w.tie", *[F.col(c if c in found.columns else f"w.{c}").alias(c) for c in fields])
    per_doc = inside.groupBy(F.col("doc_id").alias("_repeats_d"), F.col("tie").alias("_repeats_t")).agg(F.collect_list(F.struct(*fields)).alias("windows"))
    joined = keyed.join(per_doc, (F.col("_repeats_id") == F.col("_repeats_d")) & (F.col("_repeats_tie") == F.col("_repeats_t")))
    return joined.select(F.col("_repeats_id").alias("doc_id"), F.col("_repeats_tie").alias("tie"), F.col("_repeats_text").alias("text"), "windows")


def _unlike_chains(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places of the chains that repeat as a whole, stretches of one chain of each kind with the windows of their run and how often they occur).

    A run is equal stretches one after the other, as in a line written many times.
    A chain is neighbouring runs of a document up to the next that content alone,
    or a gap, makes the first of another; so a passage found in many documents has
    equal chains in all of them, except at its ends.
    """
    order = Window.partitionBy("doc_id", "tie").orderBy("at")
    window = ["more", "lead", "anchor", "content"]

    def numbered(rows: DataFrame, first: Column, name: str) -> DataFrame:
        rows = rows.withColumn("_first", F.coalesce(first, F.lit(True)).cast("int"))
        return rows.withColumn(name, F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def gap(more: str) -> Column:
        return F.lag(F.col("at") + F.col(more) + 1).over(order) != F.col("at")

    once = mixed.repartition("doc_id", "tie").groupBy("doc_id", "tie", "at", *window).agg(F.count(F.lit(1)).alias("n"))  # equal rows share a place
    runs = numbered(once, gap("more") | (F.lag(F.struct(*window)).over(order) != F.struct(*window)), "run")
    whole = (F.max("at") - F.min("at") + F.col("more")).alias("whole")
    runs = runs.groupBy("doc_id", "tie", "run", *window).agg(F.min("at").alias("at"), whole, F.max("n").alias("n"), F.count(F.lit(1)).alias("times"))
    chains = numbered(runs, gap("whole") | (F.pmod("content", F.lit(CHAIN)) == 0), "chain")
    more = (F.max(F.col("at") + F.col("whole")) - F.min("at")).alias("all")
    chains = chains.groupBy("doc_id", "tie", "chain").agg(F.min("at").alias("at"), more, F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "whole", "times", *window))).alias("runs"))
    alike = F.transform("runs", lambda r: F.struct(*[r[c] for c in ("times", *window)]))
    chains = stored(chains.select("doc_id", "tie", "at", "all", "n", "runs", F.xxhash64(alike).alias("name"), F.hash(alike).alias("check")), "chains")
    place = F.min(F.struct("doc_id", "tie", "at", "runs")).alias("w")
    kinds = stored(chains.groupBy("name", "check").agg(F.sum("n").alias("n"), place), "chain-kinds")
    twice = kinds.where("n >= 2").select(F.col("name").alias("_n"), F.col("check").alias("_c"))
    copied = chains.join(twice, (F.col("name") == F.col("_n")) & (F.col("check") == F.col("_c")), "left_semi").select("doc_id", "tie", "at", F.col("all").alias("more"))
    single = kinds.select("w.doc_id", "w.tie", "n", F.explode("w.runs").alias("r"))
    return copied, stored(single.select("doc_id", "tie", *[f"r.{c}" for c in ("at", "whole", *window)], (F.col("n") * F.col("r.times")).alias("n")), "unlike-stretches")


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, tie and spans (array of start, end in bytes, not yet united) of the documents that hold repeated strings."""
    keyed = _keyed(docs)
    texts = keyed.select(F.col("_repeats_id").alias("doc_id"), F.col("_repeats_tie").alias("tie"), F.col("_repeats_text").alias("text"))
    stretches = _stretches(texts.where(F.octet_length("text") >= length), length)
    again = stretches.groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    again = stored(again.where("n >= 2").select("_anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    hit = stored(stretches.join(again, F.col("anchor") == F.col("_anchor")).drop("_anchor"), "stretches")

    copied, mixed = _unlike_chains(hit.where("mixed"))
    place = F.min(F.struct("doc_id", "tie", "at", "more", "lead")).alias("w")
    kinds = stored(mixed.groupBy("anchor", "content").agg(F.sum("n").alias("n"), place), "kinds")
    whole = kinds.where("n >= 2").select(F.col("anchor").alias("_a"), F.col("content").alias("_c"))
    equal = mixed.join(whole, (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")), "left_semi")
    equal = hit.where("not mixed").select("doc_id", "tie", "at", "more").unionByName(copied).unionByName(equal.select("doc_id", "tie", "at", F.col("whole").alias("more")))

    blocks_ = stored(_blocks(_with_texts(keyed, kinds, "at", "more", "lead", "anchor", "n"), length), "blocks")
    place = F.min(F.struct("doc_id", "tie", "at", "more")).alias("w")
    unlike = blocks_.groupBy("anchor", "block", "content").agg(F.sum("n").alias("n"), F.min("core").alias("core"), place)
    unlike = stored(unlike, "unlike-blocks")
    twice = unlike.where("n >= 2").select(F.col("anchor").alias("_a"), F.col("block").alias("_b"), F.col("content").alias("_c"))
    same = (F.col("anchor") == F.col("_a")) & (F.col("block") == F.col("_b")) & (F.col("content") == F.col("_c"))
    equal = equal.unionByName(blocks_.where("n = 1").join(twice, same, "left_semi").select("doc_id", "tie", "at", "more"))

    # Blocks with the same common bytes that differ at an end: only there single suffixes have to be compared.
    ends = unlike.groupBy(F.col("anchor").alias("_a"), F.col("block").alias("_b"), F.col("core").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    same = (F.col("anchor") == F.col("_a")) & (F.col("block") == F.col("_b")) & (F.col("core") == F.col("_c"))
    rest = unlike.join(ends, same, "left_semi").select(F.xxhash64("anchor", "block").alias("anchor"), "w", (F.col("n") >= 2).alias("known"))
    rest = stored(rest, "single-suffixes")
    total = rest.agg(F.sum(F.col("w.more") + 1)).first()[0] or 0
    parts = max(1, -(-total // MERGE_ROWS))
    many = rest.groupBy(F.col("anchor").alias("_a")).agg(F.sum(F.col("w.more") + 1).alias("_n")).where(F.col("_n") > MERGE_ROWS)
    many = stored(many.select("_a", F.least(F.ceil(F.col("_n") / MERGE_ROWS), F.lit(parts)).cast("int").alias("_spread")), "large-anchors")
    rest = rest.join(many, F.col("anchor") == F.col("_a"), "left").select("anchor", "w", "known", F.coalesce("_spread", F.lit(1)).alias("spread"))
    ends = _merge(_runs(_with_texts(keyed, rest, "at", "more", "anchor", "known", "spread"), length, parts), length)

    spans = equal.select("doc_id", "tie", F.struct(F.col("at").alias("start"), (F.col("at") + F.col("more") + length).alias("end")).alias("span"))
    spans = spans.unionByName(ends.select("doc_id", "tie", F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end")).alias("span")))
    return spans.groupBy("doc_id", "tie").agg(F.collect_set("span").alias("spans"))  # distinct, so bounded by the text's length however often the row is repeated


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = 200, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_removed, n_spans and kept (binary: the remaining bytes), which replace columns so named.

    ``as_text`` gives ``kept`` as a string, without the bytes of characters that were cut.

    A null text is empty and keeps nothing; texts under ``length`` bytes stay
    whole.  Repeated rows repeat each other's text and lose all of it that is
    covered.  An empty table stays empty.  Cuts may fall inside a character.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    spans = repeated_spans(docs, length).select(F.col("doc_id").alias("_repeats_d"), F.col("tie").alias("_repeats_t"), F.col("spans").alias("_repeats_spans"))
    joined = _keyed(docs).join(spans, (F.col("_repeats_id") == F.col("_repeats_d")) & (F.col("_repeats_tie") == F.col("_repeats_t")), "left").drop("_repeats_d", "_repeats_t", "_repeats_id", "_repeats_tie", "_repeats_text")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rounds(batches):
            sizes, removed, counts, kept = [], [], [], []
            for t, s in zip(b.column("text").to_pylist(), b.column("_repeats_spans").to_pylist(), strict=True):
                raw = (t or "").encode()
                cut = unite([(x["start"], x["end"]) for x in s]) if s else []
                edges = [0, *(e for x in cut for e in x), len(raw)]
                sizes.append(len(raw))
                left = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                kept.append(left.decode(errors="ignore") if as_text else left)
                removed.append(len(raw) - len(left))
                counts.append(len(cut))
            new = [pa.array(x, pa.int64()) for x in (sizes, removed, counts)] + [pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new], [*columns, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary")
    return joined.mapInArrow(run, schema)
