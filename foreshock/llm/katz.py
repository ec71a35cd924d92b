"""Scores of texts under a bigram model with Katz backoff.

Counts of one to five are discounted by Good and Turing's estimate; what that
sets free for a history goes to the words not seen after it, in proportion to
their own probabilities, by a weight that makes the sum exactly one.  One more
event is any unknown word.

Words and bigrams are 64-bit hashes in tables in parts by hash; nothing that
grows with the vocabulary goes to all tasks.  The model is made by three
exchanges between the parts of both tables: bigrams ask for the counts of their
second words, send what was seen after their first words there, and get the
first words' backoff back.  A bigram's entry then is

    log P(w | h) - log(weight of h) - log P(w)

and a word's entry log P(w) + log(weight of w as a history), so a text's score
is the sum of its words' and its bigrams' entries, each looked up where its part
is; a bigram that was not seen adds nothing.  The end of a text is also the
history of the next one's first word.

With a shortlist, words outside it are one class in the bigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.llm.base import discard, remainder, stored, stored_by
from foreshock.llm.exchange import pack_ids, unpack_ids
from foreshock.llm.text import mix, rounds, text_bytes, to_batch, words

#: Counts up to this are discounted.
DISCOUNTED = 5
END_HASH = np.uint64(0x5DEECE66D1234567)
#: Class of the words outside a shortlist.
RARE_HASH = np.uint64(0x3C6EF372FE94F82B)
#: Bytes of text in one round, bytes of text per part of the tables, and distinct keys a task holds before it passes them on.
ROUND = 4 << 20
PART_BYTES = 16 << 20
HELD_KEYS = 1_000_000
#: Parts in which bigrams are counted, for each part of the tables: with both words they are wide.
FINER = 4
#: Bigrams are looked up by these bits of their hash besides their part, whose number grows with the data.
LOW = np.uint64((1 << 48) - 1)
#: Texts are scored in so many passes, so that the keys of one pass alone are on the disks.
PASSES = 3
WORDS, PAIRS, ABOUT, HISTORY, SECONDS = 0, 1, 2, 3, 4


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all words and the end of every text, in order."""
    buf, at = text_bytes(column)
    rows = len(at) - 1
    w = words(buf, at)
    row, h = np.empty(len(w.row) + rows, np.int64), np.empty(len(w.row) + rows, np.uint64)
    place = np.arange(len(w.row)) + w.row
    row[place], h[place] = w.row, w.hash
    ends = np.cumsum(np.bincount(w.row, minlength=rows) + 1) - 1
    row[ends], h[ends] = np.arange(rows), END_HASH
    return row, h


def discounts(counted: dict[int, int]) -> np.ndarray:
    """Share of a count r that is kept, for r from 0 to DISCOUNTED; absolute discounting where Good-Turing's estimate is none."""
    n = [0, *(counted.get(r, 0) for r in range(1, DISCOUNTED + 2))]
    keep = np.ones(DISCOUNTED + 1)
    if n[1] and all(n[1:]):
        tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        d = np.array([((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if tail != 1 else 0 for r in range(1, DISCOUNTED + 1)])
        if ((d > 0) & (d < 1)).all():
            keep[1:] = d
            return keep
    less = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    less = min(0.9, max(0.1, less))
    keep[1:] = [(r - less) / r for r in range(1, DISCOUNTED + 1)]
    return keep


def discounted(count: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return count * keep[np.where(count <= DISCOUNTED, count, 0)]


@dataclass
class KatzModel:
    """Stored tables and what all tasks know."""

    tables: DataFrame  # part, kind, origin, source, keys, before, counts, entries
    parts: int
    total: int  # tokens
    distinct: int  # different tokens
    keep_words: np.ndarray
    unknown: float  # probability of the unknown word
    scale_words: float
    names: np.ndarray | None = None  # hashes of a shortlist, ascending
    rare: float = 0.0  # probability of the words outside it
    rare_weight: float = 0.0  # logarithm of their backoff weight
    keep_pairs: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}  # tasks get the numbers; tables are joined

    def classes(self, h: np.ndarray) -> np.ndarray:
        if self.names is None:
            return h
        if not len(self.names):
            return np.full(len(h), RARE_HASH)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        return np.where(self.names[at] == h, h, RARE_HASH)

    def word_chance(self, count: np.ndarray) -> np.ndarray:
        """Probability of words by count, by the unigram model."""
        return np.where(count > 0, self.scale_words * discounted(count, self.keep_words) / max(1, self.total), self.unknown)


def _pairs(model: KatzModel, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and of tokens in order."""
    now = model.classes(h)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    before[first] = END_HASH
    return before, now


def _pair_hash(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(mix(before) + now)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together and compressed: they are few or zero in most ranks."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _flat(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _ascending(x: np.ndarray) -> bytes:
    return _planes(np.diff(x.astype("<u8"), prepend=np.uint64(0)))


def _climbed(data: bytes) -> np.ndarray:
    return np.cumsum(_flat(data, "<u8"), dtype=np.uint64)


def _listed(x: np.ndarray) -> bytes:
    """Different values once, ascending, and where each entry is among them: few bytes where words come again."""
    names, index = np.unique(x, return_inverse=True)
    front = _ascending(names)
    return np.int64(len(front)).tobytes() + front + _planes(index.astype("<u4"))


def _unlisted(data: bytes) -> np.ndarray:
    n = 8 + int(np.frombuffer(data[:8], "<i8")[0])
    return _climbed(data[8:n])[_flat(data[n:], "<u4")]


def _joined(blocks: Iterator[bytes], read) -> np.ndarray:
    return np.concatenate([read(b) for b in blocks])


def _at(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the ascending ``names``, and whether it is there."""
    if not len(names):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return at, names[at] == keys


def _deal(key: np.ndarray, parts: int, mask: np.uint64 | None = None) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the keys by (part, key, or its bits in ``mask``), and (part, from, to)."""
    part = (mix(key) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.lexsort((key if mask is None else key & mask, part))
    part = part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    return order, [(int(part[a]), a, b) for a, b in zip([0, *cut], [*cut, len(part)], strict=True) if b > a]


def _word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """Words in ``docs`` with their counts, one block per part, and how many occur 1, 2, ... times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def pool() -> None:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, index = np.unique(keys, return_inverse=True)
            held[:] = [(keys, np.bincount(index, counts).astype(np.int64))]

        def rows() -> pa.RecordBatch:
            pool()
            keys, counts = held.pop()
            order, cuts = _deal(keys, parts)
            keys, counts = keys[order].astype("<u8"), counts[order].astype("<u4")
            return to_batch(out, part=[p for p, _, _ in cuts], keys=[keys[a:b].tobytes() for _, a, b in cuts], counts=[counts[a:b].tobytes() for _, a, b in cuts])

        for b in rounds(batches, ROUND, 4000):
            held.append(np.unique(tokens(b.column("text"))[1], return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_KEYS:
                pool()
                if len(held[0][0]) > HELD_KEYS // 2:
                    yield rows()
        if held:
            yield rows()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys, index = np.unique(np.frombuffer(b"".join(rows["keys"]), "<u8"), return_inverse=True)
        counts = np.bincount(index, np.frombuffer(b"".join(rows["counts"]), "<u4")).astype("<i8")
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "total": [int(counts.sum())], "distinct": [len(keys)], "often": [_how_often(counts)]})

    made = docs.select("text").mapInArrow(count, "part int, keys binary, counts binary")
    return made.groupBy("part").applyInPandas(add, "part int, keys binary, counts binary, total long, distinct long, often array<long>")


def _how_often(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3).tolist()


def _pair_counts(docs: DataFrame, model: KatzModel) -> DataFrame:
    """Bigrams in ``docs`` with their counts, one block per part, and how many occur 1, 2, ... times."""
    parts = model.parts * FINER

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("part", pa.int32()), ("before", pa.binary()), ("now", pa.binary()), ("counts", pa.binary())])
        held: list[tuple[np.ndarray, ...]] = []

        def pool() -> None:
            key, before, now, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            key, first, index = np.unique(key, return_index=True, return_inverse=True)
            held[:] = [(key, before[first], now[first], np.bincount(index, counts).astype(np.int64))]

        def rows() -> pa.RecordBatch:
            pool()
            key, before, now, counts = held.pop()
            order, cuts = _deal(key, parts)
            columns: dict[str, list] = {f.name: [] for f in out}
            for p, a, b in cuts:
                block = order[a:b]
                for name, v in zip(columns, (p, *_pair_block(before[block], now[block], counts[block])), strict=True):
                    columns[name].append(v)
            return to_batch(out, **columns)

        for b in rounds(batches, ROUND, 4000):
            before, now = _pairs(model, *tokens(b.column("text")))
            key, first, counts = np.unique(_pair_hash(before, now), return_index=True, return_counts=True)
            held.append((key, before[first], now[first], counts))
            if sum(len(x[0]) for x in held) > HELD_KEYS:
                pool()
                if len(held[0][0]) > HELD_KEYS // 2:
                    yield rows()
        if held:
            yield rows()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        before, now = _joined(rows["before"], _climbed), _joined(rows["now"], _unlisted)
        _, first, index = np.unique(_pair_hash(before, now), return_index=True, return_inverse=True)
        counts = np.bincount(index, _joined(rows["counts"], lambda x: _flat(x, "<u8"))).astype(np.int64)
        before, now, packed = _pair_block(before[first], now[first], counts)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "before": [before], "now": [now], "counts": [packed], "often": [_how_often(counts)]})

    made = docs.select("text").mapInArrow(count, "part int, before binary, now binary, counts binary")
    return made.groupBy("part").applyInPandas(add, "part int, before binary, now binary, counts binary, often array<long>")


def _pair_block(before: np.ndarray, now: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    order = np.lexsort((now, before))
    return _ascending(before[order]), _listed(now[order]), _planes(counts[order].astype("<u8"))


def _often(table: DataFrame) -> dict[int, int]:
    sums = table.agg(*[F.sum(F.col("often")[r]).alias(str(r)) for r in range(1, DISCOUNTED + 2)]).first()
    return {r: sums[str(r)] or 0 for r in range(1, DISCOUNTED + 2)}


def fit(docs: DataFrame, shortlist: int | None = None) -> KatzModel:
    """Model of the texts of ``docs``; a null text is empty and has only its end.

    Without rows every token is unknown.
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    table = stored(_word_counts(docs, parts), "word-counts")
    total, distinct = table.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    keep = discounts(_often(table))
    kept = table.mapInArrow(_kept(keep), "x double").agg(F.sum("x")).first()[0] or 0.0
    # What the discounts leave is the unknown word's; at least as much as one more token would have.
    spare = 1 - kept / total if total else 1.0
    unknown = max(spare, 1 / (total + distinct + 1))
    scale = (1 - unknown) * total / kept if kept else 0.0
    words_ = table.select("part", "keys", "counts")
    model = KatzModel(words_, parts, total, distinct, keep, unknown, scale)
    if shortlist is not None:
        model.names, count = _shortlist(table, shortlist)
        model.rare = max(1 - float(model.word_chance(count).sum()), unknown)

    pairs = stored(_pair_counts(docs, model), "pair-counts")
    model.keep_pairs = discounts(_often(pairs))
    seen = stored_by(_followers(pairs, words_, model), "pair-chances", "kind", [HISTORY, SECONDS])
    weighed = stored(_weighed(seen[HISTORY], words_, model), "word-entries")
    discard(seen[HISTORY])
    discard(table)
    if shortlist is not None:
        model.rare_weight = weighed.agg(F.max("rare_weight")).first()[0] or 0.0
    model.tables = _tables(pairs, seen[SECONDS], weighed)
    return model


def _shortlist(table: DataFrame, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the most frequent words; those as frequent as one that has no room are left out too."""
    least = _least_count(table, shortlist)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("h", pa.int64()), ("c", pa.int64())])
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                h, c = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8")
                yield to_batch(out, h=h[c >= least].view(np.int64), c=c[c >= least])

    top = table.select("keys", "counts").mapInArrow(leading, "h long, c long").toPandas()  # at most the shortlist's size in all
    names = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], top["c"].to_numpy(np.int64)[order]


def _least_count(table: DataFrame, shortlist: int) -> int:
    """Smallest count that at most ``shortlist`` words reach; the different counts are as few as the root of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for counts in b.column("counts").to_pylist():
                c, n = np.unique(np.frombuffer(counts, "<i8"), return_counts=True)
                yield to_batch(pa.schema([("c", pa.int64()), ("n", pa.int64())]), c=c, n=n)

    sizes = table.select("counts").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas().sort_values("c", ascending=False)
    fits = sizes["c"][sizes["n"].cumsum() <= shortlist]
    return int(fits.min()) if len(fits) else np.iinfo(np.int64).max


def _kept(keep: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for counts in b.column("counts").to_pylist():
                yield to_batch(pa.schema([("x", pa.float64())]), x=[float(discounted(np.frombuffer(counts, "<i8"), keep).sum())])

    return run


def _followers(pairs: DataFrame, words_: DataFrame, model: KatzModel) -> DataFrame:
    """Rows HISTORY, dealt like words: what each part of the bigrams holds after its histories; rows SECONDS: the counts of the bigrams' second words."""
    parts = model.parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("part", pa.int32()), ("origin", pa.int32()), ("keys", pa.binary())])
        for b in batches:
            for origin, now in zip(b.column("part").to_pylist(), b.column("now").to_pylist(), strict=True):
                now = np.unique(_unlisted(now))
                order, cuts = _deal(now, parts)
                now = now[order]
                yield to_batch(out, part=[p for p, _, _ in cuts], origin=[origin] * len(cuts), keys=[_ascending(now[i:j]) for _, i, j in cuts])

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names, counts = (np.frombuffer(b"".join(known[c]), kind) for c, kind in (("keys", "<u8"), ("counts", "<i8")))  # one block
        found = []
        for origin, keys in zip(asked["origin"], asked["keys"], strict=True):
            at, there = _at(names, k := _climbed(keys))
            found.append((origin, keys, _planes(np.where(there, counts[at] if len(counts) else 0, 0).astype("<u8"))))
        return pd.DataFrame(found, columns=["origin", "keys", "counts"])

    def see(told: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        name, count = _joined(told["keys"], _climbed), _joined(told["counts"], lambda x: _flat(x, "<u8")).astype(np.int64)
        order = np.argsort(name)
        name, count = name[order], count[order]
        pair = mine.iloc[0]
        before, now, c = _climbed(pair["before"]), _unlisted(pair["now"]), _flat(pair["counts"], "<u8").astype(np.int64)
        count = count[_at(name, now)[0]]
        chance = _second_chance(now, count, model)
        less = discounted(c, model.keep_pairs)
        h, index = np.unique(before, return_inverse=True)
        sums = [np.bincount(index, x) for x in (c, less, chance)]
        order, cuts = _deal(h, parts)
        found = [(p, int(pair["part"]), HISTORY, _ascending(h[order[i:j]]), *(_planes(x[order[i:j]]) for x in sums)) for p, i, j in cuts]
        found.append((int(pair["part"]), 0, SECONDS, b"", _planes(count.astype("<u8")), b"", b""))
        return pd.DataFrame(found, columns=["part", "origin", "kind", "keys", "total", "seen", "covered"])

    asked = pairs.select("part", "now").mapInArrow(ask, "part int, origin int, keys binary")
    told = asked.groupBy("part").cogroup(words_.groupBy("part")).applyInPandas(answer, "origin int, keys binary, counts binary")
    schema = "part int, origin int, kind int, keys binary, total binary, seen binary, covered binary"
    return told.groupBy("origin").cogroup(pairs.drop("often").groupBy("part")).applyInPandas(see, schema)


def _weighed(histories: DataFrame, words_: DataFrame, model: KatzModel) -> DataFrame:
    """Rows WORDS with the words' entries, and rows HISTORY for the parts of the bigrams: what a history adds to their entries.

    Rows HISTORY are without keys: the bigrams' part knows which it asked of ``source`` for, in order.
    """

    def weigh(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("origin")  # sums in the same order whenever a task is run again
        keys = [_climbed(k) for k in asked["keys"]]
        h, index = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
        total, seen, covered = (np.bincount(index, np.concatenate([np.zeros(0), *(_flat(x, "<f8") for x in asked[c])]), len(h)) for c in ("total", "seen", "covered"))
        share = seen / np.maximum(1, total)
        # The unknown word follows no history in training; a class of rare words may.
        free = np.maximum(1 - covered, model.unknown if model.names is None else 0)
        full = free < (0 if model.names is None else 1e-9)
        # A history that was followed by everything keeps its whole mass; one without discounts gives up as much as one more token.
        scale = np.where(full, 1 / share, np.minimum(1.0, total / (total + 1) / share))
        weight = np.where(full, 1.0, (1 - scale * share) / np.where(full, 1, free))  # of a full history, nothing asks for it
        added, weight = np.log10(scale / total) - np.log10(weight), np.log10(weight)
        found = [(int(o), int(p), HISTORY, b"", b"", _planes(added[_at(h, x)[0]]), None) for o, p, x in zip(asked["origin"], asked["part"], keys, strict=True)]
        if len(known):
            name, count = np.frombuffer(known["keys"].iloc[0], "<u8"), np.frombuffer(known["counts"].iloc[0], "<i8")
            at, there = _at(h, name)
            entry = np.log10(model.word_chance(count)) + (np.where(there, weight[at], 0) if len(h) else 0)
            found.append((int(known["part"].iloc[0]), 0, WORDS, _ascending(name), _planes(count), _planes(entry), None))
        rare, there = _at(h, np.array([RARE_HASH]))
        if there[0]:
            found.append((0, 0, ABOUT, b"", b"", b"", float(weight[rare[0]])))
        return pd.DataFrame(found, columns=["part", "source", "kind", "keys", "counts", "entries", "rare_weight"]).astype({"rare_weight": "float64"})

    schema = "part int, source int, kind int, keys binary, counts binary, entries binary, rare_weight double"
    return histories.select("part", "origin", "keys", "total", "seen", "covered").groupBy("part").cogroup(words_.groupBy("part")).applyInPandas(weigh, schema)


def _second_chance(now: np.ndarray, count: np.ndarray, model: KatzModel) -> np.ndarray:
    """Probability of second words, with their counts, by the unigram model."""
    return np.where(now == RARE_HASH, model.rare, model.word_chance(count))


def _tables(pairs: DataFrame, seconds: DataFrame, weighed: DataFrame) -> DataFrame:
    """What scores are looked up in, by parts of the words: the words' entries, and of every block of bigrams all that makes its entries."""
    words_, histories = (weighed.where(F.col("kind") == kind) for kind in (WORDS, HISTORY))
    block = (F.col("part") / FINER).cast("int").alias("part")
    nothing, here = F.lit(None).cast("binary"), F.lit(0).alias("source")
    return (
        words_.select("part", "kind", F.lit(0).alias("origin"), "source", "keys", nothing.alias("before"), "counts", "entries")
        .unionByName(pairs.select(block, F.lit(PAIRS).alias("kind"), F.col("part").alias("origin"), here, F.col("now").alias("keys"), "before", "counts", nothing.alias("entries")))
        .unionByName(seconds.select(block, F.lit(SECONDS).alias("kind"), F.col("part").alias("origin"), here, nothing.alias("keys"), nothing.alias("before"), F.col("total").alias("counts"), nothing.alias("entries")))
        .unionByName(histories.select(block, "kind", F.col("part").alias("origin"), "source", nothing.alias("keys"), nothing.alias("before"), nothing.alias("counts"), "entries"))
    )


def _pair_entries(block: pd.DataFrame, model: KatzModel) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and entries of a block of bigrams: from their counts, those of their second words and what their histories add."""
    pair, second, history = (block[block["kind"] == kind] for kind in (PAIRS, SECONDS, HISTORY))
    before, now = _climbed(pair["before"].iloc[0]), _unlisted(pair["keys"].iloc[0])
    c, count = (_flat(x["counts"].iloc[0], "<u8").astype(np.int64) for x in (pair, second))
    first = np.ones(len(before), bool)
    first[1:] = before[1:] != before[:-1]
    order, _ = _deal(before[first], model.parts)
    added = np.empty(len(order))
    added[order] = _joined(history.sort_values("source")["entries"], lambda x: _flat(x, "<f8"))
    return _pair_hash(before, now), np.log10(discounted(c, model.keep_pairs) / _second_chance(now, count, model)) + added[np.cumsum(first) - 1]


_ENTRY = "part int, kind int, batch long, keys binary, times binary, rows binary, ids binary, n_tokens array<long>, base array<double>, score array<double>"
_SUMS = "batch long, part int, kind int, base binary, known binary, score binary, ids binary, n_tokens array<long>"


def score(docs: DataFrame, model: KatzModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``docs`` (doc_id, text).

    ``base_score`` is the add-one unigram model's.  A null or empty text has its
    end as the only token.  Repeated rows are scored alike.
    """
    floor = np.log10(model.total + model.distinct + 1)
    parts = model.parts

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        out = pa.schema(
            [("part", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("times", pa.binary()), ("rows", pa.binary()), ("ids", pa.binary()), ("n_tokens", longs), ("base", doubles), ("score", doubles)]
        )
        batch = TaskContext.get().partitionId() << 32
        for b in rounds(batches, ROUND, 4000):
            rows = b.num_rows
            row, h = tokens(b.column("text"))
            before, now = _pairs(model, row, h)
            n = np.bincount(row, minlength=rows)
            columns: dict[str, list] = {f.name: [] for f in out}

            def put(part, kind, keys=None, times=None, at=None, ids=None, size=None, base=None, score=None, columns=columns):
                for name, v in zip(columns, (part, kind, batch, keys, times, at, ids, size, base, score), strict=True):
                    columns[name].append(v)

            for kind, key, mask in ((WORDS, h, None), (PAIRS, _pair_hash(before, now), LOW)):
                order, cuts = _deal(key, parts, mask)
                key, who = key[order] if mask is None else key[order] & mask, row[order].astype("<u2")
                for p, a, z in cuts:
                    keys, times = np.unique(key[a:z], return_counts=True)
                    put(p, kind, _ascending(keys), _planes(times.astype("<u4")), _planes(who[a:z]))
            rare = np.bincount(row[(now == RARE_HASH) & (h != END_HASH)], minlength=rows)
            put(batch % parts, ABOUT, ids=pack_ids(b.column("doc_id").to_pylist()), size=n.tolist(), base=(-n * floor).tolist(), score=(rare * model.rare_weight).tolist())
            yield to_batch(out, **columns)
            batch += 1

    def sums(entries: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        found = []
        table = {}
        mine = tables[tables["kind"] == WORDS]
        reads = {"keys": _climbed, "counts": lambda x: _flat(x, "<i8"), "entries": lambda x: _flat(x, "<f8")}
        table[WORDS] = tuple(_joined(mine[c], read) if len(mine) else np.zeros(0) for c, read in reads.items())  # one block
        made = [(np.zeros(0, np.uint64), np.zeros(0)), *(_pair_entries(block, model) for _, block in tables[tables["kind"] != WORDS].groupby("origin"))]
        names, values = (np.concatenate(x) for x in zip(*made, strict=True))
        del tables, mine, made
        names = names & LOW
        order = np.argsort(names)
        table[PAIRS] = names[order], np.zeros(0, np.int64), values[order]
        del names, values, order
        for e in entries.itertuples():
            if e.kind == ABOUT:
                base = np.asarray(e.base, np.float64)
                found.append((e.batch, e.part, e.kind, base.tobytes(), b"", np.asarray(e.score, np.float64).tobytes(), e.ids, e.n_tokens))
                continue
            names, counts, values = table[e.kind]
            at, there = _at(names, _climbed(e.keys))
            value = np.where(there, values[at], np.log10(model.unknown) if e.kind == WORDS else 0) if len(names) else np.full(len(at), np.log10(model.unknown) if e.kind == WORDS else 0.0)
            times, row = _flat(e.times, "<u4"), _flat(e.rows, "<u2")
            base = known = b""
            if e.kind == WORDS:
                count = np.where(there, counts[at], 0) if len(names) else np.zeros(len(at), np.int64)
                base, known = (np.bincount(row, np.repeat(x, times)) for x in (np.log10(count + 1.0), count > 0))
                base, known = base.tobytes(), known.astype(np.int64).tobytes()
            found.append((e.batch, e.part, e.kind, base, known, np.bincount(row, np.repeat(value, times)).tobytes(), None, None))
        return pd.DataFrame(found, columns=["batch", "part", "kind", "base", "known", "score", "ids", "n_tokens"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "part"])  # sums in the same order whenever a task is run again
        about = rows[rows["kind"] == ABOUT].iloc[0]
        n = len(about["n_tokens"])
        out = {}
        for name, kind in (("base", np.float64), ("known", np.int64), ("score", np.float64)):
            out[name] = np.zeros(n, kind)
            for x in rows[name]:
                x = np.frombuffer(x, kind)
                out[name][: len(x)] += x
        return pd.DataFrame({"doc_id": unpack_ids(about["ids"]), "n_tokens": about["n_tokens"], "n_known": out["known"], "base_score": out["base"], "score": out["score"]})

    found = []
    for k in range(PASSES):
        mine = docs.where(F.pmod(F.xxhash64(F.substring("text", 1, 64), F.length("text"), "doc_id"), F.lit(PASSES)) == k)
        entries = mine.select("doc_id", "text").mapInArrow(look_up, _ENTRY)
        summed = entries.groupBy("part").cogroup(model.tables.groupBy("part")).applyInPandas(sums, _SUMS)
        found.append(stored(summed.groupBy("batch").applyInPandas(add, "doc_id long, n_tokens long, n_known long, base_score double, score double"), "scores"))
    return reduce(DataFrame.unionByName, found)


def score_held_out(docs: DataFrame, shortlist: int | None = None) -> DataFrame:
    """Learned from six sevenths of the documents and applied to all."""
    held_out = remainder("doc_id", 7) == 2
    model = fit(docs.where(~held_out).select("text"), shortlist)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
