"""Best-fit packing of documents into sequences of a fixed capacity.

Pieces longer than a third of the capacity are matched in pairs: the longest
goes with the longest partner that still fits, which gives as many pairs as can
be had.  Shorter ones, longest first, go to the tightest gap that takes them; a
new sequence is opened only when none does.

Pieces of one length are interchangeable, so the plan is made from the counts
per length alone (at most ``capacity`` of them, however large the corpus) and
holds runs "ranks a to b of length n go to sequences from s on".  Spark counts,
ranks and assigns; the driver sees only the counts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.llm.base import stored
from foreshock.llm.text import rounds, to_batch

#: Words kept per Python worker; about 250 bytes each.  The ones before are looked up until there are as many again.
CACHED_WORDS = 400_000
#: Words encoded in one call; longer texts cost the tokenizer more a word.
WORDS_A_CALL = 100
#: Bytes of text whose distinct chunks are looked up at once.
LOOKED_UP = 4 << 20
#: What may follow a word's letters as one token of the splitting rule.
MARKS = ".,;:!?#*$%&|<>"
#: Pieces per block in which ranks are counted.
BLOCK_ROWS = 4000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _latin(chunk: str) -> bool:
    return chunk.isalpha() if chunk.isascii() else max(chunk) < "\u0250" and chunk.lower().isalpha()


class WordTokenizer:
    """Ids of whole texts from the ids of their space-separated chunks.

    Valid for tokenizers that never join text across a space or line feed, as
    those that drop white space before merging; each distinct chunk is encoded once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}  # the words known before the last clearing
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, chunks: list[str]) -> None:
        # A chunk of Latin letters is one word to the tokenizer: many are encoded in one call and cut at word ends.
        words = [c for c in chunks if _latin(c)]
        for at in range(0, len(words), WORDS_A_CALL):
            some = words[at : at + WORDS_A_CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                self.known.update(zip(some, (raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True))
        rest = [c for c in chunks if c not in self.known]
        done = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        self.known.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in done), strict=True))

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        found = list(map(self.known.get, chunks))
        new = [c for c, x in zip(chunks, found, strict=True) if x is None]
        if new:
            again = {c: x for c in new if (x := self.before.get(c)) is not None}
            self.known.update(again)
            # Letters and marks after them are two tokens of the splitting rule, so the parts are encoded alone.
            cut, single = [], {}
            for c in new:
                if c in again:
                    continue
                body = c.rstrip(MARKS)
                if 0 < len(body) < len(c) and _latin(body):
                    cut.append((c, body, c[len(body) :]))
                    single[body] = single[c[len(body) :]] = None
                else:
                    single[c] = None
            self._learn([c for c in single if c not in self.known])
            self.known.update((c, self.known[body] + self.known[marks]) for c, body, marks in cut)
            found = [self.known[c] if x is None else x for c, x in zip(chunks, found, strict=True)]
        if len(self.known) > CACHED_WORDS:
            self.known, self.before = {"": b""}, self.known
        return found

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit; null is empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # strings in one call, not one scalar each
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        chunk = coded.indices.to_numpy()
        times = size[chunk]
        end = np.cumsum(times)
        place = np.arange(end[-1] if len(end) else 0) + np.repeat(start[chunk] - end + times, times)
        raw = flat[place].tobytes()
        stops = (4 * np.append(0, end)[np.cumsum(split.value_lengths().to_numpy())]).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=False)]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then id 0; a null text is empty and gives the one
    id 0.  Only longer documents are cut.  Rows with a null doc_id stay rows.
    """
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
            + ([("ids", pa.binary())] if with_ids else [])
        )
        tok = _tokenizer(tokenizer_path)
        for b in rounds(batches, LOOKED_UP):
            rows: dict[str, list] = {f.name: [] for f in out}
            ids = tok.encode(b.column("text"))
            for doc, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                x += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(x), 4 * capacity)):
                    part = x[at : at + 4 * capacity]
                    for name, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        rows[name].append(v)
            yield to_batch(out, **rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset of the first) that pack ``counts`` pieces.

    The work and the number of runs depend on the number of distinct lengths only.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece is empty or longer than the capacity")
    bins: dict[int, list[tuple[int, tuple]]] = {}  # gap -> [(sequences, ((length, times), ...))]

    def put(gap: int, count: int, content: tuple) -> None:
        if count:
            bins.setdefault(gap, []).append((count, content))

    # Long pieces: at most two of them fit a sequence.
    long = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in long:
        while left[n]:
            fits = (m for m in long if m <= min(n, capacity - n) and left[m] > (m == n))
            m = next(fits, None)
            if m is None:
                put(capacity - n, left[n], ((n, 1),))
                left[n] = 0
            elif m == n:
                put(capacity - 2 * n, left[n] // 2, ((n, 2),))
                left[n] %= 2
            else:
                pairs = min(left[n], left[m])
                put(capacity - n - m, pairs, ((n, 1), (m, 1)))
                left[n] -= pairs
                left[m] -= pairs

    # Short ones: the tightest gap takes as many of one length as it can before the next gap is looked at.
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            gap = min((g for g, b in bins.items() if g >= n and b), default=None)
            if gap is None:
                count, content, gap = -(-todo // (capacity // n)), (), capacity
            else:
                count, content = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
            k = gap // n
            full = min(count, todo // k)
            put(gap - k * n, full, (*content, (n, k)))
            todo -= full * k
            if full < count:
                some = todo
                if some:
                    put(gap - some * n, 1, (*content, (n, some)))
                if content:
                    put(gap, count - full - (some > 0), content)
                todo = 0

    runs, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for _, groups in sorted(bins.items()):
        for count, content in groups:
            offset = 0
            for n, k in content:
                runs.append((n, rank[n], sequence, k, offset))
                rank[n] += k * count
                offset += n * k
            sequence += count
    return sorted(runs)


def assign(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """``items`` (with columns doc_id, piece, length and maybe more) with sequence_id and offset.

    Sequences are gapless from offset 0.  Repeated rows are packed as often as
    they occur; ties are ordered by (doc_id, piece, start); no rows give no
    sequences.  ``items`` is read three times and should be a stored table.
    """
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    key = (runs[:, 0] << 44) | runs[:, 1]
    blocks = max(1, -(-sum(counts.values()) // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")
    dealt = items.withColumn("_block", block)
    # A common length may hold a third of the rows: ranks are counted in blocks of it.
    before = dealt.groupBy(F.col("length").alias("_n"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy("_n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_n", "_b", F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "start"))
    ranked = (
        dealt.withColumn("_inside", inside)
        .join(before, (F.col("length") == F.col("_n")) & (F.col("_block") == F.col("_b")))
        .withColumn("_rank", F.col("_before") + F.col("_inside") - 1)
        .select(*items.columns, "_rank")
    )
    schema = items.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            r = runs[np.searchsorted(key, (n << 44) | rank, side="right") - 1]
            ahead = rank - r[:, 1]
            sequence, offset = r[:, 2] + ahead // r[:, 3], r[:, 4] + n * (ahead % r[:, 3])
            names = [c for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return assign(stored(pieces(docs, tokenizer_path, capacity, with_ids), "pieces"), capacity)
