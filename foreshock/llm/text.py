"""Arrow batches of texts as byte arrays, and 64-bit hashes of words and shingles over a whole batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled by one round of array operations; a longer single text is a round of its own.
ROUND_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def grown(n: int) -> int:
    """Size of a table that is asked for ``n`` entries; few sizes, little waste."""
    return max(1024, n if n < 1 << 18 else -(-n // (1 << 18)) * (1 << 18))


def powers(n: int) -> np.ndarray:
    """BASE ** 0, 1, ... modulo 2 ** 64, at least ``n`` of them."""
    global _powers
    if len(_powers) < n:
        step = np.full(grown(n), BASE, np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers


def rounds(batches: Iterator[pa.RecordBatch], limit: int = ROUND_BYTES, rows: int = 1000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``limit`` bytes of ``column`` and at most ``rows`` rows; never an empty slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(total, base + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and where each starts (one more for the end); null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch in order: row of the text, hash, first byte and length."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray


def words(buf: np.ndarray, at: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes that are no ASCII white space; they never cross texts."""
    empty = np.zeros(0, np.int64)
    if not len(buf):
        return Words(empty, empty.astype(np.uint64), empty, empty)
    if lower:
        buf = LOWER[buf]
    solid = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[at[:-1]] = True  # a text starts here; the place after the last byte is no byte
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    start = np.flatnonzero(begin)
    if not len(start):
        return Words(empty, empty.astype(np.uint64), empty, empty)
    length = np.add.reduceat(solid.view(np.uint8), start, dtype=np.int64)
    body = buf[solid]
    head = np.cumsum(length) - length
    place = np.arange(len(body)) - np.repeat(head, length)
    value = BYTE_VALUE[body] * powers(int(length.max()))[place]
    h = mix(np.add.reduceat(value, head))
    row = np.searchsorted(at, start, side="right") - 1
    return Words(row, h, start, length)


_TURN = powers(16)[1:].copy()


def shingles(w: Words, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a text with fewer words has one run of all its words."""
    n = len(w.row)
    count = np.bincount(w.row, minlength=rows)
    if n >= size:
        full = w.row[: n - size + 1] == w.row[size - 1 :]
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h += w.hash[k : n - size + 1 + k] * _TURN[k]
        row, h = w.row[: n - size + 1][full], mix(h[full])
    else:
        row, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        head = np.cumsum(count) - count
        extra = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = count[few] > k
            extra[has] += w.hash[head[few][has] + k] * _TURN[k]
        extra = mix(extra + count[few].astype(np.uint64))
        row, h = np.concatenate([row, few]), np.concatenate([h, extra])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def distinct_per_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), ascending."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def to_batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type, from_pandas=False) for f in schema], schema=schema
    )


def keep_rows(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, with all their columns, for whose texts ``decide`` says yes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rounds(batches):
            yield b.filter(pa.array(decide(b.column("text")), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
