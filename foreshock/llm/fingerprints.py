"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the top bits choose its bin, the rest competes for
the bin's minimum.  Empty bins copy a bin found by a fixed sequence of random
probes (optimal densification), the same for all documents.  Only the low bits
of each minimum are stored; the share of equal bins is corrected for the matches
that chance gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.llm.text import mix, rounds, shingles, text_bytes, to_batch, words

BINS = 256
BITS = 8
#: Documents per block of neighbouring ids.
BLOCK_ROWS = 5000
LEAST = -(1 << 63)


def fingerprints(column: pa.Array, bins: int = BINS) -> np.ndarray:
    """Low byte of every bin's minimum (rows x bins); rows without words have a first column of -1."""
    buf, at = text_bytes(column)
    rows = len(at) - 1
    row, h = shingles(words(buf, at), rows)
    width = np.uint64(64 - (bins.bit_length() - 1))
    top = np.iinfo(np.uint64).max
    least = np.full(rows * bins, top, np.uint64)
    np.minimum.at(least, row * bins + (h >> width).astype(np.int64), h & ((np.uint64(1) << width) - np.uint64(1)))
    least = least.reshape(rows, bins)
    filled = least != top
    some = filled.any(1)
    r, c = np.nonzero(~filled & some[:, None])
    out = (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.int16)
    probe = 0
    while len(r):
        probe += 1
        source = (mix(c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(probe)) % np.uint64(bins)).astype(np.int64)
        hit = filled[r, source]
        out[r[hit], c[hit]] = out[r[hit], source[hit]]
        r, c = r[~hit], c[~hit]
    out[~some] = 0
    out[~some, 0] = -1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of fingerprints, row by row; texts without words are like each other only."""
    chance = 0.5**BITS
    share = (a == b).mean(1)
    blank = (a[:, 0] < 0).astype(int) + (b[:, 0] < 0)
    return np.where(blank == 2, 1.0, np.where(blank == 1, 0.0, np.clip((share - chance) / (1 - chance), 0, 1)))


def as_text(f: np.ndarray) -> list[str]:
    """Packed bytes as hex; empty for texts without words."""
    return ["" if r[0] < 0 else r.astype(np.uint8).tobytes().hex() for r in f]


def _blocks(docs: DataFrame) -> np.ndarray:
    """First id of each block of about BLOCK_ROWS neighbouring ids: a number per block, from the id column alone."""
    ids = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"))
    n = max(1, -(-ids.count() // BLOCK_ROWS))
    heads = ids.repartitionByRange(n, "doc_id").select(F.spark_partition_id().alias("p"), "doc_id").groupBy("p").agg(F.min("doc_id").alias("h"))
    return np.array(sorted({r["h"] for r in heads.collect()}), np.int64)


def with_next(docs: DataFrame) -> DataFrame:
    """Every text once in a block of neighbouring ids, and the first text of a block once more at the end of the block before.

    Columns doc_id, text, code (fingerprint, two bytes per bin), block, extra.
    The last block ends with the very first document.
    """
    heads = _blocks(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("code", pa.binary()), ("block", pa.int64()), ("extra", pa.bool_())])
        for b in rounds(batches):
            ids = b.column("doc_id").fill_null(LEAST).to_numpy(zero_copy_only=False)
            block = np.searchsorted(heads, ids, side="right") - 1
            head = np.flatnonzero(heads[block] == ids)
            take = np.concatenate([np.arange(len(ids)), head])
            code = pa.array([f.astype("<i2").tobytes() for f in fingerprints(b.column("text"))], pa.binary())
            yield to_batch(
                out,
                doc_id=b.column("doc_id").take(pa.array(take)),
                text=b.column("text").take(pa.array(take)),
                code=code.take(pa.array(take)),
                block=np.concatenate([block, (block[head] - 1) % max(1, len(heads))]),
                extra=take != np.concatenate([take[: len(ids)], np.full(len(head), -1)]),
            )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, text string, code binary, block long, extra boolean")


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next by (doc_id, text); after the last comes the
    first, so a single document follows itself.  Null ids come first, null texts
    are empty.  Repeated rows follow each other.  Other columns are not read.
    """
    dealt = with_next(docs).repartition("block").sortWithinPartitions("block", "extra", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema(
            [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
        )
        before = None
        for b in rounds(batches):
            pairs = []
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "code", "block", "extra")), strict=True):
                if before is not None and before[3] == row[3] and not before[4]:
                    pairs.append((before, row))
                before = row
            if not pairs:
                continue
            edited = [edit(a[1], n[1]) for a, n in pairs]
            own, following = (np.stack([np.frombuffer(x[k][2], "<i2") for x in pairs]) for k in (0, 1))
            other = fingerprints(pa.array(edited, pa.string()))
            yield to_batch(
                out,
                doc_id=[a[0] for a, _ in pairs],
                n_chars=[len(a[1]) for a, _ in pairs],
                edited_sha256=[hashlib.sha256(e.encode()).hexdigest() for e in edited],
                fingerprint=as_text(own),
                edited_fingerprint=as_text(other),
                near_edited=likeness(own, other),
                near_next=likeness(own, following),
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
