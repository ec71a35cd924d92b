"""Quality by the vote of the nearest labelled documents in a latent-semantic space.

Byte n-gram counts, weighted by log frequency and rarity, and a few rates of
repetition are projected on the leading singular directions of a bounded
labelled sample.  The sample's vectors
go to every task; each round of documents is multiplied with all of them in one
block, and the most similar vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.llm.base import remainder
from foreshock.llm.ngrams import ngram_counts, unit_rows
from foreshock.llm.sampling import one_label, sample_labelled
from foreshock.llm.text import distinct_per_row, keep_rows, rounds, shingles, text_bytes, to_batch, words

DIMS = 2048
SIZES = (1, 2, 3)
#: Labelled documents of each label kept as voters: 2,400 x 48 numbers are broadcast at most.
VOTERS_PER_LABEL = 1200
RANK = 48
K = 15
THRESHOLD = 0.3


def features(column: pa.Array) -> np.ndarray:
    """Per text: n-gram counts, then shares of words that repeat the word before them, repeat an earlier word, or lie in repeated shingles."""
    buf, at = text_bytes(column)
    rows = len(at) - 1
    w = words(buf, at)
    n = np.maximum(np.bincount(w.row, minlength=rows), 1)
    again = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    row, h = shingles(w, rows)
    total = np.maximum(np.bincount(row, minlength=rows), 1)
    rates = [
        np.bincount(w.row[1:][again], minlength=rows) / n,
        1 - np.bincount(distinct_per_row(w.row, w.hash)[0], minlength=rows) / n,
        1 - np.bincount(distinct_per_row(row, h)[0], minlength=rows) / total,
    ]
    rates[1][n == 1], rates[2][total == 1] = 0, 0
    return np.concatenate([ngram_counts(column, DIMS, SIZES), np.stack(rates, 1).astype(np.float32)], 1)


@dataclass
class VoteModel:
    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return unit_rows(weighted(x, self.rarity) @ self.axes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the K nearest; the prior where nothing is similar."""
        x = self.project(x)
        near = x @ self.vectors.T
        k = min(K, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, top, 1), 0) ** 4
        total = w.sum(1)
        vote = (w * self.label[top]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, vote, self.prior), 0, 1)


def weighted(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """N-gram part scaled to length 1, beside the rates; all zero for empty texts."""
    return np.concatenate([unit_rows(np.log1p(x[:, :DIMS]) * rarity), x[:, DIMS:]], 1)


def fit(x: np.ndarray, label: np.ndarray, prior: float) -> VoteModel:
    """Latent axes of the sample by subspace iteration; the cost does not depend on the corpus."""
    seen = (x[:, :DIMS] > 0).sum(0)
    rarity = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
    x = weighted(x, rarity)
    axes = np.random.default_rng(5).standard_normal((x.shape[1], RANK + 8)).astype(np.float32)
    for _ in range(6):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    _, turn = np.linalg.eigh((x @ axes).T @ (x @ axes))
    axes = np.ascontiguousarray((axes @ turn)[:, ::-1][:, :RANK])
    return VoteModel(rarity, axes, unit_rows(x @ axes), label.astype(np.float32), prior)


def learn(docs: DataFrame, labels: DataFrame, voters: int = VOTERS_PER_LABEL) -> VoteModel | None:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality; one row per document); None without labelled rows."""
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    if share is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.binary())])
        for b in rounds(batches):
            yield to_batch(out, doc_id=b.column("doc_id"), quality=b.column("quality").cast(pa.int32()), x=[r.tobytes() for r in features(b.column("text"))])

    sample = sample_labelled(docs, labels, "quality", voters).mapInArrow(run, "doc_id long, quality int, x binary")
    got = sample.toPandas().sort_values("doc_id")  # the bounded sample
    if not len(got):
        return None
    return fit(np.stack([np.frombuffer(v, np.float32) for v in got["x"]]), got["quality"].to_numpy(), float(share))


def classify(docs: DataFrame, model: VoteModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text.

    A null or empty text has no direction and gets the share of label 1 in the
    labelled rows; so does every text, as 0.5, when nothing was learned.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
        for b in rounds(batches):
            score = np.full(b.num_rows, 0.5) if model is None else model.score(features(b.column("text"))).astype(float)
            yield to_batch(out, doc_id=b.column("doc_id"), score=score, predicted=(score >= threshold).astype(np.int32))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def learn_quality(docs: DataFrame, labels: DataFrame) -> VoteModel | None:
    """Learned only from rows whose id is not held out."""
    return learn(docs, one_label(labels.where(remainder("doc_id", 5) != 0), "quality"))


def classify_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    model = learn_quality(docs, labels)
    return classify(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: VoteModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows, with all columns, that :func:`classify` does not reject."""
    return docs if model is None else keep_rows(docs, lambda texts: model.score(features(texts)) >= threshold)
