"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, on byte n-grams,
tells the two halves of the languages apart.  A text goes to the codeword with
the least loss over the bits, each bit weighted by how well its classifier
knows that language; a small lead over the second codeword is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.llm.base import remainder
from foreshock.llm.ngrams import LETTERS, ngram_counts, unit_rows
from foreshock.llm.sampling import sample_rows
from foreshock.llm.text import rounds, to_batch

DIMS = 2048
SIZES = (2, 3)
#: The classifiers are fitted on about this many documents in all, at most.
SAMPLE_ROWS = 2400
ROUNDS = 80
#: Up to this many languages every split into two halves is a bit; beyond, random splits.
EXHAUSTIVE = 6
UNDECIDED = "und"


def features(column: pa.Array) -> np.ndarray:
    return unit_rows(np.sqrt(ngram_counts(column, DIMS, SIZES, LETTERS)))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """``k`` codewords of +1 and -1, all different, no constant bit."""
    if k < 2:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        bits = [[1, *(1 if j >> i & 1 else -1 for i in range(k - 1))] for j in range(2 ** (k - 1) - 1)]
        return np.array(bits, float).T
    rng = np.random.default_rng(seed)
    width = int(np.ceil(15 * np.log2(k)))
    while True:
        code = rng.choice([-1.0, 1.0], (k, width))
        if len(np.unique(code, axis=0)) == k and (abs(code.sum(0)) < k).all():
            return code


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    coefficients: np.ndarray
    intercept: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss (rows x languages) of every codeword."""
        margin = x @ self.coefficients + self.intercept
        return np.stack([np.logaddexp(0, -margin * c) @ w for c, w in zip(self.code, self.weight, strict=True)], 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score, and the lead over the second."""
        # The loss is a mean over the bits, so the sum stands for independent bits.
        loss = self.losses(x) * self.code.shape[1]
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return loss.argmin(1), top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def fit(x: np.ndarray, y: list[str]) -> CodeModel:
    """Logistic classifiers of all bits at once, by accelerated gradient steps on rows of length 1."""
    languages = sorted(set(y))
    code = codewords(len(languages))
    x, target = np.ascontiguousarray(x, np.float32), code[np.searchsorted(languages, y)].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, step, ridge = w.copy(), b.copy(), np.float32(2), np.float32(1e-5)
    for i in range(ROUNDS):
        g = -target / (1 + np.exp(target * (x @ vw + vb))) / np.float32(len(x))
        nw, nb = vw - step * (x.T @ g + ridge * vw), vb - step * g.sum(0)
        m = np.float32(i / (i + 3))
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    right = (np.sign(x @ w + b) == target).astype(float)
    index = np.searchsorted(languages, y)
    weight = np.stack([right[index == i].mean(0) for i in range(len(languages))])
    weight = np.maximum(weight, 1e-3)
    return CodeModel(languages, code, weight / weight.sum(1, keepdims=True), w, b)


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> CodeModel | None:
    """Model from ``docs`` (doc_id, text, lang): a bounded sample, spread evenly over the languages; None without any."""
    sample = sample_rows(docs.where(F.col("text").isNotNull()), "lang", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])
        for b in rounds(batches):
            yield to_batch(out, doc_id=b.column("doc_id"), lang=b.column("lang"), x=[r.tobytes() for r in features(b.column("text"))])

    got = sample.mapInArrow(run, "doc_id long, lang string, x binary").toPandas().sort_values("doc_id")  # the bounded sample
    if not len(got):
        return None
    return fit(np.stack([np.frombuffer(v, np.float32) for v in got["x"]]), got["lang"].tolist())


def identify(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned.  Equal losses go to the first language in order.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
        for b in rounds(batches):
            lettered = np.array([any(map(str.isalpha, t or "")) for t in b.column("text").to_pylist()])
            if model is None:
                index, score, lead = np.zeros(len(lettered), int), np.zeros(len(lettered)), np.zeros(len(lettered))
                names = [UNDECIDED]
            else:
                index, score, lead = model.predict(features(b.column("text")))
                names = model.languages
            yield to_batch(
                out,
                doc_id=b.column("doc_id"),
                lang_pred=[names[i] if k else UNDECIDED for i, k in zip(index, lettered, strict=True)],
                score=np.where(lettered, score, 0.0),
                ambiguous=~lettered | (lead < 0.2),
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learned from two thirds of the documents and applied to all: doc_id, held_out, lang_pred, score, ambiguous."""
    held_out = remainder("doc_id", 3) == 1
    model = learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
