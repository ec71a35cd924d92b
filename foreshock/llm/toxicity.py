"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding takes away case, look-alike letters, invisible characters, loose marks
and digits or signs put in place of letters; accented letters are letters of
their languages and stay.  An entry is a whole word or the stem
of words; a word counts once, with its heaviest entry.  Hits inside an exception
phrase do not count.  The sum is normalised by length and turned into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.llm.base import remainder, stored
from foreshock.llm.sampling import one_label, sample_labelled
from foreshock.llm.text import keep_rows, rounds, to_batch

#: Labelled documents of each label that the lexicon is learned from, at most.
SAMPLE_PER_LABEL = 1500
STEMS = (4, 5, 6, 7, 8)
#: An entry stands behind this many different words in toxic texts, so copies of one text make no entry.
MIN_CONTEXTS = 8
MIN_ODDS = 20.0
MAX_ENTRIES = 500
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and characters written in place of letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _fold_table() -> dict[int, str | None]:
    """Full-width characters by their decomposition, then the fixed look-alikes; marks that are part of no letter go."""
    table: dict[int, str | None] = {ord(c): None for c in INVISIBLE} | dict.fromkeys(range(0x300, 0x370))
    table |= {code: unicodedata.normalize("NFKD", chr(code)).lower() for code in range(0xFF01, 0xFF5F)}
    return table | {ord(k): v for k, v in HOMOGLYPHS.items()}


FOLD = _fold_table()
SUBSTITUTE = str.maketrans(DIGITS)
# Signs stand for letters inside a word or before it; digits also after it.
INSTEAD = re.compile(r"(?<=[a-z])[0134578@$!|+]+(?=[a-z])|(?<![a-z0-9])[0134578@$]+(?=[a-z])|(?<=[a-z])[0134578]+")
CUES = re.compile(r"[01345780@$!|+]")
GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at both ends; one space for a text without words."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).translate(FOLD)
    if CUES.search(text):
        text = INSTEAD.sub(lambda m: m.group().translate(SUBSTITUTE), text)
    return GAPS.sub(" ", f" {text} ")


@dataclass
class Lexicon:
    """Entries ("word " is a whole word, "stem" a beginning of words) with weights, exception phrases and the curve of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = -6.0
    _machine: object = None

    def machine(self):
        if self._machine is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for e, w in self.weights.items():
                a.add_word(f" {e}", (len(e) + 1, w))
            for e in self.exceptions:
                a.add_word(f" {e} ", (len(e) + 2, None))
            a.make_automaton()
            self._machine = a
        return self._machine

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def strength(self, folded: str) -> tuple[float, int]:
        """Sum of the weights of all hits, normalised by length, and their number."""
        if not self.weights:
            return 0.0, 0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.machine().iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            else:
                hits[start] = max(hits.get(start, 0.0), w)
        kept = [w for s, w in hits.items() if not any(a <= s < b for a, b in spared)]
        return sum(kept) / (1 + math.log1p(len(folded)) / 4), len(kept)

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * strength + self.offset))))


def entries_of(folded: str) -> Iterable[tuple[str, str]]:
    """(possible entry, word before) of every word."""
    before = ""
    for w in folded.split():
        if len(w) >= 3:
            yield w + " ", before
        for n in STEMS:
            if len(w) > n:
                yield w[:n], before
        before = w


def _choose(rows: list[tuple[str, int, float]], limit: int) -> dict[str, float]:
    """Short entries first; longer ones they cover are left out, as is a stem that nearly always is one word."""
    support = {e: n for e, n, _ in rows}
    words = [e for e in support if e.endswith(" ")]
    best = Counter()
    for w in words:
        for n in STEMS:
            if len(w) - 1 > n:
                best[w[:n]] = max(best[w[:n]], support[w])
    out: dict[str, float] = {}
    for e, n, odds in sorted(rows, key=lambda r: (r[0].endswith(" "), len(r[0]), r[0])):
        if any(e[:k] in out for k in STEMS if k < len(e)):
            continue
        if not e.endswith(" ") and best[e] >= 0.8 * n:
            continue
        out[e] = math.log(odds)
    top = sorted(out, key=lambda e: (-support[e], e))[:limit]
    return {e: out[e] for e in top}


def _curve(strength: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the sample's strengths, by Newton steps with a small ridge."""
    x = np.stack([strength, np.ones_like(strength)], 1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2
        w -= np.linalg.solve(h, x.T @ (p - label) + 1e-2 * w)
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = (), cap: int = SAMPLE_PER_LABEL) -> Lexicon:
    """Lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic; one row per document); an empty one when a label is missing.

    ``exceptions`` are phrases given by the user; a two-word phrase around an
    entry that clean texts use again and again is learned as one too.
    """
    sample = stored(sample_labelled(docs, labels, "toxic", cap), "toxic-sample")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("entry", pa.string()), ("before", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
        for b in rounds(batches, rows=200):
            seen: set[tuple[str, str]] = set()
            docs_with = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                found = set(entries_of(fold(t)))
                docs_with[not y].update({e for e, _ in found})
                if y:
                    seen |= found
            toxic, clean = docs_with
            names = sorted(toxic.keys() | clean.keys())
            yield to_batch(
                out,
                entry=[*(e for e, _ in seen), *names],
                before=[*(p for _, p in seen), *[None] * len(names)],
                toxic=[*[0] * len(seen), *(toxic[e] for e in names)],
                clean=[*[0] * len(seen), *(clean[e] for e in names)],
            )

    sizes = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon()
    counted = sample.mapInArrow(collect, "entry string, before string, toxic long, clean long")
    counted = counted.groupBy("entry").agg(F.countDistinct("before").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.5) / (sizes[1] + 1)) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    strong = counted.withColumn("odds", odds).where((F.col("contexts") >= MIN_CONTEXTS) & (F.col("odds") >= MIN_ODDS))
    top = strong.orderBy(F.desc("contexts"), "entry").limit(20 * MAX_ENTRIES).collect()
    weights = _choose([(r["entry"], r["contexts"], r["odds"]) for r in top], MAX_ENTRIES)
    lexicon = Lexicon(weights, [fold(e).strip() for e in exceptions])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("strength", pa.float64()), ("phrases", pa.list_(pa.string()))])
        for b in rounds(batches):
            texts = [fold(t) for t in b.column("text").to_pylist()]
            yield to_batch(
                out,
                doc_id=b.column("doc_id"),
                toxic=b.column("toxic").cast(pa.int32()),
                strength=[lexicon.strength(t)[0] for t in texts],
                phrases=pa.array([sorted(phrases_around(lexicon, t)) for t in texts], pa.list_(pa.string())),
            )

    measured = sample.mapInArrow(measure, "doc_id long, toxic int, strength double, phrases array<string>").toPandas().sort_values("doc_id")  # the bounded sample
    toxic, clean = Counter(), Counter()
    for y, found in zip(measured["toxic"], measured["phrases"], strict=True):
        (toxic if y else clean).update(found)
    lexicon.exceptions += sorted(p for p, n in clean.items() if n >= 5 and n > 10 * toxic[p])
    lexicon._machine = None
    lexicon.slope, lexicon.offset = _curve(measured["strength"].to_numpy(), measured["toxic"].to_numpy())
    return lexicon


def phrases_around(lexicon: Lexicon, folded: str) -> set[str]:
    """Two-word phrases that hold a hit."""
    found = set()
    if lexicon.weights:
        for end, (n, _) in lexicon.machine().iter(folded):
            start = end - n + 1
            stop = folded.index(" ", max(end, start + 1)) if folded[end] != " " else end
            before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
            if before >= 0:
                found.add(folded[before + 1 : stop])
            if after >= 0:
                found.add(folded[start + 1 : after])
    return {p for p in found if " " in p}


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and hits of every whole text.

    A null or empty text has no hits and the score of a clean text.  Repeated
    rows are scored alike; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("hits", pa.int64())])
        for b in rounds(batches):
            found = [lexicon.strength(fold(t)) for t in b.column("text").to_pylist()]
            s = np.array([lexicon.score(x) for x, _ in found])
            yield to_batch(out, doc_id=b.column("doc_id"), score=s, predicted=(s >= threshold).astype(np.int32), hits=[n for _, n in found])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, hits long")


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learned only from rows whose id is not held out."""
    return learn(docs, one_label(labels.where(remainder("doc_id", 3) != 1), "toxic"))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, hits of all documents."""
    lexicon = learn_toxicity(docs, labels)
    return score(docs, lexicon).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "hits")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Rows, with all columns, that :func:`score` does not predict to be toxic."""
    return keep_rows(docs, lambda texts: np.array([lexicon.score(lexicon.strength(fold(t))[0]) < threshold for t in texts.to_pylist()], bool))
