"""Small corpora for the tests of the corpus operators."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "béta", "gamma", "de", "la", "xyz", "uno", "dos", "river", "stone"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def texts(seed=3, n=50):
    """Prose with shared passages, truncated passages, repeated words, edits, copies, and null, empty and blank texts."""
    rng = random.Random(seed)
    passages = [prose(rng, 60) for _ in range(4)]
    short = prose(rng, 24)[:190]
    out = [None, "", " \n", "short", prose(rng, 2500)]
    for _ in range(n):
        k, t = rng.random(), prose(rng, rng.randrange(5, 80))
        if k < 0.3:
            t = prose(rng, 20) + rng.choice(passages) + prose(rng, 20)
        elif k < 0.4:
            t = rng.choice(passages)[rng.randrange(30) :]
        elif k < 0.5:
            t = "He " * rng.randrange(60, 200) + prose(rng, 10)
        elif k < 0.6:
            t = prose(rng, 30) + short + prose(rng, 30)
        elif k < 0.75:
            b = out[-1] or "x"
            t = b[: len(b) // 2] + "Z" + b[len(b) // 2 :]
        elif k < 0.85:
            t = out[rng.randrange(len(out))]
        out.append(t)
    return out


def frame(spark, rows):
    """(doc_id, text) rows as documents."""
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns whose names clash."""
    long = "word " * 30_000 + "end"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two three", "fr", None, 13),
        (5, long, "en", "b", len(long)), (6, "12 34 !!", "de", "b", 8), (7, "same text again " * 20, "en", "b", 320),
        (7, "same text again " * 20, "en", "b", 320), (8, "same text again " * 20, None, "b", 320), (None, "no id at all " * 20, "en", "c", 260),
        (None, None, None, None, None), (9, "é漢😀 ▁ \x00x", "es", "c", None), (9, "another text under the id nine", "es", "c", 30),
    ]
    extra = ", score double, part int, keys binary, at int, n long, n_bytes long, kept string, _x string, _d long, label int, predicted int, length long"
    more = (0.5, 1, b"k", 2, 3, 4, "k", "x", 5, 6, 7, 8)
    return spark.createDataFrame([(*r, *more) for r in rows], DOCUMENTS + extra)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
