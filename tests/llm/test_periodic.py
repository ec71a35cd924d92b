"""Runs against a plain search of every period, and the digests of the query."""

import hashlib
import random
import zlib

import corpus
import numpy as np
import pytest

from foreshock.llm import periodic


def plain(v):
    """Runs by trying every period; a run is reported under its smallest period."""
    found = {}
    for q in range(1, len(v) // 4 + 1):
        i = 0
        while i < len(v) - q:
            s = i
            while i < len(v) - q and v[i] == v[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q - s), q)
            i += 1
    return sorted([(s, n, q) for (s, n), q in found.items()], key=lambda r: (r[0], r[2]))


def sequence(rng):
    k = rng.choice([1, 2, 3, 6])
    v = [rng.randrange(k) for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(4)):
        p = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
        v += (p * 9)[: rng.randrange(1, 60)] + [rng.randrange(k) for _ in range(rng.randrange(5))]
    return v


def test_grammar_runs_equal_plain_search():
    rng = random.Random(5)
    for _ in range(1500):
        v = sequence(rng)
        assert periodic.grammar_runs(v) == plain(v)
        h = periodic.mix(np.array(v, np.uint64))
        kept = zip(*periodic.stretches(h, np.array([0]), np.array([len(v)])), strict=True)
        moved = [(int(s) + r[0], r[1], r[2]) for s, e in kept for r in periodic.grammar_runs(v[s:e])]
        assert sorted(moved, key=lambda r: (r[0], r[2])) == plain(v)


def test_repair_rules_rebuild_the_sequence():
    v = [1, 2, 1, 2, 1, 2, 3, 1, 2, 3, 4, 1, 2, 3, 4]
    rules, left = periodic.repair(v)
    names = {max(v) + 1 + k: p for k, p in enumerate(rules)}
    flat = lambda s: [x for y in names[s] for x in flat(y)] if s in names else [s]
    assert [x for s in left for x in flat(s)] == v
    assert rules[0] == (1, 2)
    pairs = list(zip(left, left[1:], strict=False))
    assert len(set(pairs)) == len(pairs)


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain(w)
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", [1, 2])
def test_digests_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    texts = corpus.texts(seed, 60) + [" ".join(f"w{x}" for x in sequence(rng)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c " * 9), (7, "x " * 40), (7, "x " * 40), (None, None)]
    got = sorted(map(tuple, periodic.digests(corpus.frame(spark, rows)).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and (t or "").split() for i, t in rows)


def test_spans_and_text_without_planting(spark):
    d = corpus.frame(spark, [(1, "a b\tc " + "x y " * 5 + "end"), (2, "no repetition here"), (3, None)])
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(d).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(3, 10, 2)]
    assert rows[1]["collapsed"] == "a b c x y end"
    assert rows[2]["runs"] == [] and rows[2]["collapsed"] == "no repetition here"
    assert rows[3]["n_words"] == 0 and rows[3]["collapsed"] == ""
