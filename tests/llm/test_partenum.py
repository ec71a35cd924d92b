import random
import re

import corpus
import numpy as np
import pandas as pd
import pytest

from foreshock.llm import partenum

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain(rows):
    """Set size and component of every row, over all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                top[y] = x
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


def near_copies(seed):
    """Groups of edited copies, chains of edits whose ends are far apart, a passage in many texts, and tiny sets."""
    rng = random.Random(seed)
    out = [None, "", "one two", "One  TWO", "a b c d e", "a b c d e f", "a b c d e f g", "a b c d e f g h"]
    for size in (12, 40, 90, 300):
        base = corpus.prose(rng, size).split()
        chain = list(base)
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randrange(1 + size // 60 + 1)):
                copy[rng.randrange(size)] = f"new{rng.randrange(99)}"
            out.append(" ".join(copy))
            chain[(5 * k) % size] = f"step{k}"
            out.append(" ".join(chain))
    passage = corpus.prose(rng, 60)
    out += [corpus.prose(rng, rng.randrange(1, 40)) + " " + passage for _ in range(40)]
    out += [corpus.prose(rng, 50) for _ in range(20)]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_all_pairs(spark, seed):
    rows = near_copies(seed)
    got = partenum.near_duplicates(corpus.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain(rows)


def test_repeated_ids_with_other_texts(spark):
    a, b = corpus.prose(random.Random(1), 40), corpus.prose(random.Random(2), 40)
    rows = [(5, a), (5, b), (3, a + " x"), (1, b), (8, "alone here")]
    got = partenum.near_duplicates(corpus.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (3, 3), (5, 1), (5, 3), (8, 8)]


def test_smallest_hashes_of_partners_overlap():
    """The lemma behind the first filter, for all sizes and the least possible overlap."""
    n = np.arange(0, 1500)
    size, shared = partenum.prefix_size(n), partenum.prefix_shared(n)
    for a in range(1, 1000):
        for b in range(a, a * 4 // 3 + 1):
            common = -(-(a + b) * 3 // 7)
            if common > a:
                continue
            met = min(size[a] - a + common, size[b] - b + common)
            assert met >= shared[a] and met >= shared[b], (a, b)


def test_signatures_find_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    for n in (3, 5, 9, 20, 33, 64, 150, 400, 1000):
        found = 0
        for _ in range(40):
            differ = n // 7  # of each: likeness just above 3/4
            pool = rng.integers(0, 1 << 63, n + differ, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[differ:])
            x, _ = partenum.signatures(np.zeros(len(a), int), a, np.array([len(a)]))
            y, _ = partenum.signatures(np.zeros(len(b), int), b, np.array([len(b)]))
            found += len(np.intersect1d(x, y)) > 0
        assert found == 40, n


def test_sketch_never_overstates():
    rng = np.random.default_rng(6)
    for n in (5, 50, 300):
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n // 3 : n + n // 5])
        one, two = (partenum.sketch(np.zeros(len(x), int), x, 1) for x in (a, b))
        assert partenum.least_difference(one, two)[0] <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "x long, y long")
    got = {r["node"]: r["component"] for r in partenum.components(links).collect()}
    assert {got[i] for i in range(41)} == {got[0]} and got[100] == got[101] != got[0]


def test_keep_one(spark):
    rows = near_copies(4)
    kept = {r["doc_id"] for r in partenum.keep_one(corpus.frame(spark, rows)).collect()}
    assert kept == {c for _, _, c in plain(rows)}


def test_keep_one_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    a, b, c, d = (corpus.prose(rng, 60) for _ in range(4))
    rows = [(5, a), (5, a), (None, a + " more"), (7, a + " x"), (None, b), (None, b), (None, b + " y"), (3, c), (None, c), (8, d), (8, d + " z"), (8, c), (1, ""), (1, ""), (2, None)]
    kept = [(r["doc_id"], r["text"]) for r in partenum.keep_one(corpus.frame(spark, rows)).collect()]
    groups = [{(5, a)}, {(None, b), (None, b + " y")}, {(3, c)}, {(8, d), (8, d + " z")}, {(1, "")}, {(2, None)}]
    assert len(kept) == len(groups) and all(len(g & set(kept)) == 1 for g in groups)


@pytest.mark.parametrize("tile", [4096, 8])
def test_pairs_inside_groups_equal_all_pairs(spark, monkeypatch, tile):
    """Members of shared groups meet once, whole or in tiles, and no alike pair of different components is missed."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(partenum, "TILE", tile)
    base = [rng.integers(0, 1 << 62, 40).astype(np.uint64) for _ in range(12)]
    sets = {}
    for b in base:
        for _ in range(4):
            x = b.copy()
            x[: rng.integers(0, 12)] = rng.integers(0, 1 << 62, 1)[0]
            h = np.unique(x)
            sets[int(rng.integers(-(1 << 60), 1 << 60))] = h
    names = sorted(sets)
    flat = [(s, len(sets[s]), bytearray(partenum.sketch(np.zeros(len(sets[s]), int), sets[s], 1)[0].tobytes())) for s in names]
    members = [(g, s, len(sets[s]), i % 7) for g in (5, -9) for i, s in enumerate(names) if g == 5 or i % 2]
    got = partenum._crossing(spark.createDataFrame(members, "g long, y long, n long, k long"), spark.createDataFrame(flat, "s long, n long, sketch binary"), 2)
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and all(x < y for x, y in got)
    k = {s: i % 7 for i, s in enumerate(names)}
    want = {(a, b) for a in names for b in names if a < b and k[a] != k[b] and partenum.alike(sets[a], sets[b])}
    assert want and want <= set(got) and len(got) < len(names) ** 2 / 6


@pytest.mark.parametrize("n", [20, 300, 800, 6000])
def test_sketches_bound_the_difference_from_below(n):
    rng = np.random.default_rng(n)
    sets = []
    for k in range(60):
        h = np.unique(rng.integers(0, 1 << 62, n, dtype=np.int64).astype(np.uint64))
        cut = rng.integers(0, n // 2)
        sets += [h, np.unique(np.concatenate([h[cut:], rng.integers(0, 1 << 62, rng.integers(0, n // 2 + 1), dtype=np.int64).astype(np.uint64)]))]
    size = np.array([len(x) for x in sets])
    flat = partenum.sketch(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets))
    a, b = flat[0::2], flat[1::2]
    true = np.array([len(np.setxor1d(x, y)) for x, y in zip(sets[0::2], sets[1::2], strict=True)])
    assert (partenum.least_difference(a, b) <= true).all()
    assert (partenum.least_difference(a, a) == 0).all()


def test_half_alike_members_of_a_group_are_no_pairs():
    """A source of 800 shingles of which every text keeps three quarters: pairs are 0.6 alike."""
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 600, dtype=np.int64)
    sets = [np.unique(np.concatenate([base, rng.integers(1, 1 << 62, 200, dtype=np.int64)])).astype(np.uint64) for _ in range(100)]
    size = np.array([len(x) for x in sets])
    flat = partenum.sketch(np.repeat(np.arange(100), size), np.concatenate(sets), 100)
    rows = pd.DataFrame({"g": 1, "y": np.arange(100), "n": size, "k": np.arange(100), "sketch": [f.tobytes() for f in flat], "side": 0, "i": 0, "j": 0, "part": 0})
    assert len(partenum._near_in_groups(rows)) < 50
