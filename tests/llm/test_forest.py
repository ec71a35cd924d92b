"""Links and components of vectors against all pairs."""

import math

import numpy as np
import pytest

from foreshock.llm import forest

SCHEMA = "vec_id long, embedding array<{0}>, label int, node long, leaf long, v binary, times int, n_links string"
MORE = (1, 2, 3, b"x", 5, "y")


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, *MORE) for i, v in rows], SCHEMA.format(kind))


def plain(rows, cosine=0.9):
    d = len(rows[0][1])
    fine = [k for k, (_, v) in enumerate(rows) if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[k][1] for k in fine], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    near |= (x[:, None, :] == x[None, :, :]).all(2)
    np.fill_diagonal(near, False)
    group = np.arange(len(fine))
    while True:
        new = np.minimum(group, np.where(near, group[None, :], len(fine)).min(1, initial=len(fine)))
        if (new == group).all():
            break
        group = new
    links, least = {k: 0 for k in range(len(rows))}, {k: rows[k][0] for k in range(len(rows))}
    for a, k in enumerate(fine):
        links[k] = int(near[a].sum())
        ids = [rows[fine[b]][0] for b in np.flatnonzero(group == group[a]) if rows[fine[b]][0] is not None]
        least[k] = min(ids, default=None) if rows[k][0] is not None else None
    return sorted(((i, links[k], least[k], i is not None and i == least[k]) for k, (i, _) in enumerate(rows)), key=repr)


def clusters(seed, n, tight):
    """Unit vectors around a few centres, exact copies, chains, and awkward rows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 24))
    x = [centres[0] + tight * rng.standard_normal(24) for _ in range(n)]
    x += [c + 0.25 * rng.standard_normal(24) for c in centres[1:] for _ in range(25)]
    x += list(rng.standard_normal((150, 24)))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(900 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[4][1]), (None, rows[200][1]), (5, rows[250][1])]
    return rows + [(1001, None), (1002, [None] + [1.0] * 23), (1003, [float("nan")] * 24), (1004, [0.0] * 24), (1005, [1.0]), (1006, [3.0e38] * 24), (None, None)]


@pytest.mark.parametrize(("leaf", "most", "tight"), [(512, 2048, 0.1), (40, 60, 0.1), (30, 30, 0.02)])
def test_links_equal_all_pairs(spark, leaf, most, tight):
    """Whole leaves, leaves split again, and one tight cluster compared in tiles."""
    rows = clusters(leaf, 200, tight)
    got = forest.near_vectors(frame(spark, rows).repartition(3), leaf=leaf, most=most)
    got = sorted(map(tuple, got.collect()), key=repr)
    want = plain(rows)
    if leaf == 512:
        assert got == want
    assert [r[0] for r in got] == [r[0] for r in want]
    total = sum(r[1] for r in want)
    assert sum(r[1] for r in got) <= total
    assert sum(r[1] for r in got) >= 0.97 * total
    assert sum(a[2:] == b[2:] for a, b in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_doubles_and_no_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e-200, 1e-201]), (3, [0.0, -1.0])]
    got = {r["vec_id"]: tuple(r)[1:] for r in forest.near_vectors(frame(spark, rows, "double")).collect()}
    assert got[3] == (0, 3, True) and got[1][0] == got[2][0]
    assert forest.near_vectors(frame(spark, [])).collect() == []
    assert [tuple(r) for r in forest.near_vectors(frame(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_forest_recall_at_the_threshold():
    """Pairs of a cosine of just 0.9, the hardest ones, are found by some tree nine times in ten at least."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.9 * a + 0.19**0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([a, b])
    found = np.zeros(len(a), bool)
    for t in range(forest.TREES):
        tree = forest.Tree(x, 1000 + t, 1.0, forest.margin(64), 100)
        for _, rows in tree.place(x):
            inside = np.zeros(len(x), bool)
            inside[rows] = True
            found |= inside[: len(a)] & inside[len(a) :]
    assert found.mean() >= 0.9
