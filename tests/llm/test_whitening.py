"""Whitening against a dense eigendecomposition, and the solver by itself."""

import math

import numpy as np
import pytest

from foreshock.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x binary, whitened double, k int"
MORE = (1, 5, b"x", 0.5, 7)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *MORE) for i, v in rows], SCHEMA)


def plain(rows, components):
    d = 3 if not rows else max({len(v) for _, v in rows if v}, key=lambda k: (sum(len(v or []) == k for _, v in rows), -k))
    fine = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in fine}))
    n, total = len(fit), fit.sum(0)
    c = (fit * n - total) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return fine, n, total, e[::-1][:components], u[:, ::-1][:, :components], e.sum()


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 12)) * np.linspace(0.5, 2, 12)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (400, rows[9][1])] * 20  # repeated rows, no id, another id
    rows += [(500, None), (501, [None] + [0.0] * 11), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (504, [1.0]), (505, [])]
    got = whitening.whitened_components(frame(spark, rows).repartition(5), 5).collect()
    fine, n, total, e, u, trace = plain(rows, 5)
    assert len(got) == 5 * len(fine)
    assert {r["n"] for r in got} == {n} and n == 300
    assert all(r["identity_error"] < 1e-9 for r in got) and len({r["identity_error"] for r in got}) == 1
    of_id = {i: np.array(x) for i, x in fine}
    signs = {}
    for r in got:
        x, k = of_id[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == int(((n * x - total) ** 2).sum())
        want = ((n * x - total) / n) @ u[:, k] / math.sqrt(e[k])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
        if abs(want) > 1e-3:
            signs.setdefault(k, set()).add(r["whitened"] * want > 0)
        assert abs(r["explained"] - e[k] / trace) < 1e-12
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_spread_gives_no_components(spark, rows):
    assert whitening.whitened_components(frame(spark, rows)).collect() == []


def test_rank_bounds_the_components(spark):
    rows = [(i, [float(i % 7), float(2 * (i % 7)), 1.0, float(i // 7)]) for i in range(49)]
    got = whitening.whitened_components(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 98
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1.0, abs=1e-12)


def test_deviation_is_exact_beyond_doubles_and_null_beyond_longs():
    m = whitening.Whitening(2, 1 << 30, np.array([0, 0]))
    assert m.deviation(np.array([[1, 0], [2, 1], [3, 0]])) == [1 << 60, (1 << 62) + (1 << 60), None]


@pytest.mark.parametrize(("d", "k"), [(1, 16), (5, 16), (64, 16), (200, 12)])
def test_jacobi_davidson_reaches_double_precision(d, k):
    a = np.random.default_rng(d).standard_normal((3 * d, d)) * np.linspace(1, 3, d)
    v = a.T @ a / len(a)
    asked = []
    found = whitening.jacobi_davidson(lambda q: asked.append(q.shape) or v @ q, d, k)
    e = np.linalg.eigvalsh(v)[::-1][:k]
    assert np.abs(found.values - e).max() < 1e-12 * e[0]
    assert found.residuals.max() < 1e-11 * e[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(e))).max() < 1e-12
    assert found.products == len(asked) and max(s[1] for s in asked) <= k + whitening.SPARE


def test_repeated_eigenvalues():
    v = np.diag([3.0, 3.0, 3.0, 1.0, 0.0, 0.0])
    assert np.allclose(whitening.jacobi_davidson(lambda q: v @ q, 6, 4).values, [3, 3, 3, 1], atol=1e-14)


def test_minres_solves_every_column():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((40, 40))
    a = a + a.T + np.diag(np.where(np.arange(40) % 2, 30.0, -30.0))
    b = rng.standard_normal((40, 3))
    x = whitening.minres(lambda v: a @ v, b, 60, 1e-13)
    assert np.linalg.norm(a @ x - b) < 1e-9
    assert not whitening.minres(lambda v: a @ v, np.zeros((40, 1)), 5).any()
