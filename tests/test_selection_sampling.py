from math import comb, erfc, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreshock.operators import nearest, sampling, selection


def frame(spark, columns, y):
    rows = [("s", i, f, float(v)) for f, xs in columns.items() for i, v in enumerate(xs)]
    labels = [("s", i, int(v)) for i, v in enumerate(y)]
    return (
        spark.createDataFrame(rows, "series string, id long, feature string, value double"),
        spark.createDataFrame(labels, "series string, id long, is_erupted int"),
    )


def test_rank_test_by_hand(spark):
    rng = np.random.default_rng(0)
    y = np.array([0] * 30 + [1] * 20)
    cols = {"a": rng.normal(size=50) + y, "t": rng.integers(0, 5, 50), "b": (rng.random(50) + y * 0.4 > 0.7), "c": np.ones(50)}
    got = {r["feature"]: r for r in selection.rank_test(*frame(spark, cols, y)).collect()}
    assert got["c"]["p_value"] == 1.0
    for f in ("a", "t"):
        x = np.asarray(cols[f], float)
        ranks = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        u = ranks[y == 1].sum() - 20 * 21 / 2
        ties = sum(c**3 - c for c in np.unique(x, return_counts=True)[1])
        var = 20 * 30 / 12 * (51 - ties / (50 * 49))
        assert np.isclose(got[f]["p_value"], erfc(max(abs(u - 300) - 0.5, 0) / sqrt(var) / sqrt(2)), atol=3e-7)
    b = np.asarray(cols["b"], int)
    a, r1, c1 = int((b & y).sum()), 20, int(b.sum())
    pk = lambda k: comb(r1, k) * comb(30, c1 - k) / comb(50, c1)
    want = sum(pk(k) for k in range(max(0, c1 - 30), min(r1, c1) + 1) if pk(k) <= pk(a) * (1 + 1e-7))
    assert np.isclose(got["b"]["p_value"], want)


def test_fisher_large_margins(spark):
    y = np.array([0, 1] * 400)
    x = (np.arange(800) % 4 == 0).astype(int)
    p = selection.rank_test(*frame(spark, {"f": x}, y)).first()["p_value"]
    assert p < 1e-50


def test_selection_falls_back_to_top_n(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 60)
    noise = {f"n{i}": rng.normal(size=60) for i in range(6)}
    out = selection.select_significant(*frame(spark, noise, y), top_n=3)
    assert out.where("selected").count() == 3 and out.count() == 6
    kept = selection.transform_selected(frame(spark, noise, y)[0], out.where("selected"))
    assert kept.count() == 3 * 60 and len(kept.collect()) == 3 * 60
    missing = out.where("selected").withColumn("feature", F.lit("zz"))
    with pytest.raises(Exception, match="missing"):
        selection.transform_selected(frame(spark, noise, y)[0], missing).collect()


def test_jaccard_of_empty_choices(spark):
    runs = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1), ("b", 1)], "method string, seed int")
    chosen = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("b", 1, "y")], "method string, seed int, feature string")
    got = {r["seed"]: r["jaccard"] for r in selection.selector_jaccard(chosen, runs).collect()}
    assert got == {0: 1.0, 1: 0.5}


def seeded(spark, n0=40, n1=10, seeds=(0, 1)):
    rows = [("s", i, int(i >= n0)) for i in range(n0 + n1)]
    return sampling.with_seeds(spark.createDataFrame(rows, "series string, id long, is_erupted int"), seeds)


def test_under_and_over(spark):
    under = sampling.undersample(seeded(spark), 0.75).groupBy("seed", "is_erupted").count().collect()
    assert {(r["seed"], r["is_erupted"]): r["count"] for r in under} == {(s, c): (10 if c else 13) for s in (0, 1) for c in (0, 1)}
    over = sampling.oversample(seeded(spark), 0.75).groupBy("seed", "is_erupted").count().collect()
    assert {(r["seed"], r["is_erupted"]): r["count"] for r in over} == {(s, c): (30 if c else 40) for s in (0, 1) for c in (0, 1)}
    a, b = (set(r["id"] for r in sampling.undersample(seeded(spark), 0.75).where(f"seed = {s} and is_erupted = 0").collect()) for s in (0, 1))
    assert a != b


def test_folds(spark):
    out = sampling.cv_splits(seeded(spark, seeds=(0,)), "stratified", 5)
    tests = out.where("part = 'test'")
    assert tests.count() == 50 and tests.select("id").distinct().count() == 50
    assert {r["count"] for r in tests.where("is_erupted = 1").groupBy("fold").count().collect()} == {2}
    ts = sampling.cv_splits(seeded(spark, seeds=(0,)), "timeseries", 4)
    for r in ts.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("id"))).alias("a"), F.min(F.when(F.col("part") == "test", F.col("id"))).alias("b")).collect():
        assert r["a"] < r["b"]
    with pytest.raises(ValueError):
        sampling.cv_splits(seeded(spark), "other")


@pytest.mark.parametrize("p,weights", [(1, "uniform"), (2, "distance"), (3, "uniform")])
def test_knn_brute_force_over_blocks(spark, p, weights):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(70, 4)), rng.integers(0, 2, 70)
    train = spark.createDataFrame([(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, vector array<double>, label double")
    query = train.select((F.col("id") + 1000).alias("id"), F.transform("vector", lambda v: v + 0.1).alias("vector"))
    got = {r["query_id"]: r["p"] for r in sampling.knn(train, query, 6, p, weights, block_rows=16).collect()}
    assert len(got) == 70
    for i in range(70):
        d = (np.abs(x - (x[i] + 0.1)) ** p).sum(axis=1) ** (1 / p)
        near = np.argsort(d, kind="stable")[:6]
        w = np.ones(6) if weights == "uniform" else 1 / d[near]
        assert np.isclose(got[1000 + i], (w * y[near]).sum() / w.sum())


@pytest.mark.parametrize("p,k", [(1, 3), (2, 6), (3, 1)])
def test_nearest_measures_few_pairs_and_misses_none(monkeypatch, p, k):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    x[100:200], x[200:300] = x[5], x[6] + 1e-7 * rng.normal(size=(100, 64))  # copies and near copies
    x[300, 0], x[301, 1], x[302] = np.nan, np.inf, 1e9
    ids = rng.permutation(3000)
    rows, pairs, measured = np.arange(0, 400), [0], nearest.measured
    monkeypatch.setattr(nearest, "measured", lambda q, t, i, *a: pairs.__setitem__(0, pairs[0] + len(i)) or measured(q, t, i, *a))
    i, j, d = nearest.nearest_others(ids[rows], x[rows], ids, x, k, p)
    got, want = list(zip(i.tolist(), ids[j].tolist(), d.tolist())), []
    with np.errstate(invalid="ignore"):
        for r in rows:
            far = np.round((np.abs(x - x[r]) ** p).sum(axis=1) ** (1 / p), 9)
            far[r] = np.inf
            best = [b for b in np.lexsort((ids, far))[:k] if np.isfinite(far[b])]
            want += [(int(r), int(ids[b]), float(far[b])) for b in best]
    assert got == want
    assert pairs[0] < 0.35 * len(rows) * len(x)


@pytest.mark.parametrize("p,weights", [(1, "distance"), (2, "uniform"), (3, "uniform")])
def test_knn_in_one_table_looks_at_a_pair_of_blocks_once(spark, p, weights):
    rng = np.random.default_rng(8)
    x, y, k = rng.integers(0, 4, (90, 3)) + 0.5, [None if i % 17 == 0 else float(i % 2) for i in range(90)], 4  # copies and ties
    table = spark.createDataFrame([(3 * i, [float(v) for v in r], c) for i, (r, c) in enumerate(zip(x, y))], "id long, vector array<double>, label double")
    got = {r["query_id"]: (r["p"], r["kth_distance"]) for r in sampling.knn(table, table, k, p, weights, block_rows=16).collect()}
    assert len(got) == 90
    for i in range(90):
        d = np.round((np.abs(x - x[i]) ** p).sum(axis=1) ** (1 / p), 9)
        near = [j for j in np.lexsort((np.arange(90), d)) if j != i][:k]
        w = np.ones(k) if weights == "uniform" else (d[near] == 0) * 1.0 if (d[near] == 0).any() else 1 / d[near]
        voted = [w[a] * y[j] for a, j in enumerate(near) if y[j] is not None]
        assert got[3 * i][1] == d[near].max() and (np.isclose(got[3 * i][0], sum(voted) / w.sum()) if voted else got[3 * i][0] is None)
    candidates = sampling._within_one(table, k, p, 6)
    assert "CoGroup" not in candidates._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("p,k", [(1, 3), (2, 6), (3, 1)])
def test_two_blocks_find_each_other_by_one_product(monkeypatch, p, k):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2300, 16))
    x[100:200], x[1200:1300], x[1300:1400] = x[5], x[5], x[6] + 1e-7 * rng.normal(size=(100, 16))  # copies and near copies
    x[300, 0], x[1500, 1], x[302] = np.nan, np.inf, 1e9
    ids = rng.permutation(2300)
    ids[1600] = ids[7]  # one id on both sides
    a, b = np.arange(0, 1100), np.arange(1100, 2300)
    with np.errstate(invalid="ignore"):
        far = np.array([np.round((np.abs(x[b] - x[r]) ** p).sum(axis=1) ** (1 / p), 9) for r in a])
    far[(ids[a][:, None] == ids[b][None, :]) | ~np.isfinite(far)] = np.inf
    limits = []
    for d in (far, far.T):  # some rows without a limit, some with one that leaves out most
        limit = np.sort(d, axis=1)[:, k] * 1.01
        limit[::9] = np.inf
        limit[::7] *= 0.9
        limits.append(np.where(np.isnan(limit), np.inf, limit))
    work, measured = [0], nearest.measured
    monkeypatch.setattr(nearest, "measured", lambda q, t, i, *rest: work.__setitem__(0, work[0] + len(i)) or measured(q, t, i, *rest))
    monkeypatch.setattr(nearest, "FOUND", 3000)
    found = nearest.between(ids[a], x[a], limits[0], ids[b], x[b], limits[1], k, p)
    for (i, j, d), mine, other, all_d, limit in zip(found, (a, b), (b, a), (far, far.T), limits):
        got, want = list(zip(i.tolist(), ids[other][j].tolist(), d.tolist())), []
        for r in range(len(mine)):
            best = [c for c in np.lexsort((ids[other], all_d[r]))[:k] if all_d[r][c] <= limit[r] and np.isfinite(all_d[r][c])]
            want += [(r, int(ids[other][c]), float(all_d[r][c])) for c in best]
        assert sorted(got) == sorted(want)
    assert work[0] < 0.5 * far.size


def test_knn_of_one_vector_many_times(spark):
    same = spark.range(3000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), (F.col("id") % 2).cast("double").alias("label"))
    got = sampling.knn(same, same, 3, 1, "distance", block_rows=1000)
    # The three smallest other ids: 0, 1, 2 but for those themselves.
    assert {r["query_id"]: round(r["p"], 6) for r in got.where("query_id < 4").collect()} == {0: round(2 / 3, 6), 1: round(1 / 3, 6), 2: round(2 / 3, 6), 3: round(1 / 3, 6)}
    assert got.count() == 3000 and got.where("kth_distance <> 0").count() == 0


def test_pick_n_rules(spark):
    df = spark.createDataFrame([(5, 0.80, 0.02, 4), (10, 0.815, 0.02, 4), (20, 0.82, 0.02, 4)], "N int, mean double, std double, n_seeds long")
    star = lambda **k: sampling.pick_n(df, **k).first()["n_star"]
    assert star() == 10 and star(parsimony=False) == 20 and star(tolerance=0.05) == 5
    single = spark.createDataFrame([(5, 0.8, None, 1), (9, 0.81, None, 1)], "N int, mean double, std double, n_seeds long")
    assert sampling.pick_n(single).first()["n_star"] == 9
    with pytest.raises(ValueError):
        sampling.pick_n(df, tolerance=1.5)
