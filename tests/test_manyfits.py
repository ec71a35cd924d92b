"""Fits of one plan against one fit at a time, by hand and by Spark ML."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from foreshock.operators import manyfits, sampling

NAMES = ["a", "b", "c", "d"]


def table(spark, n=120, series="s", shift=0):
    rng = np.random.default_rng(7 + shift)
    x = rng.normal(size=(n, 4)) * [1, 5, 100, 0.01] + [0, 3, 1e6, 0]
    y = (x[:, 0] + (x[:, 2] - 1e6) / 200 + rng.normal(size=n) > 0.7).astype(int)
    long = [(series, i, NAMES[j], float(x[i, j])) for i in range(n) for j in range(4)]
    labels = [(series, i, int(y[i])) for i in range(n)]
    f = spark.createDataFrame(long, "series string, id long, feature string, value double")
    return f, spark.createDataFrame(labels, "series string, id long, is_erupted int"), x, y


def choices(spark, series="s", seeds=(0, 1)):
    rows = [(series, "m", s, n, r + 1) for s in seeds for r, n in enumerate(NAMES if s == 0 else ["c", "a", "d", "b"])]
    rows += [(series, "one", s, "b", 1) for s in seeds]
    return spark.createDataFrame(rows, "series string, method string, seed int, feature string, rank int")


def one_fit(x, y, c=1.0):
    """Minimum of the summed loss by plain Newton steps; returns a function of new rows.  NaN counts as the mean."""
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    sd[sd == 0] = 1
    z = np.nan_to_num(np.column_stack([(x - mean) / sd, np.ones(len(x))]))
    share, ridge = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))), np.diag([1 / c] * x.shape[1] + [0])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (share * p * (1 - p))[:, None]) + ridge, z.T @ (share * (p - y)) + ridge @ w)
    return lambda v: 1 / (1 + np.exp(-np.nan_to_num(np.column_stack([(v - mean) / sd, np.ones(len(v))])) @ w))


@pytest.fixture(scope="module")
def scored(spark):
    f, y, x, labels = table(spark)
    splits = sampling.cv_splits(sampling.with_seeds(y, [0, 1]), "stratified", 3)
    chosen = choices(spark)
    jobs = manyfits.chosen_jobs(chosen.where("method = 'm'"), [1, 3, 9]).unionByName(manyfits.chosen_jobs(chosen.where("method = 'one'")))
    got = manyfits.held_out_scores(f, splits, jobs).toPandas()
    return got, splits.toPandas(), x, labels, {(r["method"], r["seed"], r["N"]): r["features"] for r in jobs.collect()}


def test_every_fit_equals_a_fit_of_its_own(scored):
    got, splits, x, y, jobs = scored
    assert set(jobs) == {("m", s, n) for s in (0, 1) for n in (1, 3)} | {("one", s, 1) for s in (0, 1)}
    for (method, seed, n, fold), part in got.groupby(["method", "seed", "N", "fold"]):
        cols = [NAMES.index(f) for f in jobs[method, seed, n]]
        own = splits[(splits["seed"] == seed) & (splits["fold"] == fold)]
        train, test = (np.sort(own[own["part"] == p]["id"].to_numpy()) for p in ("train", "test"))
        want = one_fit(x[train][:, cols], y[train])(x[test][:, cols])
        part = part.sort_values("id")
        assert list(part["id"]) == list(test) and np.abs(part["p"].to_numpy() - want).max() < 1e-8
        assert list(part["is_erupted"]) == list(y[test])
    assert len(got) == 6 * 120


def test_library_gives_the_same_model(spark, scored):
    got, splits, x, y, _ = scored
    own = splits[(splits["seed"] == 0) & (splits["fold"] == 0)]
    train, test = (own[own["part"] == p]["id"].to_numpy() for p in ("train", "test"))
    z = (x[:, :3] - x[train][:, :3].mean(0)) / x[train][:, :3].std(0)
    n, n1 = len(train), y[train].sum()
    frame = lambda ids: spark.createDataFrame(
        [(int(i), [float(v) for v in z[i]], float(y[i]), float(n / (2 * n1) if y[i] else n / (2 * (n - n1)))) for i in ids],
        "id long, x array<double>, label double, weight double",
    ).withColumn("features", array_to_vector("x"))
    model = LogisticRegression(weightCol="weight", regParam=1.0 / n, standardization=False, tol=1e-12, maxIter=500).fit(frame(train))
    want = {r["id"]: r["p"] for r in model.transform(frame(test)).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    mine = got[(got["method"] == "m") & (got["seed"] == 0) & (got["N"] == 3) & (got["fold"] == 0)]
    assert all(abs(want[i] - p) < 1e-5 for i, p in zip(mine["id"], mine["p"], strict=True))


def test_series_missing_values_and_copies(spark):
    f, y, x, labels = table(spark)
    g, z, *_ = table(spark, 60, "t", 1)
    holed = f.withColumn("value", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    holed = holed.where("NOT (id % 11 = 0 AND feature = 'a')").withColumn("block", F.lit("mine"))
    splits = sampling.cv_splits(sampling.with_seeds(y.unionByName(z), [0]), "stratified", 2)
    copies = splits.unionByName(splits.where("part = 'train' AND is_erupted = 1"))
    jobs = manyfits.chosen_jobs(choices(spark, seeds=(0,)).unionByName(choices(spark, "t", (0,))))
    got = manyfits.held_out_scores(holed.drop("block").unionByName(g), copies, jobs).toPandas()
    assert sorted(got.groupby("series").size().items()) == [("s", 240), ("t", 120)] and got["p"].between(0, 1).all()
    s = splits.where("series = 's' AND fold = 0").toPandas()
    train = s[s["part"] == "train"]["id"].to_numpy()
    train = np.concatenate([train, [i for i in train if labels[i]]])
    v = x[:, [1]].copy()
    v[[i for i in range(len(v)) if i % 5 == 0 or i % 7 == 0]] = np.nan
    part = got[(got["series"] == "s") & (got["method"] == "one") & (got["fold"] == 0)].sort_values("id")
    want = one_fit(v[train], labels[train])(v[part["id"].to_numpy()])
    assert np.abs(part["p"].to_numpy() - want).max() < 1e-8


def test_errors_and_no_rows(spark):
    f, y, *_ = table(spark)
    splits = sampling.cv_splits(sampling.with_seeds(y, [0]), "stratified", 2)
    jobs = manyfits.chosen_jobs(choices(spark, seeds=(0,)))
    with pytest.raises(ValueError, match="absent"):
        manyfits.held_out_scores(f.where("feature <> 'c'"), splits, jobs)
    with pytest.raises(ValueError, match="both classes"):
        manyfits.held_out_scores(f, splits.withColumn("is_erupted", F.lit(1)), jobs)
    assert manyfits.held_out_scores(f, splits, jobs.limit(0)).count() == 0
    assert manyfits.chosen_jobs(choices(spark), [9]).count() == 0


def test_a_step_that_raises_the_loss_is_halved():
    fit = {"cols": [0], "mean": [0.0], "sd": [1.0], "size": 4.0, "hits": 2.0, "w": [8.0, 0.0], "back": [2.0, 0.0], "back_loss": 1.0}
    after = manyfits.newton_step(fit, [np.array([5.0, 0, 0, 1, 0, 0, 1])], 1.0)
    assert after["w"] == [5.0, 0.0] and after["back"] == [2.0, 0.0] and not after["done"]
