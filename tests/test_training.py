import numpy as np
import pytest
from pyspark.sql import functions as F

from foreshock.operators import evaluation, sampling, training

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    y = np.array([0] * 60 + [1] * 40)
    x = np.column_stack([rng.normal(size=100) + 2 * y, rng.normal(size=100), rng.normal(size=100)])
    rows = [("s", i, n, float(x[i, j])) for i in range(100) for j, n in enumerate(NAMES)]
    features = spark.createDataFrame(rows, "series string, id long, feature string, value double").cache()
    labels = spark.createDataFrame([("s", i, int(v)) for i, v in enumerate(y)], "series string, id long, is_erupted int").cache()
    train = training.matrix(features, NAMES).join(labels, ["series", "id"]).coalesce(1).cache()
    return features, labels, train


@pytest.mark.parametrize("kind", ["dt", "lr", "nb", "svm", "lite-rf", "voting"])
def test_kinds_beat_the_base_rate(data, kind):
    features, labels, train = data
    model = training.fit_classifier(kind, train, NAMES, 1)
    scored = training.score_seeds([model], features).join(labels, ["series", "id"])
    assert scored.where("p < 0 or p > 1").count() == 0
    assert evaluation.roc_auc(scored).first()["roc_auc"] > 0.8


def test_same_seed_same_scores(data):
    features, _, train = data
    a, b = (training.score_seeds([training.fit_classifier("lite-rf", train, NAMES, 5)], features) for _ in range(2))
    assert a.exceptAll(b).count() == 0


def test_argument_errors(data):
    _, _, train = data
    with pytest.raises(ValueError):
        training.fit_classifier("nope", train, NAMES)
    with pytest.raises(ValueError, match="both classes"):
        training.fit_classifier("lr", train.where("is_erupted = 0"), NAMES)


def test_ensemble_is_saved_and_reused(spark, data, tmp_path):
    features, labels, _ = data
    path = str(tmp_path / "e")
    first = training.train_ensemble(features, labels, ["lr"], [0, 1], top_n=2)
    training.save_ensemble(first, path, spark)
    done = training.registry_pairs(spark, path)
    assert done == {("lr", 0), ("lr", 1)}
    assert [m.seed for m in training.train_ensemble(features, labels, ["lr"], [0, 1, 2], top_n=2, done=done)] == [2]
    again = training.load_ensemble(spark, path)
    a, b = training.score_seeds(first, features), training.score_seeds(again, features)
    assert a.exceptAll(b).count() == 0
    assert "a" in first[0].features


def test_permutation_finds_the_feature(data):
    _, _, train = data
    out = training.select_permutation(train, NAMES, 3, repeats=3, trees=10).orderBy("rank").collect()
    assert out[0]["feature"] == "a" and out[0]["mean"] > 0.1


def test_sampled_contributions_add_up(data):
    _, _, train = data
    model = training.fit_classifier("dt", train, NAMES, 0)
    rows = train.select("series", "id", "x")
    total = training.attribute_sampled(model, rows, 4).groupBy("id").agg(F.sum("contribution").alias("t"))
    means = rows.groupBy("series").agg(F.array(*[F.avg(F.element_at("x", i)) for i in (1, 2, 3)]).alias("x")).withColumn("id", F.lit(-1).cast("long"))
    base = training.score_model(model, means).first()["p"]
    scored = training.score_model(model, rows).join(total, "id")
    assert scored.where(F.abs(F.col("p") - base - F.col("t")) > 1e-9).count() == 0


def test_grid_search_and_sweep(data):
    features, labels, train = data
    seeded = sampling.with_seeds(labels, [0])
    folds = sampling.cv_splits(seeded, "stratified", 2).where("part = 'test'")
    model, scores = training.grid_search("dt", train, NAMES, folds, 2, grid={"maxDepth": [1, 3]}, parallelism=2)
    assert len(scores) == 2 and all(0 <= s <= 1 for _, s in scores) and model.features == NAMES
    raw = training.feature_count_sweep("lr", features, seeded, {0: NAMES}, [1, 3, 9], k=2)
    assert {r["N"] for r in raw.collect()} == {1, 3}
    with pytest.raises(ValueError):
        training.feature_count_sweep("lr", features, seeded, {0: NAMES}, [9], k=2)
