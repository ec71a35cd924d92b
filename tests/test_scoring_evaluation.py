from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreshock.functions.expr import literal_table
from foreshock.operators import attribution, evaluation, scoring
from tests.helpers import START


def score_frame(spark, p, y, seeds=1):
    rows = [("s", "c", s, i, float(v[s] if seeds > 1 else v), int((v[s] if seeds > 1 else v) >= 0.5), int(t)) for s in range(seeds) for i, (v, t) in enumerate(zip(p, y))]
    return spark.createDataFrame(rows, "series string, classifier string, seed int, id long, p double, pred int, is_erupted int")


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 200)
    return np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2), y


def test_areas_brute_force(spark, drawn):
    p, y = drawn
    row = evaluation.ranking_metrics(evaluation.score_histogram(score_frame(spark, p, y))).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    points = [(0.0, 1.0)] + [((y[p >= t]).sum() / y.sum(), y[p >= t].mean()) for t in sorted(set(p), reverse=True)]
    r, q = np.array(points).T
    assert np.isclose(row["roc_auc"], auc)
    assert np.isclose(row["average_precision"], (np.diff(r) * q[1:]).sum())
    assert np.isclose(row["pr_auc"], (np.diff(r) * (q[1:] + q[:-1]) / 2).sum())


def test_mean_curve_is_np_interp(spark, drawn):
    p, y = drawn
    df = score_frame(spark, p, y)
    curve = evaluation.roc_curve(evaluation.score_histogram(df)).orderBy("fpr", "tpr").collect()
    grid = np.linspace(0, 1, 100)
    want = np.interp(grid, [r["fpr"] for r in curve], [r["tpr"] for r in curve])
    got = [r["mean_tpr"] for r in evaluation.mean_roc(df, force_origin=False).orderBy("fpr").collect()]
    assert np.allclose(got, want)
    assert evaluation.mean_roc(df).orderBy("fpr").first()["mean_tpr"] == 0.0


def test_single_class_has_no_auc(spark):
    df = score_frame(spark, [0.1, 0.9], [1, 1])
    assert evaluation.roc_auc(df).first()["roc_auc"] is None
    m = evaluation.seed_metrics(df).first()
    assert (m["specificity"], m["recall"], m["mcc"]) == (0.0, 0.5, 0.0)


def test_sweep_counts_brute_force(spark, drawn):
    p, y = drawn
    got = evaluation.threshold_sweep(score_frame(spark, p, y)).orderBy("threshold").collect()
    assert len(got) == 101
    for k in (0, 29, 50, 100):
        z = p >= k / 100
        assert np.isclose(got[k]["recall"], (z & (y == 1)).sum() / y.sum())
        assert np.isclose(got[k]["specificity"], (~z & (y == 0)).sum() / (y == 0).sum())


def test_unknown_metric(spark, drawn):
    table = evaluation.metrics_table(evaluation.seed_metrics(score_frame(spark, *drawn)))
    with pytest.raises(ValueError):
        evaluation.rank_classifiers(table, "nope")
    assert evaluation.rank_classifiers(table).first()["rank"] == 1


def test_consensus_lies_between_classifiers(spark):
    rng = np.random.default_rng(9)
    rows = [("s", c, s, i, float(v), int(v >= 0.5)) for c in "ab" for s in range(3) for i, v in enumerate(rng.random(20))]
    df = spark.createDataFrame(rows, "series string, classifier string, seed int, id long, p double, pred int")
    wide = scoring.forecast_table(scoring.seed_consensus(df), ["a", "b"])
    bad = wide.where(
        (F.col("consensus_probability") > F.greatest("a_probability", "b_probability") + 1e-12)
        | (F.col("consensus_probability") < F.least("a_probability", "b_probability") - 1e-12)
    )
    assert wide.count() == 20 and bad.count() == 0


def test_alert_bands_and_episodes(spark):
    rows = [("s", START + timedelta(hours=6 * i), v) for i, v in enumerate([0.1, 0.4, 0.45, 0.5, 0.9, 0.39])]
    df = spark.createDataFrame(rows, "series string, ts timestamp, probability double")
    banded = scoring.alert_bands(df)
    assert [r["state"] for r in banded.orderBy("ts").collect()] == ["quiet", "watch", "watch", "alert", "alert", "quiet"]
    episodes = scoring.alert_episodes(banded).orderBy("episode").collect()
    assert [(r["state"], r["n_rows"]) for r in episodes] == [("quiet", 1), ("watch", 2), ("alert", 2), ("quiet", 1)]


def test_event_without_rows_is_skipped(spark):
    df = score_frame(spark, [0.2, 0.7, 0.7], [0, 1, 1]).drop("is_erupted")
    labels = spark.createDataFrame([("s", i, START + timedelta(hours=i)) for i in range(3)], "series string, id long, ts timestamp")
    dates = literal_table(spark, "d", ["2025-01-01", "2025-03-01"]).select(F.lit("s").alias("series"), F.to_date("d").alias("event_date"))
    out = {r["level"]: r for r in evaluation.event_picks(df, labels, dates).collect()}
    assert set(out) == {"seed", "event", "overall"}
    assert (out["event"]["highest_id"], out["event"]["lowest_id"]) == (1, 0)


def test_linear_contributions_add_up(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(15, 2))
    f = spark.createDataFrame([("s", i, n, float(x[i, j])) for i in range(15) for j, n in enumerate("uv")], "series string, id long, feature string, value double")
    coef = spark.createDataFrame([("c", 0, "u", 2.0), ("c", 0, "v", -1.0)], "classifier string, seed int, feature string, coef double")
    got = {r["id"]: r["t"] for r in attribution.attribute_linear(f, coef).groupBy("id").agg(F.sum("contribution").alias("t")).collect()}
    s = 2 * x[:, 0] - x[:, 1]
    assert np.allclose([got[i] for i in range(15)], s - s.mean())
