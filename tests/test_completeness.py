"""Nothing is lost without notice: late rows, missing values, absent names, far tails."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foreshock.operators import lookback, scoring, selection, training
from foreshock.operators.features.extract import extract_features
from foreshock.streaming.score import forecast_sink

START = datetime(2024, 1, 1)
SCHEMA = "series string, metric string, ts timestamp, v double"
NAME = "m__mean"


def hours(spark, values):
    return spark.createDataFrame([("s", "m", START + timedelta(hours=h), float(v)) for h, v in values], SCHEMA)


def linear(spark):
    weights = spark.createDataFrame([("c", 0, NAME, 1.0), ("c", 0, "intercept", 0.0)], "classifier string, seed int, feature string, coef double")
    return lambda features: scoring.score_linear(features, weights)


def forecasts(spark, path, batches):
    sink = forecast_sink(f"{path}/tremor", f"{path}/forecast", linear(spark), [NAME], 1, 6 * 3600, 3600)
    for i, b in enumerate(batches):
        sink(hours(spark, b), i)
    rows = spark.read.parquet(f"{path}/forecast").select("id", "probability").collect()
    return {r["id"]: round(r["probability"], 9) for r in rows}


def test_late_and_corrected_rows_give_the_forecasts_of_one_run(spark, tmp_path):
    value = {h: (h * 7 % 11) / 10 for h in range(96)}
    first = [(h, value[h]) for h in range(48) if h not in (10, 30)] + [(30, 49.0)]
    later = [(h, value[h]) for h in range(48, 96)]
    parts = [first, later, [(10, value[10])], [(30, value[30])]]
    piecewise = forecasts(spark, str(tmp_path / "a"), parts)
    whole = forecasts(spark, str(tmp_path / "b"), [list(value.items())])
    assert piecewise == whole
    epoch = int((START - datetime(1970, 1, 1)).total_seconds()) // 21600
    assert set(whole) == {epoch + k for k in range(4, 17)}


def test_look_back_across_two_batches(spark, tmp_path):
    value = {h: float(h % 5) for h in range(60)}
    parts = [[(h, v) for h, v in value.items() if h < 31], [(h, v) for h, v in value.items() if h >= 31]]
    assert forecasts(spark, str(tmp_path / "a"), parts) == forecasts(spark, str(tmp_path / "b"), [list(value.items())])


def long_features(spark, rows):
    return spark.createDataFrame(rows, "series string, id long, feature string, value double")


def test_ids_with_missing_features_are_trained_and_forecast(spark):
    rows = [("s", i, n, float(i + k)) for i in range(20) for k, n in enumerate("ab")]
    rows += [("s", 90, "a", 5.0), ("s", 91, "a", None), ("s", 91, "b", float("inf")), ("s", 92, "a", float("nan")), ("s", 92, "b", float("-inf"))]
    features = long_features(spark, rows)
    fill = training.fill_values(features.where("id < 20"), ["a", "b"])
    assert fill == [(0.0, 9.5, 19.0), (1.0, 10.5, 20.0)]
    x = {r["id"]: r["x"] for r in training.matrix(features, ["a", "b"], fill).collect()}
    assert x[90] == [5.0, 10.5] and x[91] == [9.5, 20.0] and x[92] == [9.5, 1.0]
    labels = spark.createDataFrame([("s", i, int(i > 9)) for i in range(20)], "series string, id long, is_erupted int")
    models = training.train_ensemble(features, labels, ["lr"], [0], top_n=2, ratio=1.0)
    assert models[0].fill and training.score_seeds(models, features).select("id").distinct().count() == 23


def test_absent_feature_raises(spark):
    features = long_features(spark, [("s", 1, "a", 1.0)])
    with pytest.raises(ValueError, match="absent.*'b'"):
        training.matrix(features, ["a", "b"])


def test_one_pivot_for_all_models(spark):
    rows = [("s", i, n, float(i * (k + 1) % 7)) for i in range(30) for k, n in enumerate("ab")]
    features = long_features(spark, rows)
    y = spark.createDataFrame([("s", i, i % 2) for i in range(30)], "series string, id long, is_erupted int")
    data = training.matrix(features, ["a", "b"]).join(y, ["series", "id"]).cache()
    models = [training.fit_classifier("dt", data, ["a", "b"], s) for s in range(3)]
    plan = training.score_seeds(models, features)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 3 and plan.split("InMemoryRelation")[0].count("Scan ExistingRDD") == 0


def test_penalty_is_weighed_by_rows():
    assert training.penalty({"C": 2.0, "tol": 1}, 50) == {"regParam": 0.01, "tol": 1}
    assert training.grid_points("nb") == [{}]


def test_far_tails_are_ranked_by_the_statistic(spark):
    n = 4000
    rows = [("s", i, "z_perfect", float(i)) for i in range(n)]
    rows += [("s", i, "a_weaker", float(i if i % 3 else (i * 7919) % n)) for i in range(n)]
    labels = spark.createDataFrame([("s", i, int(i >= n // 2)) for i in range(n)], "series string, id long, is_erupted int")
    ranked = selection.fdr_filter(selection.rank_test(long_features(spark, rows), labels)).orderBy("rank").collect()
    assert [r["feature"] for r in ranked] == ["z_perfect", "a_weaker"]


def test_unknown_feature_names_raise(spark):
    m = lookback.lookback_matrix(
        hours(spark, [(h, h) for h in range(48)]),
        spark.createDataFrame([("s", 1, START + timedelta(days=2))], "series string, id long, ts timestamp"),
        2,
        21600,
        3600,
    )
    with pytest.raises(ValueError, match="unknown features.*nonsense"):
        extract_features(m, only=["m__mean", "m__nonsense"])
    with pytest.raises(ValueError, match="coeff_999"):
        extract_features(m, only=["m__mean", 'm__fft_coefficient__attr_"abs"__coeff_999'])


def test_no_common_feature_raises(spark):
    one, two = (
        spark.createDataFrame([(n, 1, 0.1, 0.0)], "feature string, frequency long, score_mean double, score_std double") for n in ("m__mean", "m__maximum")
    )
    with pytest.raises(ValueError, match="common"):
        selection.common_features({"a": one, "b": two})
    assert selection.common_features({"a": one, "b": one}).where(F.col("feature") == "m__mean").count() == 1
