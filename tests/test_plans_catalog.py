import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foreshock import bindings as B
from foreshock.plans.forecast import ForecastPlan

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120


def test_entry(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize(
    "name", ["rsam", "label_standard", "lookback_matrix", "features_moments", "threshold_sweep", "event_picks", "score_seeds", "scenario_grid"]
)
def test_no_nested_loops(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_samples_are_read_once_and_narrow(spark):
    plan = plan_of(entry.queries()["rsam"](spark, SF))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>", plan)
    # Partial aggregation before the only shuffle.
    assert plan.count("Exchange") == 1 and "partial_stddev_pop" in plan


def test_features_share_one_shuffle(spark):
    plan = plan_of(entry.queries()["features_changes"](spark, SF))
    outer = plan.split("InMemoryTableScan")[0]
    assert outer.count("hashpartitioning(series#") - outer.count("ReusedExchange") <= 4


def test_pipeline_end_to_end(spark):
    names = [f"rsam_f{i}__{c}" for i in range(2) for c in ("mean", "maximum")]
    plan = ForecastPlan(B.BANDS, window_s=3600, methods=["rsam"], feature_names=names, min_day_ratio=0.0)
    tremor = plan.calculate(B.samples(spark, SF)).cache()
    assert tremor.where("v is null").count() == 0
    truth = plan.label(B.event_dates(spark), "2024-01-04", "2024-01-28").cache()
    features = plan.features(tremor, truth).cache()
    plan.train(features, truth, ["lr", "dt"], [0, 1], top_n=4)
    out = plan.predict(features)
    assert out.where((F.col("consensus_probability") < 0) | (F.col("consensus_probability") > 1)).count() == 0
    assert plan.evaluate(features, truth).count() == 4
    assert plan.explain(features, truth, B.event_dates(spark), 2).groupBy("classifier", "event_date").count().count() == 8
