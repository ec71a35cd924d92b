from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foreshock.functions.expr import literal_table
from foreshock.operators import labels as L
from foreshock.operators import lookback
from tests.helpers import long


def dates(spark, *days):
    return literal_table(spark, "d", list(days)).select(F.lit("all").alias("series"), F.to_date("d").alias("event_date"))


def positives(df):
    return [r["ts"] for r in df.where("is_erupted = 1").orderBy("ts").collect()]


def test_grid_and_positive_range(spark):
    y = L.label_standard(spark, dates(spark, "2020-01-10"), "2020-01-01", "2020-01-15", 12)
    assert y.count() == 30 and [r["id"] for r in y.orderBy("ts").collect()] == list(range(30))
    assert positives(y) == [datetime(2020, 1, d, h) for d in (9, 10) for h in (0, 12)]
    out = L.label_standard(spark, dates(spark, "2020-01-10"), "2020-01-01", "2020-01-15", 12, include=False)
    assert positives(out)[0] == datetime(2020, 1, 8)


def test_event_outside_grid(spark):
    grid = L.label_grid(spark, "2020-01-01", "2020-01-15", 12)
    after = L.label_events(grid, dates(spark, "2020-01-16"), 2)
    assert positives(after) == []
    last = L.label_events(grid, dates(spark, "2020-01-15"), 2)
    assert len(positives(last)) == 4
    with pytest.raises(Exception, match="no event"):
        L.label_standard(spark, dates(spark, "2021-01-01"), "2020-01-01", "2020-01-15", 12).collect()


def test_argument_errors(spark):
    with pytest.raises(ValueError):
        L.label_grid(spark, "2020-01-01", "2020-01-15", 1, "days")
    with pytest.raises(ValueError):
        L.label_grid(spark, "2020-01-15", "2020-01-01", 1)
    with pytest.raises(Exception, match="exceeds"):
        L.label_grid(spark, "2020-01-01", "2020-01-02", 72).collect()


def test_dynamic_grids_merge(spark):
    y = L.label_dynamic(dates(spark, "2020-01-10", "2020-01-12"), 7, 6)
    assert y.count() == 10 * 4
    assert [r["id"] for r in y.orderBy("ts").collect()] == list(range(40))
    assert len(positives(y)) == 4 * 4


def test_split_is_clamped(spark):
    def test_part(size, *days):
        return [str(r["event_date"]) for r in L.split_events(dates(spark, *days), size).where("part = 'test'").orderBy("event_date").collect()]

    days = [f"2020-01-{d:02d}" for d in (1, 2, 3, 4, 5)]
    assert test_part(0.2, *days) == ["2020-01-05"]
    assert test_part(0.0, *days) == ["2020-01-05"]
    assert len(test_part(1.0, *days)) == 4


def test_attach_datetime_length(spark):
    y = L.label_grid(spark, "2020-01-01", "2020-01-03", 12)
    assert L.attach_datetime(y.drop("ts", "is_erupted"), y).count() == 6
    with pytest.raises(Exception, match="differ in length"):
        L.attach_datetime(y.where("id > 0").drop("ts", "is_erupted"), y).collect()


def test_lookback_both_join_forms_agree(spark):
    tremor = long(spark, [float(i) for i in range(24 * 8)], series="all")
    y = L.label_grid(spark, "2025-01-01", "2025-01-08", 6)
    a = lookback.slices(tremor, y, 2, 6 * 3600)
    b = lookback.slices(tremor, y, 2, 7 * 3600)  # step does not divide a day: day-bucket join
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    full = lookback.lookback_matrix(tremor, y, 2, 6 * 3600, 3600)
    assert full.select("id").distinct().count() == 32 - 8
    first = full.where("id = 8").orderBy("pos").collect()
    assert (first[0]["v"], first[-1]["v"], len(first)) == (0.0, 47.0, 48)


def test_union_of_metrics_equals_matrix(spark, tmp_path):
    tremor = long(spark, [1.0] * 96, series="all").unionByName(long(spark, [2.0] * 96, metric="k", series="all"))
    y = L.label_grid(spark, "2025-01-03", "2025-01-04", 12)
    both = lookback.lookback_matrix(tremor, y, 2, 43200, 3600)
    single = lookback.lookback_matrix(tremor, y, 2, 43200, 3600, metrics=["k"])
    assert both.where("metric = 'k'").exceptAll(single).count() == 0
    lookback.matrix_per_metric(both, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "metric=k")).count() == single.count()
