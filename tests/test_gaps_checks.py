from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foreshock.operators import checks, gaps
from tests.helpers import START, column, long


def test_interpolation_edges(spark):
    df = long(spark, [None, 2.0, None, 6.0, None])
    assert column(gaps.interpolate_time(df, both=True)) == [2.0, 2.0, 4.0, 6.0, 6.0]
    assert column(gaps.interpolate_time(df, both=False)) == [None, 2.0, 4.0, 6.0, 6.0]
    assert column(gaps.interpolate_time(long(spark, [None, None]), both=True)) == [None, None]


def test_linear_by_position_differs_from_time(spark):
    rows = [("s", "m", START + timedelta(hours=h), v) for h, v in ((0, 0.0), (1, None), (10, 2.0))]
    df = spark.createDataFrame(rows, "series string, metric string, ts timestamp, v double")
    assert column(gaps.interpolate_linear(df)) == [0.0, 1.0, 2.0]
    assert column(gaps.interpolate_time(df)) == pytest.approx([0.0, 0.2, 2.0])


def test_gap_across_months(spark):
    values = [1.0] + [None] * (24 * 70) + [2.0]
    got = column(gaps.interpolate_time(long(spark, values)))
    assert np.allclose(got, np.linspace(1, 2, len(values)))


def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=24 * 75)
    got = column(gaps.rolling_stat(long(spark, [float(v) for v in x]), 6 * 3600, "median"), "stat")
    s = pd.Series(x, index=pd.date_range(START, periods=len(x), freq="h"))
    assert np.allclose(got, s.rolling("6h", center=True).median())


def test_robust_anomalies(spark):
    assert column(gaps.robust_anomalies(long(spark, [1.0, 1.1, 0.9, 1.05, 50.0]), 3.5))[-1] is None
    assert column(gaps.robust_anomalies(long(spark, [1.0, 1.0, 1.0, 9.0]), 3.5))[-1] == 9.0
    with pytest.raises(ValueError):
        gaps.robust_anomalies(long(spark, [1.0]), 0)


def checked(spark, hours):
    rows = [("s", START + timedelta(hours=h)) for h in hours]
    return checks.check_sampling(spark.createDataFrame(rows, "series string, ts timestamp"), 3600, 60)


def test_sampling_check(spark):
    good = checks.sampling_summary(checked(spark, range(20))).first()
    assert (good["is_consistent"], good["good_rows"], good["rate_s"]) == (True, 20, 3600)
    bad = checks.sampling_summary(checked(spark, [0, 1, 2, 2.5, 3, 4])).first()
    assert (bad["is_consistent"], bad["bad_rows"], bad["rate_s"]) == (False, 2, None)
    day = checks.sampling_summary(checked(spark, [0, 25])).first()
    assert day["bad_rows"] == 1
    with pytest.raises(Exception, match="at least 2 rows"):
        checks.sampling_summary(checked(spark, [0])).collect()


def test_select_and_clip(spark):
    wide = spark.createDataFrame([("s", START, 1.0)], "series string, ts timestamp, a double")
    with pytest.raises(ValueError, match="missing"):
        checks.select_metrics(wide, ["nope"])
    df = long(spark, [1.0, 5.0], metric="rsam_f0")
    assert column(checks.clip_above(df, "rsam", 5.0)) == [1.0, None]
    assert checks.trim_buffer(df, "2025-01-02").count() == 0
    assert checks.slice_dates(df, "2025-01-01", "2025-01-01").count() == 2
    assert df.where(F.col("v") > 0).count() == 2
