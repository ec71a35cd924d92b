from datetime import timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foreshock.operators import signal
from tests.helpers import START, column, events_with_a_day_of_zeros, samples


def test_maximum_outlier_goes_and_ties_keep_one(spark):
    base = [1.0 + 0.01 * (i % 7) for i in range(58)]
    one = samples(spark, base + [1e6])
    kept = signal.drop_max_outlier(one, 3600)
    assert kept.count() == 58 and kept.agg(F.max("x")).first()[0] < 2
    tied = samples(spark, base[:40] + [1e6] + base[:17] + [1e6])
    left = signal.drop_max_outlier(tied, 3600).where("x > 1000").collect()
    assert len(left) == 1 and left[0]["ts"] == START + timedelta(minutes=58)
    assert signal.drop_max_outlier(samples(spark, [2.0] * 10), 3600).count() == 10
    with pytest.raises(ValueError):
        signal.drop_max_outlier(one, 3600, 0)


def test_zero_samples_are_not_used(spark):
    assert column(signal.rsam(samples(spark, [0.0, 2.0, 4.0]), 3600)) == [3.0]
    assert column(signal.rsam(samples(spark, [0.0, 0.0]), 3600)) == [None]


def test_windows_of_zeros_may_be_left_out(spark):
    df = samples(spark, [0.0, None, float("nan"), 2.0, -4.0, 0.0], step_s=1200)
    assert column(signal.rsam(df, 3600)) == [None, 3.0]
    assert column(signal.rsam(df, 3600, empty_windows=False)) == [3.0]


@pytest.mark.parametrize("name", ["rsam_many_series", "rsam", "write_table"])
def test_queries_of_window_means_equal_their_sql(spark, tmp_path, name):
    sf = events_with_a_day_of_zeros(tmp_path)
    got = [tuple(r) for r in entry.queries()[name](spark, sf).select("series", "band", "ts", "v").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.sql(f"SELECT series, band, ts, v FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and None not in [r[3] for r in got]


def test_one_pass_equals_two_pass(spark):
    rng = np.random.default_rng(1)
    df = samples(spark, [float(v) for v in rng.standard_t(2, 2000)], step_s=20)
    mag = df.withColumn("x", F.abs("x"))
    two = signal.drop_max_outlier(mag, 3600).groupBy("window_start").agg(F.avg("x").alias("v"))
    a = column(signal.rsam(df, 3600))
    b = column(two, order="window_start")
    assert np.allclose(a, b)


def test_completeness_rule(spark):
    df = samples(spark, [1.0] * 10)
    assert column(signal.rsam(df, 3600, expected=60)) == [None]
    assert column(signal.rsam(df, 3600, expected=30)) == [1.0]
    assert column(signal.rsam(df, 3600, multiplier=5.0)) == [5.0]


def test_window_metric_options(spark):
    df = samples(spark, [1.0, -3.0, 2.0])
    assert column(signal.window_metric(df, 3600, F.max)) == [3.0]
    assert column(signal.window_metric(df, 3600, F.max, absolute=False)) == [2.0]
    with pytest.raises(ValueError):
        signal.window_metric(df, 3600, outliers="some")
    with pytest.raises(ValueError):
        signal.window_metric(df, 7000)


def test_entropy_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(5, 2, 50))
    got = column(signal.shannon_entropy(samples(spark, [float(v) for v in x]), 3600))
    z = (x.max() - x.mean()) / x.std()
    y = x[x < x.max()] if z > 3 else x
    p = np.exp(-(((y - y.mean()) / y.std()) ** 2) / 2) / (y.std() * np.sqrt(2 * np.pi))
    assert np.isclose(got[0], -(p * np.log2(p)).sum())
    with_zero = samples(spark, [float(v) for v in x] + [0.0])
    assert column(signal.shannon_entropy(with_zero, 3600, strict=True)) == [None]
    assert column(signal.shannon_entropy(samples(spark, [0.01, 0.02]), 3600)) == [None]


def test_integral_restarts_each_day(spark):
    start = START + timedelta(hours=23, minutes=58)
    got = column(signal.integrate(samples(spark, [1.0, 3.0, 5.0, 7.0], start=start)), "x")
    assert got == [0.0, 120.0, 0.0, 360.0]


def test_dsar_needs_two_bands(spark):
    with pytest.raises(ValueError):
        signal.adjacent_ratio(signal.rsam(samples(spark, [1.0]), 3600), ["b0"])
    a = samples(spark, [4.0], band="b0").unionByName(samples(spark, [2.0], band="b1"))
    row = signal.adjacent_ratio(signal.rsam(a, 3600), ["b0", "b1"], 10.0).first()
    assert (row["metric"], row["v"]) == ("dsar_f0-f1", 20.0)


def test_chunks_stay_in_their_day(spark):
    df = samples(spark, [1.0, 2.0], step_s=3600, start=START + timedelta(hours=22, minutes=30))
    got = signal.chunk_windows(df, 7200, 50.0)
    assert got.select("window_start").distinct().count() == 23
    assert got.where("x = 2").count() == 1 and got.where("x = 1").count() == 2
    with pytest.raises(ValueError):
        signal.chunk_windows(df, 7200, 100.0)


def test_bandpass_keeps_only_its_tone(spark):
    rate, n = 0.1, 8640
    t = np.arange(n) / rate
    x = np.sin(2 * np.pi * 0.002 * t) + np.sin(2 * np.pi * 0.03 * t)
    df = samples(spark, [float(v) for v in x], step_s=10)
    out = signal.bandpass(df, [("low", 0.001, 0.004), ("high", 0.02, 0.045)], rate)
    power = {r["band"]: r["p"] for r in out.groupBy("band").agg(F.avg(F.col("x") * F.col("x")).alias("p")).collect()}
    assert abs(power["low"] - 0.5) < 0.05 and abs(power["high"] - 0.5) < 0.05


def test_tremor_table_covers_missing_day(spark):
    two = samples(spark, [1.0, 2.0], step_s=2 * 86400)
    wide = signal.tremor_table(two, 3600, ["b0"], ["rsam"])
    assert wide.count() == 72 and wide.where("rsam_f0 is not null").count() == 2
    assert signal.drop_incomplete_days(wide, 3600, 0.03).select(F.to_date("ts")).distinct().count() == 2
