"""Band filters in pieces: equal to one filter over the whole series, wherever pieces end."""

from datetime import timedelta

import numpy as np
import pytest
from helpers import START, samples
from pyspark.sql import functions as F

from foreshock.operators import bands, signal
from foreshock.plans.forecast import ForecastPlan

RATE = 1 / 60
SLOW, FAST = ("slow", 0.0005, 0.002), ("fast", 0.003, 0.007)


def noise(n, seed=1):
    return np.random.default_rng(seed).normal(size=n) + 1000.0


def whole_series(x, low, high, rate):
    """One spectrum of the padded series, as a filter without pieces has it."""
    pad = 1 << 16
    padded = np.zeros(pad * 2)
    padded[pad // 2 : pad // 2 + len(x)] = x
    freq = np.fft.rfftfreq(len(padded), 1 / rate)
    return np.fft.irfft(np.fft.rfft(padded) * bands.gain(freq, low, high), len(padded))[pad // 2 : pad // 2 + len(x)]


def filtered(df, some, **kw):
    rows = bands.bandpass(df, some, RATE, **kw).orderBy("band", "ts").collect()
    return {b: np.array([np.nan if r["x"] is None else r["x"] for r in rows if r["band"] == b]) for b, _, _ in some}


def test_pieces_equal_one_filter_over_all_days(spark):
    x = noise(4 * 1440) - 1000.0
    got = filtered(samples(spark, [float(v) for v in x]), [SLOW, FAST], piece=1300)
    for name, low, high in (SLOW, FAST):
        want = whole_series(x, low, high, RATE)
        assert len(got[name]) == len(x)
        assert np.abs(got[name] - want).max() < 2e-3 * want.std()


def test_results_do_not_depend_on_the_pieces(spark):
    df = samples(spark, [float(v) for v in noise(3000)])
    small, large = filtered(df, [SLOW, FAST], piece=1250), filtered(df, [SLOW, FAST])
    for name in small:
        assert np.abs(small[name] - large[name]).max() < 1e-8


def test_kernel_is_blind_to_a_constant(spark):
    halo = bands.halo_samples(0.0005, 0.002, RATE, 1e-6)
    assert abs(bands.kernel(0.0005, 0.002, RATE, halo).sum()) < 1e-12
    got = filtered(samples(spark, [5e6] * 3000), [SLOW], piece=1300)["slow"]
    assert np.abs(got[halo:-halo]).max() < 1e-4


def test_missing_repeated_and_undated_rows(spark):
    x = [float(v) for v in noise(600)]
    base = samples(spark, x)
    late = [("s", "b0", START + timedelta(minutes=700), None), ("s", "b0", START + timedelta(minutes=701), float("nan")), ("s", "b0", None, 3.0)]
    odd = base.unionByName(spark.createDataFrame(late, base.schema)).unionByName(base)
    out = bands.bandpass(odd, [FAST], RATE)
    assert out.count() == 1202 and out.where("x is null").count() == 2 and out.where("isnan(x)").count() == 0
    got = out.where("x is not null").groupBy("ts").agg(F.max("x").alias("v"), F.min("x").alias("w")).orderBy("ts").collect()
    want = filtered(base, [FAST])["fast"]
    assert np.abs(np.array([r["v"] for r in got]) - want).max() < 1e-9 and all(r["v"] == r["w"] for r in got)
    assert bands.bandpass(base.limit(0), [FAST], RATE).count() == 0


def test_many_series_and_columns_of_other_names(spark):
    a = samples(spark, [float(v) for v in noise(500, 2)]).withColumn("_place", F.lit("mine"))
    b = a.withColumn("series", F.lit(None).cast("string"))
    out = bands.bandpass(a.unionByName(b), [FAST], RATE)
    assert out.columns == ["series", "band", "ts", "x"]
    assert out.groupBy("series").count().count() == 2 and out.count() == 1000


def test_plan_sends_samples_once(spark, tmp_path):
    samples(spark, [float(v) for v in noise(100)]).write.parquet(str(tmp_path / "s"))
    plan = bands.bandpass(spark.read.parquet(str(tmp_path / "s")), [SLOW, FAST], RATE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_arguments(spark):
    df = samples(spark, [1.0])
    for bad in ([], [("a", 0.0, 0.1)], [("a", 0.2, 0.1)], [("a", 0.001, 9.0)], [FAST, FAST]):
        with pytest.raises(ValueError):
            bands.bandpass(df, bad, RATE)
    with pytest.raises(ValueError, match="at least"):
        bands.bandpass(df, [SLOW], RATE, piece=10)


def test_plan_calculates_from_unfiltered_samples(spark):
    t = np.arange(2 * 1440)
    x = np.sin(2 * np.pi * 0.001 * t * 60) * 50 + np.sin(2 * np.pi * 0.005 * t * 60) * 3
    plan = ForecastPlan(bands=["slow", "fast"], window_s=3600, methods=("rsam", "entropy"), filters=[SLOW, FAST], rate=RATE, entropy_band="slow")
    got = plan.calculate(samples(spark, [float(v) for v in x], band="raw"))
    mid = {r["metric"]: r["v"] for r in got.groupBy("metric").agg(F.percentile("v", 0.5).alias("v")).collect()}
    assert abs(mid["rsam_f0"] - 50 * 2 / np.pi) < 2 and abs(mid["rsam_f1"] - 3 * 2 / np.pi) < 0.2
    direct = signal.tremor_table(bands.bandpass(samples(spark, [float(v) for v in x]), [SLOW, FAST], RATE), 3600, ["slow", "fast"], ("rsam",))
    want = {r["ts"]: r["rsam_f1"] for r in direct.collect()}
    for r in got.where("metric = 'rsam_f1'").collect():
        assert abs(r["v"] - want[r["ts"]]) < 1e-6
    with pytest.raises(ValueError):
        ForecastPlan(bands=["slow"], filters=[FAST], rate=RATE).calculate(samples(spark, [1.0]))


def test_window_metrics_filter_once(spark, tmp_path):
    from foreshock.operators import onepass

    samples(spark, [float(v) for v in noise(3000)]).write.parquet(str(tmp_path / "s"))
    raw = spark.read.parquet(str(tmp_path / "s"))
    df = onepass.reduced(bands.bandpass(raw, [SLOW, FAST], RATE), 3600)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("FlatMapGroupsIn") == 1
