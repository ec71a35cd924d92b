"""Look-backs from shared panes equal those from multiplied rows."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreshock.operators import lookback, panes
from foreshock.operators.features import extract
from tests.helpers import START, long


def labels(spark, hours, series="s"):
    rows = [(series, i, START + timedelta(hours=h)) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "series string, id long, ts timestamp")


def tremor(spark):
    rng = np.random.default_rng(3)
    a = [float(v) for v in rng.lognormal(0, 1, 24 * 12)]
    a[30] = a[200] = None
    b = [2.5] * 100 + [float(v) for v in np.round(rng.standard_normal(100), 1)]
    first = long(spark, a, 1800, "m").unionByName(long(spark, b, 1800, "k", START + timedelta(hours=10)))
    return first.unionByName(long(spark, a[:60], 1800, "m", START + timedelta(hours=200), series="z"))


def table(df):
    return {(r["series"], r["id"], r["feature"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize(("days", "step", "ratio"), [(1, 3600, 1.0), (0.5, 7200, 0.3), (2, 1800, 0.9), (1, 86400, 0.5)])
def test_equal_to_multiplied_rows(spark, days, step, ratio):
    t = tremor(spark)
    y = labels(spark, range(0, 260, max(1, step // 3600))).unionByName(labels(spark, range(190, 240, 24 if step == 86400 else 2), "z").where(F.unix_seconds("ts") % step == 0))
    y = y.where(F.unix_seconds("ts") % step == 0)
    matrix = lookback.lookback_matrix(t, y, days, step, 1800, ratio)
    want = table(extract.extract_features(matrix, exclude=(), families=["moments"]))
    got = table(panes.pane_features(t, y, days, step, 1800, ratio))
    assert len(want) > 50 and got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None), k
        assert v is None or np.isclose(got[k], v, rtol=1e-9, atol=1e-9), (k, v, got[k])


def test_only_wanted_and_no_values_kept(spark):
    t, y = tremor(spark), labels(spark, range(24, 100))
    df = panes.pane_features(t, y, 1, 3600, 1800, wanted=lambda n: n in ("mean", "kurtosis"))
    assert {r["feature"] for r in df.select("feature").distinct().collect()} == {"m__mean", "m__kurtosis", "k__mean", "k__kurtosis"}
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        panes.pane_features(t, y, 1, 3600, 1800, wanted=lambda n: False)
    with pytest.raises(ValueError):
        panes.pane_features(t, y, 1, 7000, 1800)
    off = y.withColumn("ts", F.col("ts") + F.expr("interval 1 minute"))
    with pytest.raises(Exception, match="multiples of the step"):
        panes.pane_features(t, off, 1, 3600, 1800).collect()


def test_rows_are_not_multiplied_by_windows(spark):
    """A row reaches at most two blocks, whatever the number of look-backs that hold it."""
    t = tremor(spark)
    width = panes.grid_steps(1, 1800)
    copied = panes._in_blocks(panes.pane_states(t, 1800), width).count()
    assert copied <= 2 * t.count() and lookback.slices(t, labels(spark, np.arange(0, 150, 0.5)), 1, 1800).count() > 20 * t.count()


def test_arrays_and_slice_features_equal_the_matrix(spark):
    t, y = tremor(spark).where("v is not null"), labels(spark, range(24, 90, 3))
    want = {(r["id"], r["metric"]): r["values"] for r in lookback.window_arrays(lookback.lookback_matrix(t, y, 1, 3600, 1800, 0.5)).collect()}
    got = {(r["id"], r["metric"]): r["v"] for r in panes.pane_arrays(t, y, 1, 3600, 1800, 0.5).collect()}
    assert got == want and len(got) > 30
    families = ["fft", "permutation_entropy"]
    a = table(panes.grid_features(t, y, 1, 3600, 1800, families, 0.5))
    b = table(extract.extract_features(lookback.lookback_matrix(t, y, 1, 3600, 1800, 0.5), families=families))
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (b[k] is None or np.isclose(a[k], b[k])) for k in b)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_sliding_merges_equal_direct_moments(width):
    rng = np.random.default_rng(width)
    cells = [rng.standard_normal(rng.integers(0, 4)) for _ in range(4 * width)]
    states = panes.empty_states((4 * width,))
    for i, v in enumerate(cells):
        if len(v):
            z = v - v.mean()
            for k, x in zip(panes.STATE, [len(v), len(v), v.sum(), (v**2).sum(), v.mean(), (z**2).sum(), (z**3).sum(), (z**4).sum(), v.min(), v.max()], strict=True):
                states[k][i] = x
    got = panes.sliding(states, width)
    for s in range(3 * width + 1):
        v = np.concatenate(cells[s : s + width])
        assert got["c"][s] == len(v)
        if len(v):
            z = v - v.mean()
            for k, x in (("m", v.mean()), ("m2", (z**2).sum()), ("m3", (z**3).sum()), ("m4", (z**4).sum()), ("lo", v.min()), ("hi", v.max())):
                assert np.isclose(got[k][s], x, atol=1e-12)
