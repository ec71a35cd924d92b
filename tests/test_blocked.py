import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foreshock.functions.blocked import (
    average_ranks,
    carry_back,
    exact_quantiles,
    neighbours,
    running_sum,
    time_block,
    value_histogram,
)
from tests.helpers import long


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.4 else float(round(x, 3)) for x in rng.normal(size=3000)]
    return long(spark, values).withColumn("b", time_block("ts", "month")).cache()


def test_blocks_equal_plain_windows(walk):
    w = Window.partitionBy("series", "metric").orderBy("ts")
    lagged = carry_back(walk, ["series", "metric"], "b", "ts", ["v"]).withColumn("plain", F.lag("v").over(w))
    assert lagged.where(~F.col("prev_v").eqNullSafe(F.col("plain"))).count() == 0
    total = running_sum(walk, ["series", "metric"], "b", "ts", {"t": F.coalesce("v", F.lit(0.0))})
    total = total.withColumn("plain", F.sum(F.coalesce("v", F.lit(0.0))).over(w))
    assert total.where(F.abs(F.col("t") - F.col("plain")) > 1e-9).count() == 0
    near = neighbours(walk, ["series", "metric"], "b", "ts", "v")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = w.rowsBetween(0, Window.unboundedFollowing)
    near = near.withColumns({"p": F.last("v", True).over(up), "q": F.first("v", True).over(down)})
    assert near.where(~F.col("lo_v").eqNullSafe(F.col("p")) | ~F.col("hi_v").eqNullSafe(F.col("q"))).count() == 0


@pytest.mark.parametrize("slices", [2, 64])
def test_histogram_is_exact_under_skew(spark, slices):
    rng = np.random.default_rng(5)
    # A third of all rows share one value of one key.
    values = np.concatenate([np.full(1000, 0.5), rng.random(1500).round(3), rng.normal(size=500)])
    keys = ["hot"] * 2500 + ["cold"] * 500
    df = spark.createDataFrame(list(zip(keys, map(float, values))), "k string, x double")
    got = {(r["k"], r["x"]): (r["n"], r["n_before"], r["n_all"]) for r in value_histogram(df, ["k"], "x", {"n": F.lit(1)}, slices).collect()}
    for k in ("hot", "cold"):
        x = np.array([v for kk, v in zip(keys, values) if kk == k])
        for v in np.unique(x):
            assert got[(k, v)] == (int((x == v).sum()), int((x < v).sum()), len(x))


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 50, 501).astype(float)
    df = spark.createDataFrame([("k", float(v)) for v in x], "k string, x double")
    row = exact_quantiles(df, ["k"], "x", {"a": 0.25, "m": 0.5, "z": 0.9}).first()
    assert np.allclose([row["a"], row["m"], row["z"]], np.quantile(x, [0.25, 0.5, 0.9]))
    ranks = {r["x"]: r["avg_rank"] for r in average_ranks(df, ["k"], "x").collect()}
    order = np.sort(x)
    for v, r in ranks.items():
        where = np.flatnonzero(order == v) + 1
        assert r == where.mean()
