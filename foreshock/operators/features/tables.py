"""Calculators that need a second grouping inside the slice.

Each first derives a small table keyed by (series, id, metric, something): lags,
distinct values, bins, digits.  The second key refines the first, so grouping
again needs no further shuffle.  Calculators on whole slices are in ``arrays``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.expr import correlation, safe_divide
from foreshock.operators.features.rows import CHUNK_LENGTHS, KEYS, MAX_LAG, to_long

# Parameter grids of the calculators.
AUTOCORR_LAGS = list(range(10))
BINS = 10


def whole():
    return Window.partitionBy(*KEYS)


def order():
    return whole().orderBy("pos")


Wanted = Callable[[str], bool]


def _kept(aggs: dict[str, Column], wanted: Wanted) -> dict[str, Column]:
    return {k: c for k, c in aggs.items() if wanted(k)}


def _finish(grouped, aggs: dict[str, Column]) -> DataFrame | None:
    if not aggs:
        return None
    return to_long(grouped.agg(*[c.alias(k) for k, c in aggs.items()]), list(aggs))


def autocorrelations(matrix: DataFrame, lags: list[int]) -> DataFrame:
    """``(keys, n, lag, r)``: unbiased autocorrelation at each lag below ``n``."""
    m = F.avg("v").over(whole())
    shifted = matrix.withColumn("z", F.col("v") - m)
    shifted = shifted.withColumns({f"z{k}": F.lead("z", k).over(order()) for k in lags if k})
    var = F.var_pop("z")
    cells = [
        F.struct(
            F.lit(k).alias("lag"),
            safe_divide(F.avg(F.col("z") * F.col(f"z{k}" if k else "z")), var).alias("r"),
        )
        for k in lags
    ]
    wide = shifted.groupBy(*KEYS).agg(F.max("n").alias("n"), F.array(*cells).alias("_a"))
    return wide.select(*KEYS, "n", F.inline("_a"))


def autocorrelation_features(matrix: DataFrame, wanted: Wanted) -> DataFrame | None:
    r = F.col("r")

    def at(k: int) -> Column:
        return F.max(F.when(F.col("lag") == k, r))

    aggs = {f"autocorrelation__lag_{k}": at(k) for k in AUTOCORR_LAGS}
    inner = F.when((F.col("lag") >= 1) & (F.col("lag") < F.col("n")), r)
    for name, fn in (("mean", F.avg), ("median", F.median), ("var", F.var_pop)):
        aggs[f'agg_autocorrelation__f_agg_"{name}"__maxlag_{MAX_LAG}'] = fn(inner)
    r1, r2 = at(1), at(2)
    aggs["partial_autocorrelation__lag_0"] = F.when(F.max(F.col("lag")) >= 0, 1.0)
    aggs["partial_autocorrelation__lag_1"] = r1
    aggs["partial_autocorrelation__lag_2"] = safe_divide(r2 - r1 * r1, 1 - r1 * r1)
    aggs = _kept(aggs, wanted)
    if not aggs:
        return None
    lags = range(MAX_LAG + 1) if any(k.startswith("agg_") for k in aggs) else AUTOCORR_LAGS
    return _finish(autocorrelations(matrix, list(lags)).groupBy(*KEYS), aggs)


def chunk_trends(matrix: DataFrame, wanted: Wanted) -> DataFrame | None:
    """Linear trend of per-chunk statistics."""
    parts = []
    for length in CHUNK_LENGTHS:
        chunk = matrix.groupBy(*KEYS, F.floor(F.col("pos") / length).cast("double").alias("chunk")).agg(
            F.max("v").alias("max"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")
        )
        aggs: dict[str, Column] = {}
        for fn in ("max", "min", "mean", "var"):
            x, y = F.col("chunk"), F.col(fn)
            r, c = correlation(y, x), F.count(y)
            stem = f'agg_linear_trend__attr_"%s"__chunk_len_{length}__f_agg_"{fn}"'
            many = F.when(c > 1, 1.0)
            aggs[stem % "slope"] = F.regr_slope(y, x) * many
            aggs[stem % "intercept"] = F.regr_intercept(y, x) * many
            aggs[stem % "rvalue"] = r * many
            aggs[stem % "stderr"] = F.when(
                c > 2, F.sqrt((1 - r * r) * F.var_pop(y) / F.nullif(F.var_pop(x), F.lit(0.0)) / F.nullif(c - 2, F.lit(0)))
            )
        parts.append(_finish(chunk.groupBy(*KEYS), _kept(aggs, wanted)))
    return _union(parts)


def repeated_values(matrix: DataFrame, wanted: Wanted) -> DataFrame | None:
    """Features of the table of distinct values."""
    x, c = F.col("v"), F.col("c")
    again = c > 1
    aggs = {
        "has_duplicate": F.max(F.when(again, 1.0).otherwise(0.0)),
        "percentage_of_reoccurring_datapoints_to_all_datapoints": F.sum(F.when(again, c).otherwise(0)) / F.sum(c),
        "percentage_of_reoccurring_values_to_all_values": F.avg(F.when(again, 1.0).otherwise(0.0)),
        "sum_of_reoccurring_data_points": F.sum(F.when(again, x * c).otherwise(0.0)),
        "sum_of_reoccurring_values": F.sum(F.when(again, x).otherwise(0.0)),
        "ratio_value_number_to_time_series_length": F.count("*") / F.sum(c),
    }
    aggs = _kept(aggs, wanted)
    if not aggs:
        return None
    counts = matrix.groupBy(*KEYS, "v").agg(F.count("*").alias("c"))
    return _finish(counts.groupBy(*KEYS), aggs)


def _entropy(counts: DataFrame) -> Column:
    p = F.col("c") / F.col("total")
    return F.sum(-p * F.log(p)) + F.lit(0.0)


def _with_total(counts: DataFrame) -> DataFrame:
    return counts.withColumn("total", F.sum("c").over(whole()))


def binned_entropy(matrix: DataFrame, wanted: Wanted) -> DataFrame | None:
    name = f"binned_entropy__max_bins_{BINS}"
    if not wanted(name):
        return None
    lo, hi = F.min("v").over(whole()), F.max("v").over(whole())
    bins = matrix.withColumns({"lo": lo, "hi": hi}).withColumn(
        "bin",
        F.when(F.col("hi") == F.col("lo"), 0).otherwise(
            F.least(
                F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * BINS),
                F.lit(BINS - 1),
            )
        ),
    )
    counts = _with_total(bins.groupBy(*KEYS, "bin").agg(F.count("*").alias("c")))
    return _finish(counts.groupBy(*KEYS), {name: _entropy(counts)})


def benford(matrix: DataFrame, wanted: Wanted) -> DataFrame | None:
    """Correlation of leading-digit shares with log10(1 + 1/d)."""
    if not wanted("benford_correlation"):
        return None
    a = F.abs("v")
    digit = F.floor(a / F.pow(F.lit(10.0), F.floor(F.log10(F.nullif(a, F.lit(0.0))))) + F.lit(1e-9))
    digits = matrix.withColumn("digit", digit)
    shares = [
        F.struct(
            F.avg(F.when(F.col("digit") == d, 1.0).otherwise(0.0)).alias("share"),
            F.lit(math.log10(1 + 1 / d)).alias("law"),
        )
        for d in range(1, 10)
    ]
    table = digits.groupBy(*KEYS).agg(F.array(*shares).alias("_s")).select(*KEYS, F.inline("_s"))
    return _finish(table.groupBy(*KEYS), {"benford_correlation": correlation("share", "law")})


def longest_runs(matrix: DataFrame, wanted: Wanted) -> DataFrame | None:
    """Longest consecutive stretch above and below the mean."""
    parts = []
    m = F.avg("v").over(whole())
    for side, cond in (("above", F.col("v") > F.col("m")), ("below", F.col("v") < F.col("m"))):
        name = f"longest_strike_{side}_mean"
        if not wanted(name):
            continue
        flagged = matrix.withColumn("m", m).withColumn("hit", cond)
        island = F.col("pos") - F.sum(F.when(F.col("hit"), 1).otherwise(0)).over(
            order().rowsBetween(Window.unboundedPreceding, 0)
        )
        runs = flagged.withColumn("island", island).groupBy(*KEYS, "island").agg(
            F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("run")
        )
        parts.append(_finish(runs.groupBy(*KEYS), {name: F.max("run").cast("double")}))
    return _union(parts)


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    frames = [p for p in parts if p is not None]
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


TABLES: dict[str, Callable[[DataFrame, Wanted], DataFrame | None]] = {
    "autocorrelation": autocorrelation_features,
    "chunk_trend": chunk_trends,
    "repeats": repeated_values,
    "runs": longest_runs,
    "binned_entropy": binned_entropy,
    "benford": benford,
}

# Calculators of each family, so that a family nobody asked for is not built.
CALCULATORS: dict[str, list[str]] = {
    "autocorrelation": ["autocorrelation", "agg_autocorrelation", "partial_autocorrelation"],
    "chunk_trend": ["agg_linear_trend"],
    "repeats": [
        "has_duplicate",
        "percentage_of_reoccurring_datapoints_to_all_datapoints",
        "percentage_of_reoccurring_values_to_all_values",
        "sum_of_reoccurring_data_points",
        "sum_of_reoccurring_values",
        "ratio_value_number_to_time_series_length",
    ],
    "runs": ["longest_strike_above_mean", "longest_strike_below_mean"],
    "binned_entropy": ["binned_entropy"],
    "benford": ["benford_correlation"],
}
