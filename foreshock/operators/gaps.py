"""Anomaly removal, gap filling and smoothing of window metrics.

All functions take ``(series, metric, ts, v)``.  Long series are handled in
calendar blocks (see :mod:`foreshock.functions.blocked`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.blocked import (
    neighbours,
    running_sum,
    time_block,
    with_halo,
)
from foreshock.functions.expr import epoch, lerp
from foreshock.functions.reuse import join_back

KEYS = ["series", "metric"]


def robust_anomalies(
    df: DataFrame, threshold: float = 3.5, keys: Sequence[str] = KEYS, interpolate: bool = False
) -> DataFrame:
    """NULL where the modified z-score 0.6745 (v - median) / MAD exceeds ``threshold``.

    The exact medians are aggregates over window metrics, of which a series has
    one per window and metric, so the calendar bounds the group; add a day to
    ``keys`` to judge each day on its own.  For larger groups
    :func:`foreshock.functions.blocked.exact_quantiles` gives the same medians
    from several tasks.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    keys = list(keys)
    med = df.groupBy(*keys).agg(F.median("v").alias("_med"))
    dev = join_back(df, med, keys).withColumn("_dev", F.abs(F.col("v") - F.col("_med")))
    mad = dev.groupBy(*keys).agg(F.median("_dev").alias("_mad"))
    z = F.lit(0.6745) * F.col("_dev") / F.nullif("_mad", F.lit(0.0))
    out = join_back(dev, mad, keys).withColumn(
        "v", F.when(F.coalesce(z > F.lit(threshold), F.lit(False)), None).otherwise(F.col("v"))
    )
    out = out.select(*df.columns)
    return interpolate_time(out, both=False) if interpolate else out


def interpolate_time(df: DataFrame, both: bool = True, block: str = "month") -> DataFrame:
    """Fill NULLs linearly in time.

    ``both`` also extends the first value back to leading NULLs; trailing NULLs
    take the last value either way.
    """
    near = neighbours(df.withColumn("_block", time_block("ts", block)), KEYS, "_block", "ts", "v")
    filled = lerp(epoch("ts"), epoch("lo_ts"), F.col("lo_v"), epoch("hi_ts"), F.col("hi_v"))
    if not both:
        filled = F.when(F.col("lo_v").isNotNull(), filled)
    return near.select(*KEYS, "ts", F.coalesce("v", filled).alias("v"))


def interpolate_linear(df: DataFrame, block: str = "month") -> DataFrame:
    """Fill NULLs linearly by row position; leading NULLs stay."""
    numbered = running_sum(
        df.withColumn("_block", time_block("ts", block)), KEYS, "_block", "ts", {"pos": F.lit(1)}
    )
    near = neighbours(numbered, KEYS, "_block", "pos", "v")
    pos, lo, hi = (F.col(c).cast("double") for c in ("pos", "lo_pos", "hi_pos"))
    filled = F.when(F.col("lo_v").isNotNull(), lerp(pos, lo, F.col("lo_v"), hi, F.col("hi_v")))
    return near.select(*KEYS, "ts", F.coalesce("v", filled).alias("v"))


def rolling_stat(df: DataFrame, width_s: int, fn: str = "mean", block_s: int | None = None) -> DataFrame:
    """Mean or median over the centred interval (ts - width/2, ts + width/2]."""
    if fn not in ("mean", "median"):
        raise ValueError("fn must be 'mean' or 'median'")
    half = width_s / 2
    block_s = block_s or max(30 * 86400, 4 * width_s)
    frame = (
        Window.partitionBy(*KEYS, "block")
        .orderBy(F.unix_micros("ts"))
        .rangeBetween(-int(half * 1e6) + 1, int(half * 1e6))
    )
    agg = F.avg("v") if fn == "mean" else F.percentile("v", F.lit(0.5))
    halo = with_halo(df, "ts", half, half, block_s)
    return halo.withColumn("stat", agg.over(frame)).where("owned").select(*KEYS, "ts", "v", "stat")


def trailing_mean(df: DataFrame, keys: Sequence[str], value: str, width_s: int, out: str) -> DataFrame:
    """Mean over (ts - width, ts]."""
    keys = list(keys)
    frame = (
        Window.partitionBy(*keys, "block")
        .orderBy(F.unix_micros("ts"))
        .rangeBetween(-int(width_s * 1e6) + 1, 0)
    )
    halo = with_halo(df, "ts", width_s, 0, max(30 * 86400, 4 * width_s))
    return halo.withColumn(out, F.avg(value).over(frame)).where("owned").drop("block", "owned")
