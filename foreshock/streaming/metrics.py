"""Window metrics on a stream of samples.

The maximum rule needs only count, sum, mean, deviation and maximum of a
window, so a plain streaming aggregate is enough and its state is one row per
open (series, band, window).  The rule for all outliers decides on every sample
once the window's deviation is known, so the state keeps the magnitudes of open
windows: what one sensor sends in a window and the delay, at any length of the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreshock.functions.expr import safe_divide, valid_sample
from foreshock.operators.signal import KEYS, magnitude_stats, mean_without_max


def mean_within(threshold: float) -> Column:
    """Mean of the ``magnitudes`` whose z does not exceed ``threshold``; NULL without any.

    Summed by size, so that the order in which they came does not matter.
    """
    far = lambda v: (F.col("sd") > 0) & (F.abs((v - F.col("m")) / F.col("sd")) > F.lit(threshold))
    kept = F.filter(F.sort_array("magnitudes"), lambda v: ~far(v))
    return safe_divide(F.aggregate(kept, F.lit(0.0), lambda s, v: s + v), F.size(kept))


def stream_window_metrics(
    samples: DataFrame,
    seconds: int,
    slide_s: int | None = None,
    delay: str = "1 hour",
    expected: float | None = None,
    min_ratio: float = 0.3,
    outliers: str = "maximum",
    threshold: float = 3.5,
    empty_windows: bool = True,
) -> DataFrame:
    """Mean magnitude per closed window after the maximum rule, or without 'all' samples whose z exceeds ``threshold``.

    Rows later than ``delay`` behind the newest event are dropped; windows are
    emitted once the watermark passes their end.  Equals the batch metric on
    closed windows.  One without a valid sample has a NULL, or no row without
    ``empty_windows``.
    """
    if outliers not in ("maximum", "all"):
        raise ValueError("outliers must be 'maximum' or 'all'")
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    width = f"{seconds} seconds"
    slide = f"{slide_s or seconds} seconds"
    stats = (
        samples.withWatermark("ts", delay)
        .groupBy(*KEYS, F.window("ts", width, slide).alias("w"))
        .agg(*magnitude_stats(), *([F.collect_list(F.abs(valid_sample("x"))).alias("magnitudes")] if outliers == "all" else []))
    )
    if not empty_windows:
        stats = stats.where("n > 0")
    v = mean_without_max() if outliers == "maximum" else mean_within(threshold)
    if expected is not None:
        v = F.when(F.col("n_valid") / F.lit(float(expected)) >= F.lit(min_ratio), v)
    return stats.select(*KEYS, F.col("w.start").alias("ts"), v.alias("v"))
