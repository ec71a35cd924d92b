"""Reduction of raw samples to window metrics.

Input schema: ``samples(series, band, ts, x)``.  Output schema of the metrics:
``(series, band | metric, ts, v)`` with ``ts`` the start of the window.

The metrics of the forecasting pipeline (:func:`rsam`, :func:`dsar`,
:func:`shannon_entropy`) use combining aggregates, so each executor reduces its
own files before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foreshock.functions.expr import (
    SECONDS_PER_DAY,
    check_divides_day,
    day_start,
    safe_divide,
    valid_sample,
    window_start,
)
from foreshock.functions.reuse import join_back, keep
from foreshock.operators import onepass
from foreshock.operators.bands import bandpass  # noqa: F401  (part of this module's interface)

KEYS = ["series", "band"]
DEFAULT_RATIO = 0.3


def day_grid(df: DataFrame, keys: Sequence[str], step_s: int, ts: str = "ts") -> DataFrame:
    """Every ``step_s`` from the first to the last day of each series.

    Built from the span of the series, never from observed rows, so windows
    without any sample are present.
    """
    check_divides_day(step_s)
    span = df.groupBy(*keys).agg(day_start(F.min(ts)).alias("_a"), day_start(F.max(ts)).alias("_b"))
    last = F.timestamp_seconds(F.unix_seconds("_b") + F.lit(SECONDS_PER_DAY - step_s))
    return span.select(
        *keys, F.explode(F.sequence("_a", last, F.make_dt_interval(secs=F.lit(step_s)))).alias("ts")
    )


def chunk_windows(samples: DataFrame, width_s: int, overlap: float | None = None) -> DataFrame:
    """Assign samples to whole windows counted from the start of each day.

    ``overlap`` is a percentage in [0, 100).  A window without samples stays
    present with a NULL ``ts`` and ``x``; a window never crosses midnight.
    """
    if overlap is not None and not 0.0 <= overlap < 100.0:
        raise ValueError("overlap must be in [0, 100)")
    step_s = width_s if overlap is None else int(width_s * (1 - overlap / 100.0))
    if step_s <= 0 or width_s > SECONDS_PER_DAY:
        raise ValueError("window must be positive and fit into a day")
    n_windows = (SECONDS_PER_DAY - width_s) // step_s + 1
    day = day_start("ts")
    offset = (F.unix_micros("ts") - F.unix_micros(day)) / F.lit(1e6)
    first = F.greatest(F.floor((offset - F.lit(width_s)) / F.lit(step_s)) + 1, F.lit(0)).cast("int")
    last = F.least(F.floor(offset / F.lit(step_s)), F.lit(n_windows - 1)).cast("int")
    start = F.timestamp_seconds(F.unix_seconds(F.col("_day")) + F.col("_k") * F.lit(step_s))
    chunks = (
        samples.withColumn("_day", day)
        .withColumn("_first", first)
        .withColumn("_last", last)
        .where("_first <= _last")
        .withColumn("_k", F.explode(F.sequence("_first", "_last")))
        .select(*KEYS, start.alias("window_start"), "ts", "x")
    )
    filled = keep(chunks.select(*KEYS, "window_start").distinct())
    days = day_grid(filled.withColumnRenamed("window_start", "ts"), KEYS, SECONDS_PER_DAY).withColumnRenamed("ts", "_day")
    grid = days.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1)))).select(
        *KEYS, start.alias("window_start")
    )
    empty = grid.join(filled, [*KEYS, "window_start"], "left_anti").select(
        *KEYS, "window_start", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("x")
    )
    return chunks.unionByName(empty)


def window_info(samples: DataFrame, rate: float, width_s: int = 600) -> DataFrame:
    """Sample and window counts per series-day at a nominal sampling ``rate`` in Hz."""
    per_window = rate * width_s
    per_day = rate * SECONDS_PER_DAY
    return samples.groupBy("series", day_start("ts").alias("day")).agg(
        F.count("*").alias("number_of_samples"),
        F.lit(float(per_day)).alias("samples_per_day"),
        F.lit(float(per_window)).alias("sample_per_window"),
        F.lit(math.ceil(round(per_day / per_window, 9))).cast("long").alias("total_windows"),
        F.ceil(F.count("*") / F.lit(float(per_window))).cast("long").alias("sample_window"),
    )


def day_completeness(samples: DataFrame, rate: float) -> DataFrame:
    """Share of valid samples among ``rate * 86400`` per series-day."""
    return samples.groupBy("series", day_start("ts").alias("day")).agg(
        (F.count(valid_sample("x")) / F.lit(float(rate * SECONDS_PER_DAY))).alias("completeness")
    )


def _with_stats(samples: DataFrame, seconds: int) -> DataFrame:
    """Valid non-zero samples joined to mean, deviation and extreme of their window.

    Aggregate then join: the aggregate combines on the map side, and adaptive
    execution can split a hot window in the join.
    """
    rows = samples.select(*samples.columns, window_start("ts", seconds).alias("window_start")).where(
        valid_sample("x").isNotNull()
    )
    mag = F.abs("x")
    stats = rows.groupBy(*KEYS, "window_start").agg(
        F.avg("x").alias("_m"),
        F.stddev_pop("x").alias("_sd"),
        F.max_by(F.struct("ts", "x"), F.struct(mag, -F.unix_micros("ts"))).alias("_top"),
    )
    return join_back(rows, stats, [*KEYS, "window_start"])


def drop_max_outlier(samples: DataFrame, seconds: int, threshold: float = 3.0) -> DataFrame:
    """Per window remove the one sample of largest magnitude if its z exceeds ``threshold``.

    Only non-zero samples take part; a window of constant values keeps all.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    joined = _with_stats(samples, seconds)
    hit = (
        (F.col("_sd") > 0)
        & (F.abs((F.col("_top.x") - F.col("_m")) / F.col("_sd")) > F.lit(threshold))
        & (F.col("ts") == F.col("_top.ts"))
        & (F.col("x") == F.col("_top.x"))
    )
    # Rows of one instant only: decides which of several equal maxima goes.
    one = Window.partitionBy(*KEYS, "window_start", "ts", "x").orderBy("x")
    marked = joined.withColumn("_hit", hit & (F.row_number().over(one) == 1))
    return marked.where(~F.coalesce("_hit", F.lit(False))).select(*samples.columns, "window_start")


def drop_outliers(
    samples: DataFrame, seconds: int, threshold: float = 3.5, return_outliers: bool = False
) -> DataFrame:
    """Per window keep the samples with ``|z| <= threshold``, or return the others."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    joined = _with_stats(samples, seconds)
    outlier = (F.col("_sd") > 0) & (F.abs((F.col("x") - F.col("_m")) / F.col("_sd")) > F.lit(threshold))
    outlier = F.coalesce(outlier, F.lit(False))
    return joined.where(outlier if return_outliers else ~outlier).select(*samples.columns, "window_start")


def window_metric(
    samples: DataFrame,
    seconds: int,
    metric: Callable[[Column], Column] = F.avg,
    expected: float | None = None,
    min_ratio: float = DEFAULT_RATIO,
    outliers: str | None = None,
    absolute: bool = True,
    mask_zero: bool = False,
    multiplier: float = 1.0,
) -> DataFrame:
    """Any aggregate per fixed window with completeness and outlier rules.

    ``expected`` is the number of samples of a full window; below
    ``min_ratio * expected`` valid samples the metric is NULL.
    """
    check_divides_day(seconds)
    if outliers not in (None, "maximum", "all"):
        raise ValueError("outliers must be None, 'maximum' or 'all'")
    x = F.nanvl("x", F.lit(None).cast("double"))
    base = samples.withColumn("x", F.abs(x) if absolute else x)
    if mask_zero:
        base = base.withColumn("x", F.nullif("x", F.lit(0.0)))
    keyed = base.withColumn("window_start", window_start("ts", seconds))
    n_valid = keyed.groupBy(*KEYS, "window_start").agg(F.count("x").alias("n_valid"))
    value = metric(F.col("x")).alias("v")
    if outliers is None:
        out = keyed.groupBy(*KEYS, "window_start").agg(F.count("x").alias("n_valid"), value)
    else:
        kept = drop_max_outlier(base, seconds) if outliers == "maximum" else drop_outliers(base, seconds)
        out = n_valid.join(kept.groupBy(*KEYS, "window_start").agg(value), [*KEYS, "window_start"], "left")
    v = F.col("v") * F.lit(multiplier) if multiplier != 1.0 else F.col("v")
    enough = F.lit(True) if expected is None else F.col("n_valid") / F.lit(float(expected)) >= F.lit(min_ratio)
    return out.select(*KEYS, F.col("window_start").alias("ts"), F.when(enough, v).alias("v"))


def mean_without_max(prefix: str = "") -> Column:
    """Mean magnitude with the largest sample removed when its z exceeds 3.

    Needs ``n, s, m, sd, top`` of the non-zero magnitudes; being algebraic it
    works in one pass and on a stream.
    """
    n, s, m, sd, top = (F.col(prefix + c) for c in ("n", "s", "m", "sd", "top"))
    hit = (sd > 0) & ((top - m) / F.nullif(sd, F.lit(0.0)) > F.lit(3.0))
    return F.when(hit, safe_divide(s - top, n - 1)).otherwise(m)


def magnitude_stats(x: str = "x") -> list[Column]:
    """Combining aggregates that :func:`mean_without_max` and the entropy need."""
    a = F.abs(valid_sample(x))
    return [
        F.count(F.when(~F.isnan(x), F.col(x))).alias("n_valid"),
        F.count(a).alias("n"),
        F.sum(a).alias("s"),
        F.avg(a).alias("m"),
        F.stddev_pop(a).alias("sd"),
        F.max(a).alias("top"),
        F.sum(a * a).alias("energy"),
    ]


def _enough(expected: float | None, min_ratio: float) -> Column:
    if expected is None:
        return F.lit(True)
    return F.col("n_valid") / F.lit(float(expected)) >= F.lit(min_ratio)


def rsam(
    samples: DataFrame,
    seconds: int,
    expected: float | None = None,
    min_ratio: float = DEFAULT_RATIO,
    multiplier: float = 1.0,
    empty_windows: bool = True,
) -> DataFrame:
    """Mean magnitude per band and window after the maximum rule, in one pass.

    A window whose samples are all zero, missing or NaN has a NULL, or no row
    without ``empty_windows``.
    """
    check_divides_day(seconds)
    stats = samples.groupBy(*KEYS, window_start("ts", seconds).alias("ts")).agg(*magnitude_stats())
    if not empty_windows:
        stats = stats.where("n > 0")
    v = mean_without_max()
    if multiplier != 1.0:
        v = v * F.lit(multiplier)
    return stats.select(*KEYS, "ts", F.when(_enough(expected, min_ratio), v).alias("v"))


def integrate(samples: DataFrame) -> DataFrame:
    """Trapezoid integral per series, band and day, starting at 0 each day.

    The running total is computed per hour and carried over, so a day of raw
    samples is spread over tasks; the samples are read and dealt once.
    """
    return onepass.integral(samples)


def adjacent_ratio(means: DataFrame, bands: Sequence[str], multiplier: float = 1.0) -> DataFrame:
    """Ratio of each band's value to the next band's at the same instant.

    ``bands`` in order define f0, f1, ...; a zero denominator gives NULL.
    """
    if len(bands) < 2:
        raise ValueError("a band ratio needs at least two bands")
    wide = means.groupBy("series", "ts").agg(
        *[F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"_b{i}") for i, b in enumerate(bands)]
    )
    pairs = [
        F.struct(
            F.lit(f"dsar_f{i}-f{i + 1}").alias("metric"),
            (safe_divide(F.col(f"_b{i}"), F.col(f"_b{i + 1}")) * F.lit(multiplier)).alias("v"),
        )
        for i in range(len(bands) - 1)
    ]
    return wide.select("series", "ts", F.inline(F.array(*pairs))).select("series", "metric", "ts", "v")


def dsar(
    samples: DataFrame,
    seconds: int,
    bands: Sequence[str],
    expected: float | None = None,
    min_ratio: float = DEFAULT_RATIO,
    multiplier: float = 1.0,
) -> DataFrame:
    """Ratio of mean magnitudes of the integrated signal between adjacent bands."""
    check_divides_day(seconds)
    deep = onepass.reduced(samples, seconds, entropy=False, magnitudes=False)
    return adjacent_ratio(_integrated_rsam(deep, expected, min_ratio), bands, multiplier)


def _integrated_rsam(deep: DataFrame, expected: float | None, min_ratio: float) -> DataFrame:
    enough = F.lit(True) if expected is None else F.col("y_n_valid") / F.lit(float(expected)) >= F.lit(min_ratio)
    return deep.where("y_n_valid > 0").select(*KEYS, F.col("window_start").alias("ts"), F.when(enough, mean_without_max("y_")).alias("v"))


def shannon_entropy(
    samples: DataFrame,
    seconds: int,
    expected: float | None = None,
    min_ratio: float = DEFAULT_RATIO,
    strict: bool = False,
    band: str | None = None,
) -> DataFrame:
    """Amplitude entropy per series and window, of one ``band`` or pooled over all bands passed in.

    Mean and deviation after the maximum rule come from the summaries of the
    windows; the second reader of the same exchange sums ``-y log2 y`` of the
    normal density ``y``, and the removed maximum is taken back out.  ``strict``
    makes a window with a zero or missing sample NULL.
    """
    check_divides_day(seconds)
    chosen = samples if band is None else samples.where(F.col("band") == band)
    return onepass.entropy_of(onepass.reduced(chosen, seconds, integrated=False, magnitudes=False), _enough(expected, min_ratio), strict)


def band_energy_dft(
    df: DataFrame, bands: Sequence[tuple[str, int, int]], points: int, period_s: int
) -> DataFrame:
    """Energy of each day's values per range of Fourier coefficients.

    ``df(series, metric, ts, v)`` holds ``points`` values a day, ``period_s``
    apart; ``bands`` are ``(name, k_first, k_last)``.  Aggregates only.
    """
    pos = (F.unix_seconds("ts") - F.unix_seconds(day_start("ts"))) / F.lit(period_s)

    def part(fn: Callable[[Column], Column], k: int) -> Column:
        return F.sum(F.col("v") * fn(pos * F.lit(2 * math.pi * k / points)))

    energy = []
    for name, first, last in bands:
        e = F.lit(0.0)
        for k in range(first, last + 1):
            re, im = part(F.cos, k), part(F.sin, k)
            e = e + (re * re + im * im) / F.lit(float(points))
        energy.append(F.struct(F.lit(name).alias("band"), e.alias("energy")))
    out = df.groupBy("series", "metric", day_start("ts").alias("day")).agg(F.array(*energy).alias("_e"))
    return out.select("series", "metric", "day", F.inline("_e"))


def band_metric(bands: Sequence[str], prefix: str = "rsam_f") -> Column:
    """Metric name of a band by its position in ``bands``."""
    names = F.create_map(*[F.lit(t) for i, b in enumerate(bands) for t in (b, f"{prefix}{i}")])
    return names[F.col("band")]


def tremor_long(
    samples: DataFrame,
    seconds: int,
    bands: Sequence[str],
    methods: Sequence[str] = ("rsam", "dsar", "entropy"),
    expected: float | None = None,
    multiplier: float = 1.0,
    entropy_band: str | None = None,
) -> DataFrame:
    """All window metrics as ``(series, metric, ts, v)``, computed windows only.

    The samples are scanned once, unless the entropy has a band of its own.
    """
    unknown = set(methods) - {"rsam", "dsar", "entropy"}
    if unknown:
        raise ValueError(f"unknown method(s) {sorted(unknown)}")
    deep_methods = [m for m in ("dsar", "entropy") if m in methods and (m != "dsar" or len(bands) > 1)]
    parts = []
    table = None
    if deep_methods and not (deep_methods == ["entropy"] and entropy_band is not None):
        table = keep(onepass.reduced(samples, seconds, "dsar" in deep_methods, "entropy" in deep_methods and entropy_band is None))
    if "rsam" in methods:
        r = rsam(samples, seconds, expected, multiplier=multiplier) if table is None else _raw_rsam(table, expected, multiplier)
        parts.append(r.select("series", band_metric(bands).alias("metric"), "ts", "v").where("metric IS NOT NULL"))
    if "dsar" in deep_methods:
        parts.append(adjacent_ratio(_integrated_rsam(table, expected, DEFAULT_RATIO), bands, multiplier))
    if "entropy" in methods:
        if entropy_band is None:
            h = onepass.entropy_of(table, _enough(None if expected is None else expected * len(bands), DEFAULT_RATIO), False)
        else:
            h = shannon_entropy(samples, seconds, expected, band=entropy_band)
        parts.append(h.select("series", F.lit("entropy").alias("metric"), "ts", "v"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _raw_rsam(raw: DataFrame, expected: float | None, multiplier: float) -> DataFrame:
    v = mean_without_max()
    if multiplier != 1.0:
        v = v * F.lit(multiplier)
    return raw.select(*KEYS, F.col("window_start").alias("ts"), F.when(_enough(expected, DEFAULT_RATIO), v).alias("v"))


def metric_names(bands: Sequence[str], methods: Sequence[str]) -> list[str]:
    names = []
    if "rsam" in methods:
        names += [f"rsam_f{i}" for i in range(len(bands))]
    if "dsar" in methods:
        names += [f"dsar_f{i}-f{i + 1}" for i in range(len(bands) - 1)]
    if "entropy" in methods:
        names.append("entropy")
    return names


def on_grid(metrics: DataFrame, seconds: int, names: Sequence[str]) -> DataFrame:
    """Long metrics on the full grid of the series' days; absent windows are NULL.

    The days come from the metrics, not from the far larger samples.
    """
    grid = day_grid(metrics, ["series"], seconds).withColumn(
        "metric", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    return join_back(grid, metrics.select("series", "metric", "ts", F.col("v").alias("_v")), ["series", "metric", "ts"], "left").select(
        "series", "metric", "ts", F.col("_v").alias("v")
    )


def tremor_table(
    samples: DataFrame,
    seconds: int,
    bands: Sequence[str],
    methods: Sequence[str] = ("rsam", "dsar", "entropy"),
    expected: float | None = None,
    entropy_band: str | None = None,
) -> DataFrame:
    """Wide table: one row per series and window of every day, one column per metric."""
    names = metric_names(bands, methods)
    long = tremor_long(samples, seconds, bands, methods, expected, entropy_band=entropy_band)
    wide = keep(
        long.groupBy("series", "ts").agg(
            *[F.max(F.when(F.col("metric") == n, F.col("v"))).alias(n) for n in names]
        )
    )
    return join_back(day_grid(wide, ["series"], seconds), wide, ["series", "ts"], "left")


def drop_incomplete_days(wide: DataFrame, period_s: int, min_ratio: float = DEFAULT_RATIO) -> DataFrame:
    """Keep days whose share of rows with any value reaches ``min_ratio``."""
    names = [c for c in wide.columns if c not in ("series", "ts")]
    any_value = F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull()
    expected = SECONDS_PER_DAY / period_s
    keyed = wide.withColumn("_day", day_start("ts"))
    null_rows = F.sum(F.when(any_value, 0).otherwise(1))
    good = keyed.groupBy("series", "_day").agg(
        ((F.lit(expected) - null_rows) / F.lit(expected)).alias("_share"), F.max(any_value).alias("_any")
    )
    good = good.where(F.col("_any") & (F.col("_share") >= F.lit(min_ratio))).select("series", "_day")
    return keyed.join(good, ["series", "_day"], "left_semi").drop("_day")
