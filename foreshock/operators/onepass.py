"""Window metrics that need more than one combining aggregate, from one scan of the samples.

Raw samples are dealt once by a hash of (series, block); a block is an hour, or the window
if that is longer.  What crosses a block border is small: per band the integral's
running total, and per window the pooled moments that the entropy needs.  These
come from summaries of the blocks, one row each, and are joined back on the very
key the samples are dealt by, so no second exchange of raw size is planned, and
both readers of the samples share the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.expr import SECONDS_PER_DAY, day_start, valid_sample, window_start

BLOCK_S = 3600


def dealt(samples: DataFrame, seconds: int) -> DataFrame:
    """Samples with their block, dealt by a hash of (series, block); rows without series, band or instant belong to no window.

    The filter is stated here, so that no reader adds one of its own below the exchange.
    """
    size = max(seconds, BLOCK_S)
    if SECONDS_PER_DAY % size:
        size = SECONDS_PER_DAY
    block = F.floor(F.unix_seconds("ts") / F.lit(size)).cast("long")
    whole = samples.where(F.col("series").isNotNull() & F.col("band").isNotNull() & F.col("ts").isNotNull())
    cut = whole.select("series", "band", "ts", "x", block.alias("block")).where(F.col("block").isNotNull())
    # One key of its own: a constant series would be folded away and the keys of later groupings no longer match.
    return cut.withColumn("deal", F.xxhash64("series", "block")).where(F.col("deal").isNotNull()).repartition("deal")


def _magnitudes(x: Column, prefix: str = "") -> list[Column]:
    a = F.abs(F.nullif(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0)))
    return [
        F.count(F.nanvl(x, F.lit(None).cast("double"))).alias(f"{prefix}n_valid"),
        F.count(a).alias(f"{prefix}n"),
        F.sum(a).alias(f"{prefix}s"),
        F.avg(a).alias(f"{prefix}m"),
        F.stddev_pop(a).alias(f"{prefix}sd"),
        F.max(a).alias(f"{prefix}top"),
        F.sum(a * a).alias(f"{prefix}energy"),
    ]


def with_local_integral(rows: DataFrame) -> DataFrame:
    """Adds ``area``, the trapezoid to the valid sample before in the block, and ``z``, their running total."""
    inside = Window.partitionBy("deal", "series", "band", "block").orderBy("ts", "x")
    held = F.col("x").isNotNull() & ~F.isnan("x")
    before = F.last(F.when(held, F.struct("ts", "x")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_b", before)
    dt = (F.unix_micros("ts") - F.unix_micros("_b.ts")) / F.lit(1e6)
    area = F.when(held, F.coalesce((F.col("x") + F.col("_b.x")) / F.lit(2.0) * dt, F.lit(0.0)))
    rows = rows.withColumn("area", area).drop("_b")
    return rows.withColumn("z", F.sum("area").over(inside.rowsBetween(Window.unboundedPreceding, 0)))


def integral_offsets(rows: DataFrame) -> DataFrame:
    """``(deal, offsets)``: per block and band the integral since midnight up to the block's first valid sample.

    ``rows`` come from :func:`with_local_integral`; a day has few blocks, so its
    totals are scanned in one window.
    """
    held = F.col("x").isNotNull() & ~F.isnan("x")
    ends = rows.where(held).groupBy("deal", "series", "block", "band").agg(
        F.min(F.struct("ts", "x")).alias("first"), F.max(F.struct("ts", "x")).alias("last"), F.sum("area").alias("total")
    )
    days = Window.partitionBy("series", "band", day_start("first.ts")).orderBy("block")
    ends = ends.withColumn("_p", F.lag("last").over(days))
    gap = (F.unix_micros("first.ts") - F.unix_micros("_p.ts")) / F.lit(1e6)
    bridge = F.coalesce((F.col("first.x") + F.col("_p.x")) / F.lit(2.0) * gap, F.lit(0.0))
    ends = ends.withColumn("_bridge", bridge)
    earlier = F.coalesce(F.sum("total").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    bridges = F.sum("_bridge").over(days.rowsBetween(Window.unboundedPreceding, 0))
    offsets = ends.select("deal", F.struct("series", "block", "band").alias("k"), (earlier + bridges).alias("o"))
    return offsets.groupBy("deal").agg(F.map_from_entries(F.collect_list(F.struct("k", "o"))).alias("offsets"))


def _joined(rows: DataFrame, small: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of their block; the keys are those the rows are dealt by."""
    right = small.select(F.col("deal").alias("_deal"), value)
    return rows.join(right, F.col("deal") == F.col("_deal"), "left").drop("_deal")


def integral(samples: DataFrame) -> DataFrame:
    """Trapezoid integral per series, band and day, starting at 0 each day, of valid samples: ``(series, band, ts, x)``."""
    rows = with_local_integral(dealt(samples, BLOCK_S))
    out = _joined(rows, integral_offsets(rows), "offsets").where(F.col("x").isNotNull() & ~F.isnan("x"))
    return out.select("series", "band", "ts", (F.col("z") + F.col("offsets")[F.struct("series", "block", "band")]).alias("x"))


def pooled_moments(stats: DataFrame) -> DataFrame:
    """Moments of a window over all its bands, with the largest magnitude taken out if its z exceeds 3."""
    window = Window.partitionBy("deal", "series", "block", "window_start")
    centre = F.sum("s").over(window) / F.nullif(F.sum("n").over(window), F.lit(0))
    spread = F.sum(F.col("n") * (F.col("sd") * F.col("sd") + (F.col("m") - F.col("_m")) * (F.col("m") - F.col("_m"))))
    pooled = stats.withColumn("_m", centre).groupBy("deal", "series", "block", "window_start").agg(
        *[F.sum(c).alias(c) for c in ("n_valid", "n", "n_rows", "energy", "s")],
        F.max("_m").alias("m"),
        F.max("top").alias("top"),
        F.sqrt(spread / F.nullif(F.sum("n"), F.lit(0))).alias("sd"),
    )
    n, m, sd, top, s = (F.col(c) for c in ("n", "m", "sd", "top", "s"))
    cut = F.coalesce((sd > 0) & ((top - m) / F.nullif(sd, F.lit(0.0)) > F.lit(3.0)), F.lit(False))
    left_var = (sd * sd * n - (top - m) * (top - m) * n / (n - 1)) / (n - 1)
    return pooled.select(
        "deal", "series", "block", "window_start", "n", "n_rows", "n_valid", "top", cut.alias("cut"),
        F.when(cut, (s - top) / (n - 1)).otherwise(m).alias("m2"),
        F.when(cut, F.sqrt(F.greatest(left_var, F.lit(0.0)))).otherwise(sd).alias("sd2"),
        F.when(cut, F.col("energy") - top * top).otherwise(F.col("energy")).alias("energy2"),
    )


def _density(a: Column, m: Column, sd: Column) -> Column:
    z = (a - m) / F.nullif(sd, F.lit(0.0))
    return F.exp(-z * z / F.lit(2.0)) / (sd * F.lit(math.sqrt(2 * math.pi)))


def _term(y: Column) -> Column:
    return -y * F.log2(F.nullif(y, F.lit(0.0)))


def window_stats(samples: DataFrame, seconds: int, integrated: bool = True, entropy: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``(raw, deep, pooled)`` tables per window from one scan.

    ``raw``: magnitudes of the samples per series, band and window.  ``deep``:
    those of the integral (``y_`` columns) and the entropy's sums ``h`` and
    ``zeros`` over the density of ``pooled``, which holds the moments per series
    and window over all bands passed in.
    """
    rows = dealt(samples, seconds)
    rows = with_local_integral(rows) if integrated else rows
    rows = rows.withColumn("window_start", window_start("ts", seconds))
    keys = ["deal", "series", "block", "band", "window_start"]
    raw = rows.groupBy(*keys).agg(*_magnitudes(F.col("x")), F.count(F.lit(1)).alias("n_rows"))
    deep, aggs, pooled = rows, [], None
    if integrated:
        deep = _joined(deep, integral_offsets(rows), "offsets")
        y = F.when(F.col("x").isNotNull() & ~F.isnan("x"), F.col("z") + F.col("offsets")[F.struct("series", "block", "band")])
        aggs += _magnitudes(y, "y_")
    if entropy:
        pooled = pooled_moments(raw)
        key = F.struct("series", "block", "window_start")
        of_block = pooled.groupBy("deal").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.struct("m2", "sd2").alias("v")))).alias("moments"))
        deep = _joined(deep, of_block, "moments").withColumn("_p", F.col("moments")[key])
        y = _density(F.abs(valid_sample("x")), F.col("_p.m2"), F.col("_p.sd2"))
        aggs += [F.sum(_term(y)).alias("h"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("zeros")]
    return raw, deep.groupBy(*keys).agg(*aggs), pooled


def entropy_of(table: DataFrame, enough: Column, strict: bool) -> DataFrame:
    """``(series, ts, v)`` from a :func:`reduced` table; the removed maximum is taken back out of the sums of all bands."""
    sums = table.groupBy("deal", "series", "block", "window_start").agg(F.sum("h").alias("h"), F.sum("zeros").alias("zeros"), F.first("pooled").alias("_p"))
    both = sums.select("h", "zeros", "_p.*")
    y_top = _density(F.col("top"), F.col("m2"), F.col("sd2"))
    h_top = F.when(F.col("cut"), F.coalesce(_term(y_top), F.lit(0.0))).otherwise(0.0)
    zero_top = F.when(F.col("cut") & (y_top == 0), 1).otherwise(0)
    ok = (F.col("energy2") >= 1) & (F.col("zeros") - zero_top == 0) & enough
    if strict:
        ok = ok & (F.col("n") == F.col("n_rows"))
    return both.select("series", F.col("window_start").alias("ts"), F.when(ok, F.col("h") - h_top).alias("v"))


def reduced(samples: DataFrame, seconds: int, integrated: bool = True, entropy: bool = True, magnitudes: bool = True) -> DataFrame:
    """Everything of :func:`window_stats` in one table per series, block, band and window, ``pooled`` as a struct.

    One query, so the samples' exchange is made once and read again; persist the
    result to derive several metrics from it.  Without ``magnitudes`` the columns
    of ``raw`` are left out.
    """
    raw, deep, pooled = window_stats(samples, seconds, integrated, entropy)
    keys = ["deal", "series", "block", "band", "window_start"]
    both = deep
    if magnitudes:
        fresh = deep.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in deep.columns if c not in keys])
        # Null-safe: an inferred filter on a key would reach one reader's scan and part the two.
        both = raw.join(fresh, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
    if pooled is None:
        return both
    of_window = pooled.select(*[F.col(k).alias(f"_{k}") for k in keys if k != "band"], F.struct(*pooled.columns).alias("pooled"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys if k != "band"]
    return both.join(of_window, on).drop(*[f"_{k}" for k in keys if k != "band"])
