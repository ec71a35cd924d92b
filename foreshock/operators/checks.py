"""Projections, filters and validation predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.blocked import carry_back, time_block
from foreshock.functions.expr import day_start, require_columns, valid_sample


def select_metrics(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keys plus the listed metric columns; an unknown name is an error."""
    require_columns(wide, names)
    return wide.select("series", "ts", *[F.col(f"`{n}`") for n in names])


def day_bounds(start: str, end: str):
    """First and last second of a range of dates."""
    return (
        F.to_timestamp(F.lit(f"{start} 00:00:00")),
        F.to_timestamp(F.lit(f"{end} 23:59:59")),
    )


def slice_dates(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` 00:00:00 to ``end`` 23:59:59, both included."""
    return df.where(F.col(ts).between(*day_bounds(start, end)))


def tremor_span(wide: DataFrame) -> DataFrame:
    """First and last instant, whole days between them and the metric names."""
    names = sorted(c for c in wide.columns if c not in ("series", "ts"))
    return wide.groupBy("series").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.floor((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / F.lit(86400)).cast("long").alias("n_days"),
        F.lit(",".join(names)).alias("columns"),
    )


def clamp_to_span(ranges: DataFrame, tremor: DataFrame) -> DataFrame:
    """Move ``start_ts`` and ``end_ts`` of requested ranges inside the span of their series."""
    span = tremor.groupBy("series").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return ranges.join(span, "series").select(
        *[c for c in ranges.columns if c not in ("start_ts", "end_ts")],
        F.greatest("start_ts", "_a").alias("start_ts"),
        F.least("end_ts", "_b").alias("end_ts"),
    )


def trim_buffer(df: DataFrame, start: str) -> DataFrame:
    """Drop warm-up rows before the real start."""
    return df.where(F.col("ts") >= F.to_timestamp(F.lit(f"{start} 00:00:00")))


def filter_event_dates(dates: DataFrame, start: str, end: str) -> DataFrame:
    """Event dates inside the span."""
    return dates.where(F.col("event_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def check_sampling(df: DataFrame, period_s: float, tolerance_s: float, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Gap to the previous row and whether it is within tolerance.

    The first row of a series is always good.  See :func:`sampling_summary` for
    the one-row verdict.
    """
    keys = list(keys)
    cols = [c for c in df.columns]
    based = df.withColumn("_block", time_block("ts")).withColumn("_t", F.col("ts"))
    lagged = carry_back(based, keys, "_block", "ts", ["_t"])
    gap = (F.unix_micros("ts") - F.unix_micros("prev__t")) / F.lit(1e6)
    good = F.coalesce(gap.between(period_s - tolerance_s, period_s + tolerance_s), F.lit(True))
    return lagged.select(*cols, gap.alias("gap_s"), good.alias("is_good"))


def sampling_summary(checked: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Verdict per series: consistent or not, good and bad rows, period in seconds.

    Fewer than two rows is an error, raised when the row is computed.
    """
    n = F.count("*")
    bad = F.sum(F.when(F.col("is_good"), 0).otherwise(1)).cast("long")
    guard = F.when(n < 2, F.raise_error(F.lit("need at least 2 rows to check sampling")).cast("long")).otherwise(bad)
    first_gap = F.min_by("gap_s", F.when(F.col("gap_s").isNotNull(), F.col("ts")))
    return checked.groupBy(*keys).agg(
        (guard == 0).alias("is_consistent"),
        (n - bad).alias("good_rows"),
        bad.alias("bad_rows"),
        F.when(bad == 0, first_gap.cast("long")).alias("rate_s"),
    )


def clip_above(df: DataFrame, prefix: str, limit: float) -> DataFrame:
    """Values of a metric family at or above ``limit`` become NULL."""
    hit = F.col("metric").startswith(prefix) & (F.col("v") >= F.lit(limit))
    return df.withColumn("v", F.when(hit, None).otherwise(F.col("v")))


def mask_zeros(samples: DataFrame) -> DataFrame:
    """Zero or NaN samples become NULL."""
    return samples.withColumn("x", valid_sample("x"))


def drop_nans(samples: DataFrame) -> DataFrame:
    """Rows whose sample is present."""
    return samples.where(F.col("x").isNotNull() & ~F.isnan("x"))


def count_valid(samples: DataFrame, keys: Sequence[str] = ("series", "band")) -> DataFrame:
    """Samples that are present and not zero."""
    return samples.groupBy(*keys).agg(F.count(valid_sample("x")).alias("n_valid"))


def clip_update_day(df: DataFrame, gap_start: str, gap_end: str) -> DataFrame:
    """Rows inside the update gap; days without any value are dropped."""
    inside = df.where(
        F.col("ts").between(F.to_timestamp(F.lit(gap_start)), F.to_timestamp(F.lit(gap_end)))
    ).withColumn("_day", day_start("ts"))
    names = [c for c in df.columns if c not in ("series", "ts")]
    any_value = F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull()
    good = inside.where(any_value).select("series", "_day").distinct()
    return inside.join(good, ["series", "_day"], "left_semi").drop("_day")
