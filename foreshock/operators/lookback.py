"""Overlapping look-back slices of the tremor table, one per label.

When the label step divides a day, each tremor row is assigned to the look-back
windows that hold it and windows meet labels in an equi-join on their end, so
no range join is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.expr import SECONDS_PER_DAY, require_columns


def slices(tremor: DataFrame, labels: DataFrame, days: float, step_s: int) -> DataFrame:
    """``(series, id, metric, ts, v)`` with ``ts`` in [label - days, label).

    Labels must lie on multiples of ``step_s`` from midnight.  Tremor rows of days
    that no look-back touches are left out before rows are multiplied.
    """
    width_s = int(days * SECONDS_PER_DAY)
    if width_s <= 0:
        raise ValueError("the look-back must be positive")
    keys = labels.select("series", "id", F.col("ts").alias("_end"))
    if SECONDS_PER_DAY % step_s == 0 and width_s % step_s == 0:
        # Ends of the look-backs that hold a row: the next width/step multiples of the step.
        first = F.floor(F.unix_micros("ts") / F.lit(step_s * 1_000_000)) + 1
        ends = F.sequence(first, first + F.lit(width_s // step_s - 1))
        day = F.sequence(F.to_date(F.timestamp_seconds(F.unix_seconds("_end") - F.lit(width_s))), F.to_date("_end"))
        days_ = keys.select("series", F.explode(day).alias("_day")).distinct()
        near = tremor.withColumn("_day", F.to_date("ts")).join(days_, ["series", "_day"], "left_semi")
        spread = near.select("series", "metric", "ts", "v", F.explode(ends).alias("_e")).select(
            "series", "metric", "ts", "v", F.timestamp_seconds(F.col("_e") * F.lit(step_s)).alias("_end")
        )
        return spread.join(keys, ["series", "_end"]).select("series", "id", "metric", "ts", "v")
    # Any other step: meet on the days a look-back touches, then compare times.
    touched = keys.withColumn(
        "_day",
        F.explode(
            F.sequence(
                F.to_date(F.timestamp_seconds(F.unix_seconds("_end") - F.lit(width_s))), F.to_date("_end")
            )
        ),
    )
    rows = tremor.select("series", "metric", "ts", "v", F.to_date("ts").alias("_day"))
    age = F.unix_micros("_end") - F.unix_micros("ts")
    return (
        rows.join(touched, ["series", "_day"])
        .where((age > 0) & (age <= F.lit(int(width_s * 1e6))))
        .select("series", "id", "metric", "ts", "v")
    )


def window_completeness(
    tremor: DataFrame, labels: DataFrame, days: float, step_s: int, period_s: float, min_ratio: float = 1.0, non_null: bool = False
) -> DataFrame:
    """Rows found per label against the rows of a full look-back, kept or not.

    Instants are counted, so the number of metrics does not matter; ``non_null``
    counts only instants with a value.
    """
    expected = days * SECONDS_PER_DAY / period_s
    rows = tremor.where("v IS NOT NULL") if non_null else tremor
    instants = rows.groupBy("series", "ts").agg(F.lit("").alias("metric"), F.lit(0.0).alias("v"))
    found = slices(instants, labels, days, step_s).groupBy("series", "id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return labels.select("series", "id", "ts").join(found, ["series", "id"], "left").select(
        "series",
        "id",
        "ts",
        n.cast("long").alias("n_rows"),
        (n / F.lit(float(expected))).alias("completeness"),
        (n / F.lit(float(expected)) >= F.lit(min_ratio)).alias("kept"),
    )


def lookback_matrix(
    tremor: DataFrame,
    labels: DataFrame,
    days: float,
    step_s: int,
    period_s: float,
    min_ratio: float = 1.0,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Slices of the labels whose look-back is complete enough.

    Rows carry ``pos`` (0-based), ``n`` and the hours since the first row.
    The number of rows of one (id, metric) is fixed by the look-back.
    """
    chosen = tremor if metrics is None else tremor.where(F.col("metric").isin(list(metrics)))
    cut = slices(chosen, labels, days, step_s)
    expected = days * SECONDS_PER_DAY / period_s
    group = Window.partitionBy("series", "id", "metric")
    numbered = cut.select(
        "*",
        (F.row_number().over(group.orderBy("ts")) - 1).cast("long").alias("pos"),
        F.count("*").over(group).alias("n"),
    )
    return numbered.where(F.col("n") / F.lit(float(expected)) >= F.lit(min_ratio))


def window_arrays(matrix: DataFrame) -> DataFrame:
    """Slice as ordered arrays; the look-back bounds their length."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "ts", "v")))
    return matrix.groupBy("series", "id", "metric").agg(ordered.alias("_a")).select(
        "series", "id", "metric", F.col("_a.ts").alias("times"), F.col("_a.v").alias("values")
    )


def matrix_per_metric(matrix: DataFrame, path: str) -> None:
    """One Parquet folder per metric."""
    require_columns(matrix, ["metric"])
    matrix.write.mode("overwrite").partitionBy("metric").parquet(path)
