"""Reading and writing the tables of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.functions.expr import day_start, require_columns
from foreshock.operators.checks import day_bounds
from foreshock.operators.gaps import interpolate_time

SAMPLES_SCHEMA = "series string, band string, ts timestamp, x double"


def load_samples(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    start: str | None = None,
    end: str | None = None,
    columns: dict[str, Column] | None = None,
    series: Sequence[str] | None = None,
) -> DataFrame:
    """Raw samples of a date range (both dates included).

    A table partitioned by ``dt`` is pruned to the wanted days; otherwise the
    range is pushed to the scan on ``ts``.  A day without files gives no rows.
    ``columns`` maps the four sample columns to source expressions.
    """
    reader = spark.read
    if fmt == "csv":
        df = reader.schema(SAMPLES_SCHEMA + ", dt date").option("header", True).csv(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")
    source_cols = df.columns
    if columns:
        df = df.select(*[e.alias(n) for n, e in columns.items()], *[c for c in source_cols if c == "dt"])
    require_columns(df, ["series", "band", "ts", "x"])
    if start and end:
        lo, hi = day_bounds(start, end)
        if "dt" in df.columns and fmt == "parquet":
            df = df.where(F.col("dt").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
        df = df.where((F.col("ts") >= lo) & (F.col("ts") < hi + F.make_dt_interval(secs=F.lit(1))))
    if series:
        df = df.where(F.col("series").isin(list(series)))
    return df.select("series", "band", F.col("ts").cast("timestamp").alias("ts"), F.nanvl("x", F.lit(None).cast("double")).alias("x"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV or snappy Parquet sink; ``dt`` is derived from ``ts`` when asked for."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be 'parquet' or 'csv'")
    if "dt" in partition_by and "dt" not in df.columns:
        df = df.withColumn("dt", F.to_date("ts"))
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("compression", "snappy").parquet(path)


def load_tremor(spark: SparkSession, path: str, metrics: Sequence[str], series: str = "all") -> DataFrame:
    """Tremor CSV with a ``datetime`` column and one column per metric."""
    schema = "datetime string, " + ", ".join(f"`{m}` double" for m in metrics)
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(F.lit(series).alias("series"), F.to_timestamp("datetime").alias("ts"), *[F.col(f"`{m}`") for m in metrics])


def concat_daily(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of per-day tables whose columns may differ; metric columns sorted by name."""
    if not frames:
        raise ValueError("nothing to concatenate")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    names = sorted(c for c in out.columns if c not in ("series", "ts"))
    return out.select("series", "ts", *[F.col(f"`{n}`") for n in names])


def update_tremor(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append new rows to a long tremor table and fill gaps again.

    A new row replaces an existing one at the same instant.  Only days touched
    by ``new`` reach :func:`foreshock.streaming.update.upsert_days`; this
    function is the whole-table form.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # A present row may hold NULL, which max_by keeps because it orders by _new.
    merged = both.groupBy("series", "metric", "ts").agg(F.max_by("v", "_new").alias("v"))
    return interpolate_time(merged, both=False)


def rows_to_process(existing: DataFrame, candidate: DataFrame, period_s: int) -> DataFrame:
    """Candidate rows from one period after the last existing row of each series."""
    last = existing.groupBy("series").agg(F.max("ts").alias("_last"))
    joined = candidate.join(last, "series", "left")
    fresh = F.col("_last").isNull() | (
        F.unix_micros("ts") >= F.unix_micros("_last") + F.lit(int(period_s * 1e6))
    )
    return joined.where(fresh).drop("_last")


def load_features(features: DataFrame, labels: DataFrame, start: str, end: str) -> DataFrame:
    """Feature rows of the labels in a date range that must lie inside the loaded span."""
    lo, hi = labels.agg(F.min(day_start("ts")), F.max(day_start("ts"))).first()
    if lo is None or str(lo.date()) > start or str(hi.date()) < end:
        raise ValueError(f"requested {start}..{end} is outside the loaded span {lo}..{hi}")
    inside = labels.where(F.col("ts").between(*day_bounds(start, end)))
    return features.join(inside.select("series", "id"), ["series", "id"], "left_semi")
