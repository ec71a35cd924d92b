"""Label grids around known event dates.

Labels are ``(series, id, ts, is_erupted)``; event dates are
``(series, event_date)``.  Dates are turned into the days they cover, so every
match is an equi-join on (series, day) and never a range join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreshock.functions.expr import literal_table
from foreshock.operators.checks import day_bounds

UNITS = {"minutes": 60, "hours": 3600}


def _step_seconds(step: int, unit: str) -> int:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    if step <= 0:
        raise ValueError("step must be positive")
    return step * UNITS[unit]


def _grid(df: DataFrame, start: Column, end: Column, step_s: int) -> DataFrame:
    """Explode the steps from ``start`` 00:00:00 to ``end`` 23:59:59 of each row."""
    a = F.date_trunc("day", start)
    b = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", end)) + F.lit(86399))
    return df.select("*", F.posexplode(F.sequence(a, b, F.make_dt_interval(secs=F.lit(step_s)))).alias("pos", "ts"))


def label_grid(
    spark: SparkSession, start: str, end: str, step: int, unit: str = "hours", series: Sequence[str] = ("all",)
) -> DataFrame:
    """Grid of label instants; ``id`` counts from 0 in each series, label 0."""
    step_s = _step_seconds(step, unit)
    days = (F.datediff(F.to_date(F.lit(end)), F.to_date(F.lit(start))) + 1).alias("d")
    base = literal_table(spark, "series", list(series))
    if start >= end:
        raise ValueError("start must be before end")
    too_long = F.lit(step_s) > days * F.lit(86400)
    base = base.where(~F.when(too_long, F.raise_error(F.lit("step exceeds the span")).cast("boolean")).otherwise(F.lit(False)))
    grid = _grid(base, F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), step_s)
    return grid.select("series", F.col("pos").cast("long").alias("id"), "ts", F.lit(0).alias("is_erupted"))


def event_days(dates: DataFrame, days_ahead: int, include: bool = True) -> DataFrame:
    """``(series, event_date, day)``: the days whose labels are positive."""
    first = F.date_sub("event_date", days_ahead - 1 if include else days_ahead)
    return dates.select("series", "event_date", F.explode(F.sequence(first, F.col("event_date"))).alias("day"))


def label_events(labels: DataFrame, dates: DataFrame, days_ahead: int, include: bool = True, skip_after: bool = True) -> DataFrame:
    """Set the label to 1 on the days leading up to each event.

    An event whose day ends after the last day of the grid is skipped.
    """
    if days_ahead < 1:
        raise ValueError("days_ahead must be at least 1")
    # The earliest event of a day decides: if any event of the day counts, it does.
    hit = event_days(dates, days_ahead, include).groupBy("series", "day").agg(F.min("event_date").alias("_event"))
    # One series' grid is one row per step of a calendar span, which bounds the window.
    last = F.to_date(F.max("ts").over(Window.partitionBy("series")))
    marked = labels.withColumns({"day": F.to_date("ts"), "_last": last}).join(hit, ["series", "day"], "left")
    counts = F.col("_event").isNotNull()
    if skip_after:
        counts = counts & (F.col("_event") <= F.col("_last"))
    return marked.select(
        "series", "id", "ts", F.greatest("is_erupted", F.when(counts, 1).otherwise(0)).cast("int").alias("is_erupted")
    )


def require_positive(labels: DataFrame) -> DataFrame:
    """Raise when a series has no positive row; checked as the rows are computed."""
    some = F.max("is_erupted").over(Window.partitionBy("series"))
    checked = labels.withColumn("_any", some)
    ok = F.when(F.col("_any") > 0, True).otherwise(
        F.raise_error(F.lit("no event between start and end")).cast("boolean")
    )
    return checked.where(ok).drop("_any")


def label_standard(
    spark: SparkSession,
    dates: DataFrame,
    start: str,
    end: str,
    step: int,
    unit: str = "hours",
    days_ahead: int = 2,
    include: bool = True,
    series: Sequence[str] = ("all",),
) -> DataFrame:
    """Grid plus events; an error when no label is positive."""
    grid = label_grid(spark, start, end, step, unit, series)
    return require_positive(label_events(grid, dates, days_ahead, include))


def label_dynamic(
    dates: DataFrame, days_before: int, step: int, unit: str = "hours", days_ahead: int = 2, include: bool = True
) -> DataFrame:
    """One grid per event over the days before it; overlaps kept once, ids renumbered.

    A grid holds one row per step of a calendar span, which bounds the window
    that renumbers one series.
    """
    step_s = _step_seconds(step, unit)
    grid = _grid(dates, F.date_sub("event_date", days_before).cast("timestamp"), F.col("event_date").cast("timestamp"), step_s)
    once = grid.select("series", "ts").distinct()
    order = Window.partitionBy("series").orderBy("ts")
    numbered = once.select(
        "series", (F.row_number().over(order) - 1).cast("long").alias("id"), "ts", F.lit(0).alias("is_erupted")
    )
    return label_events(numbered, dates, days_ahead, include, skip_after=False)


def event_slices(labels: DataFrame, dates: DataFrame, days_ahead: int, include: bool = True) -> DataFrame:
    """Label rows of each event's window, keyed by event date."""
    days = event_days(dates, days_ahead, include)
    return labels.withColumn("day", F.to_date("ts")).join(days, ["series", "day"]).select(
        "series", "event_date", "id", "ts", "is_erupted"
    )


def label_summary(labels: DataFrame, days_ahead: int, include: bool = True) -> DataFrame:
    """Windows, positives, negatives, positive days per event and their ratio."""
    n, p = F.count("*"), F.sum("is_erupted").cast("long")
    return labels.groupBy("series").agg(
        n.alias("n_windows"),
        p.alias("n_positive"),
        (n - p).alias("n_negative"),
        F.lit(days_ahead + (0 if include else 1)).cast("long").alias("positive_days_per_event"),
        (p / n).alias("positive_ratio"),
    )


def class_distribution(labels: DataFrame) -> DataFrame:
    """Count and percent of each class."""
    counts = labels.groupBy("series", "is_erupted").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("series"))
    return counts.withColumn("percent", F.col("n") / whole * 100)


def compare_distributions(named: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named label set with counts and percents of both classes."""
    if not named:
        raise ValueError("no label sets given")
    parts = [df.select(F.lit(name).alias("name"), "is_erupted") for name, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n0 = F.sum(F.when(F.col("is_erupted") == 0, 1).otherwise(0))
    n1 = F.sum(F.when(F.col("is_erupted") == 1, 1).otherwise(0))
    return out.groupBy("name").agg(
        n0.alias("n_0"),
        n1.alias("n_1"),
        (n0 / F.count("*") * 100).alias("percent_0"),
        (n1 / F.count("*") * 100).alias("percent_1"),
    )


def build_y_true(labels: DataFrame, dates: DataFrame) -> DataFrame:
    """Labels with missing as 0 and every row of an event day as 1."""
    hit = dates.select("series", F.col("event_date").alias("day")).distinct().withColumn("_hit", F.lit(1))
    out = labels.withColumn("day", F.to_date("ts")).join(hit, ["series", "day"], "left")
    return out.select(
        "series",
        "id",
        "ts",
        F.greatest(F.coalesce("is_erupted", F.lit(0)), F.coalesce("_hit", F.lit(0))).cast("int").alias("is_erupted"),
    )


def truth_on_grid(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Truth for each predicted (series, id, ts); instants without a label are 0."""
    return predictions.select("series", "id", "ts").distinct().join(
        labels.select("series", "ts", F.col("is_erupted").alias("_y")), ["series", "ts"], "left"
    ).select("series", "id", "ts", F.coalesce("_y", F.lit(0)).cast("int").alias("is_erupted"))


def split_events(dates: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Mark the last ``ceil(n * test_size)`` dates of a series as test, between 1 and n - 1."""
    if not 0 <= test_size <= 1:
        raise ValueError("test_size must be between 0 and 1")
    keyed = Window.partitionBy("series")
    n = F.count("*").over(keyed)
    rank = F.row_number().over(keyed.orderBy("event_date"))
    # Clipping with a lower bound above the upper one yields the upper one.
    n_test = F.least(F.greatest(F.ceil(n * F.lit(float(test_size))), F.lit(1)), n - 1)
    return dates.select("series", "event_date", F.when(rank > n - n_test, "test").otherwise("train").alias("part"))


def minority_share(labels: DataFrame, limit: float = 0.15) -> DataFrame:
    """Share of the rarer class and whether automatic under-sampling applies."""
    p = F.avg(F.col("is_erupted").cast("double"))
    return labels.groupBy("series").agg(F.least(p, 1 - p).alias("minority_share")).withColumn(
        "undersample", F.col("minority_share") <= F.lit(limit)
    )


def attach_datetime(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``ts`` by (series, id); both sides must have the same number of ids."""
    n_left = df.select("series", "id").distinct().groupBy("series").agg(F.count("*").alias("_l"))
    n_right = labels.groupBy("series").agg(F.count("*").alias("_r"))
    same = n_left.join(n_right, "series", "left").select(
        "series",
        F.when(F.col("_l") == F.col("_r"), True)
        .otherwise(F.raise_error(F.lit("labels and rows differ in length")).cast("boolean"))
        .alias("_ok"),
    )
    out = df.join(labels.select("series", "id", "ts"), ["series", "id"])
    return out.join(same, "series").where("_ok").drop("_ok")


def scenario_grid(labels: DataFrame, scenarios: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """Labels tagged with every scenario and part whose dates hold them.

    A scenario is ``(name, train_start, train_end, predict_start, predict_end)``;
    the short list becomes one array literal, so no join is needed.
    """
    spans = []
    for name, a, b, c, d in scenarios:
        for part, lo, hi in (("train", a, b), ("predict", c, d)):
            first, last = day_bounds(lo, hi)
            spans.append(F.when(F.col("ts").between(first, last), F.struct(F.lit(name).alias("scenario"), F.lit(part).alias("part"))))
    return labels.select("*", F.inline(F.filter(F.array(*spans), lambda s: s.isNotNull()))).select(
        "scenario", "part", "series", "id", "ts", "is_erupted"
    )
