"""Forecasts that follow a stream of window metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.expr import SECONDS_PER_DAY
from foreshock.operators import lookback, scoring
from foreshock.operators.features.extract import extract_features
from foreshock.streaming.update import read_days, upsert_days


def touched_labels(batch: DataFrame, table: DataFrame, days: float, step_s: int, period_s: int) -> DataFrame:
    """Instants on the step grid whose look-back holds a row of ``batch`` and has ended in ``table``; the id is the step number.

    A row at t belongs to the look-backs that end in (t, t + days], so late and
    corrected rows change labels that lie ahead of them, perhaps behind newer rows.
    """
    span = batch.groupBy("series").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    ended = table.groupBy("series").agg(F.max("ts").alias("_end"))
    first = F.floor(F.unix_seconds("_a") / F.lit(step_s)) + 1
    reached = F.unix_seconds("_b") + F.lit(int(days * SECONDS_PER_DAY))
    last = F.floor(F.least(reached, F.unix_seconds("_end") + F.lit(period_s)) / F.lit(step_s))
    grid = span.join(ended, "series").where(first <= last).select("series", F.explode(F.sequence(first, last)).alias("id"))
    return grid.withColumn("ts", F.timestamp_seconds(F.col("id") * F.lit(step_s)))


def forecast_sink(
    tremor_path: str,
    forecast_path: str,
    score: Callable[[DataFrame], DataFrame],
    names: Sequence[str],
    days: float,
    step_s: int,
    period_s: int,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: upsert metrics, then forecast every label they touch.

    ``score`` maps features to seed scores.  Only the days that look-backs of
    the touched labels reach are read back; a forecast is made when the last row
    of its look-back arrives, also a late one, and replaced when one changes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            span = batch.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
            if span["a"] is None:
                return
            upsert_days(spark, batch.select("series", "metric", "ts", "v"), tremor_path, ["series", "metric", "ts"])
            table = read_days(spark, tremor_path)
            margin = math.ceil(days) + 1
            reach = table.where(
                F.col("dt").between(
                    F.date_sub(F.to_date(F.lit(span["a"])), margin), F.date_add(F.to_date(F.lit(span["b"])), margin)
                )
            ).drop("dt")
            labels = touched_labels(batch, reach, days, step_s, period_s)
            slices = lookback.lookback_matrix(reach, labels, days, step_s, period_s)
            features = extract_features(slices, only=names)
            per = scoring.seed_consensus(score(features))
            timed = per.join(labels, ["series", "id"])
            upsert_days(spark, timed, forecast_path, ["series", "classifier", "ts"])
        finally:
            batch.unpersist()

    return write
