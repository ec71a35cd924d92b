"""How the driver tables become this engine's inputs.

``events`` are read as samples of one series whose bands are the event types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.functions.expr import literal_table
from foreshock.session import ensure_utc

# The five bands in order (f0..f4).
BANDS = ["click", "error", "purchase", "signup", "view"]
# Dates of the events to forecast.
EVENT_DATES = ["2024-01-09", "2024-01-15", "2024-01-21", "2024-01-27"]

WINDOW_S = 3600
LOOKBACK_DAYS = 2
STEP_HOURS = 6
GRID_START = "2024-01-03"
GRID_END = "2024-01-30"
TRAIN_END = "2024-01-18"
DAYS_AHEAD = 2
CLASSIFIERS = ["rf", "gb", "lr"]
SEEDS = [0, 1, 2, 3, 4]
RSAM_METRICS = [f"rsam_f{i}" for i in range(len(BANDS))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, series: str = "'all'") -> DataFrame:
    """``samples(series, band, ts, x)`` from the events table."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.expr(series).cast("string").alias("series"),
        F.col("event_type").alias("band"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.nanvl(F.col("value"), F.lit(None).cast("double")).alias("x"),
    )


def event_dates(spark: SparkSession, dates: list[str] | None = None) -> DataFrame:
    ensure_utc(spark)
    days = literal_table(spark, "d", EVENT_DATES if dates is None else dates)
    return days.select(F.lit("all").alias("series"), F.to_date("d").alias("event_date"))
