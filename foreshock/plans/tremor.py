"""From samples to a gap-free tremor table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.expr import rounded
from foreshock.functions.reuse import keep
from foreshock.operators.gaps import interpolate_time
from foreshock.operators.signal import band_metric, on_grid, rsam


def filled_rsam(samples: DataFrame, seconds: int, bands: Sequence[str]) -> DataFrame:
    """Mean-magnitude metrics on the full grid, gaps filled in time, 6 places."""
    names = [f"rsam_f{i}" for i in range(len(bands))]
    cells = rsam(samples, seconds).select("series", band_metric(bands).alias("metric"), "ts", "v")
    # The reduced table is read for its span, its cells and its neighbours; samples are scanned once.
    grid = on_grid(keep(cells.where(F.col("metric").isNotNull())), seconds, names)
    return interpolate_time(grid, both=True).withColumn("v", rounded("v"))
