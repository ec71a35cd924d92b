"""Columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_size(vectors: DataFrame, column: str = "embedding") -> int:
    """The number of entries that most vectors have (ties: the smaller one); 0 if there is no vector with an entry."""
    size = F.size(column)
    found = vectors.where(F.col(column).isNotNull() & (size > 0)).groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows x ``d`` matrix in double precision) of the vectors that have ``d`` entries, all of them finite."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    stored = np.where(length > 0, length, 0)
    start = np.cumsum(stored) - stored
    place = np.flatnonzero(length == d)
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    x = flat[start[place][:, None] + np.arange(d)] if len(place) and d else np.zeros((len(place), d))
    good = np.isfinite(x).all(1)
    return place[good], x[good]
