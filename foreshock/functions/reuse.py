"""Persisting reduced tables that one plan reads several times.

Column pruning gives each reader of a subplan its own shape, which defeats
exchange reuse; persisting the reduced table keeps the expensive input (raw
samples, the feature pipeline) at one pass.  Persisted blocks spill to disk and
are recomputed from lineage when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist ``df`` lazily until :func:`release`."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release() -> None:
    """Drop everything persisted by :func:`keep`; call after results are written."""
    while _kept:
        df = _kept.pop()
        try:
            df.unpersist(blocking=False)
        except Exception:  # the session that held it may be gone
            continue


def join_back(df: DataFrame, derived: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table to something derived from itself.

    The derived side gets fresh key columns.  Otherwise the analyzer rewrites
    its whole plan to tell the two sides apart, and the rewritten copy no longer
    matches a persisted table or a reusable exchange.
    """
    fresh = {k: f"_r_{k}" for k in keys}
    right = derived.select(
        *[F.col(k).alias(r) for k, r in fresh.items()], *[F.col(f"`{c}`") for c in derived.columns if c not in fresh]
    )
    on = [F.col(k) == F.col(r) for k, r in fresh.items()]
    return df.join(right, on, how).drop(*fresh.values())
