"""Samples to ranked features: the plan behind the flagship query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.expr import rounded
from foreshock.operators import lookback, selection
from foreshock.operators.features.extract import extract_features
from foreshock.plans.tremor import filled_rsam

# Calculators of the compact feature set used for ranking and scoring.
COMPACT = [
    "mean",
    "standard_deviation",
    "maximum",
    "skewness",
    "mean_abs_change",
    'linear_trend__attr_"slope"',
    "symmetry_looking__r_0.05",
    "large_standard_deviation__r_0.25",
]


def compact_names(metrics: Sequence[str], calculators: Sequence[str] = COMPACT) -> list[str]:
    return [f"{m}__{c}" for m in metrics for c in calculators]


def features_from_samples(
    samples: DataFrame,
    labels: DataFrame,
    bands: Sequence[str],
    period_s: int,
    days: float,
    step_s: int,
    names: Sequence[str],
) -> DataFrame:
    """Named features of every label whose look-back is complete, at 6 places."""
    tremor = filled_rsam(samples, period_s, bands)
    matrix = lookback.lookback_matrix(tremor, labels, days, step_s, period_s)
    return extract_features(matrix, only=names).withColumn("value", rounded("value"))


def ranked_features(features: DataFrame, labels: DataFrame, top_n: int = 20) -> DataFrame:
    """The ``top_n`` features with the smallest p-values."""
    ranked = selection.fdr_filter(selection.rank_test(features, labels))
    return ranked.where(F.col("rank") <= top_n)
