"""Seed scores, consensus forecasts, envelopes and alerts.

Scores are long: ``(series, classifier, seed, id, p, pred)``; forecasts are
``(series, id | ts, classifier, probability, uncertainty, prediction, confidence)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.blocked import carry_back, running_sum, time_block, with_halo
from foreshock.operators.gaps import trailing_mean

FORECAST = ["probability", "uncertainty", "prediction", "confidence"]


def logistic(s: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


def score_linear(features: DataFrame, coefficients: DataFrame, places: int | None = None) -> DataFrame:
    """Scores of linear models given as rows ``(classifier, seed, feature, coef)``.

    The row with feature ``intercept`` holds the constant.  Every model meets
    its own features only; a feature absent from the table contributes nothing.
    """
    weights = coefficients.where("feature <> 'intercept'")
    constants = coefficients.where("feature = 'intercept'").select("classifier", "seed", F.col("coef").alias("_b"))
    dot = features.join(weights, "feature").groupBy("series", "classifier", "seed", "id").agg(
        F.sum(F.col("coef") * F.col("value")).alias("_s")
    )
    p = logistic(F.col("_s") + F.coalesce("_b", F.lit(0.0)))
    if places is not None:
        p = F.round(p, places)
    out = dot.join(constants, ["classifier", "seed"], "left").withColumn("p", p)
    return out.select("series", "classifier", "seed", "id", "p", (F.col("p") >= 0.5).cast("int").alias("pred"))


def seed_matrix(scores: DataFrame, seeds: Sequence[int], value: str = "p") -> DataFrame:
    """One row per (series, classifier, id), one column per seed."""
    return scores.groupBy("series", "classifier", "id").agg(
        *[F.max(F.when(F.col("seed") == s, F.col(value))).alias(f"seed_{s:05d}") for s in seeds]
    )


def seed_table(scores: DataFrame) -> DataFrame:
    """Per seed: probability of no event, of an event, and the class."""
    return scores.select(
        "series", "classifier", "seed", "id", (1 - F.col("p")).alias("p_no"), F.col("p").alias("p_yes"), F.col("pred").alias("prediction")
    )


def confidence(q: Column, n: Column) -> Column:
    """Half width of the 95 % interval of a share ``q`` of ``n`` votes."""
    return F.lit(1.96) * F.sqrt(q * (1 - q) / n)


def seed_consensus(scores: DataFrame) -> DataFrame:
    """Per classifier: mean probability, population deviation, mean class and its interval."""
    q = F.avg(F.col("pred").cast("double"))
    return scores.groupBy("series", "id", "classifier").agg(
        F.avg("p").alias("probability"),
        F.stddev_pop("p").alias("uncertainty"),
        q.alias("prediction"),
        confidence(q, F.count("*")).alias("confidence"),
    )


def classifier_consensus(per_classifier: DataFrame) -> DataFrame:
    """The same over classifiers, from their mean probabilities and mean classes."""
    q = F.avg("prediction")
    return per_classifier.groupBy("series", "id").agg(
        F.avg("probability").alias("probability"),
        F.stddev_pop("probability").alias("uncertainty"),
        q.alias("prediction"),
        confidence(q, F.count("*")).alias("confidence"),
    )


def forecast_table(per_classifier: DataFrame, classifiers: Sequence[str]) -> DataFrame:
    """Wide forecast: ``consensus_*`` and ``{classifier}_*`` columns from one grouping."""
    q = F.avg("prediction")
    aggs = [
        F.avg("probability").alias("consensus_probability"),
        F.stddev_pop("probability").alias("consensus_uncertainty"),
        q.alias("consensus_prediction"),
        confidence(q, F.count("*")).alias("consensus_confidence"),
    ]
    for c in classifiers:
        aggs += [F.max(F.when(F.col("classifier") == c, F.col(m))).alias(f"{c}_{m}") for m in FORECAST]
    return per_classifier.groupBy("series", "id").agg(*aggs)


def predict(forecast: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class of a forecast row at a probability threshold."""
    return forecast.withColumn("label", (F.col("probability") >= F.lit(threshold)).cast("int"))


def features_union(registry: DataFrame) -> DataFrame:
    """Every feature used by any seed; ``registry(classifier, seed, features ARRAY)``."""
    return registry.select(F.explode("features").alias("feature")).distinct()


def envelope(per_classifier: DataFrame, value: str = "probability", period_s: int = 21600) -> DataFrame:
    """Largest and smallest classifier value per instant and their centred 6-row envelope.

    Needs ``ts``.  Row i's envelope covers rows i-3..i+2; the rows sit on a grid
    of ``period_s``, so a halo of four periods holds the frame at block borders.
    """
    spread = per_classifier.groupBy("series", "ts").agg(F.max(value).alias("highest"), F.min(value).alias("lowest"))
    halo = with_halo(spread, "ts", 4 * period_s, 4 * period_s, max(30 * 86400, 40 * period_s))
    frame = Window.partitionBy("series", "block").orderBy("ts").rowsBetween(-3, 2)
    return (
        halo.withColumns({"min_envelope": F.min("lowest").over(frame), "max_envelope": F.max("highest").over(frame)})
        .where("owned")
        .drop("block", "owned")
    )


def smooth_forecast(forecast: DataFrame, hours: float = 6, value: str = "probability") -> DataFrame:
    """Trailing mean over (ts - hours, ts]."""
    keys = [c for c in ("series", "classifier") if c in forecast.columns]
    return trailing_mean(forecast, keys, value, int(hours * 3600), "smoothed")


def alert_bands(forecast: DataFrame, threshold: float = 0.5, tolerance: float = 0.1) -> DataFrame:
    """'alert' at or above the threshold, 'watch' within ``tolerance`` below, else 'quiet'."""
    p = F.col("probability")
    # Compared at 9 places: threshold - tolerance is not exact in binary.
    low = F.lit(round(threshold - tolerance, 9))
    state = F.when(p >= F.lit(threshold), "alert").when(F.round(p, 9) >= low, "watch").otherwise("quiet")
    return forecast.withColumn("state", state)


def alert_episodes(banded: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Consecutive rows of one state: start, end, rows and peak probability."""
    keys = list(keys)
    based = banded.withColumn("_block", time_block("ts"))
    lagged = carry_back(based, keys, "_block", "ts", ["state"])
    changed = F.when(F.col("prev_state") == F.col("state"), 0).otherwise(1)
    numbered = running_sum(lagged, keys, "_block", "ts", {"episode": changed})
    return numbered.groupBy(*keys, "episode", "state").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("n_rows"),
        F.max("probability").alias("peak"),
    )


def align_labels(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Labels that have features."""
    return labels.join(features.select("series", "id").distinct(), ["series", "id"], "left_semi")
