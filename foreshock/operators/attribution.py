"""Contributions of features to scores.

Attributions are ``(classifier, seed, series, id, feature, contribution, value)``;
a feature a seed did not select has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.reuse import join_back, keep


def attribute_linear(features: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Exact contributions of linear models: coef * (value - mean value)."""
    used = keep(features)
    means = used.groupBy("series", "feature").agg(F.avg("value").alias("_mean"))
    centred = join_back(used, means, ["series", "feature"])
    return centred.join(coefficients, "feature").select(
        "classifier",
        "seed",
        "series",
        "id",
        "feature",
        (F.col("coef") * (F.col("value") - F.col("_mean"))).alias("contribution"),
        "value",
    )


def mean_abs_attribution(attributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per seed, averaged over the seeds that use the feature.

    Also the number of such seeds and their share of all seeds of the classifier.
    """
    per_seed = keep(
        attributions.groupBy("classifier", "seed", "feature").agg(F.avg(F.abs("contribution")).alias("_m"))
    )
    total = per_seed.groupBy("classifier").agg(F.count_distinct("seed").alias("_total"))
    agg = per_seed.groupBy("classifier", "feature").agg(
        F.avg("_m").alias("mean_abs"), F.count("*").alias("n_seeds_selected")
    )
    return join_back(agg, total, ["classifier"]).select(
        "classifier", "feature", "mean_abs", (F.col("n_seeds_selected") / F.col("_total")).alias("selection_frequency"), "n_seeds_selected"
    )


def stack_attributions(attributions: DataFrame, classifier: str) -> DataFrame:
    """Tidy rows (feature, seed, obs, contribution, value) of one classifier."""
    return attributions.where(F.col("classifier") == classifier).select(
        "series", "feature", "seed", F.col("id").alias("obs"), "contribution", "value"
    )


def explain_events(attributions: DataFrame, picks: DataFrame, top_n: int | None = None) -> DataFrame:
    """Contributions of the highest-probability row of each event, matched by keys.

    ``top_n`` keeps the largest absolute contributions of each event.
    """
    best = picks.where("level = 'event'").select(
        "series",
        "classifier",
        "event_date",
        F.col("highest_seed").alias("seed"),
        F.col("highest_id").alias("id"),
        F.col("highest_p").alias("p"),
    )
    out = best.join(attributions, ["series", "classifier", "seed", "id"])
    if top_n is None:
        return out
    order = Window.partitionBy("series", "classifier", "event_date").orderBy(
        F.round(F.abs("contribution"), 9).desc(), F.col("feature")
    )
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_n).drop("_r")
