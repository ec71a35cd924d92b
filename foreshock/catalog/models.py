"""Queries whose core is a fitted model; checked by properties, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.catalog.base import query
from foreshock.catalog.label_matrix import labels
from foreshock.catalog.ranking import features
from foreshock.functions.reuse import keep
from foreshock.operators import sampling, scoring, selection, training
from foreshock.plans.ranking import compact_names

NAMES = compact_names(B.RSAM_METRICS, ["mean", "standard_deviation", "maximum", "mean_abs_change"])
SEEDS = [0, 1]


def parts(spark, sf, names=NAMES):
    f = keep(features(spark, sf, names))
    y = labels(spark)
    cut = F.lit(f"{B.TRAIN_END} 23:59:59").cast("timestamp")
    return f, y.where(F.col("ts") <= cut), y.where(F.col("ts") > cut)


def train_rows(f, y, names=NAMES):
    return keep(training.matrix(f, names).join(y.select("series", "id", "is_erupted"), ["series", "id"]))


@query("fit_classifier")
def fit_classifier(spark, sf):
    """Every kind fitted on the training span, scored on the later one."""
    f, y, later = parts(spark, sf, NAMES)
    train = train_rows(f, y)
    # Each boosting round and each step of the network is a job of its own: fewer of them on so small a table.
    few = {"gb": {"maxIter": 10}, "voting": {"rf": {"numTrees": 20}, "gb": {"maxIter": 10}}, "nn": {"hidden": (8,), "maxIter": 20}}
    models = [training.fit_classifier(k, train, NAMES, 0, few.get(k)) for k in training.KINDS]
    rows = f.join(later.select("series", "id"), ["series", "id"], "left_semi")
    return training.score_seeds(models, rows)


@query("grid_search")
def grid_search(spark, sf):
    f, y, _ = parts(spark, sf, NAMES)
    folds = sampling.cv_splits(sampling.with_seeds(y, [0]), "stratified", 3).where("part = 'test'")
    model, scores = training.grid_search(
        "dt", train_rows(f, y), NAMES, folds, 3, grid={"maxDepth": [2, 4], "impurity": ["gini", "entropy"]}
    )
    cells = F.array(
        *[
            F.struct(F.lit(p["maxDepth"]).alias("max_depth"), F.lit(p["impurity"]).alias("impurity"), F.lit(float(s)).alias("score"))
            for p, s in scores
        ]
    )
    return training.score_seeds([model], f).join(spark.range(1).select(F.inline(cells)).agg(F.max("score").alias("cv_score")))


@query("train_ensemble")
def train_ensemble(spark, sf):
    """Two kinds by two seeds, consensus forecast of the later span."""
    f, y, later = parts(spark, sf)
    models = training.train_ensemble(f, y, ["lr", "lite-rf"], SEEDS, top_n=6)
    rows = f.join(later.select("series", "id"), ["series", "id"], "left_semi")
    per = scoring.seed_consensus(training.score_seeds(models, rows))
    return scoring.forecast_table(per, ["lr", "lite-rf"])


@query("learning_curve")
def learning_curve(spark, sf):
    f, y, _ = parts(spark, sf, NAMES)
    splits = sampling.cv_splits(sampling.with_seeds(y, [0]), "stratified", 2)
    return training.learning_curve("lr", train_rows(f, y), NAMES, splits, [0.4, 1.0])


@query("feature_count_sweep")
def feature_count_sweep(spark, sf):
    f, y, _ = parts(spark, sf)
    seeded = keep(sampling.undersample(sampling.with_seeds(y.select("series", "id", "is_erupted"), SEEDS), 0.75))
    ranked = selection.per_seed_selection(f, seeded, 9).select("seed", "rank", "feature").orderBy("seed", "rank").collect()
    lists = {s: [r["feature"] for r in ranked if r["seed"] == s] for s in SEEDS}
    return sampling.cv_scores(training.feature_count_sweep("lr", f, seeded, lists, [2, 5, 9], k=2))


@query("select_permutation")
def select_permutation(spark, sf):
    f, y, _ = parts(spark, sf, NAMES)
    return training.select_permutation(train_rows(f, y), NAMES, 5, repeats=10, trees=20)


@query("feature_importance")
def feature_importance(spark, sf):
    f, y, _ = parts(spark, sf, NAMES)
    train = train_rows(f, y)
    models = [training.fit_classifier("rf", train, NAMES, s, {"numTrees": 20}) for s in SEEDS]
    return training.feature_importance(models, spark, 5)


@query("attribute_sampled")
def attribute_sampled(spark, sf):
    f, y, later = parts(spark, sf, NAMES)
    model = training.fit_classifier("rf", train_rows(f, y), NAMES, 0, {"numTrees": 20})
    return training.attribute_sampled(model, training.matrix(f, NAMES), 4)
