"""Seeded classifiers on Spark ML: fitting, tuning, scoring, importance.

Relational parts (sampling, ranking, splits) carry the seed as a column; only
the fits themselves are a driver loop, over small matrices of labelled windows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreshock.functions.reuse import join_back, keep
from foreshock.operators import sampling, selection
from foreshock.operators.scoring import logistic

KINDS = ["svm", "dt", "rf", "gb", "nn", "nb", "lr", "voting", "lite-rf"]
# Kinds whose classes are weighted by n / (2 n_class) by default.
WEIGHTED = {"svm", "dt", "rf", "lite-rf", "lr"}

# Hyper-parameter grids, in Spark ML names; C is the weight of the summed loss against the penalty.
GRIDS: dict[str, dict[str, list]] = {
    "svm": {"C": [0.001, 0.01, 0.1, 1.0, 10.0]},
    "dt": {"maxDepth": [3, 5, 7], "impurity": ["gini", "entropy"]},
    "rf": {
        "numTrees": [50, 100],
        "maxDepth": [3, 5, 7],
        "impurity": ["gini", "entropy"],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
        "minInstancesPerNode": [1, 2],
    },
    "gb": {"maxIter": [100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1], "subsamplingRate": [0.8, 1.0]},
    "nn": {"hidden": [(50,), (100,), (100, 50), (100, 100)], "stepSize": [0.001, 0.01]},
    "nb": {},
    "lr": {"C": [0.001, 0.01, 0.1, 1.0, 10.0], "elasticNetParam": [0.0, 0.15, 0.5, 0.85, 1.0]},
    "lite-rf": {
        "numTrees": [10, 30, 100],
        "maxDepth": [3, 5, 7],
        "impurity": ["gini", "entropy"],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
    },
}


#: Smallest, median and largest finite value of a feature in the training rows.
Fill = tuple[float, float, float]


@dataclass
class SeedModel:
    """A fitted model of one seed with the features it reads, in order."""

    classifier: str
    seed: int
    features: list[str]
    models: list[Model] = field(default_factory=list)
    fill: list[Fill] = field(default_factory=list)


def fill_values(features: DataFrame, names: Sequence[str]) -> list[Fill]:
    """Smallest, median and largest finite value of each named feature; an absent name is an error.

    One row per name reaches the driver.
    """
    value = F.col("value")
    finite = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
    stats = features.where(F.col("feature").isin(list(names))).groupBy("feature").agg(
        F.min(finite).alias("lo"), F.percentile(finite, 0.5).alias("mid"), F.max(finite).alias("hi")
    )
    found = {r["feature"]: tuple(float(v) if v is not None else 0.0 for v in (r["lo"], r["mid"], r["hi"])) for r in stats.collect()}
    absent = [n for n in names if n not in found]
    if absent:
        raise ValueError(f"features are absent: {absent}")
    return [found[n] for n in names]


def _pivoted(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per id with column ``_i`` for the i-th name; ids without any of them have a row too."""
    named = [F.max(F.when(F.col("feature") == n, F.col("value"))).alias(f"_{i}") for i, n in enumerate(names)]
    return features.groupBy("series", "id").agg(*named)


def _filled(columns: Sequence[str], fill: Sequence[Fill]) -> Column:
    inf = F.lit(float("inf"))
    out = []
    for c, (lo, mid, hi) in zip(columns, fill, strict=True):
        v = F.col(c)
        missing = v.isNull() | F.isnan(v)
        out.append(F.when(missing, F.lit(mid)).when(v == inf, F.lit(hi)).when(v == -inf, F.lit(lo)).otherwise(v))
    return F.array(*out)


def matrix(features: DataFrame, names: Sequence[str], fill: Sequence[Fill] | None = None) -> DataFrame:
    """``(series, id, x)``: one array of the named features for every id.

    A missing value becomes the median of ``fill``, an infinite one its largest
    or smallest; without ``fill`` they are those of ``features``.  A name that
    ``features`` lacks is an error.
    """
    fill = fill_values(features, names) if fill is None else fill
    wide = _pivoted(features, names)
    return wide.select("series", "id", _filled([f"_{i}" for i in range(len(names))], fill).alias("x"))


def with_weights(train: DataFrame, weighted: bool) -> DataFrame:
    """Add ``label``, ``weight`` and the feature vector of a training matrix."""
    out = train.withColumns({"label": F.col("is_erupted").cast("double"), "features": array_to_vector("x")})
    if not weighted:
        return out.withColumn("weight", F.lit(1.0))
    n, n1 = train.agg(F.count("*"), F.sum("is_erupted")).first()
    n1 = n1 or 0
    if not 0 < n1 < n:
        raise ValueError("training needs both classes")
    w = F.when(F.col("is_erupted") == 1, n / (2 * n1)).otherwise(n / (2 * (n - n1)))
    return out.withColumn("weight", w)


def penalty(params: Mapping[str, object], n_rows: int) -> dict[str, object]:
    """``C`` as Spark's ``regParam``, which weighs the penalty against the mean loss: 1 / (n C)."""
    p = dict(params)
    if "C" in p:
        p["regParam"] = 1.0 / (max(1, n_rows) * float(p.pop("C")))
    return p


def estimator(kind: str, seed: int, n_features: int, params: Mapping[str, object] | None = None, n_rows: int = 1):
    """Unfitted Spark ML estimator of a kind, for ``n_rows`` training rows."""
    p = {"C": 1.0, **(params or {})} if kind in ("lr", "svm") and "regParam" not in (params or {}) else dict(params or {})
    p = penalty(p, n_rows)
    io = {"featuresCol": "features", "labelCol": "label"}
    w = {**io, "weightCol": "weight"}
    if kind == "rf":
        return RandomForestClassifier(**w, seed=seed, **{"numTrees": 100, "maxDepth": 5, **p})
    if kind == "lite-rf":
        return RandomForestClassifier(**w, seed=seed, **{"numTrees": 10, "maxDepth": 5, **p})
    if kind == "dt":
        return DecisionTreeClassifier(**w, seed=seed, **{"maxDepth": 5, **p})
    if kind == "gb":
        return GBTClassifier(**w, seed=seed, **{"maxIter": 100, "maxDepth": 3, **p})
    if kind == "lr":
        return LogisticRegression(**w, **{"elasticNetParam": 0.0, **p})
    if kind == "nb":
        return NaiveBayes(**w, modelType="gaussian", **p)
    if kind == "svm":
        return LinearSVC(**w, **{"maxIter": 100, "tol": 1e-4, **p})
    if kind == "nn":
        hidden = list(p.pop("hidden", (50,)))
        return MultilayerPerceptronClassifier(**io, seed=seed, layers=[n_features, *hidden, 2], **{"maxIter": 1000, "tol": 1e-4, **p})
    raise ValueError(f"unknown classifier {kind}; choose from {KINDS}")


def fit_classifier(
    kind: str,
    train: DataFrame,
    names: Sequence[str],
    seed: int = 0,
    params: Mapping[str, object] | None = None,
    fill: Sequence[Fill] = (),
) -> SeedModel:
    """Fit one kind on ``train(series, id, x, is_erupted)``; ``fill`` is kept for scoring.

    ``voting`` is the soft mean of the forest and the boosted trees; its
    ``params`` are those of each by kind.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown classifier {kind}; choose from {KINDS}")
    parts = ["rf", "gb"] if kind == "voting" else [kind]
    models = []
    n_rows = train.count() if kind in ("lr", "svm") else 1
    for part in parts:
        data = with_weights(train, part in WEIGHTED)
        own = (params or {}).get(part) if kind == "voting" else params
        models.append(estimator(part, seed, len(names), own, n_rows).fit(data))
    return SeedModel(kind, seed, list(names), models, list(fill))


def _probability(scored: DataFrame) -> Column:
    """P(class 1); a decision score goes through the logistic function."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    return logistic(vector_to_array("rawPrediction")[1])


def score_model(model: SeedModel, rows: DataFrame) -> DataFrame:
    """``(series, classifier, seed, id, p, pred)`` of ``rows(series, id, x)``; extra columns kept."""
    out = rows.withColumn("features", array_to_vector("x"))
    ps = []
    for i, m in enumerate(model.models):
        scored = m.transform(out)
        made = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
        out = scored.withColumn(f"_p{i}", _probability(scored)).drop(*made)
        ps.append(F.col(f"_p{i}"))
    p = sum(ps[1:], ps[0]) / len(ps)
    extra = [c for c in rows.columns if c not in ("series", "id", "x")]
    return out.select(
        "series", F.lit(model.classifier).alias("classifier"), F.lit(model.seed).alias("seed"), "id", *extra,
        p.alias("p"), (p >= 0.5).cast("int").alias("pred"),
    )


def score_seeds(models: Sequence[SeedModel], features: DataFrame) -> DataFrame:
    """Scores of every seed model on its own features, for every id of ``features``.

    One pivot serves all models.  Values are filled as in training; models
    without such a record fill from ``features``.
    """
    names = list(dict.fromkeys(n for m in models for n in m.features))
    own = dict(zip(names, fill_values(features, names), strict=True))
    column = {n: f"_{i}" for i, n in enumerate(names)}
    wide = keep(_pivoted(features, names))
    parts = []
    for m in models:
        x = _filled([column[n] for n in m.features], m.fill or [own[n] for n in m.features])
        parts.append(score_model(m, wide.select("series", "id", x.alias("x"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class BalancedAccuracy(Evaluator):
    """Mean of the recalls of both classes."""

    def _evaluate(self, dataset: DataFrame) -> float:
        hit = F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)
        r1 = F.avg(F.when(F.col("label") == 1, hit))
        r0 = F.avg(F.when(F.col("label") == 0, hit))
        row = dataset.agg(r1.alias("a"), r0.alias("b")).first()
        present = [v for v in (row["a"], row["b"]) if v is not None]
        return float(sum(present) / len(present)) if present else 0.0

    def isLargerBetter(self) -> bool:
        return True


def grid_points(kind: str, grid: Mapping[str, Sequence] | None = None) -> list[dict]:
    grid = dict(GRIDS[kind] if grid is None else grid)
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_search(
    kind: str,
    train: DataFrame,
    names: Sequence[str],
    folds: DataFrame,
    k: int,
    seed: int = 0,
    grid: Mapping[str, Sequence] | None = None,
    parallelism: int = 4,
) -> tuple[SeedModel, list[tuple[dict, float]]]:
    """Every grid point on every fold by mean balanced accuracy, refit on all rows.

    ``folds(series, id, fold)`` gives the test fold of each row.
    """
    if kind == "voting":
        raise ValueError("tune the members of 'voting' on their own")
    points = grid_points(kind, grid)
    data = with_weights(train, kind in WEIGHTED).join(folds.select("series", "id", F.col("fold").cast("int").alias("fold")), ["series", "id"])
    data = data.cache()
    try:
        n_rows = data.count()
        base = estimator(kind, seed, len(names), None, n_rows)
        maps = []
        for point in points:
            named = {("layers" if n == "hidden" else n): v for n, v in penalty(point, n_rows).items()}
            if "layers" in named:
                named["layers"] = [len(names), *named["layers"], 2]
            maps.append({base.getParam(n): v for n, v in named.items()})
        cv = CrossValidator(
            estimator=base, estimatorParamMaps=maps, evaluator=BalancedAccuracy(), numFolds=k, foldCol="fold", parallelism=parallelism
        ).fit(data)
    finally:
        data.unpersist()
    return SeedModel(kind, seed, list(names), [cv.bestModel]), list(zip(points, cv.avgMetrics))


def train_ensemble(
    features: DataFrame,
    labels: DataFrame,
    kinds: Sequence[str],
    seeds: Sequence[int],
    top_n: int = 20,
    ratio: float = 0.75,
    params: Mapping[str, Mapping[str, object]] | None = None,
    done: set[tuple[str, int]] = frozenset(),
) -> list[SeedModel]:
    """Per seed: under-sample, rank features, fit every kind.

    Sampling and ranking run once for all seeds; the resulting feature lists
    (seeds x top_n names) are the only thing brought to the driver.  Pairs in
    ``done`` are skipped.
    """
    kept = keep(features)
    sampled = keep(sampling.undersample(sampling.with_seeds(labels.select("series", "id", "is_erupted"), seeds), ratio))
    ranked = selection.per_seed_selection(kept, sampled, top_n)
    lists: dict[int, list[str]] = {}
    for row in ranked.select("seed", "rank", "feature").distinct().orderBy("seed", "rank", "feature").collect():
        names = lists.setdefault(row["seed"], [])
        if row["feature"] not in names:
            names.append(row["feature"])
    names = sorted({n for chosen in lists.values() for n in chosen})
    trained_on = kept.join(labels.select("series", "id").distinct(), ["series", "id"], "left_semi")
    fills = dict(zip(names, fill_values(trained_on, names), strict=True)) if names else {}
    out = []
    for seed in seeds:
        pending = [k for k in kinds if (k, seed) not in done]
        if not pending or seed not in lists:
            continue
        rows = sampled.where(F.col("seed") == seed).select("series", "id", "is_erupted")
        fill = [fills[n] for n in lists[seed]]
        train = matrix(kept, lists[seed], fill).join(rows, ["series", "id"]).cache()
        try:
            for kind in pending:
                out.append(fit_classifier(kind, train, lists[seed], seed, (params or {}).get(kind), fill))
        finally:
            train.unpersist()
    return out


def save_ensemble(models: Sequence[SeedModel], path: str, spark: SparkSession) -> None:
    """Write fitted models and append their registry rows."""
    rows = []
    for m in models:
        for i, part in enumerate(m.models):
            part.write().overwrite().save(f"{path}/models/{m.classifier}/{m.seed:05d}/{i}")
        rows.append((m.classifier, m.seed, m.features, [type(p).__name__ for p in m.models], [list(f) for f in m.fill]))
    if rows:
        schema = "classifier string, seed int, features array<string>, parts array<string>, fill array<array<double>>"
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{path}/registry")


def registry_pairs(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """(classifier, seed) pairs already trained under ``path``."""
    try:
        df = spark.read.parquet(f"{path}/registry")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()  # no registry yet
    return {(r["classifier"], r["seed"]) for r in df.select("classifier", "seed").distinct().collect()}


def load_ensemble(spark: SparkSession, path: str) -> list[SeedModel]:
    """Models of a registry, ready to score."""
    import pyspark.ml.classification as classes

    out = []
    # A pair that was trained again has several rows of the same models.
    registry = spark.read.parquet(f"{path}/registry").dropDuplicates(["classifier", "seed"])
    for r in registry.orderBy("classifier", "seed").collect():
        parts = [
            getattr(classes, name).load(f"{path}/models/{r['classifier']}/{r['seed']:05d}/{i}") for i, name in enumerate(r["parts"])
        ]
        out.append(SeedModel(r["classifier"], r["seed"], list(r["features"]), parts, [tuple(f) for f in r["fill"]]))
    return out


def _balanced(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = F.when(F.col("pred") == F.col("is_erupted"), 1.0).otherwise(0.0)
    r1, r0 = F.avg(F.when(F.col("is_erupted") == 1, hit)), F.avg(F.when(F.col("is_erupted") == 0, hit))
    return scored.groupBy(*keys).agg(((F.coalesce(r1, r0) + F.coalesce(r0, r1)) / 2).alias("score"))


def learning_curve(
    kind: str, data: DataFrame, names: Sequence[str], splits: DataFrame, sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), seed: int = 0
) -> DataFrame:
    """Train and test balanced accuracy for growing training sets, mean and deviation over folds.

    ``data(series, id, x, is_erupted)``; ``splits(series, id, fold, part)``.
    A training set is a prefix of the shuffled order of its fold, per class, so
    both classes are present at every size.
    """
    base = splits.select("series", "id", "fold", "part").join(data, ["series", "id"])
    base = keep(sampling.shuffled_position(base.withColumn("seed", F.lit(seed)), ["series", "fold", "part", "is_erupted"]))
    totals = base.where("part = 'train'").groupBy("series", "fold", "is_erupted").agg(F.count("*").alias("_n"))
    rows = keep(base.join(totals, ["series", "fold", "is_erupted"], "left"))
    folds = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    parts = []
    for size in sizes:
        for fold in folds:
            here = rows.where(F.col("fold") == fold)
            train = here.where((F.col("part") == "train") & (F.col("position") <= F.ceil(F.col("_n") * F.lit(float(size)))))
            cols = ["series", "id", "x", "is_erupted"]
            model = fit_classifier(kind, train.select(*cols), names, seed)
            both = train.select(*cols, F.lit("train").alias("part")).unionByName(
                here.where("part = 'test'").select(*cols, F.lit("test").alias("part"))
            )
            scored = score_model(model, both)
            parts.append(
                _balanced(scored, ["part"]).select(F.lit(float(size)).alias("size"), F.lit(fold).alias("fold"), "part", "score")
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("size", "part").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def feature_count_sweep(
    kind: str, features: DataFrame, seed_labels: DataFrame, rankings: Mapping[int, Sequence[str]], counts: Sequence[int], k: int = 5
) -> DataFrame:
    """Raw scores ``(N, seed, score)``: mean test balanced accuracy over folds.

    A count beyond the shortest ranking is dropped.  Resampling, if any, is in
    ``seed_labels`` and stays inside the seed's rows.
    """
    shortest = min(len(r) for r in rankings.values())
    usable = [n for n in counts if 1 <= n <= shortest]
    if not usable:
        raise ValueError("no count fits the shortest ranking")
    splits = keep(sampling.cv_splits(seed_labels, "stratified", k))
    kept = keep(features)
    parts = []
    for seed, names in rankings.items():
        mine = splits.where(F.col("seed") == seed)
        for n in usable:
            data = keep(matrix(kept, names[:n]).join(mine.select("series", "id", "fold", "part", "is_erupted"), ["series", "id"]))
            for fold in range(k):
                here = data.where(F.col("fold") == fold)
                model = fit_classifier(kind, here.where("part = 'train'").select("series", "id", "x", "is_erupted"), names[:n], seed)
                scored = score_model(model, here.where("part = 'test'").select("series", "id", "x", "is_erupted"))
                parts.append(_balanced(scored, []).select(F.lit(n).alias("N"), F.lit(seed).alias("seed"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("N", "seed").agg(F.avg("score").alias("score"))


def select_permutation(
    data: DataFrame, names: Sequence[str], top_n: int = 20, repeats: int = 10, seed: int = 0, trees: int = 100
) -> DataFrame:
    """Score drop when a feature is shuffled: mean, deviation and rank per feature.

    All shuffles are scored by one batch job: each row is repeated per feature
    and repeat with that one value taken from the row at the same place of a
    shuffled order.
    """
    model = fit_classifier("rf", data, names, seed, {"numTrees": trees, "maxDepth": 5, "minInstancesPerNode": 5})
    n_tasks = len(names) * repeats
    rows = keep(data.select("series", "id", "x", "is_erupted"))
    task = F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))).alias("task")
    feature = F.floor(F.col("task") / repeats).cast("int")
    plain = sampling.shuffled_position(rows.withColumn("seed", F.lit(0)), ["series"]).drop("seed")
    donors = rows.select("series", "id", "x", task)
    donors = sampling.shuffled_position(
        donors.withColumn("seed", F.col("task") + F.lit(seed * 1000 + 1)), ["series", "task"]
    ).select("series", "task", "position", F.element_at("x", feature + 1).alias("_new"))
    swapped = plain.join(donors, ["series", "position"]).withColumn("_f", feature)
    swapped = swapped.withColumn(
        "x", F.expr("transform(x, (v, i) -> if(i = _f, _new, v))")
    ).select("series", "id", "x", "is_erupted", "task")
    base = _balanced(score_model(model, rows), []).withColumnRenamed("score", "_base")
    shuffled = _balanced(score_model(model, swapped), ["task"]).crossJoin(F.broadcast(base))
    by_name = F.element_at(F.array(*[F.lit(n) for n in names]), feature + 1)
    agg = shuffled.groupBy(by_name.alias("feature")).agg(
        F.avg(F.col("_base") - F.col("score")).alias("mean"), F.stddev_pop(F.col("_base") - F.col("score")).alias("std")
    )
    ranked = agg.withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("mean", 9).desc(), "feature")).cast("long")
    )
    return ranked.where(F.col("rank") <= top_n)


def feature_importance(models: Sequence[SeedModel], spark: SparkSession, top_n: int | None = None) -> DataFrame:
    """Model importances: mean and population deviation over the seeds that use a feature.

    One row per (model, feature): as many as the models have inputs.
    """
    rows = []
    for m in models:
        for part in m.models:
            if hasattr(part, "featureImportances"):
                values = part.featureImportances.toArray()
            elif hasattr(part, "coefficients"):
                values = abs(part.coefficients.toArray())
            else:
                continue
            rows += [(m.classifier, m.seed, f, float(v)) for f, v in zip(m.features, values)]
    df = spark.createDataFrame(rows, "classifier string, seed int, feature string, importance double")
    out = df.groupBy("classifier", "feature").agg(
        F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"), F.count_distinct("seed").alias("n_seeds")
    )
    if top_n is None:
        return out
    order = Window.partitionBy("classifier").orderBy(F.col("mean").desc(), F.col("feature"))
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_n).drop("_r")


def attribute_sampled(model: SeedModel, rows: DataFrame, orders: int = 8, seed: int = 0) -> DataFrame:
    """Sampled-permutation Shapley contributions of any model, as one scoring job.

    For each of ``orders`` feature orders a row is scored with the first 0..F
    features present and the others at their mean; consecutive differences are
    the contributions.  Per order they add up to f(x) - f(mean).
    """
    names = model.features
    f = len(names)
    kept = keep(rows.select("series", "id", "x"))
    means = kept.groupBy("series").agg(*[F.avg(F.element_at("x", i + 1)).alias(f"_m{i}") for i in range(f)])
    means = means.select("series", F.array(*[f"_m{i}" for i in range(f)]).alias("_mean"))
    perms = []
    for o in range(orders):
        # Odd orders run the preceding order backwards, which cancels much of the noise.
        key = [((i + 1) * (48271 + (o // 2 + seed) * 69621)) % 2147483647 for i in range(f)]
        order = sorted(range(f), key=lambda i: key[i])
        perms.append(order if o % 2 == 0 else order[::-1])
    place = [[p.index(i) for i in range(f)] for p in perms]
    orders_lit = F.array(*[F.array(*[F.lit(v) for v in p]) for p in place])
    grown = (
        join_back(kept, means, ["series"])
        .select("*", F.posexplode(orders_lit).alias("ord", "_place"))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(f))))
        .withColumn("x", F.expr("transform(x, (v, i) -> if(_place[i] < step, v, _mean[i]))"))
        .select("series", "id", "x", "ord", "step")
    )
    scored = score_model(model, grown)
    steps = Window.partitionBy("series", "id", "ord").orderBy("step")
    gained = scored.withColumn("_d", F.col("p") - F.lag("p").over(steps)).where("step > 0")
    at = F.array(*[F.array(*[F.lit(v) for v in p]) for p in perms])
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.element_at(F.element_at(at, F.col("ord") + 1), F.col("step")) + 1)
    return gained.groupBy("series", "id", name.alias("feature")).agg((F.sum("_d") / F.lit(float(orders))).alias("contribution")).select(
        F.lit(model.classifier).alias("classifier"), F.lit(model.seed).alias("seed"), "series", "id", "feature", "contribution"
    )
