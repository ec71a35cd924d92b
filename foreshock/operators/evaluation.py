"""Metrics, curves, thresholds, rankings and event summaries of scores.

The working table is ``evaluated``: ``(series, classifier, seed, id, p, pred,
is_erupted)``.  Curve points come from a histogram of scores, so one model's
scores are never sorted in a single task; grids and thresholds are fixed short
lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.blocked import value_histogram
from foreshock.functions.expr import lerp, zero_divide
from foreshock.functions.reuse import join_back, keep

KEYS = ["series", "classifier", "seed"]
METRICS = [
    "accuracy",
    "balanced_accuracy",
    "precision",
    "recall",
    "specificity",
    "f1_score",
    "mcc",
    "g_mean",
]


def with_truth(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of labelled ids with their truth."""
    return scores.join(labels.select("series", "id", "is_erupted"), ["series", "id"])


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def confusion(evaluated: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """tn, fp, fn, tp of the predicted class."""
    y, z = F.col("is_erupted") == 1, F.col("pred") == 1
    return evaluated.groupBy(*keys).agg(
        _count(~y & ~z).alias("tn"), _count(~y & z).alias("fp"), _count(y & ~z).alias("fn"), _count(y & z).alias("tp")
    )


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall = zero_divide(tp, tp + fn)
    specificity = zero_divide(tn, tn + fp)
    return {
        "accuracy": zero_divide(tp + tn, tn + fp + fn + tp),
        "balanced_accuracy": (recall + specificity) / 2,
        "precision": zero_divide(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "f1_score": zero_divide(2 * tp, 2 * tp + fp + fn),
        "mcc": zero_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "g_mean": F.sqrt(recall * specificity),
    }


def seed_metrics(evaluated: DataFrame, keys: Sequence[str] = KEYS, places: int | None = None) -> DataFrame:
    """Class metrics per model; division by zero is 0.  ``places`` rounds at the end."""
    rates = _rates()
    if places is not None:
        rates = {n: F.round(c, places) for n, c in rates.items()}
    return confusion(evaluated, keys).select(*keys, "tn", "fp", "fn", "tp", *[c.alias(n) for n, c in rates.items()])


def score_histogram(evaluated: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per distinct score: rows and positives here, at or above, and in total."""
    hist = value_histogram(evaluated, keys, "p", {"n": F.lit(1), "n1": F.col("is_erupted").cast("long")})
    return hist.select(
        *keys,
        "p",
        "n",
        "n1",
        "n_before",
        "n1_before",
        (F.col("n_all") - F.col("n_before")).alias("above"),
        (F.col("n1_all") - F.col("n1_before")).alias("tp"),
        F.col("n_all").alias("total"),
        F.col("n1_all").alias("pos"),
    )


def ranking_metrics(hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """ROC AUC (NULL with one class), average precision and PR AUC in one aggregation."""
    n, n1, tp, above = (F.col(c).cast("double") for c in ("n", "n1", "tp", "above"))
    rank_sum = F.sum(n1 * (F.col("n_before") + (n + 1) / 2))
    pos, neg = F.max("pos").cast("double"), (F.max("total") - F.max("pos")).cast("double")
    precision = tp / above
    step = n1 / F.nullif(F.col("pos").cast("double"), F.lit(0.0))
    # The point above this score; the curve starts at recall 0, precision 1.
    higher = F.when(above - n > 0, (tp - n1) / F.nullif(above - n, F.lit(0.0))).otherwise(1.0)
    return hist.groupBy(*keys).agg(
        ((rank_sum - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0))).alias("roc_auc"),
        F.sum(step * precision).alias("average_precision"),
        F.sum(step * (precision + higher) / 2).alias("pr_auc"),
    )


def roc_auc(evaluated: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return ranking_metrics(score_histogram(evaluated, keys), keys).select(*keys, "roc_auc")


def average_precision(evaluated: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return ranking_metrics(score_histogram(evaluated, keys), keys).select(*keys, "average_precision", "pr_auc")


def _origin(hist: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """One extra point per model, at a threshold above every score."""
    return hist.groupBy(*keys).agg(F.max("total").alias("total"), F.max("pos").alias("pos")).select(
        *keys, F.lit(None).cast("double").alias("threshold"), *[c.alias(n) for n, c in values.items()]
    )


def roc_curve(hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """fpr and tpr per distinct score, plus the origin (NULL threshold)."""
    pos, neg = F.col("pos").cast("double"), (F.col("total") - F.col("pos")).cast("double")
    points = hist.select(
        *keys,
        F.col("p").alias("threshold"),
        zero_divide((F.col("above") - F.col("tp")).cast("double"), neg).alias("fpr"),
        zero_divide(F.col("tp").cast("double"), pos).alias("tpr"),
    )
    return points.unionByName(_origin(hist, keys, fpr=F.lit(0.0), tpr=F.lit(0.0)))


def pr_curve(hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Precision and recall per distinct score, plus the end point (0, 1)."""
    points = hist.select(
        *keys,
        F.col("p").alias("threshold"),
        (F.col("tp") / F.col("above")).alias("precision"),
        zero_divide(F.col("tp").cast("double"), F.col("pos").cast("double")).alias("recall"),
    )
    return points.unionByName(_origin(hist, keys, precision=F.lit(1.0), recall=F.lit(0.0)))


def _mean_curve(
    points: DataFrame, areas: DataFrame, size: int, start: float, names: tuple[str, str, str], force_origin: bool = False
) -> DataFrame:
    """Curves on ``size`` even steps of x in [0, 1], averaged over seeds.

    ``points(keys, num, den, seq, y)`` has x = num / den in order of ``seq`` and
    an implied first point (0, ``start``); ``areas`` has one row per model.
    Points are reduced to the first and last of each grid cell, so at most two
    points per cell are interpolated however long the curve is.
    """
    x_name, y_name, score = names
    top = F.lit(size - 1)
    # Grid step at or after a point: an integer ceiling, so no point changes sides by rounding.
    cell = F.expr(f"cast((num * {size - 1} + den - 1) div den as int)")
    point = F.struct((F.col("num") / F.col("den")).alias("x"), F.col("seq"), F.col("y"))
    cells = points.groupBy(*KEYS, cell.alias("g")).agg(F.min(point).alias("_lo"), F.max(point).alias("_hi"))
    every = areas.select(*KEYS, score, F.explode(F.sequence(F.lit(0), top)).alias("g"))
    order = Window.partitionBy(*KEYS).orderBy("g")
    near = join_back(every, cells, [*KEYS, "g"], "left").withColumns(
        {
            "_a": F.last("_hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_b": F.first("_lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    at = F.col("g") / top
    x0, y0 = F.coalesce("_a.x", F.lit(0.0)), F.coalesce("_a.y", F.lit(float(start)))
    y = lerp(at, x0, y0, F.col("_b.x"), F.col("_b.y"))
    if force_origin:
        y = F.when(F.col("g") == 0, F.lit(0.0)).otherwise(y)
    curve = near.select(*KEYS, "g", at.alias("x"), y.alias("y"), score)
    return curve.groupBy("series", "classifier", "g").agg(
        F.max("x").alias(x_name),
        F.avg("y").alias(f"mean_{y_name}"),
        F.stddev_pop("y").alias(f"std_{y_name}"),
        F.avg(score).alias(f"mean_{score}"),
        F.stddev_pop(score).alias(f"std_{score}"),
    ).drop("g")


def mean_roc(evaluated: DataFrame, size: int = 100, force_origin: bool = True) -> DataFrame:
    """Mean ROC over seeds on an even grid of false-positive rates.

    ``force_origin`` sets the first point to 0, as the per-classifier form does.
    """
    hist = score_histogram(evaluated)
    neg = F.col("total") - F.col("pos")
    points = hist.where(neg > 0).select(
        *KEYS, (F.col("above") - F.col("tp")).alias("num"), neg.alias("den"), F.col("above").alias("seq"),
        (F.col("tp") / F.col("pos")).alias("y"),
    )
    return _mean_curve(points, ranking_metrics(hist), size, 0.0, ("fpr", "tpr", "roc_auc"), force_origin)


def mean_pr(evaluated: DataFrame, size: int = 200) -> DataFrame:
    """Mean precision over seeds on an even grid of recalls."""
    hist = score_histogram(evaluated)
    points = hist.where("pos > 0").select(
        *KEYS, F.col("tp").alias("num"), F.col("pos").alias("den"), F.col("above").alias("seq"),
        (F.col("tp") / F.col("above")).alias("y"),
    )
    return _mean_curve(points, ranking_metrics(hist), size, 1.0, ("recall", "precision", "average_precision"))


def threshold_sweep(evaluated: DataFrame, resolution: int = 101, keys: Sequence[str] = KEYS) -> DataFrame:
    """Metrics at even thresholds in [0, 1], a row counting as positive at ``p >= threshold``.

    Scores are binned once and summed from the top; the sweep never multiplies
    the rows by the number of thresholds.
    """
    keys = list(keys)
    top = resolution - 1
    # Rounded so that a score equal to a threshold reaches its bin.
    bin_ = F.least(F.floor(F.round(F.col("p") * F.lit(top), 6)), F.lit(top)).cast("int")
    bins = keep(
        evaluated.groupBy(*keys, bin_.alias("k")).agg(F.count("*").alias("n"), F.sum("is_erupted").alias("n1"))
    )
    every = bins.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(top))))
    filled = join_back(every, bins, [*keys, "k"], "left").fillna(0, ["n", "n1"])
    group = Window.partitionBy(*keys)
    down = group.orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    tp, above = F.sum("n1").over(down), F.sum("n").over(down)
    pos, total = F.sum("n1").over(group), F.sum("n").over(group)
    counts = filled.select(
        *keys, "k", tp.alias("tp"), (above - tp).alias("fp"), (pos - tp).alias("fn"), (total - pos - above + tp).alias("tn")
    )
    rates = _rates()
    names = ["precision", "recall", "f1_score", "balanced_accuracy", "specificity", "mcc", "g_mean"]
    return counts.select(*keys, (F.col("k") / F.lit(float(top))).alias("threshold"), *[rates[n].alias(n) for n in names])


SWEEP_METRICS = ["precision", "recall", "f1_score", "balanced_accuracy", "specificity", "mcc", "g_mean"]


def threshold_aggregate(sweep: DataFrame) -> DataFrame:
    """Over seeds: mean and population deviation of each metric, quartiles of g-mean and MCC."""
    aggs = [f(c).alias(f"{c}_{s}") for c in SWEEP_METRICS for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    for c in ("g_mean", "mcc"):
        aggs += [F.percentile(c, F.lit(q)).alias(f"{c}_q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return sweep.groupBy("series", "classifier", "threshold").agg(*aggs)


def best_threshold(sweep: DataFrame, metric: str = "f1_score", keys: Sequence[str] = KEYS) -> DataFrame:
    """Lowest threshold with the largest value of a metric."""
    value = F.round(metric, 9)
    return sweep.groupBy(*keys).agg(
        F.max_by("threshold", F.struct(value, -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric)
    )


def metrics_long(per_seed: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    cells = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return per_seed.selectExpr("series", "classifier", "seed", f"stack({len(metrics)}, {cells}) as (metric, value)")


def metrics_table(per_seed: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean, population deviation, min and max over seeds, per classifier and metric."""
    return metrics_long(per_seed, metrics).groupBy("series", "classifier", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def rank_classifiers(table: DataFrame, metric: str = "recall", by: str = "mean") -> DataFrame:
    """Classifiers in descending order of one metric; ties by name."""
    if metric not in METRICS + ["roc_auc", "pr_auc", "average_precision"]:
        raise ValueError(f"unknown metric {metric}")
    if by not in ("mean", "std", "min", "max"):
        raise ValueError(f"unknown statistic {by}")
    order = Window.partitionBy("series").orderBy(F.round(by, 9).desc(), F.col("classifier"))
    return table.where(F.col("metric") == metric).select(
        "series", "classifier", F.col(by).alias("value"), F.row_number().over(order).cast("long").alias("rank")
    )


def seed_stability(per_seed: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per-seed values of each metric with the quartiles of their classifier."""
    long = metrics_long(per_seed, metrics)
    group = ["series", "classifier", "metric"]
    box = long.groupBy(*group).agg(
        *[F.percentile("value", F.lit(q)).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
    )
    return join_back(long, box, group)


def evaluate(scores: DataFrame, labels: DataFrame, places: int | None = None) -> DataFrame:
    """All per-model metrics from one joined table of scores and truth."""
    joined = keep(with_truth(scores, labels))
    areas = ranking_metrics(score_histogram(joined))
    if places is not None:
        areas = areas.select(*KEYS, *[F.round(c, places).alias(c) for c in ("roc_auc", "average_precision", "pr_auc")])
    return seed_metrics(joined, places=places).join(areas, KEYS)


def event_picks(scores: DataFrame, labels: DataFrame, dates: DataFrame) -> DataFrame:
    """Highest and lowest probability on each event day: per seed, per event, overall.

    ``level`` is 'seed', 'event' or 'overall'.  Ties go to the smaller id, then
    the smaller seed.  An event without rows has no output.
    """
    timed = scores.join(labels.select("series", "id", "ts"), ["series", "id"]).withColumn("event_date", F.to_date("ts"))
    hit = timed.join(dates.select("series", "event_date").distinct(), ["series", "event_date"])
    pick = F.struct("id", "seed", "ts", "p")
    high = F.max_by(pick, F.struct(F.col("p"), -F.col("id"), -F.col("seed"))).alias("hi")
    low = F.min_by(pick, F.struct(F.col("p"), F.col("id"), F.col("seed"))).alias("lo")
    sets = [["series", "classifier", "event_date", "seed"], ["series", "classifier", "event_date"], ["series", "classifier"]]
    groups = hit.withColumn("g_event", F.col("event_date")).withColumn("g_seed", F.col("seed"))
    sets = [[{"event_date": "g_event", "seed": "g_seed"}.get(c, c) for c in s] for s in sets]
    grouped = groups.groupingSets([[F.col(c) for c in s] for s in sets], "series", "classifier", "g_event", "g_seed").agg(
        high, low
    )
    level = F.when(F.col("g_seed").isNotNull(), "seed").when(F.col("g_event").isNotNull(), "event").otherwise("overall")
    return grouped.select(
        "series", "classifier", level.alias("level"), F.col("g_event").alias("event_date"), F.col("g_seed").alias("seed"),
        *[
            F.col(f"{side}.{c}").alias(f"{name}_{c}")
            for side, name in (("hi", "highest"), ("lo", "lowest"))
            for c in ("id", "seed", "ts", "p")
        ],
    )
