"""Feature ranking, false-discovery control, and comparison of rankings.

Features are ``(series, id, feature, value)`` and labels
``(series, id, is_erupted)``.  Every function accepts extra key columns such as
``seed``, so all seeds are ranked by one plan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.blocked import average_ranks, value_histogram
from foreshock.functions.expr import correlation, erfc, failing_rows, log_erfc
from foreshock.functions.reuse import join_back, keep
from foreshock.operators.features.extract import describe_features

DEFAULT_KEYS = ("series",)


def log_factorial(n: str) -> str:
    """ln n! as an expression; exact to rounding below 21, Stirling's series above."""
    x = f"double(greatest({n}, 21))"
    series = (
        f"{x} * ln({x}) - {x} + 0.5D * ln({2 * math.pi}D * {x}) "
        f"+ 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5))"
    )
    return f"(case when {n} <= 20 then ln(double(factorial(int(least({n}, 20))))) else {series} end)"


def _hypergeometric(k: str) -> Column:
    """ln of the probability of a 2x2 table with ``k`` in its first cell, margins r1, r2, c1."""
    up = ["r1", "r2", "c1", "(r1 + r2 - c1)"]
    down = ["(r1 + r2)", k, f"(r1 - {k})", f"(c1 - {k})", f"(r2 - c1 + {k})"]
    return F.expr(" + ".join(map(log_factorial, up)) + " - " + " - ".join(map(log_factorial, down)))


def rank_test(features: DataFrame, labels: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """``(keys, feature, n_distinct, z, p_value)`` of each feature against the 0/1 label.

    Two-valued features get Fisher's exact test, others the Mann-Whitney test
    with tie and continuity correction; a constant feature gets p = 1.  Ranks
    come from a histogram of values, so equal values and long features are
    spread over tasks.
    """
    keys = list(keys)
    group = [*keys, "feature"]
    on = [k for k in (*keys, "id") if k in features.columns]
    joined = features.join(labels.select(*keys, "id", "is_erupted"), on)
    hist = value_histogram(joined, group, "value", {"n": F.lit(1), "n1": F.col("is_erupted").cast("long")})
    n, n1 = F.col("n"), F.col("n1")
    rank = F.col("n_before") + (n + 1) / F.lit(2.0)
    d = n.cast("double")
    stats = hist.groupBy(*group).agg(
        F.count("*").alias("n_distinct"),
        F.sum(n1 * rank).alias("_r1"),
        F.sum(d * d * d - d).alias("_ties"),
        F.max("n_all").alias("_n"),
        F.max("n1_all").alias("_n1"),
        F.max_by(n1, F.col("value")).alias("a"),
        F.max_by(n, F.col("value")).alias("c1"),
    )
    total, pos = F.col("_n").cast("double"), F.col("_n1").cast("double")
    neg = total - pos
    u = F.col("_r1") - pos * (pos + 1) / 2
    var = pos * neg / 12 * ((total + 1) - F.col("_ties") / F.nullif(total * (total - 1), F.lit(0.0)))
    z = F.greatest(F.abs(u - pos * neg / 2) - F.lit(0.5), F.lit(0.0)) / F.sqrt(F.nullif(var, F.lit(0.0)))
    stats = stats.withColumn("z", F.when((pos > 0) & (neg > 0), z))
    # Fisher's exact test: the possible tables become rows and are summed, so a
    # long support is spread like any other data; other features keep one row.
    two = F.col("n_distinct") == 2
    stats = stats.withColumns({"r1": F.col("_n1"), "r2": F.col("_n") - F.col("_n1")})
    lo = F.greatest(F.col("c1") - F.col("r2"), F.lit(0))
    tables = stats.withColumn(
        "k", F.explode(F.when(two, F.sequence(lo, F.least("r1", "c1"))).otherwise(F.array(F.lit(0).cast("long"))))
    )
    p_k = F.exp(_hypergeometric("k"))
    as_extreme = two & (p_k <= F.exp(_hypergeometric("a")) * F.lit(1 + 1e-7))
    out = tables.groupBy(*group).agg(
        F.first("n_distinct").alias("n_distinct"),
        F.first("z").alias("z"),
        F.least(F.sum(F.when(as_extreme, p_k)), F.lit(1.0)).alias("_fisher"),
    )
    p = F.when(two, F.col("_fisher")).otherwise(erfc(F.col("z") / F.lit(math.sqrt(2))))
    return out.select(*group, "n_distinct", "z", F.coalesce(p, F.lit(1.0)).alias("p_value"))


def fdr_filter(p_values: DataFrame, level: float = 0.05, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Benjamini-Yekutieli: add ``rank``, ``adjusted`` and ``relevant``.

    One window per key over the list of features, whose length is the number of
    calculators and does not grow with the data.  The order is that of ln p,
    taken from the statistic where there is one, so features far beyond the
    smallest p-value are still told apart; equal ones are ordered by name.
    """
    keys = list(keys)
    log_p = F.coalesce(F.log("p_value"), F.lit(-1e300))
    if "z" in p_values.columns:
        tail = (F.col("n_distinct") != 2) & F.col("z").isNotNull()
        log_p = F.when(tail, log_erfc(F.col("z") / F.lit(math.sqrt(2)))).otherwise(log_p)
    # Rounded so that values equal up to summation order count as ties.
    order = Window.partitionBy(*keys).orderBy(F.round(log_p, 9), "feature")
    whole = Window.partitionBy(*keys)
    up = order.rowsBetween(0, Window.unboundedFollowing)
    ranked = p_values.withColumn("rank", F.row_number().over(order).cast("long"))
    harmonic = F.sum(F.lit(1.0) / F.col("rank")).over(whole)
    raw = F.col("p_value") * F.count("*").over(whole) * harmonic / F.col("rank")
    ranked = ranked.withColumn("_raw", raw)
    adjusted = F.least(F.min("_raw").over(up), F.lit(1.0))
    return ranked.withColumn("adjusted", adjusted).withColumn("relevant", F.col("adjusted") <= F.lit(level)).drop("_raw")


def select_significant(
    features: DataFrame,
    labels: DataFrame,
    top_n: int = 20,
    level: float = 0.05,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Ranking of all features with ``selected``.

    Selected are the survivors of the false-discovery filter, or the ``top_n``
    smallest p-values when fewer than ``top_n`` survive.
    """
    ranked = fdr_filter(rank_test(features, labels, keys), level, keys)
    survivors = F.sum(F.col("relevant").cast("int")).over(Window.partitionBy(*keys))
    selected = F.when(survivors >= top_n, F.col("relevant")).otherwise(F.col("rank") <= top_n)
    return ranked.withColumn("selected", selected)


def per_seed_selection(
    features: DataFrame, seed_labels: DataFrame, top_n: int = 20, level: float = 0.05
) -> DataFrame:
    """Ranking cut at ``top_n`` for every seed of ``seed_labels(series, seed, id, is_erupted)``.

    The cut is the first ``top_n`` of the p-value order, never more than the
    number of selected features.
    """
    keys = ["series", "seed"]
    ranked = select_significant(features, seed_labels, top_n, level, keys)
    n_selected = F.sum(F.col("selected").cast("int")).over(Window.partitionBy(*keys))
    kept = ranked.withColumn("_n", F.least(n_selected, F.lit(top_n))).where("rank <= _n")
    return kept.select("series", "seed", "feature", "p_value", "rank")


def transform_selected(features: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of the selected features; a selected feature that is absent is an error."""
    chosen = selected.select("series", "feature").distinct()
    have = features.select("series", "feature").distinct().withColumn("_have", F.lit(True))
    message = F.concat(F.lit("selected feature is missing: "), F.col("feature"))
    # A branch of its own: it has rows, and therefore raises, only for absent features.
    lost = failing_rows(chosen.join(have, ["series", "feature"], "left"), F.col("_have").isNull(), message)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in features.schema.fields]
    return features.join(chosen, ["series", "feature"], "left_semi").select(*features.columns).unionByName(lost.select(*none))


def feature_scores(ranked: DataFrame) -> DataFrame:
    """Score table of a ranking: p-value, rank and whether selected."""
    return ranked.select("series", "feature", F.col("p_value").alias("score"), "rank", "selected")


def _order(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col("frequency").desc(), F.col("score_mean"), F.col("feature"))
    )


def top_features(rankings: DataFrame, top_n: int | None = None, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Over seeds: how often a feature is chosen, its mean and sample deviation of score."""
    keys = list(keys)
    agg = rankings.groupBy(*keys, "feature").agg(
        F.count("p_value").alias("frequency"),
        F.avg("p_value").alias("score_mean"),
        F.stddev_samp("p_value").alias("score_std"),
    )
    ranked = agg.withColumn("position", _order(agg, keys).cast("long"))
    ranked = ranked.withColumn("alias", F.concat(F.lit("ft_"), F.col("position")))
    if top_n:
        ranked = ranked.where(F.col("position") <= top_n)
    return describe_features(ranked).drop("short_name")


def common_features(tables: Mapping[str, DataFrame], mean: bool = False) -> DataFrame:
    """Features present in every table; frequency, mean and deviation are summed and re-ranked.

    ``mean`` averages the scores instead.
    """
    if not tables:
        raise ValueError("no tables given")
    cols = ["feature", "frequency", "score_mean", "score_std"]
    union = reduce(
        DataFrame.unionByName, [t.select(*cols, F.lit(name).alias("source")) for name, t in tables.items()]
    )
    fn = F.avg if mean else F.sum
    agg = union.groupBy("feature").agg(
        F.count_distinct("source").alias("_k"),
        F.sum("frequency").alias("frequency"),
        fn("score_mean").alias("score_mean"),
        F.coalesce(fn("score_std"), F.lit(0.0)).alias("score_std"),
    )
    common = agg.where(F.col("_k") == len(tables)).drop("_k").withColumn("_all", F.lit(1))
    # One row for each name of the calculators: none in common is an error at once.
    if common.isEmpty():
        raise ValueError("no feature is common to all tables")
    ranked = common.withColumn("position", _order(common, ["_all"]).cast("long")).drop("_all")
    return describe_features(ranked.withColumn("alias", F.concat(F.lit("ft_"), F.col("position")))).drop("short_name")


def band_contribution(rankings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Features counted by metric prefix, with percent of the group."""
    prefix = F.regexp_extract("feature", r"^(rsam_f\d+|dsar_f\d+-f\d+|entropy)(?=_|$)", 1)
    band = F.when(prefix == "", F.col("feature")).otherwise(prefix)
    counts = rankings.groupBy(*keys, band.alias("band")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*(list(keys) or [F.lit(0)]))
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(whole) * 100)


def feature_correlation(features: DataFrame, names: Sequence[str], method: str = "spearman") -> DataFrame:
    """Correlation of every pair of the listed top features.

    The names are a short list, so the matrix is one aggregation over a row per
    id with one correlation per pair; no pair of rows is formed.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError("method must be 'spearman' or 'pearson'")
    picked = features.where(F.col("feature").isin(list(names)))
    if method == "spearman":
        picked = keep(picked)
        ranks = average_ranks(picked, ["series", "feature"], "value")
        picked = join_back(picked, ranks, ["series", "feature", "value"]).withColumn("value", F.col("avg_rank"))
    wide = picked.groupBy("series", "id").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"_c{i}") for i, f in enumerate(names)]
    )
    cells = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            r = correlation(f"_c{min(i, j)}", f"_c{max(i, j)}")
            cells.append(
                F.struct(
                    F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), r.alias("r")
                )
            )
    return wide.groupBy("series").agg(F.array(*cells).alias("_m")).select("series", F.inline("_m"))


def common_heatmap(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Feature by scenario: frequency, 0 where a scenario lacks the feature."""
    union = reduce(
        DataFrame.unionByName,
        [t.select("feature", "frequency", F.lit(name).alias("scenario")) for name, t in tables.items()],
    )
    return union.groupBy("feature").agg(
        *[F.coalesce(F.max(F.when(F.col("scenario") == s, F.col("frequency"))), F.lit(0)).alias(s) for s in tables]
    )


def common_correlation(matrices: Mapping[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """Pearson correlation over the stacked rows of several scenarios."""
    stacked = reduce(
        DataFrame.unionByName,
        [
            m.select("series", F.concat(F.lit(f"{s}/"), F.col("id")).alias("id"), "feature", "value")
            for s, m in matrices.items()
        ],
    )
    return feature_correlation(stacked, names, "pearson")


def selection_frequency(chosen: DataFrame) -> DataFrame:
    """How many seeds of a method chose each feature."""
    return chosen.groupBy("method", "feature").agg(F.count("*").alias("count"))


def selector_jaccard(chosen: DataFrame, runs: DataFrame) -> DataFrame:
    """Jaccard overlap of two methods' choices for each seed they share.

    ``runs(method, seed)`` lists every run, so a run that chose nothing counts;
    two empty choices overlap fully.  A choice holds at most top-n names.
    """
    picked = chosen.groupBy("method", "seed").agg(F.collect_set("feature").alias("s"))
    sets = join_back(runs, picked, ["method", "seed"], "left").select("method", "seed", F.coalesce("s", F.array().cast("array<string>")).alias("s"))
    left = sets.select(F.col("method").alias("method_a"), "seed", F.col("s").alias("_a"))
    right = sets.select(F.col("method").alias("method_b"), "seed", F.col("s").alias("_b"))
    both = join_back(left, right, ["seed"]).where("method_a < method_b")
    union = F.size(F.array_union("_a", "_b"))
    overlap = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("_a", "_b")) / F.nullif(union, F.lit(0)))
    return both.select("method_a", "method_b", "seed", overlap.alias("jaccard"))


def compare_selectors(chosen: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per method: mean and sample deviation of its metrics, and the mean overlap with others.

    ``metrics(method, seed, balanced_accuracy, roc_auc)`` has one row per run.
    """
    overlap = selector_jaccard(chosen, runs).agg(F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("mean_jaccard"))
    sizes = chosen.groupBy("method", "seed").agg(F.count("*").alias("n_selected"))
    per_run = join_back(join_back(runs, sizes, ["method", "seed"], "left"), metrics, ["method", "seed"])
    summary = per_run.groupBy("method").agg(
        F.avg(F.coalesce("n_selected", F.lit(0))).alias("n_selected_mean"),
        F.avg("balanced_accuracy").alias("balanced_accuracy_mean"),
        F.stddev_samp("balanced_accuracy").alias("balanced_accuracy_std"),
        F.avg("roc_auc").alias("roc_auc_mean"),
        F.stddev_samp("roc_auc").alias("roc_auc_std"),
    )
    # One row beside a handful of methods.
    return summary.crossJoin(F.broadcast(overlap))
