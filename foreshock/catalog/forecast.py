"""Queries for scoring, evaluation and attribution on a fixed linear scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.catalog.base import cte, oracle, query
from foreshock.catalog.label_matrix import labels
from foreshock.catalog.ranking import features
from foreshock.functions.expr import rounded
from foreshock.functions.reuse import join_back, keep
from foreshock.operators import attribution, evaluation, scoring

USED = ["rsam_f0__mean", "rsam_f1__maximum", "rsam_f2__standard_deviation"]


def coefficient_rows() -> list[tuple[str, int, str, float]]:
    """Coefficients as a fixed function of classifier and seed."""
    rows = []
    for c, name in enumerate(B.CLASSIFIERS):
        for s in B.SEEDS:
            rows.append((name, s, "intercept", round(-0.8 + 0.1 * s + 0.2 * c, 6)))
            rows.append((name, s, USED[0], round(0.6 + 0.15 * s - 0.3 * c, 6)))
            rows.append((name, s, USED[1], round(-0.5 + 0.2 * ((s + c) % 3), 6)))
            if s % 2 == 0:
                rows.append((name, s, USED[2], round(0.25 - 0.1 * c, 6)))
    return rows


COEF_SQL = ", ".join(f"('{c}', {s}, '{f}', {v}::DOUBLE)" for c, s, f, v in coefficient_rows())
cte("coef", f"SELECT classifier, CAST(seed AS INTEGER) AS seed, feature, coef FROM (VALUES {COEF_SQL}) t(classifier, seed, feature, coef)")
cte(
    "zfeat",
    """SELECT series, id, feature, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) + 1e-9, 6) AS value
FROM feat WHERE feature IN ({}) WINDOW w AS (PARTITION BY series, feature)""".format(", ".join(repr(u) for u in USED)),
    "feat",
)
cte(
    "scores",
    """SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM (
  SELECT f.series, c.classifier, c.seed, f.id, round(1 / (1 + exp(-1 * (sum(c.coef * f.value) + max(b.coef)))) + 1e-9, 6) AS p
  FROM zfeat f JOIN coef c ON f.feature = c.feature JOIN coef b ON b.classifier = c.classifier AND b.seed = c.seed AND b.feature = 'intercept'
  GROUP BY f.series, c.classifier, c.seed, f.id)""",
    "zfeat",
    "coef",
)
cte("ev", "SELECT s.*, y.ts, y.is_erupted FROM scores s JOIN y ON s.series = y.series AND s.id = y.id", "scores", "y")


def coefficients(spark):
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("classifier"), F.lit(s).alias("seed"), F.lit(f).alias("feature"), F.lit(v).alias("coef"))
            for c, s, f, v in coefficient_rows()
        ]
    )
    return spark.range(1).select(F.inline(cells))


def standardised(spark, sf):
    f = keep(features(spark, sf, USED))
    stats = f.groupBy("series", "feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd"))
    z = (F.col("value") - F.col("_m")) / F.nullif("_sd", F.lit(0.0))
    return join_back(f, stats, ["series", "feature"]).select("series", "id", "feature", rounded(z).alias("value"))


def scores(spark, sf):
    raw = scoring.score_linear(standardised(spark, sf), coefficients(spark))
    p = rounded("p")
    return keep(raw.select("series", "classifier", "seed", "id", p.alias("p"), (p >= 0.5).cast("int").alias("pred")))


def timed_scores(spark, sf):
    return scores(spark, sf).join(labels(spark).select("series", "id", "ts"), ["series", "id"])


def evaluated(spark, sf):
    return evaluation.with_truth(scores(spark, sf), labels(spark))


# ---------------------------------------------------------------- scoring


@query("score_seeds", oracle("SELECT series, classifier, seed, id, p, pred FROM scores", "scores", dbl=["p"]))
def score_seeds(spark, sf):
    return scores(spark, sf)


@query(
    "seed_matrix",
    oracle(
        "SELECT series, classifier, id, "
        + ", ".join(f"max(p) FILTER (seed = {s}) AS seed_{s:05d}" for s in B.SEEDS)
        + " FROM scores GROUP BY series, classifier, id",
        "scores",
        dbl=[f"seed_{s:05d}" for s in B.SEEDS],
    ),
)
def seed_matrix(spark, sf):
    return scoring.seed_matrix(scores(spark, sf), B.SEEDS)


@query(
    "seed_table",
    oracle("SELECT series, classifier, seed, id, 1 - p AS p_no, p AS p_yes, pred AS prediction FROM scores", "scores", dbl=["p_no", "p_yes"]),
)
def seed_table(spark, sf):
    return scoring.seed_table(scores(spark, sf))


cte(
    "per_classifier",
    """SELECT series, id, classifier, avg(p) AS probability, stddev_pop(p) AS uncertainty, avg(pred) AS prediction,
  1.96e0 * sqrt(avg(pred) * (1 - avg(pred)) / count(*)) AS confidence FROM scores GROUP BY series, id, classifier""",
    "scores",
)
cte(
    "consensus",
    """SELECT series, id, avg(probability) AS probability, stddev_pop(probability) AS uncertainty, avg(prediction) AS prediction,
  1.96e0 * sqrt(avg(prediction) * (1 - avg(prediction)) / count(*)) AS confidence FROM per_classifier GROUP BY series, id""",
    "per_classifier",
)
FOUR = scoring.FORECAST


@query("seed_consensus", oracle("SELECT * FROM per_classifier", "per_classifier", dbl=FOUR))
def seed_consensus(spark, sf):
    return scoring.seed_consensus(scores(spark, sf))


@query("classifier_consensus", oracle("SELECT * FROM consensus", "consensus", dbl=FOUR))
def classifier_consensus(spark, sf):
    return scoring.classifier_consensus(scoring.seed_consensus(scores(spark, sf)))


FORECAST_COLS = [f"{c}_{m}" for c in ["consensus", *B.CLASSIFIERS] for m in FOUR]


@query(
    "forecast_table",
    oracle(
        "SELECT c.series, c.id, "
        + ", ".join(f"max(c.{m}) AS consensus_{m}" for m in FOUR)
        + ", "
        + ", ".join(f"max(p.{m}) FILTER (classifier = '{c}') AS {c}_{m}" for c in B.CLASSIFIERS for m in FOUR)
        + " FROM consensus c JOIN per_classifier p ON c.series = p.series AND c.id = p.id GROUP BY c.series, c.id",
        "consensus",
        "per_classifier",
        dbl=FORECAST_COLS,
    ),
)
def forecast_table(spark, sf):
    return scoring.forecast_table(scoring.seed_consensus(scores(spark, sf)), B.CLASSIFIERS)


@query(
    "predict",
    oracle("SELECT *, CAST(probability >= 0.5 AS INTEGER) AS label FROM consensus", "consensus", dbl=FOUR),
)
def predict(spark, sf):
    return scoring.predict(scoring.classifier_consensus(scoring.seed_consensus(scores(spark, sf))))


@query(
    "features_union",
    oracle(
        "SELECT DISTINCT c.feature FROM coef c JOIN feat f ON f.feature = c.feature WHERE c.feature <> 'intercept'", "coef", "feat"
    ),
)
def features_union(spark, sf):
    present = features(spark, sf, USED).select("feature").distinct()
    registry = coefficients(spark).join(present, "feature").groupBy("classifier", "seed").agg(
        F.collect_set("feature").alias("features")
    )
    return scoring.features_union(registry)


cte("per_ts", "SELECT p.*, y.ts FROM per_classifier p JOIN y ON p.series = y.series AND p.id = y.id", "per_classifier", "y")


def timed_consensus(spark, sf):
    per = scoring.seed_consensus(scores(spark, sf))
    return per.join(labels(spark).select("series", "id", "ts"), ["series", "id"])


@query(
    "envelope",
    oracle(
        """SELECT *, min(lowest) OVER w AS min_envelope, max(highest) OVER w AS max_envelope FROM (
  SELECT series, ts, max(probability) AS highest, min(probability) AS lowest FROM per_ts GROUP BY series, ts)
WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""",
        "per_ts",
        dbl=["highest", "lowest", "min_envelope", "max_envelope"],
    ),
)
def envelope(spark, sf):
    return scoring.envelope(timed_consensus(spark, sf))


@query(
    "smooth_forecast",
    oracle(
        """SELECT series, id, classifier, ts, probability, avg(probability) OVER (PARTITION BY series, classifier ORDER BY ts
  RANGE BETWEEN INTERVAL 43199999999 MICROSECOND PRECEDING AND CURRENT ROW) AS smoothed FROM per_ts""",
        "per_ts",
        dbl=["probability", "smoothed"],
    ),
)
def smooth_forecast(spark, sf):
    return scoring.smooth_forecast(timed_consensus(spark, sf), 12).select(
        "series", "id", "classifier", "ts", "probability", "smoothed"
    )


cte(
    "banded",
    """SELECT c.*, y.ts, CASE WHEN probability >= 0.5 THEN 'alert' WHEN round(probability, 9) >= 0.4 THEN 'watch' ELSE 'quiet' END AS state
FROM consensus c JOIN y ON c.series = y.series AND c.id = y.id""",
    "consensus",
    "y",
)


def banded(spark, sf):
    con = scoring.classifier_consensus(scoring.seed_consensus(scores(spark, sf)))
    timed = con.join(labels(spark).select("series", "id", "ts"), ["series", "id"])
    return keep(scoring.alert_bands(timed, 0.5, 0.1))


@query("alert_bands", oracle("SELECT * FROM banded", "banded", dbl=FOUR))
def alert_bands(spark, sf):
    return banded(spark, sf)


@query(
    "alert_episodes",
    oracle(
        """SELECT series, episode, state, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows, max(probability) AS peak FROM (
  SELECT *, CAST(sum(c) OVER (PARTITION BY series ORDER BY ts) AS BIGINT) AS episode FROM (
    SELECT *, CASE WHEN lag(state) OVER (PARTITION BY series ORDER BY ts) = state THEN 0 ELSE 1 END AS c FROM banded))
GROUP BY series, episode, state""",
        "banded",
        dbl=["peak"],
    ),
)
def alert_episodes(spark, sf):
    return scoring.alert_episodes(banded(spark, sf))


@query("align_labels", oracle("SELECT y.series, y.id, y.ts, y.is_erupted FROM y WHERE id IN (SELECT id FROM feat)", "y", "feat"))
def align_labels(spark, sf):
    return scoring.align_labels(labels(spark), features(spark, sf, USED))


# ---------------------------------------------------------------- evaluation

K = "series, classifier, seed"
cte(
    "conf",
    f"""SELECT {K}, count(*) FILTER (is_erupted = 0 AND pred = 0) AS tn, count(*) FILTER (is_erupted = 0 AND pred = 1) AS fp,
  count(*) FILTER (is_erupted = 1 AND pred = 0) AS fn, count(*) FILTER (is_erupted = 1 AND pred = 1) AS tp FROM ev GROUP BY {K}""",
    "ev",
)


def rate_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, tn, fp, fn, tp, (tp + tn) / (tn + fp + fn + tp)::DOUBLE AS accuracy, (recall + specificity) / 2 AS balanced_accuracy,
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, recall, specificity, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1_score,
  coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
  sqrt(recall * specificity) AS g_mean FROM (
  SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity FROM {source})"""


cte("seed_rates", rate_sql("conf", K), "conf")
M = evaluation.METRICS


@query("confusion", oracle("SELECT * FROM conf", "conf"))
def confusion(spark, sf):
    return evaluation.confusion(evaluated(spark, sf))


@query("seed_metrics", oracle("SELECT * FROM seed_rates", "seed_rates", dbl=M))
def seed_metrics(spark, sf):
    return evaluation.seed_metrics(evaluated(spark, sf))


cte(
    "auc",
    f"""SELECT {K}, (sum(rk) FILTER (is_erupted = 1) - sum(is_erupted) * (sum(is_erupted) + 1) / 2e0) / (sum(is_erupted) * sum(1 - is_erupted))::DOUBLE AS roc_auc
FROM (SELECT *, rank() OVER (PARTITION BY {K} ORDER BY p) + (count(*) OVER (PARTITION BY {K}, p) - 1) / 2e0 AS rk FROM ev) GROUP BY {K}""",
    "ev",
)
cte(
    "steps",
    f"""SELECT {K}, p, n, n1, sum(n) OVER d AS above, sum(n1) OVER d AS tp, sum(n1) OVER (PARTITION BY {K}) AS pos, sum(n) OVER (PARTITION BY {K}) AS total
FROM (SELECT {K}, p, count(*) AS n, sum(is_erupted) AS n1 FROM ev GROUP BY {K}, p) WINDOW d AS (PARTITION BY {K} ORDER BY p DESC)""",
    "ev",
)
cte(
    "pr",
    f"""SELECT {K}, p AS threshold, tp / above::DOUBLE AS precision, tp / pos::DOUBLE AS recall, CAST(above AS BIGINT) AS seq FROM steps
UNION ALL SELECT DISTINCT {K}, CAST(NULL AS DOUBLE), 1e0, 0e0, 0 FROM steps""",
    "steps",
)
cte(
    "areas",
    f"""SELECT {K}, sum((recall - r0) * precision) AS average_precision, sum((recall - r0) * (precision + p0) / 2) AS pr_auc FROM (
  SELECT *, lag(recall) OVER (PARTITION BY {K} ORDER BY seq) AS r0, lag(precision) OVER (PARTITION BY {K} ORDER BY seq) AS p0 FROM pr)
GROUP BY {K}""",
    "pr",
)


@query("roc_auc", oracle("SELECT * FROM auc", "auc", dbl=["roc_auc"]))
def roc_auc(spark, sf):
    return evaluation.roc_auc(evaluated(spark, sf))


@query("average_precision", oracle("SELECT * FROM areas", "areas", dbl=["average_precision", "pr_auc"]))
def average_precision(spark, sf):
    return evaluation.average_precision(evaluated(spark, sf))


cte(
    "roc",
    f"""SELECT {K}, p AS threshold, (above - tp) / (total - pos)::DOUBLE AS fpr, tp / pos::DOUBLE AS tpr FROM steps
UNION ALL SELECT DISTINCT {K}, CAST(NULL AS DOUBLE), 0e0, 0e0 FROM steps""",
    "steps",
)


@query("roc_curve", oracle("SELECT * FROM roc", "roc", dbl=["threshold", "fpr", "tpr"]))
def roc_curve(spark, sf):
    return evaluation.roc_curve(keep(evaluation.score_histogram(evaluated(spark, sf))))


@query("pr_curve", oracle("SELECT * EXCLUDE (seq) FROM pr", "pr", dbl=["threshold", "precision", "recall"]))
def pr_curve(spark, sf):
    return evaluation.pr_curve(keep(evaluation.score_histogram(evaluated(spark, sf))))


def curve_sql(points: str, size: int, x: str, y: str, area: str, score: str, origin: bool) -> str:
    """``points`` has keys, x, o (order among equal x), y."""
    first = "CASE WHEN g = 0 THEN 0e0 ELSE v END" if origin else "v"
    return f"""SELECT c.series, c.classifier, c.{x}, c.mean_{y}, c.std_{y}, a.mean_{score}, a.std_{score} FROM (
  SELECT series, classifier, g / {size - 1}e0 AS {x}, avg({first}) AS mean_{y}, stddev_pop({first}) AS std_{y} FROM (
    SELECT {K}, g, CASE WHEN b IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (g / {size - 1}e0 - a.x) / (b.x - a.x) END AS v FROM (
      SELECT {K}, g, max({{'x': x, 'o': o, 'y': y}}) FILTER (x <= g / {size - 1}e0 + 1e-12) AS a, min({{'x': x, 'o': o, 'y': y}}) FILTER (x > g / {size - 1}e0 + 1e-12) AS b
      FROM ({points}) CROSS JOIN (SELECT unnest(generate_series(0, {size - 1})) AS g) GROUP BY {K}, g))
  GROUP BY series, classifier, g) c
JOIN (SELECT series, classifier, avg({score}) AS mean_{score}, stddev_pop({score}) AS std_{score} FROM {area} GROUP BY series, classifier) a
ON c.series = a.series AND c.classifier = a.classifier"""


@query(
    "mean_roc",
    oracle(
        curve_sql(f"SELECT {K}, fpr AS x, tpr AS o, tpr AS y FROM roc", 100, "fpr", "tpr", "auc", "roc_auc", True),
        "roc",
        "auc",
        dbl=["fpr", "mean_tpr", "std_tpr", "mean_roc_auc", "std_roc_auc"],
    ),
)
def mean_roc(spark, sf):
    return evaluation.mean_roc(evaluated(spark, sf))


@query(
    "mean_pr",
    oracle(
        curve_sql(f"SELECT {K}, recall AS x, seq AS o, precision AS y FROM pr", 200, "recall", "precision", "areas", "average_precision", False),
        "pr",
        "areas",
        dbl=["recall", "mean_precision", "std_precision", "mean_average_precision", "std_average_precision"],
    ),
)
def mean_pr(spark, sf):
    return evaluation.mean_pr(evaluated(spark, sf))


SWEEP_KEYS = K + ", threshold"
cte(
    "sweep_counts",
    f"""SELECT {K}, k / 100e0 AS threshold, count(*) FILTER (is_erupted = 0 AND p < k / 100e0) AS tn, count(*) FILTER (is_erupted = 0 AND p >= k / 100e0) AS fp,
  count(*) FILTER (is_erupted = 1 AND p < k / 100e0) AS fn, count(*) FILTER (is_erupted = 1 AND p >= k / 100e0) AS tp
FROM ev CROSS JOIN (SELECT unnest(generate_series(0, 100)) AS k) GROUP BY {K}, k""",
    "ev",
)
SW = evaluation.SWEEP_METRICS
cte("thresholds", f"SELECT {SWEEP_KEYS}, {', '.join(SW)} FROM ({rate_sql('sweep_counts', SWEEP_KEYS)})", "sweep_counts")


@query("threshold_sweep", oracle("SELECT * FROM thresholds", "thresholds", dbl=["threshold", *SW]))
def threshold_sweep(spark, sf):
    return evaluation.threshold_sweep(evaluated(spark, sf))


AGG_COLS = [f"{c}_{s}" for c in SW for s in ("mean", "std")] + [f"{c}_q{q}" for c in ("g_mean", "mcc") for q in (25, 50, 75)]


@query(
    "threshold_aggregate",
    oracle(
        "SELECT series, classifier, threshold, "
        + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in SW)
        + ", "
        + ", ".join(f"quantile_cont({c}, {q / 100}) AS {c}_q{q}" for c in ("g_mean", "mcc") for q in (25, 50, 75))
        + " FROM thresholds GROUP BY series, classifier, threshold",
        "thresholds",
        dbl=["threshold", *AGG_COLS],
    ),
)
def threshold_aggregate(spark, sf):
    return evaluation.threshold_aggregate(evaluation.threshold_sweep(evaluated(spark, sf)))


@query(
    "best_threshold",
    oracle(
        f"SELECT {K}, threshold, f1_score FROM thresholds QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY round(f1_score, 9) DESC, threshold) = 1",
        "thresholds",
        dbl=["threshold", "f1_score"],
    ),
)
def best_threshold(spark, sf):
    return evaluation.best_threshold(evaluation.threshold_sweep(evaluated(spark, sf)), "f1_score")


cte(
    "rates_long",
    "\nUNION ALL ".join(f"SELECT {K}, '{m}' AS metric, {m} AS value FROM seed_rates" for m in M),
    "seed_rates",
)
cte(
    "rates_table",
    "SELECT series, classifier, metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM rates_long GROUP BY series, classifier, metric",
    "rates_long",
)


@query("metrics_table", oracle("SELECT * FROM rates_table", "rates_table", dbl=["mean", "std", "min", "max"]))
def metrics_table(spark, sf):
    return evaluation.metrics_table(evaluation.seed_metrics(evaluated(spark, sf)))


@query(
    "rank_classifiers",
    oracle(
        "SELECT series, classifier, mean AS value, row_number() OVER (PARTITION BY series ORDER BY round(mean, 9) DESC, classifier) AS rank FROM rates_table WHERE metric = 'recall'",
        "rates_table",
        dbl=["value"],
    ),
)
def rank_classifiers(spark, sf):
    return evaluation.rank_classifiers(evaluation.metrics_table(evaluation.seed_metrics(evaluated(spark, sf))))


@query(
    "seed_stability",
    oracle(
        """SELECT l.*, q25, median, q75 FROM rates_long l JOIN (SELECT series, classifier, metric, quantile_cont(value, 0.25) AS q25,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM rates_long GROUP BY series, classifier, metric) b
ON l.series = b.series AND l.classifier = b.classifier AND l.metric = b.metric""",
        "rates_long",
        dbl=["value", "q25", "median", "q75"],
    ),
)
def seed_stability(spark, sf):
    return evaluation.seed_stability(keep(evaluation.seed_metrics(evaluated(spark, sf))))


@query(
    "evaluate",
    oracle(
        f"SELECT r.*, roc_auc, average_precision, pr_auc FROM seed_rates r JOIN auc USING ({K}) JOIN areas USING ({K})",
        "seed_rates",
        "auc",
        "areas",
        dbl=[*M, "roc_auc", "average_precision", "pr_auc"],
    ),
)
def evaluate(spark, sf):
    return evaluation.evaluate(scores(spark, sf), labels(spark))


PICK_COLS = ", ".join(
    f"max({c}) FILTER (r{side} = 1) AS {name}_{c}" for side, name in (("h", "highest"), ("l", "lowest")) for c in ("id", "seed", "ts", "p")
)


def pick_sql(level: str, part: str, event: str, seed: str) -> str:
    return f"""SELECT series, classifier, '{level}' AS level, {event} AS event_date, {seed} AS seed, {PICK_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY p DESC, id, seed) AS rh, row_number() OVER (PARTITION BY {part} ORDER BY p, id, seed) AS rl
  FROM ev JOIN dates ON CAST(ev.ts AS DATE) = event_date) GROUP BY {part}"""


cte(
    "picks",
    "\nUNION ALL ".join(
        [
            pick_sql("seed", "series, classifier, event_date, seed", "event_date", "seed"),
            pick_sql("event", "series, classifier, event_date", "event_date", "CAST(NULL AS INTEGER)"),
            pick_sql("overall", "series, classifier", "CAST(NULL AS DATE)", "CAST(NULL AS INTEGER)"),
        ]
    ),
    "ev",
    "dates",
)


def picks(spark, sf):
    return evaluation.event_picks(scores(spark, sf), labels(spark), B.event_dates(spark))


@query("event_picks", oracle("SELECT * FROM picks", "picks", dbl=["highest_p", "lowest_p"]))
def event_picks(spark, sf):
    return picks(spark, sf)


# ---------------------------------------------------------------- attribution

cte(
    "attr",
    """SELECT c.classifier, c.seed, f.series, f.id, f.feature, c.coef * (f.value - avg(f.value) OVER (PARTITION BY f.series, f.feature, c.classifier, c.seed)) AS contribution, f.value
FROM zfeat f JOIN coef c ON f.feature = c.feature""",
    "zfeat",
    "coef",
)


def attributions(spark, sf):
    weights = coefficients(spark).where("feature <> 'intercept'")
    return attribution.attribute_linear(standardised(spark, sf), weights)


@query("attribute_linear", oracle("SELECT * FROM attr", "attr", dbl=["contribution", "value"]))
def attribute_linear(spark, sf):
    return attributions(spark, sf)


@query(
    "mean_abs_attribution",
    oracle(
        """SELECT classifier, feature, avg(m) AS mean_abs, count(*) / 5e0 AS selection_frequency, count(*) AS n_seeds_selected FROM (
  SELECT classifier, seed, feature, avg(abs(contribution)) AS m FROM attr GROUP BY classifier, seed, feature) GROUP BY classifier, feature""",
        "attr",
        dbl=["mean_abs", "selection_frequency"],
    ),
)
def mean_abs_attribution(spark, sf):
    return attribution.mean_abs_attribution(attributions(spark, sf))


@query(
    "stack_attributions",
    oracle("SELECT series, feature, seed, id AS obs, contribution, value FROM attr WHERE classifier = 'rf'", "attr", dbl=["contribution", "value"]),
)
def stack_attributions(spark, sf):
    return attribution.stack_attributions(attributions(spark, sf), "rf")


@query(
    "explain_events",
    oracle(
        """SELECT p.series, p.classifier, p.highest_seed AS seed, p.highest_id AS id, p.event_date, p.highest_p AS p, a.feature, a.contribution, a.value
FROM picks p JOIN attr a ON p.classifier = a.classifier AND p.highest_seed = a.seed AND p.highest_id = a.id AND p.series = a.series WHERE level = 'event'""",
        "picks",
        "attr",
        dbl=["p", "contribution", "value"],
    ),
)
def explain_events(spark, sf):
    return attribution.explain_events(attributions(spark, sf), picks(spark, sf))
