"""Queries for feature tables, selection, sampling and the count sweep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.catalog.base import cte, oracle, query
from foreshock.catalog.label_matrix import labels, labels_seen, matrix
from foreshock.catalog.window_features import changes_sql, moments_sql, trends_sql, unpivot
from foreshock.functions.expr import literal_table, rounded
from foreshock.functions.reuse import keep
from foreshock.operators import sampling, selection
from foreshock.operators.features import extract
from foreshock.plans.ranking import COMPACT, compact_names, features_from_samples, ranked_features

STEP_S = B.STEP_HOURS * 3600
NAMES = compact_names(B.RSAM_METRICS)
ALL_SQL = moments_sql() | changes_sql() | trends_sql()

cte(
    "feat",
    "SELECT series, id, feature, round(value + 1e-9, 6) AS value FROM ("
    + unpivot("fx", {c: ALL_SQL[c] for c in COMPACT}).replace("SELECT series, metric ||", "SELECT series, id, metric ||")
    + ")",
    "fx",
)


def features(spark, sf, names=NAMES):
    return features_from_samples(
        B.samples(spark, sf), labels(spark), B.BANDS, B.WINDOW_S, B.LOOKBACK_DAYS, STEP_S, names
    )


# ---------------------------------------------------------------- feature tables


@query("only_features", oracle("SELECT * FROM feat WHERE feature IN ('rsam_f1__mean', 'rsam_f3__linear_trend__attr_\"slope\"', 'rsam_f4__maximum')", "feat", dbl=["value"]))
def only_features(spark, sf):
    return features(spark, sf, ["rsam_f1__mean", 'rsam_f3__linear_trend__attr_"slope"', "rsam_f4__maximum"])


TRENDS_ONLY = unpivot("fx", trends_sql())


@query(
    "exclude_features",
    oracle(
        f"SELECT * FROM ({TRENDS_ONLY}) WHERE feature NOT LIKE '%timewise%' AND feature <> 'rsam_f0__linear_trend__attr_\"stderr\"'",
        "fx",
        dbl=["value"],
    ),
)
def exclude_features(spark, sf):
    return extract.exclude_features(matrix(spark, sf), ['rsam_f0__linear_trend__attr_"stderr"'], families=["trends"])


@query(
    "extract_features",
    oracle(
        "SELECT series, id, count(*) AS n_features, round(sum(value), 2) AS total FROM ("
        + "\nUNION ALL\n".join([TRENDS_ONLY, unpivot("fx", changes_sql()), unpivot("fx", moments_sql())])
        + """) WHERE NOT regexp_matches(feature, '__(linear_trend_timewise|length|median|minimum|quantile)(__|$)') GROUP BY series, id""",
        "fx",
        dbl=["total"],
    ),
)
def extract_features(spark, sf):
    """Default set of three families in one aggregation, summed per label."""
    long = extract.extract_features(matrix(spark, sf), families=["trends", "changes", "moments"])
    return long.groupBy("series", "id").agg(F.count("*").alias("n_features"), F.round(F.sum("value"), 2).alias("total"))


HOLED = "SELECT series, id, feature, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN 'Infinity'::DOUBLE WHEN id % 13 = 0 THEN '-Infinity'::DOUBLE ELSE value END AS value FROM feat"


@query(
    "impute",
    oracle(
        f"""SELECT h.series, h.id, h.feature, CASE WHEN value IS NULL THEN med WHEN value = 'Infinity'::DOUBLE THEN hi
  WHEN value = '-Infinity'::DOUBLE THEN lo ELSE value END AS value
FROM ({HOLED}) h JOIN (SELECT series, feature, max(value) AS hi, min(value) AS lo, quantile_cont(value, 0.5) AS med
  FROM ({HOLED}) WHERE isfinite(value) GROUP BY ALL) s ON h.series = s.series AND h.feature = s.feature""",
        "feat",
        dbl=["value"],
    ),
)
def impute(spark, sf):
    holed = features(spark, sf).withColumn(
        "value",
        F.when(F.col("id") % 7 == 0, None)
        .when(F.col("id") % 11 == 0, F.lit(float("inf")))
        .when(F.col("id") % 13 == 0, F.lit(float("-inf")))
        .otherwise(F.col("value")),
    )
    return extract.impute(holed)


@query("concat_features", oracle("SELECT * FROM feat WHERE feature LIKE 'rsam_f0%' OR feature LIKE 'rsam_f2%'", "feat", dbl=["value"]))
def concat_features(spark, sf):
    both = features(spark, sf, compact_names(["rsam_f0", "rsam_f2"]))
    return extract.concat_features([both.where(F.col("feature").startswith(m)) for m in ("rsam_f0", "rsam_f2")])


@query(
    "merge_matrices",
    oracle(
        """SELECT f.series, y.ts, f.feature, CASE WHEN y.ts < TIMESTAMP '2024-01-19' THEN value ELSE value * 2 END AS value
FROM feat f JOIN y ON f.series = y.series AND f.id = y.id WHERE feature IN ('rsam_f0__mean', 'rsam_f1__mean')""",
        "feat",
        "y",
        dbl=["value"],
    ),
)
def merge_matrices(spark, sf):
    names = ["rsam_f0__mean", "rsam_f1__mean", "rsam_f2__mean"]
    dated = features(spark, sf, names).join(labels(spark).select("series", "id", "ts"), ["series", "id"]).drop("id")
    cut = F.lit("2024-01-19").cast("timestamp")
    train = dated.where(F.col("ts") < cut)
    later = dated.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).withColumn("value", F.col("value") * 2)
    return extract.merge_matrices(train, later, names[:2])


@query(
    "missing_names",
    oracle("SELECT 'rsam_f9__mean' AS feature WHERE NOT EXISTS (SELECT 1 FROM feat WHERE feature = 'rsam_f9__mean')", "feat"),
)
def missing_names(spark, sf):
    wanted = literal_table(spark, "feature", ["rsam_f0__mean", "rsam_f9__mean"])
    return extract.missing_names(features(spark, sf, ["rsam_f0__mean", "rsam_f1__mean"]), wanted)


@query("features_to_series", oracle("SELECT id, value FROM feat WHERE feature = 'rsam_f0__mean'", "feat", dbl=["value"]))
def features_to_series(spark, sf):
    names = ["rsam_f0__mean", "rsam_f1__mean"]
    return extract.features_to_series(extract.to_wide(features(spark, sf, names), names), "rsam_f0__mean")


@query(
    "describe_features",
    oracle(
        """SELECT DISTINCT feature,
  CASE split_part(feature, '__', 2) WHEN 'mean' THEN 'Mean' WHEN 'standard_deviation' THEN 'Standard deviation' WHEN 'maximum' THEN 'Maximum'
    WHEN 'skewness' THEN 'Skewness' WHEN 'mean_abs_change' THEN 'Mean absolute change' WHEN 'linear_trend' THEN 'Linear trend (attr=slope)'
    WHEN 'symmetry_looking' THEN 'Symmetry looking test (r=0.05)' ELSE 'Large standard deviation flag (r=0.25)' END
  || ' of RSAM ' || CASE split_part(feature, '__', 1) WHEN 'rsam_f0' THEN '0.01–0.1' WHEN 'rsam_f1' THEN '0.1–2' WHEN 'rsam_f2' THEN '2–5'
    WHEN 'rsam_f3' THEN '4.5–8' ELSE '8–16' END || ' Hz' AS description,
  split_part(feature, '__', 1) || ' | ' || CASE split_part(feature, '__', 2) WHEN 'standard_deviation' THEN 'std'
    WHEN 'maximum' THEN 'max' WHEN 'skewness' THEN 'skew' WHEN 'mean_abs_change' THEN 'mean_abs_chg' WHEN 'linear_trend' THEN 'lin_trend(slope)'
    WHEN 'symmetry_looking' THEN 'sym_looking(0.05)' WHEN 'large_standard_deviation' THEN 'large_std(0.25)' ELSE 'mean' END AS short_name
FROM feat""",
        "feat",
    ),
)
def describe_features(spark, sf):
    return extract.describe_features(features(spark, sf).select("feature").distinct())


# ---------------------------------------------------------------- ranking


def erfc_sql(z: str) -> str:
    k = f"(1 / (1 + 0.3275911e0 * {z}))"
    return (
        f"((0.254829592e0 * {k} - 0.284496736e0 * power({k}, 2) + 1.421413741e0 * power({k}, 3) "
        f"- 1.453152027e0 * power({k}, 4) + 1.061405429e0 * power({k}, 5)) * exp(-1 * {z} * {z}))"
    )


def rank_test_sql(source: str, keys: str) -> str:
    """``source`` has keys, feature, value, is_erupted."""
    lf = "lgamma({} + 1)"
    num = " + ".join(lf.format(x) for x in ("r1", "r2", "c1", "(r1 + r2 - c1)"))
    den = lambda k: " - ".join(lf.format(x) for x in ("(r1 + r2)", k, f"(r1 - {k})", f"(c1 - {k})", f"(r2 - c1 + {k})"))
    return f"""SELECT {keys}, feature, n_distinct, z, CASE WHEN n_distinct = 2 THEN fisher WHEN z IS NULL THEN 1 ELSE {erfc_sql('(z / sqrt(2e0))')} END AS p_value FROM (
  SELECT *, greatest(abs(r1s - n1 * (n1 + 1) / 2e0 - n1 * n0 / 2e0) - 0.5e0, 0) / sqrt(nullif(n1 * n0 / 12e0 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1e0))), 0)) AS z,
    CASE WHEN n_distinct = 2 THEN least(1, list_sum(list_transform(generate_series(greatest(0, c1 - r2), least(r1, c1)),
      lambda k: CASE WHEN exp({num} - {den('k')}) <= exp({num} - {den('a')}) * (1 + 1e-7) THEN exp({num} - {den('k')}) ELSE 0 END))) END AS fisher
  FROM (SELECT {keys}, feature, count(DISTINCT value) AS n_distinct, sum(CASE WHEN is_erupted = 1 THEN rk END) AS r1s,
      CAST(sum(is_erupted) AS BIGINT) AS n1, CAST(sum(1 - is_erupted) AS BIGINT) AS n0, sum((t * t - 1)::DOUBLE) AS ties,
      CAST(sum(is_erupted) FILTER (value = vmax) AS BIGINT) AS a, count(*) FILTER (value = vmax) AS c1,
      CAST(sum(is_erupted) AS BIGINT) AS r1, CAST(sum(1 - is_erupted) AS BIGINT) AS r2
    FROM (SELECT *, rank() OVER (PARTITION BY {keys}, feature ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, feature, value) - 1) / 2e0 AS rk,
        count(*) OVER (PARTITION BY {keys}, feature, value) AS t, max(value) OVER (PARTITION BY {keys}, feature) AS vmax FROM {source})
    GROUP BY {keys}, feature))"""


LOG_P_SQL = (
    "CASE WHEN n_distinct = 2 THEN CASE WHEN p_value > 0 THEN ln(p_value) ELSE -1e300 END WHEN z IS NULL THEN 0 ELSE ln("
    + erfc_sql("(z / sqrt(2e0))").rsplit(" * exp(", 1)[0].removeprefix("(")
    + ") - z * z / 2 END"
)


def fdr_sql(source: str, keys: str) -> str:
    return f"""SELECT *, least(1, min(raw) OVER (PARTITION BY {keys} ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted FROM (
  SELECT *, p_value * count(*) OVER (PARTITION BY {keys}) * sum(1e0 / rank) OVER (PARTITION BY {keys}) / rank AS raw FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round({LOG_P_SQL}, 9), feature) AS rank FROM {source}))"""


cte("feat_y", "SELECT f.*, is_erupted FROM feat f JOIN y ON f.series = y.series AND f.id = y.id", "feat", "y")
cte("ranked_p", rank_test_sql("feat_y", "series"), "feat_y")
cte("fdr", fdr_sql("ranked_p", "series"), "ranked_p")
cte(
    "chosen",
    """SELECT *, CASE WHEN count(*) FILTER (adjusted <= 0.05) OVER (PARTITION BY series) >= 20
  THEN CAST(adjusted <= 0.05 AS INTEGER) ELSE CAST(rank <= 20 AS INTEGER) END AS selected FROM fdr""",
    "fdr",
)


@query("rank_test", oracle("SELECT series, feature, n_distinct, z, p_value FROM ranked_p", "ranked_p", dbl=["z", "p_value"]))
def rank_test(spark, sf):
    return selection.rank_test(features(spark, sf), labels(spark))


@query(
    "flagship_ranking",
    oracle(
        """SELECT series, feature, n_distinct, z, p_value, rank, adjusted, CAST(adjusted <= 0.05 AS INTEGER) AS relevant FROM fdr WHERE rank <= 20""",
        "fdr",
        dbl=["z", "p_value", "adjusted"],
    ),
)
def flagship_ranking(spark, sf):
    """Samples, window metrics, gap filling, labels, look-back, features, ranking."""
    return ranked_features(features(spark, sf), labels(spark), 20)


@query(
    "fdr_filter",
    oracle(
        "SELECT series, feature, n_distinct, z, p_value, rank, adjusted, CAST(adjusted <= 0.5 AS INTEGER) AS relevant FROM fdr",
        "fdr",
        dbl=["z", "p_value", "adjusted"],
    ),
)
def fdr_filter(spark, sf):
    return selection.fdr_filter(selection.rank_test(features(spark, sf), labels(spark)), 0.5)


@query(
    "select_significant",
    oracle(
        "SELECT series, feature, p_value AS score, rank, selected FROM chosen", "chosen", dbl=["score"]
    ),
)
def select_significant(spark, sf):
    return selection.feature_scores(selection.select_significant(features(spark, sf), labels(spark), 20))


@query(
    "relevant_features",
    oracle(
        """SELECT f.series, f.id, f.feature, f.value FROM feat f JOIN chosen c ON f.series = c.series AND f.feature = c.feature
WHERE selected = 1 AND f.id IN (SELECT id FROM y WHERE ts < TIMESTAMP '2024-01-25')""",
        "feat",
        "chosen",
        "y",
        dbl=["value"],
    ),
)
def relevant_features(spark, sf):
    """Features of the labels up to a date, kept where they are significant over all labels."""
    f, y = features(spark, sf), labels(spark)
    early = y.where(F.col("ts") < F.lit("2024-01-25").cast("timestamp"))
    kept = selection.select_significant(f, y, 20).where("selected")
    return selection.transform_selected(extract.relevant_ids(f, early), kept)


@query(
    "transform_selected",
    oracle("SELECT f.* FROM feat f JOIN chosen c ON f.series = c.series AND f.feature = c.feature WHERE rank <= 5", "feat", "chosen", dbl=["value"]),
)
def transform_selected(spark, sf):
    f = features(spark, sf)
    return selection.transform_selected(f, selection.select_significant(f, labels(spark), 20).where("rank <= 5"))


# ---------------------------------------------------------------- sampling

SEEDS = B.SEEDS


def key_sql(seed: str = "seed") -> str:
    return f"((((id + 1) * ((({seed}) * 69621 + 48271) % 2147483647)) % 2147483647) * 16807 + 11) % 2147483647"


cte(
    "y_seeds",
    f"SELECT y.series, CAST(s AS INTEGER) AS seed, y.id, y.ts, y.is_erupted FROM y_seen y CROSS JOIN (SELECT unnest({SEEDS}) AS s)",
    "y_seen",
)
cte(
    "y_sized",
    f"""SELECT *, least(p, n - p) AS n_min, greatest(p, n - p) AS n_maj, CASE WHEN p * 2 <= n THEN 1 ELSE 0 END AS minor,
  row_number() OVER (PARTITION BY series, seed, is_erupted ORDER BY {key_sql()}, id) AS position
FROM (SELECT *, sum(is_erupted) OVER (PARTITION BY series, seed) AS p, count(*) OVER (PARTITION BY series, seed) AS n FROM y_seeds)""",
    "y_seeds",
)
cte("under", "SELECT series, seed, id, is_erupted FROM y_sized WHERE is_erupted = minor OR position <= floor(n_min / 0.75e0)", "y_sized")


def seed_labels(spark, sf):
    return sampling.with_seeds(labels_seen(spark, sf).select("series", "id", "ts", "is_erupted"), SEEDS)


@query("undersample", oracle("SELECT * FROM under", "under"))
def undersample(spark, sf):
    return sampling.undersample(seed_labels(spark, sf), 0.75)


@query(
    "oversample",
    oracle(
        """SELECT series, seed, id, is_erupted, CAST(unnest(generate_series(0, CASE WHEN is_erupted = minor
  THEN CAST(floor((greatest(floor(n_maj * 0.75e0), n_min) - position) / n_min::DOUBLE) AS BIGINT) ELSE 0 END)) AS INTEGER) AS copy FROM y_sized""",
        "y_sized",
    ),
)
def oversample(spark, sf):
    return sampling.oversample(seed_labels(spark, sf), 0.75)


@query(
    "rebuild_resampled",
    oracle(
        "SELECT u.series, u.seed, u.id, u.is_erupted, f.feature, f.value FROM under u JOIN feat f ON u.series = f.series AND u.id = f.id WHERE f.feature IN ('rsam_f0__mean', 'rsam_f1__mean')",
        "under",
        "feat",
        dbl=["value"],
    ),
)
def rebuild_resampled(spark, sf):
    f = features(spark, sf, ["rsam_f0__mean", "rsam_f1__mean"])
    return sampling.rebuild_resampled(f, sampling.undersample(seed_labels(spark, sf), 0.75))


@query(
    "cv_splits_stratified",
    oracle(
        """SELECT series, seed, id, is_erupted, CAST(f AS INTEGER) AS fold, CASE WHEN (position - 1) % 5 = f THEN 'test' ELSE 'train' END AS part
FROM y_sized CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS f)""",
        "y_sized",
    ),
)
def cv_splits_stratified(spark, sf):
    return sampling.cv_splits(seed_labels(spark, sf), "stratified", 5)


@query(
    "cv_splits_shuffle",
    oracle(
        f"""SELECT series, seed, id, is_erupted, CAST(f AS INTEGER) AS fold, CASE WHEN (position - 1) % 5 = f THEN 'test' ELSE 'train' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY series, seed ORDER BY {key_sql()}, id) AS position FROM y_seeds)
CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS f)""",
        "y_seeds",
    ),
)
def cv_splits_shuffle(spark, sf):
    return sampling.cv_splits(seed_labels(spark, sf), "shuffle", 5)


@query(
    "cv_splits",
    oracle(
        f"""SELECT series, seed, id, is_erupted, CAST(f AS INTEGER) AS fold,
  CASE WHEN row_number() OVER (PARTITION BY series, seed, f, is_erupted ORDER BY {key_sql('seed + f * 1000003')}, id)
    <= round(count(*) OVER (PARTITION BY series, seed, f, is_erupted) * 0.25e0) THEN 'test' ELSE 'train' END AS part
FROM y_seeds CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS f)""",
        "y_seeds",
    ),
)
def cv_splits(spark, sf):
    return sampling.cv_splits(seed_labels(spark, sf), "shuffle-stratified", 5, 0.25)


@query(
    "cv_splits_timeseries",
    oracle(
        """SELECT * FROM (SELECT series, seed, id, is_erupted, CAST(f AS INTEGER) AS fold, CASE WHEN position <= n - (n // 6) * (5 - f) THEN 'train'
  WHEN position <= n - (n // 6) * (5 - f) + n // 6 THEN 'test' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY series, seed ORDER BY ts) AS position, count(*) OVER (PARTITION BY series, seed) AS n FROM y_seeds)
CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS f)) WHERE part IS NOT NULL""",
        "y_seeds",
    ),
)
def cv_splits_timeseries(spark, sf):
    return sampling.cv_splits(seed_labels(spark, sf), "timeseries", 5)


def knn_sql(k: int, dist: str, weight: str) -> str:
    return f"""SELECT query_id, sum(w * y) / sum(w) AS p, max(d) AS kth_distance FROM (
  SELECT *, {weight} AS w FROM (
    SELECT a.vec_id AS query_id, b.vec_id, (b.label % 2)::DOUBLE AS y, round({dist}, 9) AS d
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) <= {k}))
GROUP BY query_id"""


def vectors(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") % 2).cast("double").alias("label")
    )


@query(
    "knn",
    oracle(knn_sql(6, "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "1e0"), dbl=["p", "kth_distance"]),
)
def knn(spark, sf):
    v = vectors(spark, sf)
    return sampling.knn(v, v, 6, 2, "uniform")


@query(
    "knn_distance_weighted",
    oracle(
        knn_sql(
            3,
            "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda t: abs(t[1] - t[2])))",
            "CASE WHEN min(d) OVER (PARTITION BY query_id) = 0 THEN CASE WHEN d = 0 THEN 1e0 ELSE 0e0 END ELSE 1 / nullif(d, 0) END",
        ),
        dbl=["p", "kth_distance"],
    ),
)
def knn_distance_weighted(spark, sf):
    v = vectors(spark, sf)
    return sampling.knn(v, v, 3, 1, "distance")


# ---------------------------------------------------------------- per-seed ranking

cte("feat_seed", "SELECT f.series, u.seed, f.id, f.feature, f.value, u.is_erupted FROM feat f JOIN under u ON f.series = u.series AND f.id = u.id", "feat", "under")
cte("seed_p", rank_test_sql("feat_seed", "series, seed"), "feat_seed")
cte("seed_fdr", fdr_sql("seed_p", "series, seed"), "seed_p")
cte(
    "seed_top",
    """SELECT series, seed, feature, p_value, rank FROM (SELECT *, CASE WHEN count(*) FILTER (adjusted <= 0.05) OVER (PARTITION BY series, seed) >= 10
  THEN count(*) FILTER (adjusted <= 0.05) OVER (PARTITION BY series, seed) ELSE least(10, count(*) OVER (PARTITION BY series, seed)) END AS n_sel FROM seed_fdr)
WHERE rank <= least(n_sel, 10)""",
    "seed_fdr",
)


def seed_rankings(spark, sf, top_n=10):
    under = sampling.undersample(seed_labels(spark, sf), 0.75)
    return keep(selection.per_seed_selection(features(spark, sf), under, top_n))


@query("per_seed_selection", oracle("SELECT * FROM seed_top", "seed_top", dbl=["p_value"]))
def per_seed_selection(spark, sf):
    return seed_rankings(spark, sf)


# Scores rounded so that both engines order equal means alike.
cte("seed_scores", "SELECT series, seed, feature, round(p_value + 1e-9, 6) AS p_value, rank FROM seed_top", "seed_top")


def rounded_rankings(spark, sf):
    return keep(seed_rankings(spark, sf).withColumn("p_value", rounded("p_value")))


cte(
    "top_table",
    """SELECT *, row_number() OVER (PARTITION BY series ORDER BY frequency DESC, round(score_mean, 9), feature) AS position FROM (
  SELECT series, feature, count(*) AS frequency, avg(p_value) AS score_mean, stddev_samp(p_value) AS score_std FROM seed_scores GROUP BY series, feature)""",
    "seed_scores",
)


@query(
    "top_features",
    oracle(
        "SELECT series, feature, frequency, score_mean, score_std, position, 'ft_' || position AS alias FROM top_table WHERE position <= 12",
        "top_table",
        dbl=["score_mean", "score_std"],
    ),
)
def top_features(spark, sf):
    return selection.top_features(rounded_rankings(spark, sf), 12).drop("description")


def two_tables(spark, sf):
    r = rounded_rankings(spark, sf)
    return {
        "low": selection.top_features(r.where("seed <= 2")),
        "high": selection.top_features(r.where("seed >= 2")),
    }


cte(
    "two_tables",
    """SELECT 'low' AS scenario, feature, count(*) AS frequency, avg(p_value) AS score_mean, stddev_samp(p_value) AS score_std FROM seed_scores WHERE seed <= 2 GROUP BY feature
UNION ALL SELECT 'high', feature, count(*), avg(p_value), stddev_samp(p_value) FROM seed_scores WHERE seed >= 2 GROUP BY feature""",
    "seed_scores",
)


@query(
    "common_features",
    oracle(
        """SELECT *, 'ft_' || position AS alias FROM (SELECT *, row_number() OVER (ORDER BY frequency DESC, round(score_mean, 9), feature) AS position FROM (
  SELECT feature, CAST(sum(frequency) AS BIGINT) AS frequency, sum(score_mean) AS score_mean, coalesce(sum(score_std), 0) AS score_std
  FROM two_tables GROUP BY feature HAVING count(DISTINCT scenario) = 2))""",
        "two_tables",
        dbl=["score_mean", "score_std"],
    ),
)
def common_features(spark, sf):
    return selection.common_features(two_tables(spark, sf)).drop("description")


@query(
    "common_heatmap",
    oracle(
        """SELECT feature, coalesce(max(frequency) FILTER (scenario = 'low'), 0) AS low, coalesce(max(frequency) FILTER (scenario = 'high'), 0) AS high
FROM two_tables GROUP BY feature""",
        "two_tables",
    ),
)
def common_heatmap(spark, sf):
    return selection.common_heatmap(two_tables(spark, sf))


@query(
    "band_contribution",
    oracle(
        """SELECT seed, split_part(feature, '__', 1) AS band, count(*) AS n, count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY seed) AS percent
FROM seed_top GROUP BY seed, band""",
        "seed_top",
        dbl=["percent"],
    ),
)
def band_contribution(spark, sf):
    return selection.band_contribution(seed_rankings(spark, sf), ["seed"])


TOP4 = ["rsam_f0__mean", "rsam_f1__mean", "rsam_f2__maximum", "rsam_f3__standard_deviation"]
IN4 = ", ".join(repr(n) for n in TOP4)


def corr_sql(source: str) -> str:
    return f"""SELECT a.series, a.feature AS feature_a, b.feature AS feature_b, corr(a.value, b.value) AS r
FROM {source} a JOIN {source} b ON a.series = b.series AND a.id = b.id GROUP BY ALL"""


cte(
    "feat_rank",
    f"""SELECT series, id, feature, rank() OVER (PARTITION BY series, feature ORDER BY value) + (count(*) OVER (PARTITION BY series, feature, value) - 1) / 2e0 AS value
FROM feat WHERE feature IN ({IN4})""",
    "feat",
)
cte(
    "feat_stacked",
    f"""SELECT series, 'a' || id AS id, feature, value FROM feat WHERE feature IN ({IN4})
UNION ALL SELECT series, 'b' || id, feature, value * 2 FROM feat WHERE feature IN ({IN4}) AND id % 2 = 0""",
    "feat",
)


@query("feature_correlation", oracle(corr_sql("feat_rank"), "feat_rank", dbl=["r"]))
def feature_correlation(spark, sf):
    return selection.feature_correlation(features(spark, sf, TOP4), TOP4, "spearman")


@query("common_correlation", oracle(corr_sql("feat_stacked"), "feat_stacked", dbl=["r"]))
def common_correlation(spark, sf):
    f = features(spark, sf, TOP4)
    half = f.where("id % 2 = 0").withColumn("value", F.col("value") * 2)
    return selection.common_correlation({"a": f, "b": half}, TOP4)


cte(
    "methods",
    """SELECT 'rank' AS method, seed, feature, rank FROM seed_top
UNION ALL SELECT 'even', seed, feature, rank FROM seed_fdr WHERE rank % 2 = 0 AND rank <= 20""",
    "seed_top",
    "seed_fdr",
)


def method_choices(spark, sf):
    under = sampling.undersample(seed_labels(spark, sf), 0.75)
    every = selection.select_significant(features(spark, sf), under, 10, keys=["series", "seed"])
    every = keep(every)
    n_selected = F.least(F.sum(F.col("selected").cast("int")).over(Window.partitionBy("series", "seed")), F.lit(10))
    rank = every.withColumn("_n", n_selected).where("rank <= _n")
    chosen = rank.select(F.lit("rank").alias("method"), "seed", "feature", "rank").unionByName(
        every.where("rank % 2 = 0 AND rank <= 20").select(F.lit("even").alias("method"), "seed", "feature", "rank")
    )
    return keep(chosen)


def method_metrics(chosen):
    """Stand-in run metrics that are a fixed function of the choices."""
    runs = chosen.groupBy("method", "seed").agg(F.count("*").alias("n"), F.sum("rank").alias("s"))
    return runs.select("method", "seed", (F.col("n") / 40).alias("balanced_accuracy"), (F.col("s") / 400).alias("roc_auc"))


@query(
    "compare_selectors",
    oracle(
        """WITH runs AS (SELECT method, seed, count(*) AS n, sum(rank) AS s FROM methods GROUP BY ALL),
j AS (SELECT a.seed, (SELECT count(*) FROM (SELECT feature FROM methods x WHERE x.method = 'even' AND x.seed = a.seed INTERSECT SELECT feature FROM methods x WHERE x.method = 'rank' AND x.seed = a.seed))
    / (SELECT count(DISTINCT feature) FROM methods x WHERE x.seed = a.seed)::DOUBLE AS jac FROM (SELECT DISTINCT seed FROM methods) a)
SELECT method, avg(n) AS n_selected_mean, avg(n / 40e0) AS balanced_accuracy_mean, stddev_samp(n / 40e0) AS balanced_accuracy_std,
  avg(s / 400e0) AS roc_auc_mean, stddev_samp(s / 400e0) AS roc_auc_std, (SELECT avg(jac) FROM j) AS mean_jaccard FROM runs GROUP BY method""",
        "methods",
        dbl=["n_selected_mean", "balanced_accuracy_mean", "balanced_accuracy_std", "roc_auc_mean", "roc_auc_std", "mean_jaccard"],
    ),
)
def compare_selectors(spark, sf):
    chosen = method_choices(spark, sf)
    return selection.compare_selectors(
        chosen.drop("rank"), chosen.select("method", "seed").distinct(), method_metrics(chosen)
    )


@query(
    "selection_frequency",
    oracle("SELECT method, feature, count(*) AS count FROM methods GROUP BY ALL", "methods"),
)
def selection_frequency(spark, sf):
    return selection.selection_frequency(method_choices(spark, sf))


# ---------------------------------------------------------------- count sweep

# Scores of a sweep: a fixed function of each seed's ranking up to N.
cte(
    "sweep",
    """SELECT CAST(n AS INTEGER) AS "N", seed, round(avg(1 - p_value) - 0.004e0 * abs(n - 5 - seed % 2) + 1e-9, 6) AS score
FROM seed_top CROSS JOIN (SELECT unnest([1, 2, 4, 6, 8, 10]) AS n) WHERE rank <= n GROUP BY n, seed""",
    "seed_top",
)
cte("sweep_mean", 'SELECT "N", avg(score) AS mean, stddev_samp(score) AS std, count(*) AS n_seeds FROM sweep GROUP BY "N"', "sweep")


def sweep(spark, sf):
    r = seed_rankings(spark, sf).withColumn("N", F.explode(F.array(*[F.lit(n) for n in (1, 2, 4, 6, 8, 10)])))
    score = F.avg(1 - F.col("p_value")) - F.lit(0.004) * F.abs(F.col("N") - 5 - F.col("seed") % 2)
    return r.where("rank <= N").groupBy("N", "seed").agg(rounded(score).alias("score"))


@query("cv_scores", oracle("SELECT * FROM sweep_mean", "sweep_mean", dbl=["mean", "std"]))
def cv_scores(spark, sf):
    return sampling.cv_scores(sweep(spark, sf))


@query(
    "pick_n",
    oracle(
        """SELECT min("N") AS n_star FROM sweep_mean CROSS JOIN (SELECT arg_max(mean - CASE WHEN n_seeds > 1 THEN std / sqrt(n_seeds) ELSE 0 END, mean) AS f FROM sweep_mean) WHERE mean >= f""",
        "sweep_mean",
    ),
)
def pick_n(spark, sf):
    return sampling.pick_n(sampling.cv_scores(sweep(spark, sf)))


cte(
    "argmax",
    'SELECT seed, "N" AS "argmax_N" FROM sweep QUALIFY row_number() OVER (PARTITION BY seed ORDER BY score DESC, "N") = 1',
    "sweep",
)


@query("argmax_hist", oracle('SELECT "argmax_N", count(*) AS n_seeds FROM argmax GROUP BY "argmax_N"', "argmax"))
def argmax_hist(spark, sf):
    return sampling.argmax_hist(sweep(spark, sf))


@query(
    "support",
    oracle(
        """SELECT series, seed, feature, p_value, rank FROM seed_top WHERE rank <= (SELECT min("N") FROM sweep_mean WHERE mean >= (SELECT max(mean) * 0.95 FROM sweep_mean))""",
        "seed_top",
        "sweep_mean",
        dbl=["p_value"],
    ),
)
def support(spark, sf):
    star = sampling.pick_n(sampling.cv_scores(sweep(spark, sf)), tolerance=0.05)
    return sampling.support(seed_rankings(spark, sf), star)


@query(
    "run_identity",
    oracle(
        """SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, 'band,series,ts,x' AS columns,
  left(sha256('{"k":3,"name":"demo"}|' || strftime(min(ts), '%Y-%m-%d %H:%M:%S') || '|' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') || '|' || count(*) || '|band,series,ts,x'), 12) AS run_key
FROM samples""",
        "samples",
    ),
)
def run_identity(spark, sf):
    return sampling.run_identity({"name": "demo", "k": 3}, B.samples(spark, sf))
