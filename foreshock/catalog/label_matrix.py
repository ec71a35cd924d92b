"""Queries for label building and look-back slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.catalog.base import cte, oracle, query
from foreshock.catalog.data_signal import long_cells
from foreshock.functions.expr import window_start
from foreshock.operators import labels as L
from foreshock.operators import lookback
from foreshock.plans.tremor import filled_rsam

STEP_S = B.STEP_HOURS * 3600


def labels(spark, days_ahead=B.DAYS_AHEAD, include=True):
    B.ensure_utc(spark)
    return L.label_standard(
        spark, B.event_dates(spark), B.GRID_START, B.GRID_END, B.STEP_HOURS, "hours", days_ahead, include
    )


def tremor(spark, sf):
    return filled_rsam(B.samples(spark, sf), B.WINDOW_S, B.BANDS)


def matrix(spark, sf, min_ratio=1.0, metrics=None):
    return lookback.lookback_matrix(
        tremor(spark, sf), labels(spark), B.LOOKBACK_DAYS, STEP_S, B.WINDOW_S, min_ratio, metrics
    )


def observed(spark, sf):
    """Rows of the label table that tie label queries to the events: 6-hour cells with samples."""
    return (
        B.samples(spark, sf)
        .groupBy("series", window_start("ts", STEP_S).alias("ts"))
        .agg(F.count("*").alias("n_samples"))
    )


cte(
    "seen",
    f"""SELECT series, to_timestamp(floor(epoch(ts) / {STEP_S}) * {STEP_S})::TIMESTAMP AS ts, count(*) AS n_samples
FROM samples GROUP BY ALL""",
    "samples",
)


def with_counts(df, spark, sf):
    """Labels joined to how many samples their step holds, so the work grows with events."""
    return df.join(observed(spark, sf), ["series", "ts"], "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


COUNTED = "SELECT {cols}, coalesce(n_samples, 0) AS n_samples FROM {src} l LEFT JOIN seen s ON l.series = s.series AND l.ts = s.ts"


@query(
    "label_grid",
    oracle(COUNTED.format(cols="l.series, l.id, l.ts, CAST(0 AS INTEGER) AS is_erupted", src="labels_grid"), "labels_grid", "seen"),
)
def label_grid(spark, sf):
    B.ensure_utc(spark)
    return with_counts(L.label_grid(spark, B.GRID_START, B.GRID_END, B.STEP_HOURS), spark, sf)


cte(
    "y_excl",
    """SELECT series, id, ts, CAST(max(CASE WHEN ts >= event_date - INTERVAL 2 DAY
    AND ts < event_date + INTERVAL 1 DAY THEN 1 ELSE 0 END) AS INTEGER) AS is_erupted
FROM labels_grid CROSS JOIN (SELECT event_date FROM dates UNION ALL SELECT DATE '2024-02-05') GROUP BY series, id, ts""",
    "labels_grid",
    "dates",
)


@query(
    "label_events",
    oracle(
        COUNTED.format(
            cols="l.series, l.id, l.ts, CAST(CASE WHEN l.ts >= TIMESTAMP '2024-01-31' THEN 0 ELSE l.is_erupted END AS INTEGER) AS is_erupted",
            src="y_excl",
        ),
        "y_excl",
        "seen",
    ),
)
def label_events(spark, sf):
    """Event day excluded from the forecast days, so the window starts a day earlier."""
    B.ensure_utc(spark)
    grid = L.label_grid(spark, B.GRID_START, B.GRID_END, B.STEP_HOURS)
    dates = B.event_dates(spark, [*B.EVENT_DATES, "2024-02-05"])
    return with_counts(L.label_events(grid, dates, B.DAYS_AHEAD, include=False), spark, sf)


@query("label_standard", oracle(COUNTED.format(cols="l.series, l.id, l.ts, l.is_erupted", src="y"), "y", "seen"))
def label_standard(spark, sf):
    return with_counts(labels(spark), spark, sf)


cte(
    "y_dyn",
    """SELECT 'all' AS series, row_number() OVER (ORDER BY g.ts) - 1 AS id, g.ts, CAST(max(CASE WHEN g.ts >= d.event_date - INTERVAL 1 DAY
    AND g.ts < d.event_date + INTERVAL 1 DAY THEN 1 ELSE 0 END) AS INTEGER) AS is_erupted
FROM (SELECT DISTINCT unnest(generate_series(event_date - INTERVAL 7 DAY, event_date + INTERVAL 86399 SECOND, INTERVAL 6 HOUR)) AS ts FROM dates) g
CROSS JOIN dates d GROUP BY g.ts""",
    "dates",
)


@query("label_dynamic", oracle(COUNTED.format(cols="l.series, l.id, l.ts, l.is_erupted", src="y_dyn"), "y_dyn", "seen"))
def label_dynamic(spark, sf):
    return with_counts(L.label_dynamic(B.event_dates(spark), 7, B.STEP_HOURS, "hours", B.DAYS_AHEAD), spark, sf)


@query(
    "event_slices",
    oracle(
        """SELECT y.series, event_date, y.id, y.ts, is_erupted, coalesce(n_samples, 0) AS n_samples
FROM y JOIN dates ON y.ts >= event_date - INTERVAL 1 DAY AND y.ts < event_date + INTERVAL 1 DAY
LEFT JOIN seen s ON s.series = y.series AND s.ts = y.ts""",
        "y",
        "dates",
        "seen",
    ),
)
def event_slices(spark, sf):
    return with_counts(L.event_slices(labels(spark), B.event_dates(spark), B.DAYS_AHEAD), spark, sf)


# Labels whose step holds at least one sample: what the summaries describe.
cte("y_seen", "SELECT y.* FROM y SEMI JOIN seen s ON y.series = s.series AND y.ts = s.ts", "y", "seen")


def labels_seen(spark, sf):
    return labels(spark).join(observed(spark, sf), ["series", "ts"], "left_semi")


@query(
    "label_summary",
    oracle(
        """SELECT series, count(*) AS n_windows, CAST(sum(is_erupted) AS BIGINT) AS n_positive,
  CAST(count(*) - sum(is_erupted) AS BIGINT) AS n_negative, CAST(2 AS BIGINT) AS positive_days_per_event,
  sum(is_erupted) / count(*) AS positive_ratio FROM y_seen GROUP BY series""",
        "y_seen",
        dbl=["positive_ratio"],
    ),
)
def label_summary(spark, sf):
    return L.label_summary(labels_seen(spark, sf), B.DAYS_AHEAD)


@query(
    "class_distribution",
    oracle(
        """SELECT series, is_erupted, count(*) AS n, count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY series) AS percent
FROM y_seen GROUP BY series, is_erupted""",
        "y_seen",
        dbl=["percent"],
    ),
)
def class_distribution(spark, sf):
    return L.class_distribution(labels_seen(spark, sf))


@query(
    "compare_distributions",
    oracle(
        """SELECT name, count(*) FILTER (is_erupted = 0) AS n_0, count(*) FILTER (is_erupted = 1) AS n_1,
  count(*) FILTER (is_erupted = 0) * 100e0 / count(*) AS percent_0, count(*) FILTER (is_erupted = 1) * 100e0 / count(*) AS percent_1
FROM (SELECT 'standard' AS name, is_erupted FROM y_seen
  UNION ALL SELECT 'dynamic', d.is_erupted FROM y_dyn d SEMI JOIN seen s ON d.series = s.series AND d.ts = s.ts) GROUP BY name""",
        "y_seen",
        "y_dyn",
        "seen",
        dbl=["percent_0", "percent_1"],
    ),
)
def compare_distributions(spark, sf):
    dyn = L.label_dynamic(B.event_dates(spark), 7, B.STEP_HOURS, "hours", B.DAYS_AHEAD)
    return L.compare_distributions(
        {"standard": labels_seen(spark, sf), "dynamic": dyn.join(observed(spark, sf), ["series", "ts"], "left_semi")}
    )


cte(
    "dates_seen",
    "SELECT 'all' AS series, CAST(ts AS DATE) AS event_date FROM events GROUP BY ALL HAVING count(*) % 3 = 0",
)


def dates_seen(spark, sf):
    """Days of the events table whose row count is a multiple of 3, used as event dates."""
    days = B.samples(spark, sf).groupBy("series", F.to_date("ts").alias("event_date")).agg(F.count("*").alias("n"))
    return days.where("n % 3 = 0").select("series", "event_date")


@query(
    "build_y_true",
    oracle(
        """SELECT y.series, y.id, y.ts, CAST(max(CASE WHEN CAST(y.ts AS DATE) = d.event_date THEN 1
    WHEN y.id % 5 = 0 THEN 0 ELSE y.is_erupted END) AS INTEGER) AS is_erupted
FROM y CROSS JOIN dates_seen d GROUP BY y.series, y.id, y.ts""",
        "y",
        "dates_seen",
    ),
)
def build_y_true(spark, sf):
    holed = labels(spark).withColumn("is_erupted", F.when(F.col("id") % 5 != 0, F.col("is_erupted")))
    return L.build_y_true(holed, dates_seen(spark, sf))


@query(
    "truth_on_grid",
    oracle(
        """SELECT s.series, CAST(epoch(s.ts) AS BIGINT) AS id, s.ts, coalesce(y.is_erupted, 0) AS is_erupted
FROM seen s LEFT JOIN y ON s.series = y.series AND s.ts = y.ts""",
        "seen",
        "y",
    ),
)
def truth_on_grid(spark, sf):
    pred = observed(spark, sf).withColumn("id", F.unix_seconds("ts"))
    return L.truth_on_grid(pred, labels(spark))


@query(
    "split_events",
    oracle(
        """SELECT series, event_date, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY event_date) >
    count(*) OVER (PARTITION BY series) - least(greatest(ceil(count(*) OVER (PARTITION BY series) * 0.2e0), 1), count(*) OVER (PARTITION BY series) - 1)
  THEN 'test' ELSE 'train' END AS part FROM dates_seen""",
        "dates_seen",
    ),
)
def split_events(spark, sf):
    return L.split_events(dates_seen(spark, sf), 0.2)


@query(
    "minority_share",
    oracle(
        """SELECT series, least(p, 1 - p) AS minority_share, CAST(least(p, 1 - p) <= 0.15 AS INTEGER) AS undersample
FROM (SELECT series, avg(is_erupted) AS p FROM y_seen GROUP BY series)""",
        "y_seen",
        dbl=["minority_share"],
    ),
)
def minority_share(spark, sf):
    return L.minority_share(labels_seen(spark, sf))


@query(
    "attach_datetime",
    oracle(
        "SELECT y.series, y.id, y.ts, coalesce(n_samples, 0) AS n_samples FROM y LEFT JOIN seen s ON y.series = s.series AND y.ts = s.ts",
        "y",
        "seen",
    ),
)
def attach_datetime(spark, sf):
    y = labels(spark)
    counts = with_counts(y, spark, sf).select("series", "id", "n_samples")
    return L.attach_datetime(counts, y)


SCENARIOS = [
    ("early", "2024-01-03", "2024-01-12", "2024-01-13", "2024-01-20"),
    ("late", "2024-01-03", "2024-01-18", "2024-01-19", "2024-01-30"),
]


@query(
    "scenario_grid",
    oracle(
        """SELECT scenario, part, series, id, ts, is_erupted FROM y_seen JOIN (VALUES
  ('early', 'train', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-12 23:59:59'), ('early', 'predict', TIMESTAMP '2024-01-13', TIMESTAMP '2024-01-20 23:59:59'),
  ('late', 'train', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-18 23:59:59'), ('late', 'predict', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-30 23:59:59')
) c(scenario, part, a, b) ON ts BETWEEN a AND b""",
        "y_seen",
    ),
)
def scenario_grid(spark, sf):
    return L.scenario_grid(labels_seen(spark, sf), SCENARIOS)


# ---------------------------------------------------------------- look-back


@query(
    "lookback_matrix",
    oracle("SELECT series, id, metric, ts, v, pos, n FROM slices WHERE n / 48e0 >= 1", "slices", dbl=["v"]),
)
def lookback_matrix(spark, sf):
    return matrix(spark, sf)


@query(
    "window_completeness",
    oracle(
        """SELECT y.series, y.id, y.ts, count(c.ts) AS n_rows, count(c.ts) / 48e0 AS completeness,
  CAST(count(c.ts) / 48e0 >= 0.9 AS INTEGER) AS kept
FROM y LEFT JOIN (SELECT DISTINCT series, ts FROM cells WHERE metric = 'rsam_f0' AND v IS NOT NULL) c
  ON c.series = y.series AND c.ts >= y.ts - INTERVAL 2 DAY AND c.ts < y.ts GROUP BY y.series, y.id, y.ts""",
        "y",
        "cells",
        dbl=["completeness"],
    ),
)
def window_completeness(spark, sf):
    cells = long_cells(spark, sf).where("metric = 'rsam_f0'")
    return lookback.window_completeness(cells, labels(spark), 2, STEP_S, B.WINDOW_S, 0.9, non_null=True)


@query(
    "window_arrays",
    oracle(
        """SELECT series, id, metric, CAST(count(*) AS INTEGER) AS n_values, min(ts) AS first_ts, max(ts) AS last_ts,
  arg_min(v, pos) AS v_first, arg_max(v, pos) AS v_last, sum(v * (pos + 1)) AS weighted
FROM slices WHERE n = 48 GROUP BY series, id, metric""",
        "slices",
        dbl=["v_first", "v_last", "weighted"],
    ),
)
def window_arrays(spark, sf):
    """The arrays are reduced to scalars here so that any engine can compare them."""
    arrays = lookback.window_arrays(matrix(spark, sf))
    weighted = F.aggregate(
        F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    return arrays.select(
        "series",
        "id",
        "metric",
        F.size("values").alias("n_values"),
        F.element_at("times", 1).alias("first_ts"),
        F.element_at("times", -1).alias("last_ts"),
        F.element_at("values", 1).alias("v_first"),
        F.element_at("values", -1).alias("v_last"),
        weighted.alias("weighted"),
    )
