"""Queries that run a stream to the end of the available input, and custom metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.catalog.base import oracle, query
from foreshock.catalog.forecast import USED, coefficients
from foreshock.catalog.label_matrix import tremor
from foreshock.operators import scoring, signal
from foreshock.streaming.metrics import stream_window_metrics
from foreshock.streaming.score import forecast_sink
from foreshock.streaming.update import run_available, shared_folder, upsert_days, upsert_sink

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_samples(spark, sf):
    B.ensure_utc(spark)
    files = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return files.select(
        F.lit("all").alias("series"),
        F.col("event_type").alias("band"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("x"),
    )


CLOSED = "ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM samples) - INTERVAL 1 HOUR"


@query("stream_window_metrics", oracle(f"SELECT series, band, ts, v FROM rsam WHERE {CLOSED}", "rsam", dbl=["v"]))
def stream_metrics(spark, sf):
    """Closed windows of the stream equal the batch metric."""
    out = shared_folder(spark, "stream-metrics")
    run_available(stream_window_metrics(stream_samples(spark, sf), B.WINDOW_S, empty_windows=False), f"{out}/checkpoint", path=f"{out}/data")
    return spark.read.parquet(f"{out}/data")


@query(
    "stream_all_outliers",
    oracle(
        f"""SELECT series, band, ts, v FROM (SELECT n.series, n.band, n.ts, k.v FROM
  (SELECT DISTINCT series, band, date_trunc('hour', ts) AS ts FROM samples) n LEFT JOIN
  (SELECT series, band, h AS ts, avg(a) AS v FROM ranked WHERE NOT (sd > 0 AND abs((a - m) / nullif(sd, 0)) > 3.5) GROUP BY ALL) k
  ON n.series = k.series AND n.band = k.band AND n.ts = k.ts) WHERE {CLOSED}""",
        "samples",
        "ranked",
        dbl=["v"],
    ),
)
def stream_all_outliers(spark, sf):
    """Closed windows of the stream, without every outlier, equal the batch metric."""
    out = shared_folder(spark, "stream-outliers")
    run_available(stream_window_metrics(stream_samples(spark, sf), B.WINDOW_S, outliers="all"), f"{out}/checkpoint", path=f"{out}/data")
    return spark.read.parquet(f"{out}/data")


@query(
    "stream_update_tremor",
    oracle(
        f"SELECT series, band, ts, CASE WHEN {CLOSED} THEN v ELSE v + 1 END AS v FROM rsam", "rsam", dbl=["v"]
    ),
)
def stream_update(spark, sf):
    """A stored table of older values is replaced by the stream on the same instants."""
    out = shared_folder(spark, "stream-update")
    old = signal.rsam(B.samples(spark, sf), B.WINDOW_S, empty_windows=False).withColumn("v", F.col("v") + 1)
    keys = ["series", "band", "ts"]
    upsert_days(spark, old, f"{out}/table", keys)
    run_available(
        stream_window_metrics(stream_samples(spark, sf), B.WINDOW_S, empty_windows=False), f"{out}/checkpoint", sink=upsert_sink(f"{out}/table", keys)
    )
    return spark.read.parquet(f"{out}/table").drop("dt")


@query(
    "stream_score",
    oracle(
        """WITH grid AS (SELECT 'all' AS series, CAST(g AS BIGINT) AS id, to_timestamp(g * 21600)::TIMESTAMP AS ts FROM (
  SELECT unnest(generate_series(CAST(ceil(epoch(min(ts)) / 21600) AS BIGINT), CAST(floor((epoch(max(ts)) + 3600) / 21600) AS BIGINT))) AS g FROM tremor)),
cut AS (SELECT g.series, g.id, g.ts, t.metric, t.v, t.ts AS at FROM grid g JOIN tremor t ON t.ts >= g.ts - INTERVAL 2 DAY AND t.ts < g.ts),
f AS (SELECT series, id, ts, metric || '__mean' AS feature, avg(v) AS value FROM cut GROUP BY series, id, ts, metric HAVING count(*) = 48
  UNION ALL SELECT series, id, ts, metric || '__maximum', max(v) FROM cut GROUP BY series, id, ts, metric HAVING count(*) = 48
  UNION ALL SELECT series, id, ts, metric || '__standard_deviation', stddev_pop(v) FROM cut GROUP BY series, id, ts, metric HAVING count(*) = 48),
s AS (SELECT f.series, c.classifier, c.seed, f.id, f.ts, 1 / (1 + exp(-1 * (sum(c.coef * f.value / 100) + max(b.coef)))) AS p FROM f
  JOIN coef c ON c.feature = f.feature JOIN coef b ON b.classifier = c.classifier AND b.seed = c.seed AND b.feature = 'intercept' GROUP BY ALL)
SELECT series, classifier, id, ts, avg(p) AS probability, stddev_pop(p) AS uncertainty FROM s GROUP BY series, classifier, id, ts""",
        "tremor",
        "coef",
        dbl=["probability", "uncertainty"],
    ),
)
def stream_score(spark, sf):
    """Stored tremor files stream in; every label completed by a batch is forecast."""
    out = shared_folder(spark, "stream-score")
    tremor(spark, sf).coalesce(1).write.parquet(f"{out}/arriving")
    scaled = coefficients(spark)

    def score(features):
        return scoring.score_linear(features.withColumn("value", F.col("value") / 100), scaled)

    arriving = spark.readStream.schema("series string, metric string, ts timestamp, v double").parquet(f"{out}/arriving")
    sink = forecast_sink(
        f"{out}/tremor", f"{out}/forecast", score, USED, B.LOOKBACK_DAYS, B.STEP_HOURS * 3600, B.WINDOW_S
    )
    run_available(arriving, f"{out}/checkpoint", sink=sink)
    return spark.read.parquet(f"{out}/forecast").select("series", "classifier", "id", "ts", "probability", "uncertainty")


def _rms(x: pd.Series) -> float:
    return float(np.sqrt(np.mean(np.square(x)))) if len(x) else None


@query(
    "custom_metric",
    oracle(
        "SELECT series, band, date_trunc('hour', ts) AS ts, sqrt(avg(x * x)) AS v FROM samples GROUP BY series, band, date_trunc('hour', ts)",
        "samples",
        dbl=["v"],
    ),
)
def custom_metric(spark, sf):
    """A caller's own function of the samples of one window."""
    rms = F.pandas_udf(_rms, "double")
    return signal.window_metric(B.samples(spark, sf), B.WINDOW_S, rms, absolute=False)
