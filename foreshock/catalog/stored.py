"""Queries that write tables and read them again, and reductions of many series at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.catalog.base import cte, oracle, query
from foreshock.catalog.label_matrix import labels, matrix, tremor
from foreshock.catalog.ranking import features
from foreshock.operators import lookback, signal
from foreshock.sources import tables
from foreshock.streaming.metrics import stream_window_metrics
from foreshock.streaming.update import run_available, shared_folder


@query("write_table", oracle("SELECT series, band, ts, v FROM rsam", "rsam", dbl=["v"]))
def write_table(spark, sf):
    """Window metrics through a Parquet table partitioned by band."""
    path = f"{shared_folder(spark, 'write-table')}/rsam"
    tables.write_table(signal.rsam(B.samples(spark, sf), B.WINDOW_S, empty_windows=False), path, partition_by=["band"])
    return spark.read.parquet(path).select("series", "band", "ts", "v")


@query(
    "load_tremor",
    oracle(
        "SELECT series, ts, " + ", ".join(f"max(v) FILTER (metric = '{m}') AS {m}" for m in B.RSAM_METRICS) + " FROM tremor GROUP BY series, ts",
        "tremor",
        dbl=B.RSAM_METRICS,
    ),
)
def load_tremor(spark, sf):
    """A gap-free tremor table through CSV."""
    path = f"{shared_folder(spark, 'load-tremor')}/tremor"
    wide = tremor(spark, sf).groupBy("ts").pivot("metric", B.RSAM_METRICS).agg(F.max("v"))
    named = wide.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), *B.RSAM_METRICS)
    tables.write_table(named, path, fmt="csv")
    return tables.load_tremor(spark, path, B.RSAM_METRICS)


@query(
    "load_features",
    oracle(
        """SELECT feat.* FROM feat JOIN y ON feat.series = y.series AND feat.id = y.id
WHERE y.ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'""",
        "feat",
        "y",
        dbl=["value"],
    ),
)
def load_features(spark, sf):
    """Features of the labels of a date range."""
    return tables.load_features(features(spark, sf), labels(spark), "2024-01-08", "2024-01-20")


@query("matrix_per_metric", oracle("SELECT series, id, metric, ts, v, pos, n FROM slices WHERE n = 48", "slices", dbl=["v"]))
def matrix_per_metric(spark, sf):
    """Look-back slices through one folder per metric."""
    path = f"{shared_folder(spark, 'matrix')}/slices"
    lookback.matrix_per_metric(matrix(spark, sf), path)
    return spark.read.parquet(path).select("series", "id", "metric", "ts", "v", "pos", "n")


cte("user_samples", "SELECT CAST(user_id AS VARCHAR) AS series, event_type AS band, ts, value AS x FROM events")
cte(
    "user_ranked",
    """SELECT series, band, date_trunc('day', ts) AS d, abs(x) AS a, avg(abs(x)) OVER w AS m, stddev_pop(abs(x)) OVER w AS sd,
  row_number() OVER (PARTITION BY series, band, date_trunc('day', ts) ORDER BY abs(x) DESC, ts) AS rn
FROM user_samples WHERE x <> 0 WINDOW w AS (PARTITION BY series, band, date_trunc('day', ts))""",
    "user_samples",
)
cte(
    "user_rsam",
    """SELECT series, band, d AS ts, avg(a) AS v FROM user_ranked
WHERE NOT (rn = 1 AND sd > 0 AND (a - m) / nullif(sd, 0) > 3) GROUP BY series, band, d""",
    "user_ranked",
)
DAY_S = 86400


@query("rsam_many_series", oracle("SELECT series, band, ts, v FROM user_rsam", "user_rsam", dbl=["v"]))
def rsam_many_series(spark, sf):
    """Daily metrics of every user as a series of its own."""
    return signal.rsam(B.samples(spark, sf, "user_id"), DAY_S, empty_windows=False)


@query(
    "stream_outlier_metrics",
    oracle(
        "SELECT series, band, ts, v FROM user_rsam WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM user_samples) - INTERVAL 1 HOUR",
        "user_rsam",
        "user_samples",
        dbl=["v"],
    ),
)
def stream_outlier_metrics(spark, sf):
    """The maximum rule on a stream of many series, from the state of open windows alone."""
    out = shared_folder(spark, "stream-outliers")
    files = spark.readStream.schema(B.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    samples = files.select(
        F.col("user_id").cast("string").alias("series"), F.col("event_type").alias("band"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x")
    )
    run_available(stream_window_metrics(samples, DAY_S, empty_windows=False), f"{out}/checkpoint", path=f"{out}/data")
    return spark.read.parquet(f"{out}/data")
