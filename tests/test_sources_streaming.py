from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foreshock.operators import signal
from foreshock.sources import archive, tables
from foreshock.streaming.metrics import stream_window_metrics
from foreshock.streaming.update import run_available, upsert_days
from tests.helpers import START, column, events_with_a_day_of_zeros, long, samples


def test_partitioned_samples_are_pruned(spark, tmp_path):
    df = samples(spark, [float(i) for i in range(96)], step_s=3600)
    path = str(tmp_path / "p")
    tables.write_table(df, path, partition_by=["dt"])
    got = tables.load_samples(spark, path, start="2025-01-02", end="2025-01-03")
    assert got.count() == 48
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    assert tables.load_samples(spark, path, start="2026-01-01", end="2026-01-02").count() == 0
    with pytest.raises(ValueError):
        tables.load_samples(spark, path, "xml")


def test_csv_round_trip(spark, tmp_path):
    df = samples(spark, [1.0, 2.0]).withColumn("dt", F.to_date("ts"))
    tables.write_table(df, str(tmp_path / "c"), "csv")
    assert column(tables.load_samples(spark, str(tmp_path / "c"), "csv"), "x") == [1.0, 2.0]
    (tmp_path / "t.csv").write_text("datetime,rsam_f0\n2025-01-01 00:10:00,2.0\n2025-01-01 00:00:00,1.0\n")
    assert column(tables.load_tremor(spark, str(tmp_path / "t.csv"), ["rsam_f0"]), "rsam_f0") == [1.0, 2.0]


def test_update_in_halves_equals_one_run(spark):
    whole = long(spark, [1.0, None, 3.0, 4.0, None, 6.0])
    cut = START + timedelta(hours=3)
    a, b = whole.where(F.col("ts") <= F.lit(cut)), whole.where(F.col("ts") >= F.lit(cut))
    assert column(tables.update_tremor(a, b)) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    fresh = tables.rows_to_process(a, whole, 3600)
    assert fresh.count() == 2


def test_label_files(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "label_2020-01-01_2020-12-31_step-6-hours_dtf-2_ie-1.csv").write_text("ts,id,is_erupted\n2020-01-01 00:00:00,0,1\n")
    row = archive.load_labels(spark, str(folder)).first()
    assert (row["window_step"], row["day_to_forecast"], row["include_event_date"]) == (6, 2, 1)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    old = archive.parse_label_name(names("label_2020-01-01_2020-12-31_step-12-minutes_dtf-3")).first()
    assert (old["window_step_unit"], old["include_event_date"]) == ("minutes", 0)
    with pytest.raises(Exception, match="not a label file name"):
        archive.parse_label_name(names("label_2020-01-01_x")).collect()


def test_features_outside_span(spark):
    labels = long(spark, [0.0] * 48, series="s").select("series", F.lit(0).cast("long").alias("id"), "ts")
    with pytest.raises(ValueError, match="outside"):
        tables.load_features(labels, labels, "2024-12-01", "2025-01-01")


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "series string, band string, ts timestamp, x double"
    first = samples(spark, [float(1 + i % 5) for i in range(600)])
    first.coalesce(1).write.parquet(src)
    stream = lambda: stream_window_metrics(spark.readStream.schema(schema).parquet(src), 3600)
    run_available(stream(), str(tmp_path / "cp"), path=out)
    closed = spark.read.parquet(out)
    assert closed.count() == 8
    batch = signal.rsam(first, 3600)
    assert closed.join(batch.withColumnRenamed("v", "w"), ["series", "band", "ts"]).where("abs(v - w) > 1e-12").count() == 0
    late = samples(spark, [1e6])
    late.coalesce(1).write.mode("append").parquet(src)
    run_available(stream(), str(tmp_path / "cp"), path=out)
    assert spark.read.parquet(out).where("v > 100").count() == 0


@pytest.mark.parametrize("name", ["stream_outlier_metrics", "stream_window_metrics"])
def test_streams_of_window_means_equal_their_sql(spark, tmp_path, name):
    sf = events_with_a_day_of_zeros(tmp_path)
    got = [tuple(r) for r in entry.queries()[name](spark, sf).select("series", "band", "ts", "v").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.sql(f"SELECT series, band, ts, v FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and sorted(got, key=repr) == sorted(want, key=repr) and None not in [r[3] for r in got]


def test_stream_without_all_outliers_equals_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "series string, band string, ts timestamp, x double"
    # Both signs, several outliers, zeros, missing values, a constant hour and an hour of zeros.
    values = [float((-1) ** i * (1 + i % 7)) for i in range(600)]
    for i, v in {5: 90.0, 17: -80.0, 70: 1e6, 90: None, 91: float("nan"), 95: 0.0}.items():
        values[i] = v
    values[180:240], values[240:300] = [4.0] * 60, [0.0] * 60
    every = samples(spark, values)
    stream = lambda: stream_window_metrics(spark.readStream.schema(schema).parquet(src), 3600, outliers="all")
    early = F.col("ts") < F.lit("2025-01-01 00:40:00").cast("timestamp")
    every.where(early).coalesce(1).write.parquet(src)
    run_available(stream(), cp, path=out)
    every.where(~early).coalesce(1).write.mode("append").parquet(src)
    run_available(stream(), cp, path=out)
    samples(spark, [1e9, 1e9]).coalesce(1).write.mode("append").parquet(src)  # too late
    run_available(stream(), cp, path=out)
    got = {r["ts"]: r["v"] for r in spark.read.parquet(out).collect()}
    batch = {r["ts"]: r["v"] for r in signal.window_metric(every, 3600, F.avg, outliers="all").collect()}
    assert len(got) == 8 and [got[t] for t in sorted(got)][4] is None and [got[t] for t in sorted(got)][3] == 4.0
    for t, v in got.items():
        assert (v is None and batch[t] is None) or abs(v - batch[t]) < 1e-12
    a = [abs(v) for v in values[:60]]
    m = sum(a) / 60
    sd = (sum((v - m) ** 2 for v in a) / 60) ** 0.5
    inside = [v for v in a if abs(v - m) / sd <= 3.5]
    assert len(inside) == 58 and abs(got[START] - sum(inside) / 58) < 1e-12
    assert spark.read.parquet(out).count() == 8
    for wrong in ({"outliers": "some"}, {"outliers": "all", "threshold": 0.0}):
        with pytest.raises(ValueError):
            stream_window_metrics(every, 3600, **wrong)


def test_upsert_touches_only_its_days(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["series", "metric", "ts"]
    upsert_days(spark, long(spark, [1.0] * 72), path, keys)
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    upsert_days(spark, long(spark, [9.0], start=START + timedelta(days=1)), path, keys)
    got = spark.read.parquet(path)
    assert got.count() == 72 and got.where("v = 9").count() == 1
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert before["dt=2025-01-01"] == after["dt=2025-01-01"] and before["dt=2025-01-02"] != after["dt=2025-01-02"]


def test_folder_of_a_cluster_has_to_be_named():
    """Only a local master may fall back to a folder of the driver."""
    from foreshock.streaming.update import shared_folder

    class Conf(dict):
        pass

    class Session:
        def __init__(self, master, folder=""):
            self.conf = Conf({"spark.checkpoint.dir": folder})
            self.sparkContext = type("C", (), {"master": master})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077"), "x")
    assert shared_folder(Session("spark://host:7077", "/shared/"), "x").startswith("/shared/x-")
    assert shared_folder(Session("local[4]"), "x")
