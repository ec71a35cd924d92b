"""Small frames for tests."""

from datetime import datetime, timedelta

import duckdb

START = datetime(2025, 1, 1)


def samples(spark, values, step_s=60, band="b0", start=START, series="s"):
    rows = [(series, band, start + timedelta(seconds=i * step_s), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, band string, ts timestamp, x double")


def long(spark, values, step_s=3600, metric="m", start=START, series="s"):
    rows = [(series, metric, start + timedelta(seconds=i * step_s), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, metric string, ts timestamp, v double")


def slices(spark, values, metric="m", id_=0):
    n = len(values)
    rows = [("s", id_, metric, START + timedelta(hours=i), float(v), i, n) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "series string, id long, metric string, ts timestamp, v double, pos long, n long"
    )


def column(df, name="v", order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def events_with_a_day_of_zeros(folder):
    """Three users: one never silent, one with a day of zeros between two others, one of zeros alone."""
    rows = []
    for user, values in ((1, [1.0, 2.0, 3.0, 4.0]), (2, [5.0, 0.0, 6.0, 7.0]), (3, [0.0, 0.0, 0.0, 0.0])):
        rows += [(user * 10 + d, START + timedelta(days=d, hours=h), user, "view" if user < 3 else "click", v) for d, v in enumerate(values) for h in (1, 2)]
    values = ", ".join(f"({e}, TIMESTAMP '{t}', {u}, '{b}', {v}::DOUBLE, '')" for e, t, u, b, v in rows)
    names = "event_id, ts, user_id, event_type, value, props"
    cast = "event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props"
    duckdb.sql(f"COPY (SELECT {cast} FROM (VALUES {values}) t({names})) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)
