"""Registry of named queries and the shared text of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.functions.expr import rounded
from foreshock.functions.reuse import release

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def finish(df: DataFrame) -> DataFrame:
    """Comparable output: doubles at 6 places, naive times, 0/1 for booleans."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "double":
            c = rounded(c)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "boolean":
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same question for another engine."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Every query starts cold: nothing persisted for an earlier one is reused.
            release()
            return finish(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (needs, text)


def oracle(body: str, *needs: str, dbl: Sequence[str] = ()) -> str:
    """``body`` preceded by the named subqueries, doubles rounded like :func:`finish`."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" if order else ""
    if dbl:
        fix = ", ".join(f'round("{c}" + 1e-9, 6) AS "{c}"' for c in dbl)
        body = f"SELECT * REPLACE ({fix}) FROM (\n{body}\n)"
    return head + body


def case_list(values: Sequence[str], fmt: str) -> str:
    return " ".join(f"WHEN '{v}' THEN '{fmt.format(i)}'" for i, v in enumerate(values))


DATES_SQL = ", ".join(f"(DATE '{d}')" for d in B.EVENT_DATES)
BAND_CASE = f"CASE band {case_list(B.BANDS, 'rsam_f{}')} END"

cte("samples", "SELECT 'all' AS series, event_type AS band, ts, value AS x FROM events")
cte(
    "hours",
    """SELECT series, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (
  SELECT series, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) + INTERVAL 23 HOUR AS b
  FROM samples GROUP BY series)""",
    "samples",
)
cte(
    "ranked",
    """SELECT series, band, date_trunc('hour', ts) AS h, ts, x, abs(x) AS a,
  avg(abs(x)) OVER w AS m, stddev_pop(abs(x)) OVER w AS sd,
  row_number() OVER (PARTITION BY series, band, date_trunc('hour', ts) ORDER BY abs(x) DESC, ts) AS rn
FROM samples WHERE x <> 0 WINDOW w AS (PARTITION BY series, band, date_trunc('hour', ts))""",
    "samples",
)
cte(
    "rsam",
    """SELECT series, band, h AS ts, avg(a) AS v FROM ranked
WHERE NOT (rn = 1 AND sd > 0 AND (a - m) / nullif(sd, 0) > 3) GROUP BY series, band, h""",
    "ranked",
)
cte(
    "cells",
    f"""SELECT g.series, g.metric, g.ts, r.v FROM
  (SELECT series, ts, unnest([{", ".join(repr(m) for m in B.RSAM_METRICS)}]) AS metric FROM hours) g
  LEFT JOIN (SELECT series, {BAND_CASE} AS metric, ts, v FROM rsam) r
  ON g.series = r.series AND g.metric = r.metric AND g.ts = r.ts""",
    "hours",
    "rsam",
)
FILL = """SELECT series, metric, ts, coalesce(v,
    CASE WHEN v0 IS NULL THEN {lead} WHEN v1 IS NULL THEN v0
      ELSE v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END) AS v
FROM (SELECT series, metric, ts, v,
    last_value(v IGNORE NULLS) OVER p AS v0,
    last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS t0,
    first_value(v IGNORE NULLS) OVER f AS v1,
    first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER f AS t1
  FROM {src} WINDOW
    p AS (PARTITION BY series, metric ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY series, metric ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
cte(
    "tremor",
    "SELECT series, metric, ts, round(v + 1e-9, 6) AS v FROM (" + FILL.format(src="cells", lead="v1") + ")",
    "cells",
)
cte(
    "labels_grid",
    f"""SELECT 'all' AS series, row_number() OVER (ORDER BY ts) - 1 AS id, ts FROM (
  SELECT unnest(generate_series(TIMESTAMP '{B.GRID_START} 00:00:00', TIMESTAMP '{B.GRID_END} 23:59:59', INTERVAL {B.STEP_HOURS} HOUR)) AS ts)""",
)
cte("dates", f"SELECT d AS event_date FROM (VALUES {DATES_SQL}) t(d)")
cte(
    "y",
    f"""SELECT series, id, ts, CAST(max(CASE WHEN ts >= event_date - INTERVAL {B.DAYS_AHEAD - 1} DAY
    AND ts < event_date + INTERVAL 1 DAY THEN 1 ELSE 0 END) AS INTEGER) AS is_erupted
FROM labels_grid CROSS JOIN dates GROUP BY series, id, ts""",
    "labels_grid",
    "dates",
)
cte(
    "slices",
    f"""SELECT *, CAST(row_number() OVER (PARTITION BY series, id, metric ORDER BY ts) - 1 AS BIGINT) AS pos,
  count(*) OVER (PARTITION BY series, id, metric) AS n FROM (
  SELECT y.series, y.id, t.metric, t.ts, t.v FROM y JOIN tremor t ON t.series = y.series
    AND t.ts >= y.ts - INTERVAL {B.LOOKBACK_DAYS} DAY AND t.ts < y.ts)""",
    "y",
    "tremor",
)
