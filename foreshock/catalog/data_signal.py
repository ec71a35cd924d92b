"""Queries for sources, checks and signal reduction."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.catalog.base import BAND_CASE, FILL, cte, oracle, query
from foreshock.functions.reuse import keep
from foreshock.operators import bands, checks, gaps, signal
from foreshock.plans.tremor import filled_rsam
from foreshock.sources import archive, tables

BANDS = B.BANDS
H = B.WINDOW_S


def rsam_wide(spark, sf):
    return signal.tremor_table(B.samples(spark, sf), H, BANDS, ["rsam"])


def long_cells(spark, sf):
    s = B.samples(spark, sf)
    cells = signal.rsam(s, H).select("series", signal.band_metric(BANDS).alias("metric"), "ts", "v")
    return signal.on_grid(keep(cells), H, B.RSAM_METRICS)


WIDE_COLS = ", ".join(f"max(CASE WHEN metric = '{m}' THEN v END) AS {m}" for m in B.RSAM_METRICS)
cte("wide", f"SELECT series, ts, {WIDE_COLS} FROM cells GROUP BY series, ts", "cells")

# ---------------------------------------------------------------- sources


@query(
    "load_samples",
    "SELECT 'all' AS series, event_type AS band, ts, round(value + 1e-9, 6) AS x FROM events",
)
def load_samples(spark, sf):
    B.ensure_utc(spark)
    return tables.load_samples(
        spark,
        f"{sf}/events.parquet",
        start="2024-01-01",
        end="2024-01-30",
        columns={
            "series": F.lit("all"),
            "band": F.col("event_type"),
            "ts": F.col("ts").cast("timestamp"),
            "x": F.col("value"),
        },
    )


@query(
    "archive_inventory",
    """WITH found AS (SELECT DISTINCT 'VG.S' || user_id || '.00.EHZ' AS series, CAST(ts AS DATE) AS day FROM events),
cal AS (SELECT series, CAST(d AS DATE) AS day FROM (SELECT DISTINCT series FROM found)
  CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d))
SELECT cal.series, cal.day, CASE WHEN found.day IS NULL THEN 'missing' ELSE 'present' END AS status
FROM cal LEFT JOIN found ON cal.series = found.series AND cal.day = found.day""",
)
def archive_inventory(spark, sf):
    ev = B.table(spark, sf, "events")
    day = F.format_string("%03d", F.dayofyear("ts"))
    sta = F.concat(F.lit("s"), F.col("user_id"))
    year = F.year("ts").cast("string")
    path = F.concat(
        year, F.lit("/VG/"), sta, F.lit("/EHZ.D/VG."), sta, F.lit(".00.EHZ.D."), year, F.lit("."), day
    )
    return archive.archive_inventory(ev.select(path.alias("path")).distinct(), "2024-01-01", "2024-01-30")


@query(
    "tremor_span",
    oracle(
        """SELECT series, min(ts) AS first_ts, max(ts) AS last_ts,
  CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS BIGINT) AS n_days,
  'rsam_f0,rsam_f1,rsam_f2,rsam_f3,rsam_f4' AS columns FROM wide GROUP BY series""",
        "wide",
    ),
)
def tremor_span(spark, sf):
    return checks.tremor_span(rsam_wide(spark, sf))


@query(
    "concat_daily",
    oracle(
        """SELECT series, ts, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN rsam_f0 END AS rsam_f0, rsam_f1,
  CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN rsam_f2 END AS rsam_f2 FROM wide""",
        "wide",
        dbl=["rsam_f0", "rsam_f1", "rsam_f2"],
    ),
)
def concat_daily(spark, sf):
    wide = rsam_wide(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    early = wide.where(F.col("ts") < cut).select("series", "ts", "rsam_f1", "rsam_f0")
    late = wide.where(F.col("ts") >= cut).select("series", "ts", "rsam_f2", "rsam_f1")
    return tables.concat_daily([early, late])


cte(
    "updated",
    """SELECT series, metric, ts, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN v ELSE v + 1 END AS v FROM cells""",
    "cells",
)


@query(
    "update_tremor",
    oracle(FILL.format(src="updated", lead="NULL"), "updated", dbl=["v"]),
)
def update_tremor(spark, sf):
    cells = long_cells(spark, sf)
    existing = cells.where(F.col("ts") < F.lit("2024-01-17").cast("timestamp")).withColumn("v", F.col("v") + 1)
    new = cells.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp"))
    return tables.update_tremor(existing, new)


@query(
    "clip_update_day",
    oracle(
        """SELECT series, ts, rsam_f0, rsam_f1 FROM wide w WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'
AND EXISTS (SELECT 1 FROM wide o WHERE o.series = w.series AND date_trunc('day', o.ts) = date_trunc('day', w.ts)
  AND o.ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'
  AND coalesce(o.rsam_f0, o.rsam_f1) IS NOT NULL)""",
        "wide",
        dbl=["rsam_f0", "rsam_f1"],
    ),
)
def clip_update_day(spark, sf):
    wide = rsam_wide(spark, sf).select("series", "ts", "rsam_f0", "rsam_f1")
    return checks.clip_update_day(wide, "2024-01-10 06:00:00", "2024-01-12 18:00:00")


@query(
    "parse_label_name",
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS a, CAST(CAST(ts AS DATE) + INTERVAL 10 DAY AS DATE) AS b, day(ts) AS k FROM events)
SELECT 'label_' || a || '_' || b || '_step-' || (k % 12 + 1) || (CASE WHEN k % 3 = 0 THEN '-minutes' ELSE '-hours' END)
    || '_dtf-' || (k % 4 + 1) || (CASE WHEN k % 2 = 0 THEN '' ELSE '_ie-' || (k % 5 % 2) END) AS name,
  a AS start_date, b AS end_date, CAST(k % 12 + 1 AS INTEGER) AS window_step,
  CASE WHEN k % 3 = 0 THEN 'minutes' ELSE 'hours' END AS window_step_unit, CAST(k % 4 + 1 AS INTEGER) AS day_to_forecast,
  CAST(CASE WHEN k % 2 = 0 THEN 0 ELSE k % 5 % 2 END AS INTEGER) AS include_event_date FROM d""",
)
def parse_label_name(spark, sf):
    k = F.dayofmonth("a")
    names = (
        B.samples(spark, sf)
        .select(F.to_date("ts").alias("a"))
        .distinct()
        .select(
            F.concat(
                F.lit("label_"), F.col("a").cast("string"), F.lit("_"), F.date_add("a", 10).cast("string"),
                F.lit("_step-"), k % 12 + 1, F.when(k % 3 == 0, "-minutes").otherwise("-hours"),
                F.lit("_dtf-"), k % 4 + 1, F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("_ie-"), k % 5 % 2)),
            ).alias("name")
        )
    )
    return archive.parse_label_name(names)


# ---------------------------------------------------------------- checks


@query(
    "select_metrics",
    oracle("SELECT series, ts, rsam_f1, rsam_f3 FROM wide", "wide", dbl=["rsam_f1", "rsam_f3"]),
)
def select_metrics(spark, sf):
    return checks.select_metrics(rsam_wide(spark, sf), ["rsam_f1", "rsam_f3"])


@query(
    "slice_dates",
    oracle(
        "SELECT * FROM samples WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 23:59:59'",
        "samples",
        dbl=["x"],
    ),
)
def slice_dates(spark, sf):
    return checks.slice_dates(B.samples(spark, sf), "2024-01-05", "2024-01-25")


@query(
    "clamp_to_span",
    oracle(
        """SELECT event_date, greatest(CAST(event_date - INTERVAL 10 DAY AS TIMESTAMP), a) AS start_ts,
  least(event_date + INTERVAL 5 DAY, b) AS end_ts
FROM dates CROSS JOIN (SELECT min(ts) AS a, max(ts) AS b FROM cells)""",
        "dates",
        "cells",
    ),
)
def clamp_to_span(spark, sf):
    ranges = B.event_dates(spark).select(
        "series",
        "event_date",
        F.expr("timestamp(event_date) - interval 10 day").alias("start_ts"),
        F.expr("timestamp(event_date) + interval 5 day").alias("end_ts"),
    )
    return checks.clamp_to_span(ranges, long_cells(spark, sf)).drop("series")


@query(
    "trim_buffer",
    oracle("SELECT * FROM cells WHERE ts >= TIMESTAMP '2024-01-03'", "cells", dbl=["v"]),
)
def trim_buffer(spark, sf):
    return checks.trim_buffer(long_cells(spark, sf), "2024-01-03")


@query(
    "filter_event_dates",
    """SELECT DISTINCT CAST(ts AS DATE) AS event_date FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-22'""",
)
def filter_event_dates(spark, sf):
    dates = B.samples(spark, sf).select(F.to_date("ts").alias("event_date")).distinct()
    return checks.filter_event_dates(dates, "2024-01-10", "2024-01-22")


cte(
    "gaps_checked",
    """SELECT series, band, ts, x, gap_s, CASE WHEN gap_s IS NULL OR gap_s BETWEEN 0 AND 3600 THEN 1 ELSE 0 END AS is_good
FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts))) / 1e6 AS gap_s FROM samples)""",
    "samples",
)


@query("check_sampling", oracle("SELECT * FROM gaps_checked", "gaps_checked", dbl=["x", "gap_s"]))
def check_sampling(spark, sf):
    return checks.check_sampling(B.samples(spark, sf), 1800.0, 1800.0)


@query(
    "sampling_summary",
    oracle(
        """SELECT series, CAST(min(is_good) AS INTEGER) AS is_consistent, CAST(sum(is_good) AS BIGINT) AS good_rows,
  CAST(sum(1 - is_good) AS BIGINT) AS bad_rows,
  CASE WHEN min(is_good) = 1 THEN CAST(floor(arg_min(gap_s, ts) FILTER (gap_s IS NOT NULL)) AS BIGINT) END AS rate_s
FROM gaps_checked GROUP BY series""",
        "gaps_checked",
    ),
)
def sampling_summary(spark, sf):
    return checks.sampling_summary(checks.check_sampling(B.samples(spark, sf), 1800.0, 1800.0))


@query(
    "clip_above",
    oracle(
        """SELECT series, metric, ts, CASE WHEN metric LIKE 'rsam%' AND v >= 60 THEN NULL ELSE v END AS v FROM cells""",
        "cells",
        dbl=["v"],
    ),
)
def clip_above(spark, sf):
    return checks.clip_above(long_cells(spark, sf), "rsam", 60.0)


@query(
    "mask_zeros",
    oracle(
        "SELECT series, band, ts, nullif(CAST(round(x / 10) AS DOUBLE), 0) AS x FROM samples", "samples", dbl=["x"]
    ),
)
def mask_zeros(spark, sf):
    coarse = B.samples(spark, sf).withColumn("x", F.round(F.col("x") / 10))
    return checks.mask_zeros(coarse)


@query(
    "drop_nans",
    oracle("SELECT * FROM (SELECT series, band, ts, CASE WHEN x >= 50 THEN x END AS x FROM samples) WHERE x IS NOT NULL", "samples", dbl=["x"]),
)
def drop_nans(spark, sf):
    holed = B.samples(spark, sf).withColumn("x", F.when(F.col("x") >= 50, F.col("x")).otherwise(F.lit(float("nan"))))
    return checks.drop_nans(holed)


@query(
    "count_valid",
    oracle(
        "SELECT series, band, count(CASE WHEN round(x / 10) <> 0 THEN 1 END) AS n_valid FROM samples GROUP BY series, band",
        "samples",
    ),
)
def count_valid(spark, sf):
    return checks.count_valid(B.samples(spark, sf).withColumn("x", F.round(F.col("x") / 10)))


# ---------------------------------------------------------------- signal

RATE = 0.004  # nominal samples per second of the events stream at sf 0.01

@query(
    "chunk_windows",
    oracle(
        """WITH starts AS (SELECT series, band, d + k * INTERVAL 1 HOUR AS window_start FROM (
  SELECT series, band, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM
    (SELECT series, band, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM samples GROUP BY series, band))
  CROSS JOIN (SELECT unnest(generate_series(0, 22)) AS k))
SELECT g.series, g.band, g.window_start, s.ts, s.x FROM starts g LEFT JOIN samples s
  ON g.series = s.series AND g.band = s.band AND s.ts >= g.window_start AND s.ts < g.window_start + INTERVAL 2 HOUR""",
        "samples",
        dbl=["x"],
    ),
)
def chunk_windows(spark, sf):
    return signal.chunk_windows(B.samples(spark, sf), 7200, 50.0)


@query(
    "window_info",
    oracle(
        f"""SELECT series, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS number_of_samples, {RATE * 86400!r}::DOUBLE AS samples_per_day,
  {RATE * H!r}::DOUBLE AS sample_per_window, CAST(24 AS BIGINT) AS total_windows,
  CAST(ceil(count(*) / {RATE * H!r}::DOUBLE) AS BIGINT) AS sample_window
FROM samples GROUP BY series, date_trunc('day', ts)""",
        "samples",
        dbl=["samples_per_day", "sample_per_window"],
    ),
)
def window_info(spark, sf):
    return signal.window_info(B.samples(spark, sf), RATE, H)


@query(
    "day_completeness",
    oracle(
        f"""SELECT series, date_trunc('day', ts)::TIMESTAMP AS day, count(nullif(x, 0)) / {RATE * 86400!r}::DOUBLE AS completeness
FROM samples GROUP BY series, date_trunc('day', ts)""",
        "samples",
        dbl=["completeness"],
    ),
)
def day_completeness(spark, sf):
    return signal.day_completeness(B.samples(spark, sf), RATE)


# A wider window than an hour, so that z-scores above the threshold exist.
cte(
    "day_ranked",
    """SELECT series, band, date_trunc('day', ts)::TIMESTAMP AS window_start, ts, x,
  avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd,
  row_number() OVER (PARTITION BY series, band, date_trunc('day', ts) ORDER BY abs(x) DESC, ts) AS rn
FROM samples WHERE x <> 0 WINDOW w AS (PARTITION BY series, band, date_trunc('day', ts))""",
    "samples",
)


@query(
    "drop_max_outlier",
    oracle(
        """SELECT series, band, ts, x, window_start FROM day_ranked
WHERE NOT (rn = 1 AND sd > 0 AND abs((x - m) / nullif(sd, 0)) > 3)""",
        "day_ranked",
        dbl=["x"],
    ),
)
def drop_max_outlier(spark, sf):
    return signal.drop_max_outlier(B.samples(spark, sf), 86400)


@query(
    "drop_outliers",
    oracle(
        """SELECT series, band, ts, x, window_start FROM day_ranked
WHERE NOT (sd > 0 AND abs((x - m) / nullif(sd, 0)) > 3.5)""",
        "day_ranked",
        dbl=["x"],
    ),
)
def drop_outliers(spark, sf):
    return signal.drop_outliers(B.samples(spark, sf), 86400)


@query(
    "return_outliers",
    oracle(
        """SELECT series, band, ts, x, window_start FROM day_ranked
WHERE sd > 0 AND abs((x - m) / nullif(sd, 0)) > 3.5""",
        "day_ranked",
        dbl=["x"],
    ),
)
def return_outliers(spark, sf):
    return signal.drop_outliers(B.samples(spark, sf), 86400, return_outliers=True)


@query(
    "window_metric",
    oracle(
        """SELECT n.series, n.band, n.ts, CASE WHEN n.c / 4e0 >= 0.3 THEN k.v * 2e0 END AS v FROM
  (SELECT series, band, date_trunc('hour', ts) AS ts, count(x) AS c FROM samples GROUP BY ALL) n LEFT JOIN
  (SELECT series, band, h AS ts, quantile_cont(a, 0.5) AS v FROM ranked
   WHERE NOT (sd > 0 AND abs((a - m) / nullif(sd, 0)) > 3.5) GROUP BY ALL) k
  ON n.series = k.series AND n.band = k.band AND n.ts = k.ts""",
        "ranked",
        dbl=["v"],
    ),
)
def window_metric(spark, sf):
    return signal.window_metric(
        B.samples(spark, sf), H, F.median, expected=4, outliers="all", multiplier=2.0
    )


@query("rsam", oracle("SELECT series, band, ts, v FROM rsam", "rsam", dbl=["v"]))
def rsam(spark, sf):
    return signal.rsam(B.samples(spark, sf), H, empty_windows=False)


cte(
    "integral",
    """SELECT series, band, ts, coalesce(sum(area) OVER (PARTITION BY series, band, date_trunc('day', ts) ORDER BY ts, x0), 0) AS x FROM (
  SELECT series, band, ts, x AS x0, coalesce((x + lag(x) OVER d) / 2 * (epoch_us(ts) - epoch_us(lag(ts) OVER d)) / 1e6, 0) AS area
  FROM samples WINDOW d AS (PARTITION BY series, band, date_trunc('day', ts) ORDER BY ts, x))""",
    "samples",
)
cte(
    "integral_mean",
    """SELECT series, band, h AS ts, avg(a) FILTER (NOT (rn = 1 AND sd > 0 AND (a - m) / nullif(sd, 0) > 3)) AS v FROM (
  SELECT series, band, date_trunc('hour', ts) AS h, abs(x) AS a, avg(abs(x)) OVER w AS m, stddev_pop(abs(x)) OVER w AS sd,
    row_number() OVER (PARTITION BY series, band, date_trunc('hour', ts) ORDER BY abs(x) DESC, ts) AS rn
  FROM integral WHERE x <> 0 WINDOW w AS (PARTITION BY series, band, date_trunc('hour', ts))) GROUP BY series, band, h""",
    "integral",
)
cte(
    "dsar",
    f"""SELECT series, metric, ts, v FROM (
  SELECT a.series, 'dsar_f' || a.pos || '-f' || (a.pos + 1) AS metric, a.ts, a.v / nullif(b.v, 0) AS v, a.pos
  FROM (SELECT i.*, list_position({BANDS!r}, band) - 1 AS pos FROM integral_mean i) a
  JOIN (SELECT i.*, list_position({BANDS!r}, band) - 1 AS pos FROM integral_mean i) b
    ON a.series = b.series AND a.ts = b.ts AND b.pos = a.pos + 1)""",
    "integral_mean",
)


@query("integrate", oracle("SELECT series, band, ts, x FROM integral", "integral", dbl=["x"]))
def integrate(spark, sf):
    return signal.integrate(B.samples(spark, sf))


@query("dsar", oracle("SELECT * FROM dsar WHERE v IS NOT NULL", "dsar", dbl=["v"]))
def dsar(spark, sf):
    return signal.dsar(B.samples(spark, sf), H, BANDS).where("v IS NOT NULL")


cte(
    "entropy",
    """SELECT series, h AS ts, CASE WHEN max(e) >= 1 AND sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) = 0
    THEN sum(-y * log2(nullif(y, 0))) END AS v FROM (
  SELECT series, h, sum(a * a) OVER w AS e,
    exp(-0.5e0 * power((a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0), 2)) / (nullif(stddev_pop(a) OVER w, 0) * sqrt(2 * pi())) AS y
  FROM (SELECT series, date_trunc('hour', ts) AS h, abs(x) AS a, avg(abs(x)) OVER q AS m, stddev_pop(abs(x)) OVER q AS sd,
      row_number() OVER (PARTITION BY series, date_trunc('hour', ts) ORDER BY abs(x) DESC, ts) AS rn
    FROM samples WHERE x <> 0 WINDOW q AS (PARTITION BY series, date_trunc('hour', ts)))
  WHERE NOT (rn = 1 AND sd > 0 AND (a - m) / nullif(sd, 0) > 3)
  WINDOW w AS (PARTITION BY series, h)) GROUP BY series, h""",
    "samples",
)


@query("shannon_entropy", oracle("SELECT series, ts, v FROM entropy", "entropy", dbl=["v"]))
def shannon_entropy(spark, sf):
    return signal.shannon_entropy(B.samples(spark, sf), H)


FILTERS = [("slow", 0.0001, 0.001), ("fast", 0.002, 0.006)]
MINUTE = 1 / 60


def _bandpass_sql():
    """Kernels as cosine sums over their spectra, then one weighted sum of neighbours per minute and band."""
    rows = []
    for name, low, high in FILTERS:
        halo = bands.halo_samples(low, high, MINUTE, 1e-6)
        rows.append(f"('{name}', {low!r}::DOUBLE, {high!r}::DOUBLE, {halo}, {bands.kernel_points(halo)})")
    return f"""WITH b AS (SELECT * FROM (VALUES {", ".join(rows)}) t(band, low, high, halo, n)),
minutes AS (SELECT series, date_trunc('minute', ts)::TIMESTAMP AS ts, CAST(epoch(date_trunc('minute', ts)) / 60 AS BIGINT) AS place, avg(x) AS x
  FROM (SELECT 'all' AS series, ts, value AS x FROM events) GROUP BY ALL),
lines AS (SELECT band, halo, n, k, CASE WHEN 2 * k = n THEN 1 ELSE 2 END / sqrt(1 + pow((f * f - low * high) / (f * (high - low)), 8)) AS g
  FROM (SELECT *, k * {MINUTE!r}::DOUBLE / n AS f FROM (SELECT *, unnest(generate_series(1, n // 2)) AS k FROM b))),
raw AS (SELECT band, halo, j, sum(g * cos(2 * pi() * ((j * k) % n) / n)) / any_value(n) AS w
  FROM lines JOIN (SELECT band AS jb, unnest(generate_series(0, halo)) AS j FROM b) ON jb = band GROUP BY band, halo, j),
kernel AS (SELECT band, halo, j, w - sum(CASE WHEN j = 0 THEN w ELSE 2 * w END) OVER (PARTITION BY band) / (2 * halo + 1) AS w FROM raw),
pairs AS (SELECT a.series, a.ts, a.place - c.place AS d, c.x FROM minutes a JOIN minutes c ON a.series = c.series
  AND c.place BETWEEN a.place - (SELECT max(halo) FROM b) AND a.place + (SELECT max(halo) FROM b)),
sums AS (SELECT series, band, ts, sum(w * x) AS v FROM pairs JOIN kernel ON j = abs(d) GROUP BY series, band, ts)
SELECT m.series, b.band, m.ts, CASE WHEN m.x IS NOT NULL THEN coalesce(v, 0) END AS x
FROM minutes m CROSS JOIN b LEFT JOIN sums s ON s.series = m.series AND s.ts = m.ts AND s.band = b.band"""


@query("bandpass", oracle(_bandpass_sql(), dbl=["x"]))
def bandpass(spark, sf):
    """Minute means of all samples filtered into two bands."""
    minutes = (
        B.samples(spark, sf)
        .groupBy("series", F.date_trunc("minute", "ts").alias("ts"))
        .agg(F.avg("x").alias("x"))
    )
    return signal.bandpass(minutes, FILTERS, MINUTE)


def _dft_sql():
    out = []
    for name, a, b in DFT_BANDS:
        parts = " + ".join(
            f"(sum(v * cos(pos * {2 * math.pi * k / 24!r})) ** 2 + sum(v * sin(pos * {2 * math.pi * k / 24!r})) ** 2) / 24e0"
            for k in range(a, b + 1)
        )
        out.append(
            f"SELECT series, metric, day, '{name}' AS band, {parts} AS energy FROM "
            "(SELECT *, date_trunc('day', ts)::TIMESTAMP AS day, hour(ts) AS pos FROM tremor) GROUP BY series, metric, day"
        )
    return "\nUNION ALL ".join(out)


DFT_BANDS = [("slow", 1, 3), ("mid", 4, 7), ("fast", 8, 12)]


@query("band_energy_dft", oracle(_dft_sql(), "tremor", dbl=["energy"]))
def band_energy_dft(spark, sf):
    return signal.band_energy_dft(filled_rsam(B.samples(spark, sf), H, BANDS), DFT_BANDS, 24, H)


ALL_METRICS = signal.metric_names(BANDS, ["rsam", "dsar", "entropy"])
cte(
    "full_wide",
    f"""SELECT h.series, h.ts, {", ".join(f"max(CASE WHEN metric = '{m}' THEN v END) AS " + chr(34) + m + chr(34) for m in ALL_METRICS)}
FROM hours h LEFT JOIN (
  SELECT series, metric, ts, v FROM (SELECT series, {BAND_CASE} AS metric, ts, v FROM rsam)
  UNION ALL SELECT series, metric, ts, v FROM dsar
  UNION ALL SELECT series, 'entropy', ts, v FROM entropy) m ON h.series = m.series AND h.ts = m.ts
GROUP BY h.series, h.ts""",
    "hours",
    "rsam",
    "dsar",
    "entropy",
)


@query("tremor_table", oracle("SELECT * FROM full_wide", "full_wide", dbl=ALL_METRICS))
def tremor_table(spark, sf):
    return signal.tremor_table(B.samples(spark, sf), H, BANDS)


@query(
    "drop_incomplete_days",
    oracle(
        """SELECT w.* FROM wide w JOIN (
  SELECT series, date_trunc('day', ts) AS d FROM wide GROUP BY series, d
  HAVING count(coalesce(rsam_f0, rsam_f1, rsam_f2, rsam_f3, rsam_f4)) > 0
    AND (24e0 - count(*) FILTER (coalesce(rsam_f0, rsam_f1, rsam_f2, rsam_f3, rsam_f4) IS NULL)) / 24e0 >= 0.98) g
  ON w.series = g.series AND date_trunc('day', w.ts) = g.d""",
        "wide",
        dbl=B.RSAM_METRICS,
    ),
)
def drop_incomplete_days(spark, sf):
    return signal.drop_incomplete_days(rsam_wide(spark, sf), H, 0.98)


@query(
    "robust_anomalies",
    oracle(
        """WITH med AS (SELECT series, metric, quantile_cont(v, 0.5) AS m FROM cells GROUP BY ALL),
dev AS (SELECT c.series, c.metric, c.ts, c.v, abs(c.v - m) AS d FROM cells c JOIN med ON c.series = med.series AND c.metric = med.metric),
mad AS (SELECT series, metric, quantile_cont(d, 0.5) AS mad FROM dev GROUP BY ALL)
SELECT dev.series, dev.metric, dev.ts, CASE WHEN coalesce(0.6745e0 * d / nullif(mad, 0) > 2, FALSE) THEN NULL ELSE v END AS v
FROM dev JOIN mad ON dev.series = mad.series AND dev.metric = mad.metric""",
        "cells",
        dbl=["v"],
    ),
)
def robust_anomalies(spark, sf):
    return gaps.robust_anomalies(long_cells(spark, sf), 2.0)


@query("interpolate_time", oracle(FILL.format(src="cells", lead="v1"), "cells", dbl=["v"]))
def interpolate_time(spark, sf):
    return gaps.interpolate_time(long_cells(spark, sf), both=True)


@query(
    "interpolate_linear",
    oracle(
        """SELECT series, metric, ts, coalesce(v, CASE WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
    ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END) AS v FROM (
  SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS p0,
    first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1
  FROM (SELECT *, row_number() OVER (PARTITION BY series, metric ORDER BY ts) AS pos FROM cells) WINDOW
    p AS (PARTITION BY series, metric ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY series, metric ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        "cells",
        dbl=["v"],
    ),
)
def interpolate_linear(spark, sf):
    return gaps.interpolate_linear(long_cells(spark, sf))


ROLL = """SELECT series, metric, ts, v, {agg} OVER (PARTITION BY series, metric ORDER BY ts
  RANGE BETWEEN INTERVAL 10799999999 MICROSECOND PRECEDING AND INTERVAL 3 HOUR FOLLOWING) AS stat FROM cells"""


@query("rolling_mean", oracle(ROLL.format(agg="avg(v)"), "cells", dbl=["v", "stat"]))
def rolling_mean(spark, sf):
    return gaps.rolling_stat(long_cells(spark, sf), 6 * 3600, "mean")


@query("rolling_median", oracle(ROLL.format(agg="quantile_cont(v, 0.5)"), "cells", dbl=["v", "stat"]))
def rolling_median(spark, sf):
    return gaps.rolling_stat(long_cells(spark, sf), 6 * 3600, "median")
