"""Queries for window features, one per calculator family, and for feature tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foreshock import bindings as B
from foreshock.catalog.base import BAND_CASE, FILL, cte, oracle, query
from foreshock.catalog.label_matrix import STEP_S, labels, matrix, tremor
from foreshock.operators import labels as L
from foreshock.operators import lookback, panes
from foreshock.operators.features import arrays, extract, rows, tables
from foreshock.plans.tremor import filled_rsam

CORRIDOR_SQL = ", ".join(f"quantile_cont(v, {q}) OVER g AS q{int(q * 100)}" for q in rows.CORRIDOR)
NEXT_SQL = ", ".join(f"lead(v, {i}) OVER o AS next{i}" for i in range(1, 7))
PEAK_SQL = ", ".join(
    f"max(v) OVER (PARTITION BY series, id, metric ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS peak_l{k}, "
    f"max(v) OVER (PARTITION BY series, id, metric ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) AS peak_r{k}"
    for k in rows.PEAKS
)
cte("whole_slices", "SELECT * FROM slices WHERE n = 48", "slices")
cte(
    "fx",
    f"""SELECT *, next1 - v AS d, (epoch_us(ts) - epoch_us(t0)) / 3.6e9 AS hours FROM (
  SELECT *, avg(v) OVER g AS m, stddev_pop(v) OVER g AS sd, min(v) OVER g AS mn, max(v) OVER g AS mx, min(ts) OVER g AS t0,
    {CORRIDOR_SQL}, {NEXT_SQL}, {PEAK_SQL}, sum(abs(v)) OVER g AS mass, sum(abs(v)) OVER o AS run_mass,
    row_number() OVER (PARTITION BY series, id, metric ORDER BY abs(v) DESC, pos) AS mag_rank
  FROM whole_slices WINDOW g AS (PARTITION BY series, id, metric), o AS (PARTITION BY series, id, metric ORDER BY pos))""",
    "whole_slices",
)


def unpivot(source: str, exprs: dict[str, str]) -> str:
    cells = ",\n  ".join(
        "{'calc': '" + n.replace("'", "''") + f"', 'value': CAST({e} AS DOUBLE)" + "}" for n, e in exprs.items()
    )
    return (
        "SELECT series, id, metric || '__' || u.calc AS feature, u.value AS value FROM (\n"
        f"SELECT series, id, metric, unnest([\n  {cells}]) AS u FROM {source} GROUP BY series, id, metric)"
    )


def share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)"


def count(c: str) -> str:
    return f"sum(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)"


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1 ELSE 0 END"


def moments_sql():
    m, sd, spread = "avg(v)", "stddev_pop(v)", "(max(v) - min(v))"
    out = {
        "sum_values": "sum(v)", "mean": m, "maximum": "max(v)", "minimum": "min(v)", "median": "quantile_cont(v, 0.5)",
        "length": "count(*)", "abs_energy": "sum(v * v)", "absolute_maximum": "max(abs(v))",
        "root_mean_square": "sqrt(avg(v * v))", "variance": "var_pop(v)", "standard_deviation": sd,
        "variation_coefficient": f"{sd} / nullif({m}, 0)",
        "variance_larger_than_standard_deviation": flag(f"var_pop(v) > {sd}"),
        "skewness": f"CASE WHEN {sd} > 0 THEN sqrt(count(*) * (count(*) - 1)) / (count(*) - 2) * avg(power(v - m, 3)) / power({sd}, 3) ELSE 0 END",
        "kurtosis": f"CASE WHEN {sd} > 0 THEN (count(*) - 1) / ((count(*) - 2) * (count(*) - 3)) * ((count(*) + 1) * (avg(power(v - m, 4)) / power({sd}, 4) - 3) + 6) ELSE 0 END",
    }
    for r in rows.LSD_R:
        out[f"large_standard_deviation__r_{r}"] = flag(f"{sd} > {r} * {spread}")
    for r in rows.SYMMETRY_R:
        out[f"symmetry_looking__r_{r}"] = flag(f"abs({m} - quantile_cont(v, 0.5)) < {r} * {spread}")
    for r in rows.SIGMA_R:
        out[f"ratio_beyond_r_sigma__r_{r}"] = share(f"abs(v - m) > {float(r)} * sd")
    for q in rows.QUANTILES:
        out[f"quantile__q_{q}"] = f"quantile_cont(v, {q})"
    return out


def changes_sql():
    out = {
        "mean_abs_change": "avg(abs(d))",
        "mean_change": "(arg_max(v, pos) - arg_min(v, pos)) / (max(n) - 1)",
        "absolute_sum_of_changes": "sum(abs(d))",
        "mean_second_derivative_central": "(max(v) FILTER (pos = n - 1) - max(v) FILTER (pos = n - 2) - max(v) FILTER (pos = 1) + max(v) FILTER (pos = 0)) / (2e0 * (max(n) - 2))",
        "cid_ce__normalize_False": "sqrt(sum(d * d))",
        "cid_ce__normalize_True": "CASE WHEN max(sd) > 0 THEN sqrt(sum(d * d)) / max(sd) ELSE 0 END",
    }
    for lag in (1, 2, 3):
        out[f"c3__lag_{lag}"] = f"avg(v * next{lag} * next{2 * lag})"
        out[f"time_reversal_asymmetry_statistic__lag_{lag}"] = (
            f"avg(next{2 * lag} * next{2 * lag} * next{lag} - next{lag} * v * v)"
        )
    for i, ql in enumerate(rows.CORRIDOR):
        for qh in rows.CORRIDOR[i + 1 :]:
            lo, hi = f"q{int(ql * 100)}", f"q{int(qh * 100)}"
            inside = f"v >= {lo} AND v <= {hi} AND next1 >= {lo} AND next1 <= {hi}"
            for is_abs in (False, True):
                for agg, fn in (("mean", "avg"), ("var", "var_pop")):
                    name = f'change_quantiles__f_agg_"{agg}"__isabs_{is_abs}__qh_{qh}__ql_{ql}'
                    out[name] = f"coalesce({fn}({'abs(d)' if is_abs else 'd'}) FILTER ({inside}), 0)"
    return out


def trends_sql():
    out = {}
    for calc, x in (("linear_trend", "pos"), ("linear_trend_timewise", "hours")):
        out[f'{calc}__attr_"slope"'] = f"regr_slope(v, {x})"
        out[f'{calc}__attr_"intercept"'] = f"regr_intercept(v, {x})"
        out[f'{calc}__attr_"rvalue"'] = f"corr(v, {x})"
        out[f'{calc}__attr_"stderr"'] = (
            f"sqrt((regr_syy(v, {x}) - regr_slope(v, {x}) * regr_sxy(v, {x})) / regr_sxx(v, {x}) / (count(*) - 2))"
        )
    return out


def counts_sql():
    out = {
        "count_above__t_0": share("v >= 0"), "count_below__t_0": share("v <= 0"),
        "count_above_mean": count("v > m"), "count_below_mean": count("v < m"),
    }
    for a, b in rows.RANGES:
        out[f"range_count__max_{b}__min_{a}"] = count(f"v >= {a} AND v < {b}")
    for x in rows.VALUE_COUNTS:
        out[f"value_count__value_{x}"] = count(f"v = {x}")
    for m0 in rows.CROSSINGS:
        out[f"number_crossing_m__m_{m0}"] = count(f"(v > {m0}) <> (next1 > {m0})")
    out["number_crossing_m__m_mean"] = count("(v > m) <> (next1 > m)")
    for k in rows.PEAKS:
        out[f"number_peaks__n_{k}"] = count(f"pos >= {k} AND pos <= n - 1 - {k} AND v > peak_l{k} AND v > peak_r{k}")
    return out


def locations_sql():
    out = {
        "first_location_of_maximum": "min(pos) FILTER (v = mx) / max(n)",
        "last_location_of_maximum": "(max(pos) FILTER (v = mx) + 1) / max(n)",
        "first_location_of_minimum": "min(pos) FILTER (v = mn) / max(n)",
        "last_location_of_minimum": "(max(pos) FILTER (v = mn) + 1) / max(n)",
        "has_duplicate_max": flag("count(*) FILTER (v = mx) > 1"),
        "has_duplicate_min": flag("count(*) FILTER (v = mn) > 1"),
        "mean_n_absolute_max__number_of_maxima_7": "avg(abs(v)) FILTER (mag_rank <= 7)",
    }
    for q in rows.QUANTILES:
        out[f"index_mass_quantile__q_{q}"] = f"min(pos + 1) FILTER (run_mass >= {q} * mass) / max(n)"
    for k in range(10):
        # 48 rows in 10 parts: eight of 5, then two of 4.
        lo, hi = (5 * k, 5 * k + 5) if k < 8 else (40 + 4 * (k - 8), 44 + 4 * (k - 8))
        out[f"energy_ratio_by_chunks__num_segments_10__segment_focus_{k}"] = (
            f"coalesce(sum(v * v) FILTER (pos >= {lo} AND pos < {hi}), 0) / nullif(sum(v * v), 0)"
        )
    return out


def _rows_query(family, exprs):
    @query(f"features_{family}", oracle(unpivot("fx", exprs), "fx", dbl=["value"]))
    def run(spark, sf):
        return extract.extract_features(matrix(spark, sf), exclude=(), families=[family])




@query("features_moments", oracle(unpivot("fx", moments_sql()), "fx", dbl=["value"]))
def features_moments(spark, sf):
    return panes.pane_features(tremor(spark, sf), labels(spark), B.LOOKBACK_DAYS, STEP_S, B.WINDOW_S)


_rows_query("changes", changes_sql())
_rows_query("trends", trends_sql())
_rows_query("counts", counts_sql())
_rows_query("locations", locations_sql())


def _table_query(family, sql):
    @query(f"features_{family}", sql)
    def run(spark, sf):
        return extract.extract_features(matrix(spark, sf), exclude=(), families=[family])


cte(
    "acf",
    """SELECT a.series, a.id, a.metric, l.lag, sum((a.v - a.m) * (b.v - a.m)) / (max(a.n) - l.lag) / nullif(max(a.sd * a.sd), 0) AS r
FROM fx a CROSS JOIN (SELECT unnest(generate_series(0, 40)) AS lag) l
JOIN whole_slices b ON a.series = b.series AND a.id = b.id AND a.metric = b.metric AND b.pos = a.pos + l.lag
GROUP BY a.series, a.id, a.metric, l.lag""",
    "fx",
)
R1, R2 = "max(r) FILTER (lag = 1)", "max(r) FILTER (lag = 2)"
_table_query(
    "autocorrelation",
    oracle(
        unpivot(
            "acf",
            {f"autocorrelation__lag_{k}": f"max(r) FILTER (lag = {k})" for k in tables.AUTOCORR_LAGS}
            | {
                'agg_autocorrelation__f_agg_"mean"__maxlag_40': "avg(r) FILTER (lag >= 1)",
                'agg_autocorrelation__f_agg_"median"__maxlag_40': "quantile_cont(r, 0.5) FILTER (lag >= 1)",
                'agg_autocorrelation__f_agg_"var"__maxlag_40': "var_pop(r) FILTER (lag >= 1)",
                "partial_autocorrelation__lag_0": "1",
                "partial_autocorrelation__lag_1": R1,
                "partial_autocorrelation__lag_2": f"({R2} - {R1} * {R1}) / (1 - {R1} * {R1})",
            },
        ),
        "acf",
        dbl=["value"],
    ),
)


def chunk_trend_sql():
    parts = []
    for length in rows.CHUNK_LENGTHS:
        exprs = {}
        for fn in ("max", "min", "mean", "var"):
            y, stem = f"{fn}_v", f'agg_linear_trend__attr_"%s"__chunk_len_{length}__f_agg_"{fn}"'
            exprs[stem % "slope"] = f"CASE WHEN count(*) > 1 THEN regr_slope({y}, c) END"
            exprs[stem % "intercept"] = f"CASE WHEN count(*) > 1 THEN regr_intercept({y}, c) END"
            exprs[stem % "rvalue"] = f"CASE WHEN count(*) > 1 THEN corr({y}, c) END"
            exprs[stem % "stderr"] = (
                f"CASE WHEN count(*) > 2 THEN sqrt((1 - power(corr({y}, c), 2)) * var_pop({y}) / var_pop(c) / (count(*) - 2)) END"
            )
        parts.append(
            unpivot(
                f"(SELECT series, id, metric, CAST(pos // {length} AS DOUBLE) AS c, max(v) AS max_v, min(v) AS min_v, avg(v) AS mean_v, var_pop(v) AS var_v FROM whole_slices GROUP BY ALL)",
                exprs,
            )
        )
    return "\nUNION ALL\n".join(parts)


_table_query("chunk_trend", oracle(chunk_trend_sql(), "whole_slices", dbl=["value"]))
_table_query(
    "repeats",
    oracle(
        unpivot(
            "(SELECT series, id, metric, v, count(*) AS c FROM whole_slices GROUP BY ALL)",
            {
                "has_duplicate": "max(CASE WHEN c > 1 THEN 1 ELSE 0 END)",
                "percentage_of_reoccurring_datapoints_to_all_datapoints": "coalesce(sum(c) FILTER (c > 1), 0) / sum(c)",
                "percentage_of_reoccurring_values_to_all_values": "count(*) FILTER (c > 1) / count(*)",
                "sum_of_reoccurring_data_points": "coalesce(sum(v * c) FILTER (c > 1), 0)",
                "sum_of_reoccurring_values": "coalesce(sum(v) FILTER (c > 1), 0)",
                "ratio_value_number_to_time_series_length": "count(*) / sum(c)",
            },
        ),
        "whole_slices",
        dbl=["value"],
    ),
)


def runs_sql():
    parts = []
    for side, op in (("above", ">"), ("below", "<")):
        parts.append(
            unpivot(
                f"""(SELECT series, id, metric, g, count(*) FILTER (hit) AS run FROM (
    SELECT series, id, metric, v {op} m AS hit, pos - sum(CASE WHEN v {op} m THEN 1 ELSE 0 END) OVER (PARTITION BY series, id, metric ORDER BY pos) AS g FROM fx)
  GROUP BY ALL)""",
                {f"longest_strike_{side}_mean": "max(run)"},
            )
        )
    return "\nUNION ALL\n".join(parts)


_table_query("runs", oracle(runs_sql(), "fx", dbl=["value"]))

ENTROPY = "-sum(c / total * ln(c / total))"


def entropy_of(counts: str) -> str:
    return f"(SELECT *, sum(c) OVER (PARTITION BY series, id, metric) AS total FROM ({counts}))"


_table_query(
    "binned_entropy",
    oracle(
        unpivot(
            entropy_of(
                "SELECT series, id, metric, CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) / (mx - mn) * 10), 9) END AS b, count(*) AS c FROM fx GROUP BY ALL"
            ),
            {"binned_entropy__max_bins_10": ENTROPY},
        ),
        "fx",
        dbl=["value"],
    ),
)


def permutation_sql(sizes):
    parts = []
    for size in sizes:
        xs = ["v"] + [f"next{i}" for i in range(1, size)]
        # Rank of each element among the others, ties by position.
        ranks = " || ".join(
            "(" + " + ".join(
                f"CASE WHEN {xs[j]} < {xs[i]} OR ({xs[j]} = {xs[i]} AND {j} < {i}) THEN 1 ELSE 0 END"
                for j in range(size) if j != i
            ) + ")::VARCHAR"
            for i in range(size)
        )
        parts.append(
            unpivot(
                entropy_of(f"SELECT series, id, metric, {ranks} AS p, count(*) AS c FROM fx WHERE pos <= n - {size} GROUP BY ALL"),
                {f"permutation_entropy__dimension_{size}__tau_1": ENTROPY},
            )
        )
    return "\nUNION ALL\n".join(parts)


_table_query("permutation_entropy", oracle(permutation_sql(arrays.PATTERN_SIZES), "fx", dbl=["value"]))
_table_query("permutation_long", oracle(permutation_sql(arrays.LONG_PATTERNS), "fx", dbl=["value"]))
_table_query(
    "benford",
    oracle(
        unpivot(
            """(SELECT k.series, k.id, k.metric, g.d, count(f.v) / max(k.n) AS s FROM (SELECT series, id, metric, max(n) AS n FROM whole_slices GROUP BY ALL) k
  CROSS JOIN (SELECT unnest(generate_series(1, 9)) AS d) g
  LEFT JOIN whole_slices f ON f.series = k.series AND f.id = k.id AND f.metric = k.metric
    AND floor(abs(f.v) / power(10e0, floor(log10(abs(f.v)))) + 1e-9) = g.d GROUP BY ALL)""",
            {"benford_correlation": "corr(s, log10(1 + 1 / d))"},
        ),
        "whole_slices",
        dbl=["value"],
    ),
)

cte(
    "templates",
    """SELECT series, id, metric, pos, n, 0.2e0 * sd AS r, v AS x0, next1 AS x1, next2 AS x2 FROM fx""",
    "fx",
)
_table_query(
    "match_entropy",
    oracle(
        """WITH pairs AS (SELECT a.series, a.id, a.metric, a.pos, max(a.n) AS n,
    count(*) FILTER (abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r) AS c2,
    count(*) FILTER (abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r AND abs(a.x2 - b.x2) <= a.r) AS c3,
    count(*) FILTER (b.x2 IS NOT NULL AND a.x2 IS NOT NULL AND abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r) AS b2
  FROM templates a JOIN templates b USING (series, id, metric) WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL GROUP BY ALL),
totals AS (SELECT series, id, metric, avg(ln(c2 / (n - 1))) AS phi2, avg(CASE WHEN c3 > 0 THEN ln(c3 / (n - 2)) END) AS phi3,
    sum(b2) - (max(n) - 2) AS b, sum(c3) - (max(n) - 2) AS a FROM pairs GROUP BY ALL)
SELECT series, id, metric || '__approximate_entropy__m_2__r_0.2' AS feature, abs(phi2 - phi3) AS value FROM totals
UNION ALL SELECT series, id, metric || '__sample_entropy', CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END FROM totals""",
        "templates",
        dbl=["value"],
    ),
)

def match_grid_sql():
    near = lambda r, size: " AND ".join(f"abs(a.x{k} - b.x{k}) <= {r} * a.sd" for k in range(size))
    counts = ",\n    ".join(
        f"count(*) FILTER ({near(r, 2)}) AS c2_{i}, count(*) FILTER ({near(r, 3)}) AS c3_{i}" for i, r in enumerate(arrays.TOLERANCES)
    )
    cells = {
        f"approximate_entropy__m_2__r_{r}": f"abs(avg(ln(c2_{i} / (n - 1))) - avg(CASE WHEN c3_{i} > 0 THEN ln(c3_{i} / (n - 2)) END))"
        for i, r in enumerate(arrays.TOLERANCES)
    }
    points = "SELECT series, id, metric, pos, n, sd, v AS x0, next1 AS x1, next2 AS x2 FROM fx"
    pairs = f"""(SELECT a.series, a.id, a.metric, a.pos, max(a.n) AS n, {counts}
  FROM ({points}) a JOIN ({points}) b USING (series, id, metric) WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL GROUP BY ALL)"""
    return unpivot(pairs, cells)


_table_query("match_entropy_grid", oracle(match_grid_sql(), "fx", dbl=["value"]))
# Ridge lines and the longer partial autocorrelations are folds that SQL does not state; tests compare them with plain versions.
_table_query("ridge_peaks", None)
_table_query("partial_long", None)

cte(
    "spec",
    """SELECT *, sqrt(re * re + im * im) AS mag FROM (
  SELECT series, id, metric, k, sum(v * cos(2 * pi() * ((k * pos) % 48) / 48e0)) AS re, -sum(v * sin(2 * pi() * ((k * pos) % 48) / 48e0)) AS im
  FROM whole_slices CROSS JOIN (SELECT unnest(generate_series(0, 24)) AS k) GROUP BY ALL)""",
    "whole_slices",
)


def fft_sql(most=24):
    out = {}
    for k in range(most + 1):
        w = f"FILTER (k = {k})"
        out[f'fft_coefficient__attr_"real"__coeff_{k}'] = f"max(re) {w}"
        out[f'fft_coefficient__attr_"imag"__coeff_{k}'] = f"max(im) {w}"
        out[f'fft_coefficient__attr_"abs"__coeff_{k}'] = f"max(mag) {w}"
        out[f'fft_coefficient__attr_"angle"__coeff_{k}'] = f"max(degrees(atan2(im, re))) FILTER (k = {k} AND mag >= 1e-9)"
    m = [f"(sum(mag * power(k, {p})) / nullif(sum(mag), 0))" for p in range(5)]
    var = f"({m[2]} - {m[1]} * {m[1]})"
    out['fft_aggregated__aggtype_"centroid"'] = m[1]
    out['fft_aggregated__aggtype_"variance"'] = var
    out['fft_aggregated__aggtype_"skew"'] = f"CASE WHEN {var} >= 0.5 THEN ({m[3]} - 3 * {m[1]} * {var} - power({m[1]}, 3)) / power({var}, 1.5) END"
    out['fft_aggregated__aggtype_"kurtosis"'] = (
        f"CASE WHEN {var} >= 0.5 THEN ({m[4]} - 4 * {m[1]} * {m[3]} + 6 * {m[2]} * {m[1]} * {m[1]} - 3 * power({m[1]}, 4)) / ({var} * {var}) END"
    )
    return out


_table_query("fft", oracle(unpivot("spec", fft_sql()), "spec", dbl=["value"]))
cte(
    "psd",
    """SELECT series, id, metric, k, (power(sum(w * (v - m) * cos(2 * pi() * ((k * pos) % 48) / 48e0)), 2) + power(sum(w * (v - m) * sin(2 * pi() * ((k * pos) % 48) / 48e0)), 2))
    * CASE WHEN k = 0 OR k = 24 THEN 1e0 ELSE 2e0 END / sum(w * w) AS density
FROM (SELECT *, 0.5e0 - 0.5e0 * cos(2 * pi() * pos / 48e0) AS w FROM fx) CROSS JOIN (SELECT unnest(generate_series(0, 24)) AS k) GROUP BY series, id, metric, k""",
    "fx",
)


def welch_sql():
    parts = [unpivot("psd", {f"spkt_welch_density__coeff_{c}": f"max(density) FILTER (k = {c})" for c in arrays.WELCH_COEFFS})]
    for bins in arrays.FOURIER_BINS:
        parts.append(
            unpivot(
                entropy_of(
                    f"""SELECT series, id, metric, least(floor(round((density - lo) / nullif(hi - lo, 0) * {bins}, 9)), {bins - 1}) AS b, count(*) AS c
  FROM (SELECT *, min(density) OVER g AS lo, max(density) OVER g AS hi FROM psd WINDOW g AS (PARTITION BY series, id, metric)) GROUP BY ALL"""
                ),
                {f"fourier_entropy__bins_{bins}": ENTROPY},
            )
        )
    return "\nUNION ALL\n".join(parts)


_table_query("welch", oracle(welch_sql(), "psd", dbl=["value"]))


def wavelet_sql(last: int) -> str:
    cols = []
    for w in arrays.CWT_WIDTHS:
        k = min(10 * w, 48)
        off = f"(i + {(k - 1) // 2} - pos)"
        z = f"(power({off} - {(k - 1) / 2!r}, 2) / {float(w * w)!r})"
        scale = 2 / (math.sqrt(3 * w) * math.pi**0.25)
        cols.append(f"coalesce(sum(v * {scale!r}::DOUBLE * (1 - {z}) * exp(-1 * {z} / 2)) FILTER ({off} >= 0 AND {off} < {k}), 0) AS w{w}")
    return f"SELECT series, id, metric, i, {', '.join(cols)} FROM whole_slices CROSS JOIN (SELECT unnest(generate_series(0, {last})) AS i) GROUP BY series, id, metric, i"


WIDTHS = "(2, 5, 10, 20)"
_table_query(
    "cwt",
    oracle(
        unpivot(
            f"({wavelet_sql(14)})",
            {
                f"cwt_coefficients__coeff_{c}__w_{w}__widths_{WIDTHS}": f"max(w{w}) FILTER (i = {c})"
                for w in arrays.CWT_WIDTHS
                for c in range(15)
            },
        ),
        "whole_slices",
        dbl=["value"],
    ),
)
PEAK_TERMS = " + ".join(
    f"CASE WHEN w{w} > lag(w{w}) OVER o AND w{w} > lead(w{w}) OVER o THEN 1 ELSE 0 END" for w in arrays.CWT_WIDTHS
)
_table_query(
    "cwt_peaks",
    oracle(
        unpivot(
            f"(SELECT series, id, metric, {PEAK_TERMS} AS s FROM ({wavelet_sql(47)}) WINDOW o AS (PARTITION BY series, id, metric ORDER BY i))",
            {"number_cwt_peaks__widths_2": "sum(CASE WHEN s >= 2 THEN 1 ELSE 0 END)"},
        ),
        "whole_slices",
        dbl=["value"],
    ),
)


# ---------------------------------------------------------------- a grid of ten minutes

FINE_S = 600
TEN = "time_bucket(INTERVAL 10 MINUTE, ts)"
cte(
    "fine_cells",
    f"""SELECT g.series, g.metric, g.ts, r.v FROM (
  SELECT series, ts, unnest([{", ".join(repr(m) for m in B.RSAM_METRICS)}]) AS metric FROM (
    SELECT series, unnest(generate_series(a, b, INTERVAL 10 MINUTE)) AS ts FROM (
      SELECT series, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) + INTERVAL 1430 MINUTE AS b FROM samples GROUP BY series))) g
LEFT JOIN (
  SELECT series, {BAND_CASE} AS metric, h AS ts, avg(a) AS v FROM (
    SELECT series, band, {TEN} AS h, ts, abs(x) AS a, avg(abs(x)) OVER w AS m, stddev_pop(abs(x)) OVER w AS sd,
      row_number() OVER (PARTITION BY series, band, {TEN} ORDER BY abs(x) DESC, ts) AS rn
    FROM samples WHERE x <> 0 WINDOW w AS (PARTITION BY series, band, {TEN}))
  WHERE NOT (rn = 1 AND sd > 0 AND (a - m) / nullif(sd, 0) > 3) GROUP BY series, band, h) r
ON g.series = r.series AND g.metric = r.metric AND g.ts = r.ts""",
    "samples",
)
cte("fine_tremor", "SELECT series, metric, ts, round(v + 1e-9, 6) AS v FROM (" + FILL.format(src="fine_cells", lead="v1") + ")", "fine_cells")
cte(
    "fine_slices",
    f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series, id, metric ORDER BY ts) - 1 AS BIGINT) AS pos,
  count(*) OVER (PARTITION BY series, id, metric) AS n FROM (
  SELECT y.series, y.id, t.metric, t.ts, t.v FROM y JOIN fine_tremor t ON t.series = y.series
    AND t.ts >= y.ts - INTERVAL {B.LOOKBACK_DAYS} DAY AND t.ts < y.ts)) WHERE n = 288""",
    "y",
    "fine_tremor",
)


def fine_tremor(spark, sf):
    return filled_rsam(B.samples(spark, sf), FINE_S, B.BANDS)


def fine_matrix(spark, sf):
    return lookback.lookback_matrix(fine_tremor(spark, sf), labels(spark), B.LOOKBACK_DAYS, STEP_S, FINE_S)


cte(
    "fine_spec",
    """SELECT *, sqrt(re * re + im * im) AS mag FROM (
  SELECT series, id, metric, k, sum(v * cos(2 * pi() * ((k * pos) % 288) / 288e0)) AS re, -sum(v * sin(2 * pi() * ((k * pos) % 288) / 288e0)) AS im
  FROM fine_slices CROSS JOIN (SELECT unnest(generate_series(0, 144)) AS k) GROUP BY ALL)""",
    "fine_slices",
)


@query("features_fft_long", oracle(unpivot("fine_spec", fft_sql(arrays.FFT_MOST)), "fine_spec", dbl=["value"]))
def features_fft_long(spark, sf):
    """Coefficients 0 to 99 of slices of 288 values."""
    return extract.extract_features(fine_matrix(spark, sf), exclude=(), families=["fft", "fft_high"])


@query("features_default")
def features_default(spark, sf):
    """The whole default set of calculators; every family has a query of its own beside SQL."""
    return extract.extract_features(matrix(spark, sf))


# Labels every ten minutes: neighbouring look-backs share 287 of 288 panes.
PANE_CALCULATORS = ["sum_values", "mean", "maximum", "minimum", "standard_deviation", "skewness", "kurtosis", "median", "quantile", "ratio_beyond_r_sigma"]
cte(
    "dense_y",
    f"""SELECT 'all' AS series, row_number() OVER (ORDER BY ts) - 1 AS id, ts FROM (
  SELECT unnest(generate_series(TIMESTAMP '{B.GRID_START} 00:00:00', TIMESTAMP '{B.GRID_END} 23:59:59', INTERVAL 10 MINUTE)) AS ts)""",
)
cte(
    "dense_slices",
    f"""SELECT * FROM (SELECT *, count(*) OVER g AS n, avg(v) OVER g AS m, stddev_pop(v) OVER g AS sd FROM (
  SELECT y.series, y.id, t.metric, t.v FROM dense_y y JOIN fine_tremor t ON t.series = y.series
    AND t.ts >= y.ts - INTERVAL {B.LOOKBACK_DAYS} DAY AND t.ts < y.ts) WINDOW g AS (PARTITION BY series, id, metric)) WHERE n = 288""",
    "dense_y",
    "fine_tremor",
)


@query(
    "features_panes",
    oracle(
        unpivot("dense_slices", {n: e for n, e in moments_sql().items() if rows.calculator_of(n) in PANE_CALCULATORS}),
        "dense_slices",
        dbl=["value"],
    ),
)
def features_panes(spark, sf):
    """Moments, extremes and order statistics of 48-hour look-backs that end every ten minutes."""
    dense = L.label_grid(spark, B.GRID_START, B.GRID_END, 10, "minutes").select(F.lit("all").alias("series"), "id", "ts")
    return panes.pane_features(
        fine_tremor(spark, sf), dense, B.LOOKBACK_DAYS, FINE_S, FINE_S, wanted=lambda n: rows.calculator_of(n) in PANE_CALCULATORS
    )
