"""Calculators that are one aggregate over a slice and its neighbour columns.

All of them share one shuffle by (series, id, metric): the window columns are
added once, and the single aggregation reuses the same partitioning.  The
calculators are SQL expressions, so only the columns a wanted calculator names
are added at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["series", "id", "metric"]
MAX_LAG = 40

# Parameter grids of the calculators.
LSD_R = [round(0.05 * i, 2) for i in range(1, 20)]
SYMMETRY_R = [round(0.05 * i, 2) for i in range(20)]
QUANTILES = [round(0.1 * i, 1) for i in range(1, 10)]
SIGMA_R = [0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10]
CORRIDOR = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
CROSSINGS = [-1, 0, 1]
PEAKS = [1, 3, 5, 10, 50]
CHUNK_LENGTHS = [5, 10, 50]
RANGES = [(-1, 1), (0, 1000000000000), (-1000000000000, 0)]
VALUE_COUNTS = [-1, 0, 1]
N_ABS_MAX = 7
SEGMENTS = 10

WHOLE = "(partition by series, id, metric)"
ORDER = "(partition by series, id, metric order by pos)"


def _rows(first: str, last: str, order: str = "pos") -> str:
    return f"(partition by series, id, metric order by {order} rows between {first} and {last})"


def window_columns() -> dict[str, str]:
    """Statistics, neighbours and running values of a slice, by column name."""
    cols = {
        "m": f"avg(v) over {WHOLE}",
        "sd": f"stddev_pop(v) over {WHOLE}",
        "mn": f"min(v) over {WHOLE}",
        "mx": f"max(v) over {WHOLE}",
        "t0": f"min(ts) over {WHOLE}",
        "mass": f"sum(abs(v)) over {WHOLE}",
        "run_mass": f"sum(abs(v)) over {_rows('unbounded preceding', 'current row')}",
        "mag_rank": "row_number() over (partition by series, id, metric order by abs(v) desc, pos)",
    }
    for q in CORRIDOR:
        cols[f"q{int(q * 100)}"] = f"percentile(v, {q}) over {WHOLE}"
    for i in range(1, 7):
        cols[f"next{i}"] = f"lead(v, {i}) over {ORDER}"
    for k in PEAKS:
        cols[f"peak_l{k}"] = f"max(v) over {_rows(f'{k} preceding', '1 preceding')}"
        cols[f"peak_r{k}"] = f"max(v) over {_rows('1 following', f'{k} following')}"
    return cols


HOURS = "((unix_micros(ts) - unix_micros(t0)) / 3.6e9D)"
STEP = "(next1 - v)"


def share(cond: str) -> str:
    return f"avg(case when {cond} then 1D else 0D end)"


def count(cond: str) -> str:
    return f"sum(case when {cond} then 1D else 0D end)"


def flag(cond: str) -> str:
    return f"case when {cond} then 1D else 0D end"


def _moments() -> dict[str, str]:
    c, sd, spread, med = "count(v)", "stddev_pop(v)", "(max(v) - min(v))", "percentile(v, 0.5D)"
    g1 = f"skewness(v) * sqrt({c} * ({c} - 1)) / ({c} - 2)"
    g2 = f"({c} - 1) / (({c} - 2) * ({c} - 3)) * (({c} + 1) * kurtosis(v) + 6)"
    out = {
        "sum_values": "sum(v)",
        "mean": "avg(v)",
        "maximum": "max(v)",
        "minimum": "min(v)",
        "median": med,
        "length": f"double({c})",
        "abs_energy": "sum(v * v)",
        "absolute_maximum": "max(abs(v))",
        "root_mean_square": "sqrt(avg(v * v))",
        "variance": "var_pop(v)",
        "standard_deviation": sd,
        "variation_coefficient": f"{sd} / nullif(avg(v), 0D)",
        "variance_larger_than_standard_deviation": flag(f"var_pop(v) > {sd}"),
        "skewness": f"case when {sd} > 0 and {c} > 2 then {g1} when {c} > 2 then 0D end",
        "kurtosis": f"case when {sd} > 0 and {c} > 3 then {g2} when {c} > 3 then 0D end",
    }
    for r in LSD_R:
        out[f"large_standard_deviation__r_{r}"] = flag(f"{sd} > {r}D * {spread}")
    for r in SYMMETRY_R:
        out[f"symmetry_looking__r_{r}"] = flag(f"abs(avg(v) - {med}) < {r}D * {spread}")
    for r in SIGMA_R:
        out[f"ratio_beyond_r_sigma__r_{r}"] = share(f"abs(v - m) > {float(r)}D * sd")
    for q in QUANTILES:
        out[f"quantile__q_{q}"] = f"percentile(v, {q}D)"
    return out


def _changes() -> dict[str, str]:
    def at(position: str) -> str:
        return f"max(case when pos = {position} then v end)"

    curve = f"({at('n - 1')} - {at('n - 2')} - {at('1')} + {at('0')})"
    cid = f"sqrt(sum({STEP} * {STEP}))"
    out = {
        "mean_abs_change": f"avg(abs({STEP}))",
        "mean_change": "(max_by(v, pos) - min_by(v, pos)) / nullif(max(n) - 1, 0)",
        "absolute_sum_of_changes": f"sum(abs({STEP}))",
        "mean_second_derivative_central": f"{curve} / nullif(2D * (max(n) - 2), 0D)",
        "cid_ce__normalize_False": cid,
        "cid_ce__normalize_True": f"case when max(sd) > 0 then {cid} / nullif(max(sd), 0D) else 0D end",
    }
    for lag in (1, 2, 3):
        a, b = f"next{lag}", f"next{2 * lag}"
        out[f"c3__lag_{lag}"] = f"avg(v * {a} * {b})"
        out[f"time_reversal_asymmetry_statistic__lag_{lag}"] = f"avg({b} * {b} * {a} - {a} * v * v)"
    for i, ql in enumerate(CORRIDOR):
        for qh in CORRIDOR[i + 1 :]:
            lo, hi = f"q{int(ql * 100)}", f"q{int(qh * 100)}"
            inside = f"v between {lo} and {hi} and next1 between {lo} and {hi}"
            for is_abs in (False, True):
                step = f"abs({STEP})" if is_abs else STEP
                for agg, fn in (("mean", "avg"), ("var", "var_pop")):
                    name = f'change_quantiles__f_agg_"{agg}"__isabs_{is_abs}__qh_{qh}__ql_{ql}'
                    out[name] = f"coalesce({fn}(case when {inside} then {step} end), 0D)"
    return out


def _trends() -> dict[str, str]:
    out: dict[str, str] = {}
    for calc, x in (("linear_trend", "double(pos)"), ("linear_trend_timewise", HOURS)):
        # Spelled out because corr() divides by zero on a constant slice.
        r = f"(covar_pop(v, {x}) / nullif(stddev_pop(v) * stddev_pop({x}), 0D))"
        out[f'{calc}__attr_"slope"'] = f"regr_slope(v, {x})"
        out[f'{calc}__attr_"intercept"'] = f"regr_intercept(v, {x})"
        out[f'{calc}__attr_"rvalue"'] = r
        out[f'{calc}__attr_"stderr"'] = (
            f"sqrt((1 - {r} * {r}) * var_pop(v) / nullif(var_pop({x}), 0D) / nullif(count(v) - 2, 0))"
        )
    return out


def _counts() -> dict[str, str]:
    out = {
        "count_above__t_0": share("v >= 0"),
        "count_below__t_0": share("v <= 0"),
        "count_above_mean": count("v > m"),
        "count_below_mean": count("v < m"),
        "number_crossing_m__m_mean": count("(v > m) <> (next1 > m)"),
    }
    for a, b in RANGES:
        out[f"range_count__max_{b}__min_{a}"] = count(f"v >= {a} and v < {b}")
    for x in VALUE_COUNTS:
        out[f"value_count__value_{x}"] = count(f"v = {x}")
    for m0 in CROSSINGS:
        out[f"number_crossing_m__m_{m0}"] = count(f"(v > {m0}) <> (next1 > {m0})")
    for k in PEAKS:
        inner = f"pos >= {k} and pos <= n - 1 - {k}"
        out[f"number_peaks__n_{k}"] = count(f"{inner} and v > peak_l{k} and v > peak_r{k}")
    return out


def segment(parts: int) -> str:
    """Part of ``pos`` when ``n`` rows are split into near-equal parts, longer ones first."""
    small = f"floor(n / {parts})"
    longer = f"(n - {small} * {parts})"
    edge = f"({longer} * ({small} + 1))"
    return (
        f"(case when pos < {edge} then floor(pos / ({small} + 1)) "
        f"else {longer} + floor((pos - {edge}) / greatest({small}, 1)) end)"
    )


def _locations() -> dict[str, str]:
    out = {
        "first_location_of_maximum": "min(case when v = mx then pos end) / max(n)",
        "last_location_of_maximum": "(max(case when v = mx then pos end) + 1) / max(n)",
        "first_location_of_minimum": "min(case when v = mn then pos end) / max(n)",
        "last_location_of_minimum": "(max(case when v = mn then pos end) + 1) / max(n)",
        "has_duplicate_max": flag(f"{count('v = mx')} > 1"),
        "has_duplicate_min": flag(f"{count('v = mn')} > 1"),
        f"mean_n_absolute_max__number_of_maxima_{N_ABS_MAX}": (
            f"case when max(n) > {N_ABS_MAX} then avg(case when mag_rank <= {N_ABS_MAX} then abs(v) end) end"
        ),
    }
    for q in QUANTILES:
        out[f"index_mass_quantile__q_{q}"] = f"min(case when run_mass >= {q}D * mass then pos + 1 end) / max(n)"
    for k in range(SEGMENTS):
        out[f"energy_ratio_by_chunks__num_segments_{SEGMENTS}__segment_focus_{k}"] = (
            f"sum(case when {segment(SEGMENTS)} = {k} then v * v else 0D end) / nullif(sum(v * v), 0D)"
        )
    return out


FAMILIES: dict[str, Callable[[], dict[str, str]]] = {
    "moments": _moments,
    "changes": _changes,
    "trends": _trends,
    "counts": _counts,
    "locations": _locations,
}


def calculator_of(name: str) -> str:
    """Calculator part of ``calc__param_value`` (without the metric)."""
    return name.split("__", 1)[0]


def to_long(wide: DataFrame, names: list[str]) -> DataFrame:
    """Unpivot feature columns to (series, id, feature, value)."""
    cells = ", ".join(f"concat(metric, '__{c}'), double(`{c}`)" for c in names)
    return wide.selectExpr("series", "id", f"stack({len(names)}, {cells}) as (feature, value)")


def aggregate_rows(matrix: DataFrame, wanted: Callable[[str], bool]) -> DataFrame | None:
    """All wanted row calculators in one aggregation, long form."""
    aggs = {name: e for build in FAMILIES.values() for name, e in build().items() if wanted(name)}
    if not aggs:
        return None
    used = set(re.findall(r"[a-z_]+\d*", " ".join(aggs.values())))
    windows = [f"{e} as {name}" for name, e in window_columns().items() if name in used]
    prepared = matrix.selectExpr("*", *windows)
    wide = prepared.groupBy(*KEYS).agg(*[F.expr(e).alias(name) for name, e in aggs.items()])
    return to_long(wide, list(aggs))
