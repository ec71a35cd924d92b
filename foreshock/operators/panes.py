"""Overlapping look-backs from shared panes.

A look-back of the width of W label steps is W panes, and neighbouring look-backs
share all but one of them.  So a tremor row is reduced once, to the state of its
pane: counts, sums, central moments, extremes and, only if an order statistic is
wanted, its values.  States are mergeable.  Within a block of the calendar the
states of all windows come from two running merges per W panes, one from each
end: a window is the merge of one state of either.  Nothing is multiplied by the
number of windows that hold it; a pane is copied only to the blocks that it
reaches, 1 + 1 / BLOCK times on average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.expr import SECONDS_PER_DAY
from foreshock.operators.features.arrays import feature_rows, features_of_arrays
from foreshock.operators.features.rows import LSD_R, QUANTILES, SIGMA_R, SYMMETRY_R, calculator_of

#: Widths of a look-back that one block of the calendar holds.
BLOCK = 4
#: State of a pane: rows, values, sum, sum of squares, mean, central sums of powers 2 to 4, extremes.
STATE = ["n", "c", "s", "q", "m", "m2", "m3", "m4", "lo", "hi"]

ORDERED = ("median", "quantile", "symmetry_looking", "ratio_beyond_r_sigma")

State = dict[str, np.ndarray]


def grid_steps(days: float, step_s: int) -> int:
    """Panes of one look-back; the step has to divide it."""
    width_s = int(days * SECONDS_PER_DAY)
    if width_s <= 0:
        raise ValueError("the look-back must be positive")
    if step_s <= 0 or width_s % step_s:
        raise ValueError("the label step must divide the look-back")
    return width_s // step_s


def pane_states(tremor: DataFrame, step_s: int, ordered: bool = True) -> DataFrame:
    """``(series, metric, pane, state..., values)``: one row per pane with rows; panes count steps from the epoch.

    ``values`` are the pane's values, bounded by the step, or NULL unless ``ordered``.
    """
    v, c = F.col("v"), F.count("v")
    var = F.var_pop("v")
    third = F.coalesce(F.when(var > 0, F.skewness("v")), F.lit(0.0)) * c * F.pow(var, 1.5)
    fourth = F.coalesce(F.when(var > 0, F.kurtosis("v") + 3), F.lit(0.0)) * c * var * var
    pane = F.floor(F.unix_micros("ts") / F.lit(step_s * 1_000_000)).cast("long")
    return tremor.groupBy("series", "metric", pane.alias("pane")).agg(
        F.count(F.lit(1)).alias("n"),
        c.alias("c"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("m"),
        F.coalesce(var * c, F.lit(0.0)).alias("m2"),
        F.coalesce(third, F.lit(0.0)).alias("m3"),
        F.coalesce(fourth, F.lit(0.0)).alias("m4"),
        F.coalesce(F.min(v), F.lit(float("inf"))).alias("lo"),
        F.coalesce(F.max(v), F.lit(float("-inf"))).alias("hi"),
        (F.collect_list(v) if ordered else F.lit(None).cast("array<double>")).alias("values"),
    )


def merge(a: State, b: State) -> State:
    """State of the rows of both."""
    na, nb = a["c"], b["c"]
    n = na + nb
    safe = np.maximum(n, 1)
    d = b["m"] - a["m"]
    d = np.where((na > 0) & (nb > 0), d, 0.0)
    share = d / safe
    m2 = a["m2"] + b["m2"] + d * share * na * nb
    m3 = a["m3"] + b["m3"] + d * share * share * na * nb * (na - nb) + 3 * share * (na * b["m2"] - nb * a["m2"])
    m4 = (
        a["m4"] + b["m4"] + d * share**3 * na * nb * (na * na - na * nb + nb * nb)
        + 6 * share**2 * (na * na * b["m2"] + nb * nb * a["m2"]) + 4 * share * (na * b["m3"] - nb * a["m3"])
    )
    m = np.where(na == 0, b["m"], np.where(nb == 0, a["m"], a["m"] + share * nb))
    return {
        "n": a["n"] + b["n"], "c": n, "s": a["s"] + b["s"], "q": a["q"] + b["q"], "m": m, "m2": m2, "m3": m3, "m4": m4,
        "lo": np.minimum(a["lo"], b["lo"]), "hi": np.maximum(a["hi"], b["hi"]),
    }


def empty_states(shape: tuple[int, ...]) -> State:
    out = {k: np.zeros(shape) for k in STATE}
    out["lo"] += np.inf
    out["hi"] -= np.inf
    return out


def sliding(states: State, width: int) -> State:
    """State of every window of ``width`` consecutive panes along the last axis, whose length is a multiple of it."""
    *lead, n = states["n"].shape
    shape = (*lead, n // width, width)
    cells = {k: v.reshape(shape) for k, v in states.items()}
    ahead, back = ({k: np.empty(shape) for k in STATE} for _ in range(2))
    for out, order in ((ahead, range(width)), (back, range(width - 1, -1, -1))):
        so_far: State | None = None
        for i in order:
            here = {k: v[..., i] for k, v in cells.items()}
            so_far = here if so_far is None else merge(so_far, here) if out is ahead else merge(here, so_far)
            for k in STATE:
                out[k][..., i] = so_far[k]
    ahead, back = ({k: v.reshape(*lead, n) for k, v in x.items()} for x in (ahead, back))
    start = np.arange(n - width + 1)
    whole = start % width == 0
    joined = merge({k: v[..., start] for k, v in back.items()}, {k: v[..., start + width - 1] for k, v in ahead.items()})
    return {k: np.where(whole, ahead[k][..., start + width - 1], joined[k]) for k in STATE}


def _sorted_windows(values: list[np.ndarray], first: np.ndarray, width: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(windows, their sorted values) for windows with as many values; ``values`` by pane."""
    size = np.array([len(v) for v in values])
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate([*values, np.zeros(0)])
    start, count = at[first], at[first + width] - at[first]
    for k in np.unique(count[count > 0]):
        rows = np.flatnonzero(count == k)
        for a in range(0, len(rows), max(1, 1_000_000 // int(k))):
            some = rows[a : a + max(1, 1_000_000 // int(k))]
            yield some, np.sort(flat[start[some][:, None] + np.arange(k)], axis=1)


def _quantile(x: np.ndarray, q: float) -> np.ndarray:
    h = (x.shape[1] - 1) * q
    low = int(np.floor(h))
    return x[:, low] + (x[:, min(low + 1, x.shape[1] - 1)] - x[:, low]) * (h - low)


def moment_columns(w: State, ordered: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The calculators of the moments family, from window states and what needed the values."""
    with np.errstate(divide="ignore", invalid="ignore"):
        c = w["c"]
        held = c > 0
        flat = w["lo"] == w["hi"]
        mean = np.where(flat, w["lo"], w["m"])
        m2, m3, m4 = (np.where(flat, 0.0, w[k]) for k in ("m2", "m3", "m4"))
        var = m2 / c
        sd = np.sqrt(var)
        spread = w["hi"] - w["lo"]
        g1 = (m3 / c) / var**1.5 * np.sqrt(c * (c - 1)) / (c - 2)
        g2 = (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * (m4 * c / (m2 * m2) - 3) + 6)
        out = {
            "sum_values": w["s"],
            "mean": mean,
            "maximum": w["hi"],
            "minimum": w["lo"],
            "length": c,
            "abs_energy": w["q"],
            "absolute_maximum": np.maximum(np.abs(w["lo"]), np.abs(w["hi"])),
            "root_mean_square": np.sqrt(w["q"] / c),
            "variance": var,
            "standard_deviation": sd,
            "variation_coefficient": np.where(mean != 0, sd / mean, np.nan),
            "variance_larger_than_standard_deviation": np.where(var > sd, 1.0, 0.0),
            "skewness": np.where(c > 2, np.where(sd > 0, g1, 0.0), np.nan),
            "kurtosis": np.where(c > 3, np.where(sd > 0, g2, 0.0), np.nan),
        }
        for r in LSD_R:
            out[f"large_standard_deviation__r_{r}"] = np.where(sd > r * spread, 1.0, 0.0)
        flags = {"variance_larger_than_standard_deviation", "large_standard_deviation", "length"}
        out = {k: v if calculator_of(k) in flags else np.where(held, v, np.nan) for k, v in out.items()}
        out |= ordered
        for r in SYMMETRY_R if "median" in ordered else ():
            out[f"symmetry_looking__r_{r}"] = np.where(np.abs(mean - ordered["median"]) < r * spread, 1.0, 0.0)
    return out


def moment_names() -> list[str]:
    one = {k: np.ones(1) for k in STATE}
    held = {k: np.ones(1) for k in _ordered_names()}
    return list(moment_columns(one, held))


def _ordered_names() -> list[str]:
    return ["median", *[f"ratio_beyond_r_sigma__r_{r}" for r in SIGMA_R], *[f"quantile__q_{q}" for q in QUANTILES]]


def _ordered(values: list[np.ndarray], first: np.ndarray, width: int, w: State) -> dict[str, np.ndarray]:
    out = {k: np.full(len(first), np.nan) for k in _ordered_names()}
    for r in SIGMA_R:
        out[f"ratio_beyond_r_sigma__r_{r}"][w["n"] > 0] = 0.0
    for rows, x in _sorted_windows(values, first, width):
        out["median"][rows] = _quantile(x, 0.5)
        for q in QUANTILES:
            out[f"quantile__q_{q}"][rows] = _quantile(x, q)
        flat = x[:, 0] == x[:, -1]
        mean = np.where(flat, x[:, 0], w["m"][rows])
        sd = np.where(flat, 0.0, np.sqrt(w["m2"][rows] / x.shape[1]))
        far = np.abs(x - mean[:, None])
        for r in SIGMA_R:
            out[f"ratio_beyond_r_sigma__r_{r}"][rows] = (far > r * sd[:, None]).sum(1) / w["n"][rows]
    return out


def _in_blocks(panes: DataFrame, width: int) -> DataFrame:
    """Panes beside the blocks of label ends that look back on them."""
    size = BLOCK * width
    first, last = F.floor((F.col("pane") + 1) / size), F.floor((F.col("pane") + width) / size)
    return panes.withColumn("block", F.explode(F.sequence(first, last)))


def _ends(labels: DataFrame, step_s: int, width: int) -> DataFrame:
    """Labels with the pane they end before and its block; an end between two steps is an error."""
    micros, step = F.unix_micros("ts"), F.lit(step_s * 1_000_000)
    off = F.raise_error(F.lit("labels have to lie on multiples of the step")).cast("long")
    end = F.when(micros % step == 0, F.floor(micros / step).cast("long")).otherwise(off)
    return labels.select("series", "id", end.alias("end")).withColumn("block", F.floor(F.col("end") / (BLOCK * width)))


def _nothing(values: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("series", "id", "metric", values)})


def pane_features(
    tremor: DataFrame,
    labels: DataFrame,
    days: float,
    step_s: int,
    period_s: float,
    min_ratio: float = 1.0,
    wanted: Callable[[str], bool] = lambda name: True,
) -> DataFrame:
    """Moment, extreme and order features of the look-backs, as ``(series, id, feature, value)``.

    Equal to the moments family over ``lookback_matrix``: ``labels`` lie on
    multiples of ``step_s`` from the epoch, look back over [end - days, end), and
    windows with less than ``min_ratio`` of their rows are left out.  A feature is
    NULL where the window has no value.
    """
    width = grid_steps(days, step_s)
    names = [n for n in moment_names() if wanted(n)]
    if not names:
        raise ValueError("no calculator left to compute")
    expected = days * SECONDS_PER_DAY / period_s
    with_values = any(calculator_of(n) in ORDERED for n in names)

    def block(panes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(panes) and len(ends):
            base = int(ends["block"].iloc[0]) * BLOCK * width - width
            length = (BLOCK + 1) * width
            metrics = sorted(panes["metric"].unique())
            number = {m: i for i, m in enumerate(metrics)}
            row, at = panes["metric"].map(number).to_numpy(), (panes["pane"] - base).to_numpy()
            states = empty_states((len(metrics), length))
            for k in STATE:
                states[k][row, at] = panes[k].to_numpy()
            windows = sliding(states, width)
            first = (ends["end"] - width - base).to_numpy()
            for i, metric in enumerate(metrics):
                w = {k: v[i, first] for k, v in windows.items()}
                ordered: dict[str, np.ndarray] = {}
                if with_values:
                    values = [np.zeros(0)] * length
                    mine = row == i
                    for p, v in zip(at[mine], panes["values"].to_numpy()[mine], strict=True):
                        values[p] = np.asarray(v, float)
                    ordered = _ordered(values, first, width, w)
                columns = moment_columns(w, ordered)
                keep = (w["n"] > 0) & (w["n"] / expected >= min_ratio)
                cells = np.stack([columns[n] for n in names], axis=1)[keep]
                out.append(pd.DataFrame({"series": ends["series"][keep].to_numpy(), "id": ends["id"][keep].to_numpy(), "metric": metric, "_f": pd.Series(list(cells), dtype=object)}))
        return pd.concat(out) if out else _nothing("_f")

    panes = _in_blocks(pane_states(tremor, step_s, with_values), width)
    ends = _ends(labels, step_s, width)
    id_type = labels.schema["id"].dataType.simpleString()
    made = panes.groupBy("series", "block").cogroup(ends.groupBy("series", "block")).applyInPandas(block, f"series string, id {id_type}, metric string, _f array<double>")
    return feature_rows(made, names)


def pane_arrays(tremor: DataFrame, labels: DataFrame, days: float, step_s: int, period_s: float, min_ratio: float = 1.0) -> DataFrame:
    """``(series, id, metric, v)``: the values of every look-back in time order, built inside its block.

    The rows reach their block once, not once per look-back; instants of one
    metric are distinct.  Missing values stay NaN.
    """
    width = grid_steps(days, step_s)
    expected = days * SECONDS_PER_DAY / period_s

    def block(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        out = []
        for metric, mine in rows.groupby("metric"):
            mine = mine.sort_values("us")
            us, v = mine["us"].to_numpy(), mine["v"].to_numpy(float)
            last = np.searchsorted(us, ends["end"].to_numpy() * step_s * 1_000_000)
            first = np.searchsorted(us, (ends["end"].to_numpy() - width) * step_s * 1_000_000)
            keep = (last > first) & ((last - first) / expected >= min_ratio)
            cells = [v[a:b] for a, b in zip(first[keep], last[keep], strict=True)]
            out.append(pd.DataFrame({"series": ends["series"][keep].to_numpy(), "id": ends["id"][keep].to_numpy(), "metric": metric, "v": pd.Series(cells, dtype=object)}))
        return pd.concat(out) if out else _nothing("v")

    us = F.unix_micros("ts")
    rows = tremor.select("series", "metric", us.alias("us"), "v", F.floor(us / F.lit(step_s * 1_000_000)).cast("long").alias("pane"))
    id_type = labels.schema["id"].dataType.simpleString()
    groups = _in_blocks(rows, width).groupBy("series", "block").cogroup(_ends(labels, step_s, width).groupBy("series", "block"))
    return groups.applyInPandas(block, f"series string, id {id_type}, metric string, v array<double>")


def grid_features(
    tremor: DataFrame, labels: DataFrame, days: float, step_s: int, period_s: float, families: Sequence[str], min_ratio: float = 1.0
) -> DataFrame:
    """Features of the slice families (``features.arrays``) of all look-backs, without multiplied rows."""
    return features_of_arrays(pane_arrays(tremor, labels, days, step_s, period_s, min_ratio), lambda n: True, families)
