"""Many penalised logistic fits as one iterated plan.

Every (series, method, seed, N, fold) of a benchmark or a count sweep is one
fit.  The rows of a series are packed into blocks once.  Each Newton step is one
pass over the blocks that returns the gradient and curvature of all fits, summed
per fit, and a small table of weights; open fits go on, finished ones are left
out.  No fit is a job of its own and no row is copied per fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.reuse import join_back, keep
from foreshock.streaming.update import shared_folder

FIT = ["series", "method", "seed", "N", "fold"]
BLOCK_ROWS = 2048
GRADIENT = 1e-9

_KEYS = "series string, method string, seed long, N long, fold long"
_STATE = "cols array<int>, size double, hits double, mean array<double>, sd array<double>, w array<double>, back array<double>, back_loss double, done boolean"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _set(seed: str = "seed", fold: str = "fold"):
    return F.concat_ws(":", F.col(seed).cast("string"), F.col(fold).cast("string"))


def chosen_jobs(chosen: DataFrame, counts: list[int] | None = None) -> DataFrame:
    """``(series, method, seed, N, features)``: the first N features of each choice.

    ``chosen(series, method, seed, feature, rank)``.  Without ``counts`` a choice
    is one job of all its features; a count beyond the shortest choice of its
    series and method is dropped.
    """
    listed = chosen.groupBy("series", "method", "seed").agg(F.sort_array(F.collect_set(F.struct("rank", "feature"))).alias("_l"))
    names = F.transform("_l", lambda e: e["feature"])
    sized = listed.select("series", F.col("method"), F.col("seed").cast("long").alias("seed"), names.alias("features"))
    if counts is None:
        return sized.select("series", "method", "seed", F.size("features").cast("long").alias("N"), "features")
    shortest = sized.groupBy("series", "method").agg(F.min(F.size("features")).alias("_min"))
    every = join_back(sized, shortest, ["series", "method"]).withColumn("N", F.explode(F.array(*[F.lit(int(n)).cast("long") for n in sorted(set(counts))])))
    usable = every.where((F.col("N") >= 1) & (F.col("N") <= F.col("_min")))
    return usable.select("series", "method", "seed", "N", F.slice("features", F.lit(1), F.col("N").cast("int")).alias("features"))


def pack_rows(features: DataFrame, splits: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(series, block, names, ids, y, x, train, test)``: rows of a series in blocks of about 2,048.

    ``x`` holds the values of ``names``, the features of any job of the series;
    what is missing or not finite is NULL.  ``train`` and ``test`` name the
    (seed, fold) sets of a row, once per copy of a repeated row.
    """
    names = jobs.select("series", F.explode("features").alias("feature")).groupBy("series").agg(F.sort_array(F.collect_set("feature")).alias("names"))
    parts = splits.groupBy("series", "id").agg(
        F.max("is_erupted").alias("y"),
        F.collect_list(F.when(F.col("part") == "train", _set())).alias("train"),
        F.collect_list(F.when(F.col("part") == "test", _set())).alias("test"),
    )
    value = F.max(F.when(~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))), F.col("value")))
    wanted = features.join(jobs.select("series", F.explode("features").alias("feature")).distinct(), ["series", "feature"], "left_semi")
    maps = wanted.groupBy("series", "id", "feature").agg(value.alias("v")).groupBy("series", "id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "v"))).alias("_m")
    )
    rows = join_back(parts, maps, ["series", "id"], "left").join(names, "series")
    x = F.transform("names", lambda n: F.try_element_at(F.coalesce(F.col("_m"), F.create_map().cast("map<string,double>")), n))
    sizes = parts.groupBy("series").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("_blocks"))
    placed = join_back(rows, sizes, ["series"]).select("series", F.pmod(F.xxhash64("id"), F.col("_blocks")).alias("block"), "names", "id", "y", x.alias("x"), "train", "test")
    row = F.struct("id", "y", "x", "train", "test")
    packed = placed.groupBy("series", "block").agg(F.first("names").alias("names"), F.sort_array(F.collect_list(row)).alias("rows"))
    return packed.select("series", "block", *[F.col(f"rows.{c}").alias(c) for c in ("id", "y", "x", "train", "test")])


def _arrays(block: pd.Series) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Values, labels and the row numbers of each set of a block."""
    x = np.array([np.asarray(v, dtype=float) for v in block["x"]])
    sets: tuple[dict, dict] = ({}, {})
    for where, name in zip(sets, ("train", "test"), strict=True):
        for i, own in enumerate(block[name]):
            for s in own:
                where.setdefault(s, []).append(i)
    train, test = ({s: np.array(v) for s, v in d.items()} for d in sets)
    return x, np.asarray(block["y"], dtype=float), train, test


def _design(x: np.ndarray, fit) -> np.ndarray:
    """Columns of a fit in units of the training deviation, missing ones at the mean, and the constant."""
    z = (x[:, np.asarray(fit["cols"], dtype=int)] - np.asarray(fit["mean"], dtype=float)) / np.asarray(fit["sd"], dtype=float)
    return np.column_stack([np.nan_to_num(z, nan=0.0), np.ones(len(z))])


def _probability(t: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * t))


def _partial(x: np.ndarray, y: np.ndarray, fit) -> np.ndarray:
    """Moments of a fit that has none yet, else its loss, gradient and curvature over the rows of a block."""
    if fit["mean"] is None:
        v = x[:, np.asarray(fit["cols"], dtype=int)]
        there = ~np.isnan(v)
        count = there.sum(0)
        mean = np.where(there, v, 0.0).sum(0) / np.maximum(count, 1)
        spread = np.where(there, (v - mean) ** 2, 0.0).sum(0)
        return np.concatenate([[len(y), y.sum()], count, mean, spread])
    z = _design(x, fit)
    share = np.where(y == 1, fit["size"] / (2 * fit["hits"]), fit["size"] / (2 * (fit["size"] - fit["hits"])))
    t = z @ np.asarray(fit["w"], dtype=float)
    p = _probability(t)
    loss = (share * np.logaddexp(0.0, np.where(y == 1, -t, t))).sum()
    return np.concatenate([[loss], z.T @ (share * (p - y)), ((z * (share * p * (1 - p))[:, None]).T @ z).ravel()])


def _moments(stats: list[np.ndarray], d: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Merged size, positives, mean and deviation; a deviation of zero becomes one."""
    n = n1 = 0.0
    count, mean, spread = np.zeros(d), np.zeros(d), np.zeros(d)
    for s in stats:
        c, m, q = s[2 : 2 + d], s[2 + d : 2 + 2 * d], s[2 + 2 * d :]
        total = np.maximum(count + c, 1)
        gap = m - mean
        mean, spread = mean + gap * c / total, spread + q + gap * gap * count * c / total
        n, n1, count = n + s[0], n1 + s[1], count + c
    sd = np.sqrt(spread / np.maximum(count, 1))
    return n, n1, mean, np.where(sd > 0, sd, 1.0)


def newton_step(fit, stats: list[np.ndarray], penalty: float) -> dict:
    """The next state of a fit from the summed partial results.

    The penalty is ``penalty / 2`` times the squared weights without the
    constant, beside the summed loss.  A step that raised the loss is halved.
    """
    d = len(fit["cols"])
    if fit["mean"] is None:
        n, n1, mean, sd = _moments(stats, d)
        w = [0.0] * (d + 1)
        return {"size": n, "hits": n1, "mean": mean.tolist(), "sd": sd.tolist(), "w": w, "back": w, "back_loss": float("inf"), "done": not 0 < n1 < n}
    total = np.sum(stats, axis=0)
    w, ridge = np.asarray(fit["w"], dtype=float), np.append(np.full(d, penalty), 0.0)
    loss = total[0] + 0.5 * (ridge * w * w).sum()
    known = {k: fit[k] for k in ("size", "hits", "mean", "sd")}
    if loss > fit["back_loss"] + 1e-9 * abs(fit["back_loss"]):
        half = (w + np.asarray(fit["back"], dtype=float)) / 2
        return {**known, "w": half.tolist(), "back": fit["back"], "back_loss": fit["back_loss"], "done": False}
    gradient = total[1 : d + 2] + ridge * w
    curvature = total[d + 2 :].reshape(d + 1, d + 1) + np.diag(ridge)
    done = bool(np.abs(gradient).max() <= GRADIENT * fit["size"])
    after = w if done else w - np.linalg.lstsq(curvature, gradient, rcond=None)[0]
    return {**known, "w": after.tolist(), "back": w.tolist(), "back_loss": float(loss), "done": done}


def _with_fits(blocks: DataFrame, fits: DataFrame) -> DataFrame:
    """Blocks beside the fits of their series, which are settings, not data: methods by seeds by counts by folds."""
    listed = fits.groupBy("series").agg(F.collect_list(F.struct("method", "seed", "N", "fold", *_NAMES)).alias("fits"))
    return blocks.join(listed, "series")


def fit_logistic(blocks: DataFrame, fits: DataFrame, c: float = 1.0, steps: int = 60) -> DataFrame:
    """Fit every row of ``fits`` on the training rows of its set; returns its state with weights ``w``.

    Classes weigh ``n / (2 n_class)``.  ``c`` weighs the summed loss against the
    penalty.  A set without both classes or a fit that is open after ``steps``
    is an error.  The weights of a step are a table in the shared folder.
    """
    spark = fits.sparkSession
    folder = shared_folder(spark, "fits")

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, block in pdf.iterrows():
                x, y, train, _ = _arrays(block)
                out = []
                for fit in block["fits"]:
                    rows = train.get(f"{fit['seed']}:{fit['fold']}")
                    if rows is not None:
                        at = {k: fit[k] for k in ("method", "seed", "N", "fold", *_NAMES)}
                        out.append({"series": block["series"], "block": block["block"], **at, "stats": _partial(x[rows], y[rows], fit)})
                if out:
                    yield pd.DataFrame(out)

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        fit = {k: (None if v is None or (np.isscalar(v) and pd.isna(v)) else v) for k, v in pdf.iloc[0].items()}
        after = newton_step(fit, [np.asarray(s, dtype=float) for s in pdf["stats"]], 1.0 / c)
        return pd.DataFrame([{**{k: fit[k] for k in FIT}, "cols": fit["cols"], **after}])[[*FIT, *_NAMES]]

    schema = f"{_KEYS}, {_STATE}"
    wide = f"series string, block long, method string, seed long, N long, fold long, {_STATE}, stats array<double>"
    state, finished = fits, []
    for step in range(steps):
        sums = _with_fits(blocks, state).mapInPandas(partials, wide)
        path = f"{folder}/step={step}"
        sums.groupBy(*FIT).applyInPandas(advance, schema).write.parquet(path)
        table = spark.read.schema(schema).parquet(path)
        n_open, one_class = table.agg(F.count(F.when(~F.col("done"), 1)), F.count(F.when((F.col("hits") <= 0) | (F.col("hits") >= F.col("size")), 1))).first()
        if one_class:
            raise ValueError("training needs both classes")
        finished.append(table.where("done"))
        if not n_open:
            break
        state = table.where("NOT done")
    else:
        raise RuntimeError(f"{n_open} fits are open after {steps} steps")
    out = finished[0]
    for table in finished[1:]:
        out = out.unionByName(table)
    return out


def held_out_scores(features: DataFrame, splits: DataFrame, jobs: DataFrame, c: float = 1.0) -> DataFrame:
    """``(series, method, seed, N, fold, id, is_erupted, p)`` of every test row by the model of its set.

    ``features(series, id, feature, value)``, ``splits`` as of
    :func:`sampling.cv_splits`, ``jobs`` as of :func:`chosen_jobs`.  A missing or
    infinite value counts as the mean of the training rows.  A job without
    features is left out; a feature that ``features`` lacks is an error.
    """
    jobs = keep(jobs.where(F.size("features") > 0))
    splits = splits.withColumns({"seed": F.col("seed").cast("long"), "fold": F.col("fold").cast("long")})
    wanted = jobs.select("series", F.explode("features").alias("feature")).distinct()
    known = features.select("series", "feature").distinct()
    absent = [r["feature"] for r in wanted.join(known, ["series", "feature"], "left_anti").limit(5).collect()]
    if absent:
        raise ValueError(f"features are absent: {absent}")
    blocks = keep(pack_rows(features, splits, jobs))
    names = wanted.groupBy("series").agg(F.sort_array(F.collect_set("feature")).alias("_names"))
    sets = splits.select("series", "seed", "fold").distinct()
    at = F.transform("features", lambda f: (F.array_position(F.col("_names"), f) - 1).cast("int"))
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in _STATE.split(", ")[1:-1])]
    fits = join_back(jobs.join(names, "series"), sets, ["series", "seed"]).select(*FIT, at.alias("cols"), *empty, F.lit(False).alias("done"))
    fitted = fit_logistic(blocks, fits, c)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, block in pdf.iterrows():
                x, y, _, test = _arrays(block)
                ids = np.asarray(block["id"])
                for fit in block["fits"]:
                    rows = test.get(f"{fit['seed']}:{fit['fold']}")
                    if rows is not None:
                        p = _probability(_design(x[rows], fit) @ np.asarray(fit["w"], dtype=float))
                        own = {k: fit[k] for k in ("method", "seed", "N", "fold")}
                        yield pd.DataFrame({"id": ids[rows], "is_erupted": y[rows].astype("int32"), "p": p}).assign(series=block["series"], **own)

    kind = dict(splits.dtypes)["id"]
    return _with_fits(blocks, fitted).mapInPandas(score, f"id {kind}, is_erupted int, p double, {_KEYS}").select(*FIT, "id", "is_erupted", "p")
