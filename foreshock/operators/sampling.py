"""Deterministic sampling, splits and nearest neighbours.

Randomness is an arithmetic order key of (id, seed), so a sample is the same on
every engine and after every retry.  The key is spread evenly over its range;
cutting the range into equal slices splits even the largest class over tasks
when rows are numbered in key order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreshock.functions.blocked import running_sum
from foreshock.functions.expr import KEY_MODULUS, literal_table, shuffle_key
from foreshock.functions.reuse import join_back, keep
from foreshock.operators import nearest

SLICES = 64
#: Blocks that a search has at least, the vectors each of them has then, and most partitions that pairs of blocks are dealt over.
BLOCKS, BLOCK_LEAST, MOST_PARTS = 8, 1024, 4096
#: Columns of candidates.
NEAR = "query_id long, train_id long, label double, dist double"


def with_seeds(labels: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Repeat labels for every seed, ``seed`` as a column."""
    return labels.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def shuffled_position(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``position`` (1-based) in the shuffled order of each key; needs id and seed."""
    keyed = df.withColumn("_k", shuffle_key("id", "seed")).withColumn(
        "_slice", F.floor(F.col("_k") * F.lit(SLICES) / F.lit(KEY_MODULUS))
    )
    keyed = keyed.withColumn("_ord", F.struct("_k", "id"))
    out = running_sum(keyed, list(keys), "_slice", "_ord", {"position": F.lit(1)})
    return out.select(*df.columns, F.col("position").cast("long").alias("position"))


def _class_sizes(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.sum("is_erupted")
    n = F.count("*")
    return labels.groupBy(*keys).agg(
        F.when(p * 2 <= n, 1).otherwise(0).alias("_minor"),
        F.least(p, n - p).alias("_n_min"),
        F.greatest(p, n - p).alias("_n_maj"),
    )


def undersample(seed_labels: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Cut the majority class so that minority / majority = ``ratio``, without replacement.

    Takes and returns ``(series, seed, id, is_erupted)``; ``ratio`` 1 balances.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    keys = ["series", "seed"]
    sizes = _class_sizes(seed_labels, keys)
    numbered = shuffled_position(seed_labels, [*keys, "is_erupted"])
    numbered = join_back(numbered, sizes, keys)
    keep = (F.col("is_erupted") == F.col("_minor")) | (
        F.col("position") <= F.floor(F.col("_n_min") / F.lit(float(ratio)))
    )
    return numbered.where(keep).select(*keys, "id", "is_erupted")


def oversample(seed_labels: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Repeat minority rows until minority / majority = ``ratio``.

    ``copy`` numbers the repeats from 0; whole rounds come first, then part of
    one more round in shuffled order.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    keys = ["series", "seed"]
    sizes = _class_sizes(seed_labels, keys)
    numbered = shuffled_position(seed_labels, [*keys, "is_erupted"])
    numbered = join_back(numbered, sizes, keys)
    target = F.greatest(F.floor(F.col("_n_maj") * F.lit(float(ratio))), F.col("_n_min"))
    # Copies of this row: one per full round plus one if its turn comes in the last.
    copies = F.floor((target - F.col("position")) / F.col("_n_min")) + 1
    times = F.when(F.col("is_erupted") == F.col("_minor"), copies).otherwise(F.lit(1)).cast("int")
    return numbered.select(*keys, "id", "is_erupted", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))


def rebuild_resampled(features: DataFrame, seed_rows: DataFrame) -> DataFrame:
    """Matrix of each seed from its stored ids."""
    return seed_rows.join(features, ["series", "id"])


def cv_splits(
    seed_labels: DataFrame, strategy: str = "shuffle-stratified", k: int = 5, test_size: float = 0.25
) -> DataFrame:
    """``(series, seed, id, is_erupted, fold, part)`` for k folds.

    ``shuffle`` and ``stratified`` partition the rows into k test folds;
    ``shuffle-stratified`` draws k independent test sets of ``test_size`` per
    class; ``timeseries`` trains on everything before each of k equal test
    blocks (needs ``ts`` in the labels, else ``id`` order).
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    keys = ["series", "seed"]
    cols = [*keys, "id", "is_erupted"]
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    if strategy in ("shuffle", "stratified"):
        group = keys if strategy == "shuffle" else [*keys, "is_erupted"]
        numbered = shuffled_position(seed_labels.select(*cols), group)
        return numbered.withColumn("_own", F.pmod(F.col("position") - 1, F.lit(k))).select(
            *cols, "_own", folds
        ).select(*cols, "fold", F.when(F.col("_own") == F.col("fold"), "test").otherwise("train").alias("part"))
    if strategy == "shuffle-stratified":
        repeated = seed_labels.select(*cols, folds).withColumn("_seed", F.col("seed"))
        # Each fold is its own shuffle: fold 1 of seed 3 orders like seed 3 + 1000003.
        repeated = repeated.withColumn("seed", F.col("_seed") + F.col("fold") * F.lit(1000003))
        group = ["series", "seed", "_seed", "fold", "is_erupted"]
        numbered = shuffled_position(repeated, group)
        sizes = repeated.groupBy(*group).agg(F.count("*").alias("_n"))
        cut = F.round(F.col("_n") * F.lit(float(test_size)))
        return join_back(numbered, sizes, group).select(
            "series", F.col("_seed").alias("seed"), "id", "is_erupted", "fold",
            F.when(F.col("position") <= cut, "test").otherwise("train").alias("part"),
        )
    if strategy == "timeseries":
        order = "ts" if "ts" in seed_labels.columns else "id"
        block = F.date_trunc("month", order) if order == "ts" else F.floor(F.col("id") / F.lit(100000))
        numbered = running_sum(
            seed_labels.withColumn("_block", block), keys, "_block", order, {"position": F.lit(1)}
        )
        total = seed_labels.groupBy(*keys).agg(F.count("*").alias("_n"))
        size = F.floor(F.col("_n") / F.lit(k + 1))
        out = join_back(numbered, total, keys).select(*cols, "position", "_n", folds)
        start = F.col("_n") - size * (F.lit(k) - F.col("fold"))
        part = F.when(F.col("position") <= start, "train").when(F.col("position") <= start + size, "test")
        return out.select(*cols, "fold", part.alias("part")).where("part IS NOT NULL")
    raise ValueError("strategy must be shuffle, stratified, shuffle-stratified or timeseries")


def knn(
    train: DataFrame,
    query: DataFrame,
    k: int = 3,
    p: int = 2,
    weights: str = "uniform",
    block_rows: int = 32768,
) -> DataFrame:
    """Class probability by the k nearest training vectors (Minkowski distance p).

    ``train(id, vector, label)``, ``query(id, vector)``; a vector is not its own
    neighbour.  Exact neighbours need every pair of blocks, but no pair of
    vectors becomes a row: both sides are dealt into blocks of at most about
    ``block_rows`` by id, each pair of blocks is one co-group whose task bounds
    the distances by a matrix product, measures those that may count
    (:mod:`foreshock.operators.nearest`) and returns only the k best per query,
    and the few candidates per query are merged.  If both are the same table, a
    pair of blocks is looked at once for both, within the distances that the
    blocks themselves give.
    """
    if k < 1 or p < 1 or weights not in ("uniform", "distance"):
        raise ValueError("bad k, p or weights")

    def blocks_of(n: int) -> int:
        # Enough pairs of blocks to keep many tasks busy, unless there is little to do.
        return max(1, -(-n // block_rows), min(BLOCKS, n // BLOCK_LEAST))

    if query is train:
        return _vote(_within_one(train, k, p, blocks_of(train.count())), k, weights)
    q_blocks, t_blocks = blocks_of(query.count()), blocks_of(train.count())
    parts = min(4 * q_blocks * t_blocks, MOST_PARTS)

    def dealt(blocks: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    vector = F.col("vector").cast("array<double>")
    pair = (F.col("qb") * F.lit(t_blocks) + F.col("tb")).alias("pair")
    left = query.select(F.col("id").alias("query_id"), vector.alias("vector"), dealt(q_blocks).alias("qb"), every(t_blocks).alias("tb"))
    right = train.select(
        F.col("id").alias("train_id"), vector.alias("vector"), F.col("label").cast("double").alias("label"), dealt(t_blocks).alias("tb"), every(q_blocks).alias("qb")
    )

    def tile(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "train_id", "label", "dist"]
        if qs.empty or ts.empty:
            return pd.DataFrame({n: [] for n in names})
        qid, tid, label = qs["query_id"].to_numpy(), ts["train_id"].to_numpy(), ts["label"].to_numpy()
        i, j, d = nearest.nearest_others(qid, np.stack(qs["vector"].to_list()), tid, np.stack(ts["vector"].to_list()), k, p)
        return pd.DataFrame({"query_id": qid[i], "train_id": tid[j], "label": label[j], "dist": d})

    partial = (
        left.select("query_id", "vector", pair).repartition(parts, "pair").groupBy("pair")
        .cogroup(right.select("train_id", "vector", "label", pair).repartition(parts, "pair").groupBy("pair"))
        .applyInPandas(tile, NEAR)
    )
    return _vote(partial, k, weights)


def _within_one(table: DataFrame, k: int, p: int, blocks: int) -> DataFrame:
    """Candidates (query_id, train_id, label, dist) of a table's rows among its own: every unordered pair of blocks is one group."""

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        ids, label, x = rows["id"].to_numpy(), rows["label"].to_numpy(), np.stack(rows["vector"].to_list())
        i, j, d = nearest.nearest_others(ids, x, ids, x, k, p)
        start, end = np.searchsorted(i, np.arange(len(ids))), np.searchsorted(i, np.arange(len(ids)), side="right")
        far = np.full(len(ids), np.inf)
        full = end - start == k
        far[full] = d[end[full] - 1]
        parts = {n: np.split(v, start[1:]) for n, v in (("train_id", ids[j]), ("near_label", label[j]), ("dist", d))}
        return rows.assign(far=far, **parts)

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        lower = (rows["block"] == rows["block"].min()).to_numpy()
        sides = [(g["id"].to_numpy(), np.stack(g["vector"].to_list()), g["far"].to_numpy(), g["label"].to_numpy()) for g in (rows[lower], rows[~lower]) if len(g)]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(sides) == 2:
            both = nearest.between(*sides[0][:3], *sides[1][:3], k, p)
            found += [(q[0][i], t[0][j], t[3][j], d) for (i, j, d), q, t in zip(both, sides, sides[::-1], strict=True)]
        return pd.DataFrame(dict(zip(["query_id", "train_id", "label", "dist"], map(np.concatenate, zip(*found, strict=True)), strict=True)))

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = table.select("id", F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("double").alias("label"), block.alias("block"))
    # Read twice: for what a block's rows find in their own block, and for the limits this gives in others.
    first = keep(
        rows.repartition(min(4 * blocks, MOST_PARTS), "block").groupBy("block")
        .applyInPandas(own, "id long, vector array<double>, label double, block int, far double, train_id array<long>, near_label array<double>, dist array<double>")
    )
    near = first.select(F.col("id").alias("query_id"), F.inline(F.arrays_zip("train_id", "near_label", "dist"))).toDF("query_id", "train_id", "label", "dist")
    near = near.withColumn("label", F.nullif("label", F.lit(float("nan"))))  # a missing label
    if blocks == 1:
        return near
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    pair = F.least("block", "other") * F.lit(blocks) + F.greatest("block", "other")
    sent = first.select("id", "vector", "label", "block", "far", other).where("block <> other").select("id", "vector", "label", "block", "far", pair.alias("pair"))
    parts = min(2 * blocks * (blocks - 1), MOST_PARTS)
    return near.union(sent.repartition(parts, "pair").groupBy("pair").applyInPandas(tile, NEAR))


def _vote(partial: DataFrame, k: int, weights: str) -> DataFrame:
    """Share of the labels of the k nearest of each query's candidates."""
    final = Window.partitionBy("query_id").orderBy("dist", "train_id")
    best = partial.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= k)
    if weights == "uniform":
        w: Column = F.lit(1.0)
    else:
        # A zero distance outweighs every other neighbour.
        exact = F.max(F.when(F.col("dist") == 0, 1).otherwise(0)).over(Window.partitionBy("query_id"))
        w = F.when(exact == 1, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(
            F.lit(1.0) / F.nullif("dist", F.lit(0.0))
        )
    return best.withColumn("_w", w).groupBy("query_id").agg(
        (F.sum(F.col("_w") * F.col("label")) / F.sum("_w")).alias("p"),
        F.max("dist").alias("kth_distance"),
    )


def pick_n(scores: DataFrame, parsimony: bool = True, tolerance: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest feature count whose mean score is within one standard error of the peak.

    ``scores(N, mean, std, n_seeds)``.  ``tolerance`` replaces the standard
    error by a share of the peak; ``parsimony=False`` returns the peak itself.
    """
    if tolerance is not None and not 0.0 < tolerance < 1.0:
        raise ValueError("tolerance must be in (0, 1)")
    peak = F.max_by(F.struct("N", "mean", "std", "n_seeds"), F.struct(F.col("mean"), -F.col("N")))
    peaks = scores.groupBy(*keys).agg(peak.alias("_p"))
    if not parsimony:
        return peaks.select(*keys, F.col("_p.N").alias("n_star"))
    if tolerance is None:
        sem = F.when(F.col("_p.n_seeds") > 1, F.coalesce(F.col("_p.std"), F.lit(0.0)) / F.sqrt("_p.n_seeds")).otherwise(0.0)
        floor = F.col("_p.mean") - sem
    else:
        floor = F.col("_p.mean") * F.lit(1.0 - tolerance)
    limits = peaks.select(*keys, floor.alias("_floor"))
    joined = scores.join(limits, list(keys)) if keys else scores.crossJoin(F.broadcast(limits))
    return joined.where("mean >= _floor").groupBy(*keys).agg(F.min("N").alias("n_star"))


def cv_scores(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Raw ``(N, seed, score)`` to mean, sample deviation and number of seeds per N."""
    return raw.groupBy(*keys, "N").agg(
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("std"),
        F.count("score").alias("n_seeds"),
    )


def seed_argmax(raw: DataFrame) -> DataFrame:
    """Best N of each seed, ties to the smaller."""
    return raw.groupBy("seed").agg(F.max_by("N", F.struct(F.col("score"), -F.col("N"))).alias("argmax_N"))


def argmax_hist(raw: DataFrame) -> DataFrame:
    """How many seeds peak at each N."""
    return seed_argmax(raw).groupBy("argmax_N").agg(F.count("*").alias("n_seeds"))


def support(rankings: DataFrame, n_star: DataFrame) -> DataFrame:
    """Features of each seed's ranking up to the recommended count."""
    return rankings.crossJoin(F.broadcast(n_star)).where("rank <= n_star").drop("n_star")


def fingerprint(df: DataFrame) -> DataFrame:
    """Span, size and columns of a table by one aggregate."""
    return df.agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(",".join(sorted(df.columns))).alias("columns"),
    )


def run_identity(params: Mapping[str, object], df: DataFrame) -> DataFrame:
    """Key of a run: SHA-256 prefix of canonical parameters and the input's fingerprint."""
    text = json.dumps(dict(params), sort_keys=True, separators=(",", ":"), default=str)
    mark = fingerprint(df)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    joined = F.concat_ws("|", F.lit(text), stamp("first_ts"), stamp("last_ts"), "n_rows", "columns")
    return mark.select("*", F.substring(F.sha2(joined, 256), 1, 12).alias("run_key"))


def params_digest(params: Mapping[str, object]) -> str:
    """Digest of parameters alone, for output folder names."""
    text = json.dumps(dict(params), sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def pending_seeds(spark: SparkSession, wanted: Sequence[int], registry: DataFrame, classifier: str) -> DataFrame:
    """Seeds of a classifier not yet in the registry."""
    done = registry.where(F.col("classifier") == classifier).select("seed")
    return literal_table(spark, "seed", [int(s) for s in wanted]).join(done, "seed", "left_anti")
