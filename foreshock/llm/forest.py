"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors by random directions.  Who lies close to a split
goes to both sides, so that two near vectors are parted only if they lie on
opposite sides of that margin; with several trees, hardly any pair is parted in
all of them.  Trees are fitted on a bounded sample; leaves that still hold too
many vectors are split again by a sample of their own, until they are small or
too tight to be split.  Such a leaf is compared in tiles of two blocks.

Pairs are compared inside leaves, in double precision, and never become rows: a
leaf gives the number of links per vector and the root of every local component.
A pair counts in the first leaf that it shares.  Equal vectors are one vector
with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreshock.llm.base import stored
from foreshock.llm.partenum import components
from foreshock.llm.text import mix, to_batch
from foreshock.llm.vectors import common_size, matrix

LEAST_COSINE = 0.9
TREES = 6
#: Vectors a leaf should hold, and at most holds unless it cannot be split.
LEAF, MOST = 512, 2048
#: Vectors that one tree, or one leaf that is split again, is fitted on.
FIT = 8192
#: Random directions of which a split takes the one with the widest spread.
DRAWS = 8
#: A split whose larger side keeps more than this share is none.
PROGRESS = 0.85
#: Rows of one matrix product inside a leaf.
BLOCK = 1024


class Tree:
    """Splits of the unit vectors of a sample; leaves are numbered by a hash of the path to them."""

    def __init__(self, sample: np.ndarray, seed: int, population: float, margin: float, leaf: int = LEAF):
        """``population``: how many vectors each row of the sample stands for; ``leaf``: how many a leaf should hold."""
        self.margin, self.size = margin, leaf
        self.directions: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.sides: list[tuple[int, int]] = []
        self.root = self._grow(sample, seed, population)

    def _grow(self, x: np.ndarray, path: int, population: float) -> int:
        """Number of a split, or -1 - leaf."""
        leaf = -1 - (int(mix(np.array([path], np.uint64))[0]) & 0xFFFFFFFFFFFF)
        if len(x) * population <= self.size or len(x) < 16:
            return leaf
        rng = np.random.default_rng([path & 0xFFFFFFFF, path >> 32])
        drawn = rng.standard_normal((x.shape[1], DRAWS))
        drawn /= np.linalg.norm(drawn, axis=0)
        p = x @ drawn
        best = int(np.argmax(p.std(0)))
        direction, p = drawn[:, best], p[:, best]
        cut = float(np.quantile(p, rng.uniform(0.4, 0.6)))
        low, high = p <= cut + self.margin, p > cut - self.margin
        if max(low.sum(), high.sum()) > PROGRESS * len(x):
            return leaf
        me = len(self.cuts)
        self.directions.append(direction)
        self.cuts.append(cut)
        self.sides.append((0, 0))
        left, right = (int(mix(np.array([path * 2 + k & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) for k in (1, 2))
        self.sides[me] = (self._grow(x[low], left, population), self._grow(x[high], right, population))
        return me

    def place(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows in it) for every leaf that holds rows of ``x``."""
        open_ = [(self.root, np.arange(len(x)))]
        while open_:
            at, rows = open_.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -1 - at, rows
                continue
            p = x[rows] @ self.directions[at]
            left, right = self.sides[at]
            open_.append((left, rows[p <= self.cuts[at] + self.margin]))
            open_.append((right, rows[p > self.cuts[at] - self.margin]))


def margin(d: int, cosine: float = LEAST_COSINE) -> float:
    """A quarter of the typical width, along a random direction, between two unit vectors of just that cosine."""
    return 0.25 * (2 - 2 * cosine) ** 0.5 / d**0.5


def _unit(v: list[bytes], d: int) -> np.ndarray:
    """Unit rows in double precision of vectors kept in the precision of their column."""
    kind = "<f4" if v and len(v[0]) == 4 * d else "<f8"
    x = np.frombuffer(b"".join(v), kind).astype(np.float64).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(trees: list[tuple[int, Tree]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) by row and leaf; the number of the tree stands in a leaf's upper bits."""
    rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t, tree in trees:
        for leaf, at in tree.place(x):
            rows.append(at)
            leaves.append(np.full(len(at), (t << 48) | leaf, np.int64))
    rows, leaves = np.concatenate(rows), np.concatenate(leaves)
    order = np.lexsort((leaves, rows))
    return rows[order], leaves[order]


def _as_lists(n: int, rows: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values))


def _rows(vectors: DataFrame, d: int) -> DataFrame:
    """vec_id and v (entries in the column's precision; null if the vector cannot link) of every row."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    out = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, x = matrix(b.column("embedding"), d)
            v: list[bytes | None] = [None] * b.num_rows
            with np.errstate(over="ignore"):
                size = np.linalg.norm(x, axis=1)
            for i, row, s in zip(place.tolist(), x + 0.0, size, strict=True):  # + 0.0 turns a negative zero into zero
                if s > 0 and np.isfinite(s):
                    v[i] = row.astype(kind).tobytes()
            yield to_batch(out, vec_id=b.column("vec_id"), v=v)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, v binary")


def _key() -> Column:
    return F.unhex(F.md5("v"))


def _nodes(rows: DataFrame) -> DataFrame:
    """Distinct vectors: node, key, v, times, least (smallest vec_id)."""
    distinct = rows.where(F.col("v").isNotNull()).groupBy(_key().alias("key")).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    return stored(distinct.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def _share(of: int | Column, seed: int, *columns: str) -> Column:
    """True for about ``of`` in a million rows, by a hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1_000_000)) < of


def _first_leaves(nodes: DataFrame, d: int, n: int, width: float, number: int, leaf: int) -> DataFrame:
    """node, v, times and leaves (ascending) by trees fitted on about FIT vectors."""
    sample = nodes.where(_share(-(-FIT * 1_000_000 // n), 3, "key")).select("v").collect()
    x = _unit([r["v"] for r in sample], d) if sample else np.zeros((0, d))
    trees = [(t, Tree(x, 1000 + t, n / max(1, len(x)), width, leaf)) for t in range(number)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, leaves = _lists(trees, _unit(b.column("v").to_pylist(), d))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "v", "times")), _as_lists(b.num_rows, rows, leaves)], ["node", "v", "times", "leaves"])

    return nodes.select("node", "v", "times").mapInArrow(run, "node long, v binary, times long, leaves array<long>")


def _split_again(placed: DataFrame, nodes: DataFrame, large: DataFrame, d: int, width: float, size: int) -> DataFrame:
    """``placed`` with the leaves in ``large`` (leaf, n) replaced by leaves of trees of their own."""
    inside = placed.select("node", "v", F.explode("leaves").alias("leaf")).join(large.select(F.col("leaf").alias("_leaf"), "n"), F.col("leaf") == F.col("_leaf"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        leaf, n = int(rows["leaf"].iloc[0]), int(rows["n"].iloc[0])
        rows = rows.sort_values("v")
        tree = Tree(_unit(rows["v"].tolist(), d), leaf, n / len(rows), width, size)
        flat = np.array(tree.directions).tobytes(), np.array(tree.cuts).tobytes(), np.array(tree.sides, np.int64).tobytes()
        return pd.DataFrame({"_at": [leaf], "directions": [flat[0]], "cuts": [flat[1]], "sides": [flat[2]]})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = b.column("leaf").to_numpy()
            new: list[list[int]] = [[] for _ in leaf]
            for k in np.unique(leaf):
                mine = np.flatnonzero(leaf == k)
                f = int(mine[0])
                tree = Tree.__new__(Tree)
                tree.margin = width
                tree.directions = list(np.frombuffer(b.column("directions")[f].as_py()).reshape(-1, d))
                tree.cuts = np.frombuffer(b.column("cuts")[f].as_py()).tolist()
                tree.sides = np.frombuffer(b.column("sides")[f].as_py(), np.int64).reshape(-1, 2).tolist()
                tree.root = 0 if tree.cuts else -1 - (int(k) & 0xFFFFFFFFFFFF)  # a leaf too tight to be split keeps its name
                for low, at in tree.place(_unit([b.column("v")[int(i)].as_py() for i in mine], d)):
                    for i in mine[at]:
                        new[i].append((int(k) >> 48 << 48) | low)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("leaf"), pa.array(new, pa.list_(pa.int64()))], ["node", "leaf", "new"])

    fitted = inside.where(_share(F.ceil(F.lit(FIT * 1_000_000) / F.col("n")), 5, "node")).select("leaf", "n", "v").groupBy("leaf").applyInPandas(fit, "_at long, directions binary, cuts binary, sides binary")
    fitted = stored(fitted, "leaf-trees")
    moved = inside.join(fitted, F.col("leaf") == F.col("_at")).select("node", "leaf", "v", "directions", "cuts", "sides").mapInArrow(route, "node long, leaf long, new array<long>")
    kept = placed.select("node", F.explode("leaves").alias("leaf")).join(large, "leaf", "left_anti").select("node", "leaf")
    every = kept.unionByName(moved.select("node", F.explode("new").alias("leaf"))).groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    return stored(nodes.select("node", "v", "times").join(every, "node"), "split-leaves")


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row connected to each of ``n`` rows by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(d: int, cosine: float):
    """Links and local roots of the vectors of one leaf, or of one tile of two blocks of it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        leaf = int(rows["leaf"].iloc[0])
        rows = rows.sort_values("node")
        x, node, times = _unit(rows["v"].tolist(), d), rows["node"].to_numpy(), rows["times"].to_numpy()
        side = rows["side"].to_numpy()
        tile = bool((rows["i"] != rows["j"]).iloc[0])
        lists = [np.asarray(v) for v in rows["leaves"]]
        flat, who = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(v) for v in lists])
        before = flat < leaf
        names, column = np.unique(flat[before], return_inverse=True)
        member = np.zeros((len(x), len(names)), np.float32)
        member[who[before], column] = 1
        links, left, right = np.zeros(len(x), np.int64), [], []
        for a in range(0, len(x), BLOCK):
            near = x[a : a + BLOCK] @ x[a:].T >= cosine
            near &= member[a : a + BLOCK] @ member[a:].T == 0
            near &= np.arange(a, a + len(near))[:, None] < np.arange(a, len(x))[None, :]
            if tile:
                near &= side[a : a + BLOCK][:, None] != side[a:][None, :]
            links[a : a + BLOCK] += near @ times[a:]
            links[a:] += times[a : a + BLOCK] @ near
            i, j = np.nonzero(near)
            left.append(i + a)
            right.append(j + a)
        some = links > 0
        root = _local_roots(len(x), np.concatenate(left), np.concatenate(right))
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root[some]]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = LEAST_COSINE, trees: int = TREES, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Rows link when the cosine of their vectors is at least ``cosine`` and the
    forest brings them together; equal vectors always link.  Vectors that are
    null, zero, of another size than most, or with null or non-finite entries
    link with nothing.  The component is named by its smallest vec_id; rows with a
    null id may connect others, have a null component and are not kept.  Repeated
    rows count as vectors of their own.  Leaves should hold ``leaf`` vectors; those
    of more than ``most`` are split again, or compared in tiles.
    """
    d = common_size(vectors)
    width = margin(d, cosine) if d else 0.0
    rows = stored(_rows(vectors, d), "vectors")
    nodes = _nodes(rows)
    n = nodes.count()
    placed = stored(_first_leaves(nodes, d, max(1, n), width, trees, leaf), "placed-vectors")
    settled: DataFrame | None = None
    while True:
        sizes = stored(placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "large-leaves")
        open_ = sizes if settled is None else sizes.join(settled, ["leaf", "n"], "left_anti")
        if open_.isEmpty():
            break
        placed = _split_again(placed, nodes, open_, d, width, leaf)
        settled = sizes  # a leaf that keeps its name and size was too tight to be split

    tiles = F.ceil(F.lit(2) * F.coalesce("n", F.lit(1)) / F.lit(most)).cast("int")
    spread = placed.select("node", "v", "times", "leaves", F.explode("leaves").alias("leaf"))
    if sizes.isEmpty():
        spread = spread.select("*", *[F.lit(0).alias(c) for c in ("side", "i", "j")])
    else:
        spread = spread.join(sizes, "leaf", "left").withColumn("tiles", F.when(F.col("n").isNull(), 1).otherwise(tiles))
        spread = spread.withColumn("side", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        spread = spread.select("node", "v", "times", "leaves", "leaf", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    found = stored(spread.groupBy("leaf", "i", "j").applyInPandas(_compare(d, cosine), "node long, links long, root long"), "vector-links")

    label = components(found.select(F.col("root").alias("x"), F.col("node").alias("y"))).select(F.col("node").alias("_label"), F.col("component").alias("_component"))
    links = found.groupBy(F.col("node").alias("_links")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "key", "times", "least").join(links, F.col("node") == F.col("_links"), "left").join(label, F.col("node") == F.col("_label"), "left")
    known = stored(known.select("key", "times", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("_component", "node").alias("k")), "vector-components")
    least = known.groupBy(F.col("k").alias("_k")).agg(F.min("least").alias("component"))
    known = known.join(least, F.col("k") == F.col("_k")).select(F.col("key").alias("_key"), "component", (F.col("links") + F.col("times") - 1).alias("n_links"))
    joined = rows.select("vec_id", _key().alias("key")).join(known, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
