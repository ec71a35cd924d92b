"""Documents whose word shingles are alike, by signatures that enumerate subsets of a partitioned domain.

Two sets of sizes a and b with Jaccard likeness of at least 3/4 differ in at
most (a + b) / 7 elements.  Sizes are cut into bands so that a pair falls into
one band or two neighbours.  For the band of the larger set, with at most k
differing elements, the domain of hashes is cut into more than (k + 1) / 2 parts
of three cells: some part then holds at most one difference, so one of its three
pairs of cells is equal in both sets.  Every non-empty pair of cells is a
signature.  Small bands repeat this with independent partitions until there are
PARTS of them, and sets of up to TINY elements use each element as well, so a
pair is missed with a probability below 1e-7 and only by the hash's doing.

Before that, documents that cannot have a partner are put aside: of the
smallest hashes, a set shares at least a known number with its partner's.

Candidates are verified on whole sets.  Within a group of equal signatures the
members are first compared with one of them, then with the smallest; afterwards
only pairs that are not yet connected are.  So a group of copies costs a few
comparisons per member, and no link between different components is lost.  The
members of large groups that are still apart, as when a passage fills most of
many texts, are told apart by their rarest elements.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreshock.llm.base import stored
from foreshock.llm.exchange import deal, equal_keys, pack_ids, unpack_ids
from foreshock.llm.text import distinct_per_row, mix, rounds, shingles, text_bytes, to_batch, words

SIZE = 5
PERCENT = 75
PARTS = 28
TINY = 16
CELLS = 3
#: Cells of the sketch that bounds the difference of two sets from below.
SKETCH = 256
#: Largest count that a cell holds; beyond it a cell only tells that there are as many.
FULL = 15
#: Members of a group of equal signatures of which every pair may be tried.
SMALL = 16
#: Members of a group that are compared in one place; larger groups are dealt out in tiles.
TILE = 4096
#: Entries of packed blocks that one task compares.
PART_ENTRIES = 1_000_000
#: Members of groups that one task compares.
PART_MEMBERS = 60_000
#: Pairs whose sketches are compared at once.
AT_ONCE = 8192


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Smallest hashes looked at for a set of ``n``."""
    return np.minimum(n, n // 4 + (n * 3) // 20 + 1)


def prefix_shared(n: np.ndarray) -> np.ndarray:
    """How many of them a partner's smallest hashes hold at least."""
    return np.maximum(1, (n * 3) // 20 - 1)


def band_tops(n: int) -> list[int]:
    """Largest size of every band, up to the band after that of ``n``."""
    tops, low = [], 1
    while True:
        tops.append(low * 4 // 3)
        if len(tops) > 1 and tops[-2] >= n:
            return tops
        low = tops[-1] + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _sums(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each row's set, whatever the order of its elements."""
    total = np.zeros(rows, np.uint64)
    np.add.at(total, row, mix(h))
    return mix(total + np.bincount(row, minlength=rows).astype(np.uint64))


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash) ascending, size and hash of every text's set."""
    buf, at = text_bytes(column)
    rows = len(at) - 1
    row, h = distinct_per_row(*shingles(words(buf, at), rows, SIZE))
    return row, h, np.bincount(row, minlength=rows), _sums(row, h, rows)


def signatures(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of sets given by (row, hash) and sizes, in the set's own band and the next."""
    tops = band_tops(int(n.max(initial=1)))
    own = np.searchsorted(tops, n)
    out, owner = [], []
    for step in (0, 1):
        band = own + step
        k = np.array([2 * t // 7 for t in [*tops, tops[-1] * 2]])[band]
        parts = np.ceil((k + 1) * 0.55).astype(np.int64)
        times = -(-PARTS // parts)
        for turn in range(int(times.max(initial=0))):
            some = (times > turn)[row]
            r, x = row[some], h[some]
            if not len(r):
                continue
            base = np.cumsum(parts * CELLS) - parts * CELLS
            spread = mix(x + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64)))
            part = ((spread >> np.uint64(32)) * parts[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            cell = ((spread & np.uint64(0xFFFFFFFF)) * np.uint64(CELLS) >> np.uint64(32)).astype(np.int64)
            total = int((parts * CELLS).sum())
            place = base[r] + part * CELLS + cell
            value, count = np.zeros(total, np.uint64), np.bincount(place, minlength=total).reshape(-1, CELLS)
            np.add.at(value, place, mix(x))
            value = value.reshape(-1, CELLS)
            who = np.repeat(np.arange(len(n)), parts)
            which = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
            tag = ((band[who] * 64 + turn) << 34) + which * 4
            for left_out in range(CELLS):
                keep = count.sum(1) - count[:, left_out] > 0
                s = value.sum(1, dtype=np.uint64) - value[:, left_out]
                out.append(mix(s + mix((tag + left_out).astype(np.uint64)))[keep])
                owner.append(who[keep])
    small = (n <= TINY)[row]
    out.append(mix(h[small] + np.uint64(77)))
    owner.append(row[small])
    return np.concatenate(out), np.concatenate(owner)


def sketch(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Per set and cell: how many elements, and a hash of them, in one byte (rows x SKETCH)."""
    spread = mix(h + np.uint64(31))
    place = row * SKETCH + (spread >> np.uint64(56)).astype(np.int64)
    total = np.zeros(rows * SKETCH, np.uint64)
    np.add.at(total, place, mix(h))
    count = np.minimum(np.bincount(place, minlength=rows * SKETCH), FULL)
    return (count * 16 + (mix(total) & np.uint64(15)).astype(np.int64)).astype(np.uint8).reshape(rows, SKETCH)


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No pair of sets with these sketches differs in fewer elements."""
    m, n = a >> 4, b >> 4
    more = np.maximum(m, n) - np.minimum(m, n)
    # Equal counts of other elements: one is missing on either side, or a full cell holds one more.
    other = (more == 0) & (a != b)
    return more.sum(1, dtype=np.int64) + 2 * other.sum(1) - (other & (m == FULL)).sum(1)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two ascending arrays of distinct hashes."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(short) < PERCENT * len(long):
        return False
    at = np.searchsorted(long, short)
    common = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


_PACKED = "part int, batch long, keys binary, rows binary, ids binary, sizes array<long>, sets array<long>"


def _packed_schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary()), ("ids", pa.binary()), ("sizes", longs), ("sets", longs)])


def profiles(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, n, s (hash of the set) and shared (smallest hashes that other documents' smallest hold too) of every row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _packed_schema()
        batch = TaskContext.get().partitionId() << 32
        for b in rounds(batches, 4 << 20, 4000):
            row, h, n, s = sets_of(b.column("text"))
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < prefix_size(n)[row]
            dealt = list(deal(mix(h[inside]), row[inside], parts))
            m = len(dealt)
            ids = b.column("doc_id").to_pylist()
            yield to_batch(
                out,
                part=[*(p for p, _, _ in dealt), batch % parts],
                batch=[batch] * (m + 1),
                keys=[*(k for _, k, _ in dealt), None],
                rows=[*(r for _, _, r in dealt), None],
                ids=[*[None] * m, pack_ids(ids)],
                sizes=pa.array([*[None] * m, n.tolist()], pa.list_(pa.int64())),
                sets=pa.array([*[None] * m, _signed(s).tolist()], pa.list_(pa.int64())),
            )
            batch += 1

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        coded = rows["keys"].notna()
        blocks = rows[coded]
        place, _ = equal_keys(blocks["keys"].tolist())
        ends = np.cumsum([len(k) // 4 for k in blocks["keys"]])
        at = np.searchsorted(ends, place, side="right")
        docs_of = np.frombuffer(b"".join(blocks["rows"]), "<u4")[place]
        order = np.argsort(at, kind="stable")
        cut = np.searchsorted(at[order], np.arange(len(blocks) + 1))
        hits = [np.bincount(docs_of[order[a:b]]).astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        counted = pd.DataFrame({"batch": blocks["batch"], "counts": hits, "ids": None, "sizes": None, "sets": None})
        meta = rows.loc[~coded, ["batch", "ids", "sizes", "sets"]].assign(counts=None)
        return pd.concat([counted, meta[counted.columns]])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        meta = rows[rows["sets"].notna()].iloc[0]
        shared = np.zeros(len(meta["sets"]), np.int64)
        for c in rows["counts"].dropna():
            c = np.frombuffer(c, "<u4")
            shared[: len(c)] += c
        return pd.DataFrame({"doc_id": unpack_ids(meta["ids"]), "n": meta["sizes"], "s": meta["sets"], "shared": shared})

    counted = docs.select("doc_id", "text").mapInArrow(pack, _PACKED).groupBy("part").applyInPandas(count, "batch long, counts binary, ids binary, sizes array<long>, sets array<long>")
    return counted.groupBy("batch").applyInPandas(add, "doc_id long, n long, s long, shared long")


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """s, n, elements (ascending, 8 bytes each) and sketch of the chosen (doc_id, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("s", pa.int64()), ("n", pa.int64()), ("elements", pa.binary()), ("sketch", pa.binary())])
        for b in rounds(batches):
            row, h, n, s = sets_of(b.column("text"))
            cut = np.concatenate([[0], np.cumsum(n)])
            flat = sketch(row, h, len(n))
            keep = np.flatnonzero(_signed(s) == b.column("_s").to_numpy())  # another text under a repeated id is not the chosen one
            yield to_batch(out, s=_signed(s[keep]), n=n[keep], elements=[h[cut[i] : cut[i + 1]].tobytes() for i in keep], sketch=[flat[i].tobytes() for i in keep])

    texts = docs.select("doc_id", "text").join(chosen.select(F.col("doc_id").alias("_d"), F.col("s").alias("_s")), F.col("doc_id") == F.col("_d"))
    return texts.select("text", "_s").mapInArrow(run, "s long, n long, elements binary, sketch binary")


def _groups(sets: DataFrame, parts: int) -> DataFrame:
    """Sets with equal signatures: rows (edge, leader, member, how often) and rows (not edge, group, member, 0)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _packed_schema()
        for b in rounds(batches, column="elements"):
            n, s = b.column("n").to_numpy(), b.column("s").to_numpy()
            h = np.frombuffer(b"".join(b.column("elements").to_pylist()), np.uint64)
            key, owner = signatures(np.repeat(np.arange(len(n)), n), h, n)
            dealt = list(deal(key, owner, parts))
            local = [np.unique(np.frombuffer(r, "<u4"), return_inverse=True) for _, _, r in dealt]
            yield to_batch(
                out,
                part=[p for p, _, _ in dealt],
                batch=[0] * len(dealt),
                keys=[k for _, k, _ in dealt],
                rows=[i.astype("<u4").tobytes() for _, i in local],
                ids=[None] * len(dealt),
                sizes=pa.nulls(len(dealt), pa.list_(pa.int64())),
                sets=pa.array([s[u] for u, _ in local], pa.list_(pa.int64())),
            )

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        place, group = equal_keys(rows["keys"].tolist())
        names = np.concatenate(rows["sets"].tolist()).astype(np.int64)
        shift = np.cumsum([0, *[len(x) for x in rows["sets"]][:-1]])
        node = np.concatenate([np.frombuffer(r, "<u4").astype(np.int64) + d for r, d in zip(rows["rows"], shift, strict=True)])
        member = names[node[place]]
        order = np.lexsort((member, group))
        member, group = member[order], group[order]
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (group[1:] != group[:-1])
        member, group = member[new], group[new]
        _, head, index, size = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        several = size > 1
        total = np.zeros(len(size), np.uint64)
        np.add.at(total, index, mix(member.view(np.uint64)))
        name = mix(total)
        _, once = np.unique(name, return_index=True)
        fresh = np.zeros(len(size), bool)
        fresh[once] = True
        leader = member[head][index]
        edge = several[index] & (leader != member)
        pair = pd.DataFrame({"x": leader[edge], "y": member[edge]}).groupby(["x", "y"]).size().rename("c").reset_index()
        inside = (several & fresh)[index]
        group_rows = pd.DataFrame({"edge": False, "x": _signed(name[index][inside]), "y": member[inside], "c": 0})
        return pd.concat([pair.assign(edge=True)[["edge", "x", "y", "c"]], group_rows])

    return sets.select("s", "n", "elements").mapInArrow(pack, _PACKED).groupBy("part").applyInPandas(match, "edge boolean, x long, y long, c long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of sets that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("left").to_pylist(), b.column("right").to_pylist()
            ok = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(left, right, strict=True)]
            yield b.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("s").alias("_x"), F.col("elements").alias("left"))
    right = sets.select(F.col("s").alias("_y"), F.col("elements").alias("right"))
    both = pairs.select("x", "y").join(right, F.col("y") == F.col("_y")).join(left, F.col("x") == F.col("_x"))
    return both.select("x", "y", "left", "right").mapInArrow(run, "x long, y long")


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("left", "right"))
            ok = 7 * least_difference(left, right) <= b.column("n").to_numpy() + b.column("m").to_numpy()
            yield b.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("s").alias("_x"), F.col("n"), F.col("sketch").alias("left"))
    right = sets.select(F.col("s").alias("_y"), F.col("n").alias("m"), F.col("sketch").alias("right"))
    both = pairs.select("x", "y").join(left, F.col("x") == F.col("_x")).join(right, F.col("y") == F.col("_y"))
    both = both.where((100 * F.col("n") >= PERCENT * F.col("m")) & (100 * F.col("m") >= PERCENT * F.col("n")))
    return both.select("x", "y", "n", "m", "left", "right").mapInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """node and component of all ends of ``links`` (x, y); equal numbers are connected.

    Each round every node joins the one of its neighbours that a hash, new in
    each round, puts first, and links are redrawn between the joined; the number
    of rounds grows with the logarithm of the largest component.
    """
    links = stored(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "links")
    label, turn = None, 0
    while not links.isEmpty():
        turn += 1
        ends = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        parent = ends.groupBy(F.col("x").alias("_n")).agg(F.min(ranked("y")).alias("_m")).select("_n", F.least("_m", ranked("_n"))["v"].alias("_p"))
        parent = stored(parent, "parents")
        if label is None:
            label = parent.select(F.col("_n").alias("node"), F.col("_p").alias("component"))
        else:
            label = label.join(parent, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_p", "component").alias("component"))
        label = stored(label, "labels")
        to_x, to_y = (parent.select(F.col("_n").alias(f"_n{c}"), F.col("_p").alias(f"_{c}")) for c in "xy")
        moved = links.join(to_x, F.col("x") == F.col("_nx")).join(to_y, F.col("y") == F.col("_ny")).where("_x <> _y")
        links = stored(moved.select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).distinct(), "links")
    if label is None:
        return links.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return label


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """``members`` (g, y, n) of the groups that hold more than one component, with the component k of each."""
    label = label.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    members = members.join(label, F.col("y") == F.col("_node"), "left").select("g", "y", "n", F.coalesce("_component", "y").alias("k"))
    members = stored(members, "members")
    mixed = members.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("size"), F.min(F.struct("n", "y", "k")).alias("least")).where("lo <> hi")
    mixed = stored(mixed.select(F.col("g").alias("_g"), "size", "least"), "mixed-groups")
    return stored(members.join(mixed, F.col("g") == F.col("_g")).drop("_g"), "open-members")


def _near_in_groups(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (x, y) of many groups, or tiles of large groups, that lie in different components and that sizes and sketches do not rule out."""
    rows = rows.sort_values(["g", "i", "j", "y"])
    g, i, j, side, y, n, k = (rows[c].to_numpy() for c in ("g", "i", "j", "side", "y", "n", "k"))
    flat = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, SKETCH)
    left, right, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(rows))
    step = 0
    while True:  # pairs at a growing distance in the sorted rows, as long as some group is that wide
        step += 1
        at = at[at < len(rows) - step]
        to = at + step
        at = at[(g[at] == g[to]) & (i[at] == i[to]) & (j[at] == j[to])]
        if not len(at):
            break
        to = at + step
        a = at[(k[at] != k[to]) & ((i[at] == j[at]) | (side[at] != side[to])) & (100 * n[at] >= PERCENT * n[to]) & (100 * n[to] >= PERCENT * n[at])]
        for b in np.array_split(a, -(-len(a) // AT_ONCE)) if len(a) else ():
            b = b[7 * least_difference(flat[b], flat[b + step]) <= n[b] + n[b + step]]
            left.append(b)
            right.append(b + step)
    left, right = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(y[left], y[right]), np.maximum(y[left], y[right])]), axis=1)
    return pd.DataFrame({"x": pairs[0], "y": pairs[1]})


def _crossing(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Possible pairs (x, y) of members (g, y, n, k) of one group that lie in different components.

    Pairs are compared by their sketches inside packed parts of many groups, and
    only those that pass become rows; a group of more than TILE members is dealt
    out in tiles of two blocks.  A pair may meet in many groups; it is one row of
    each part, so there are no more parts than the number of members asks for.
    """
    sketches = sets.groupBy(F.col("s").alias("_s")).agg(F.first("sketch").alias("sketch"))
    members = stored(members.select("g", "y", "n", "k").distinct().join(sketches, F.col("y") == F.col("_s")).drop("_s"), "sketched-members")
    large = members.groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TILE)
    large = stored(large.select("_g", F.ceil(F.lit(2) * F.col("_n") / TILE).cast("int").alias("_t")), "large-groups")
    tiles = F.coalesce("_t", F.lit(1))
    rows = members.join(large, F.col("g") == F.col("_g"), "left").withColumn("side", F.pmod(F.xxhash64("y"), tiles).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    rows = rows.select("g", "y", "n", "k", "sketch", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    parts = max(8, -(-rows.count() // PART_MEMBERS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("g", "i", "j"), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(_near_in_groups, "x long, y long").distinct()


def _rare_prefixes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (g: element, y, n, k) of groups by the rarest elements of each of the ``nodes`` (y, k).

    In one order of all elements, rarest first, two alike sets meet within the
    first quarter and one of both.  What many texts share comes last there, so
    texts meet on it only if hardly anything else is in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rounds(batches, column="elements"):
            e = np.frombuffer(b"".join(b.column("elements").to_pylist()), np.int64)
            pick = pa.array(np.repeat(np.arange(b.num_rows), b.column("n").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(e), *(b.column(c).take(pick) for c in "ynk")], ["e", "y", "n", "k"])

    chosen = sets.select(F.col("s").alias("_s"), "n", "elements").join(nodes, F.col("_s") == F.col("y")).select("y", "n", "k", "elements")
    every = stored(chosen.mapInArrow(run, "e long, y long, n long, k long"), "open-elements")
    often = every.groupBy(F.col("e").alias("_e")).agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("y").orderBy("often", "e")
    ranked = every.join(often, F.col("e") == F.col("_e")).withColumn("place", F.row_number().over(order))
    kept = stored(ranked.where("place <= floor(n / 4) + 1 and often > 1").select(F.col("e").alias("g"), "y", "n", "k"), "rare-prefixes")
    mixed = kept.groupBy(F.col("g").alias("_g")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("_g")
    return kept.join(mixed, F.col("g") == F.col("_g"), "left_semi")


def link_sets(sets: DataFrame, parts: int) -> DataFrame:
    """Links (x, y) between sets, enough of them to connect all that are alike directly or through others.

    In groups of up to SMALL members every pair between components is tried.
    Members of larger ones that are still apart meet by their rarest elements.
    """
    groups = stored(_groups(sets, parts), "groups")
    stars = groups.where("edge").groupBy("x", "y").agg(F.sum("c").alias("c"))
    best = stars.groupBy("y").agg(F.max_by("x", F.struct("c", "x")).alias("x"))
    links = stored(_verified(best, sets), "star-links")

    sizes = sets.select(F.col("s").alias("_s"), "n").distinct()
    members = groups.where("not edge").select(F.col("x").alias("g"), "y").distinct().join(sizes, F.col("y") == F.col("_s")).select("g", "y", "n")
    opened = _labelled(members, components(links))
    # The smallest member has the least that is its own, so it is likest to most of the others.
    second = opened.where(F.col("k") != F.col("least.k")).select(F.col("least.y").alias("x"), "y").distinct()
    second = _verified(stored(_possible(second, sets), "possible-stars"), sets)
    links = stored(links.unionByName(second), "links-to-least")
    opened = _labelled(opened.select("g", "y", "n"), components(links))

    few = opened.where(F.col("size") <= SMALL).select("g", "y", "n", "k")
    nodes = opened.where(F.col("size") > SMALL).groupBy("y").agg(F.min("k").alias("k"))
    rare = _rare_prefixes(sets, nodes).select(F.xxhash64(F.lit(1), "g").alias("g"), "y", "n", "k")
    pairs = stored(_crossing(few.unionByName(rare), sets), "possible-pairs")
    return links.unionByName(_verified(pairs, sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    The component is named by its smallest doc_id.  A null or empty text, or one
    of white space, has no shingles and is a component of its own.  Rows with a
    null id may connect others but have a null component.  Repeated rows are
    repeated in the result; different texts under one id are told apart.
    """
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (12 * PART_ENTRIES)))
    profile = stored(profiles(docs, parts), "profiles")
    n = F.col("n")
    needed = F.greatest(F.lit(1), F.floor(n * 3 / 20) - 1)
    chosen = profile.where((n > 0) & (F.col("shared") >= needed)).groupBy("s").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
    sets = stored(_sets(docs, chosen), "sets")
    label = components(link_sets(sets, parts)).select(F.col("node").alias("_s"), F.col("component").alias("k"))

    of_set = profile.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"))
    of_set = stored(of_set.join(label, F.col("s") == F.col("_s"), "left").select("s", F.coalesce("k", "s").alias("k"), "least"), "set-labels")
    least = of_set.groupBy(F.col("k").alias("_k")).agg(F.min("least").alias("component"))
    of_set = stored(of_set.join(least, F.col("k") == F.col("_k")).select(F.col("s").alias("_s"), "component"), "set-components")
    joined = profile.join(of_set, (F.col("s") == F.col("_s")) & (n > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component of ``docs``: of its smallest id, or of none if no row has one; equal rows are one.

    Components are those of near copies, whatever the rows' ids: other texts under
    one id are told apart, and rows with a null id take part.  Texts without
    shingles have no copies but equal rows.  Rows that agree in id and text alone
    leave the smallest of them.
    """
    key = F.xxhash64(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text").isNull().alias("empty"), F.coalesce("text", F.lit("")).alias("text")))
    keyed = docs.withColumn("_keep_key", key)
    near = stored(near_duplicates(keyed.select(F.col("_keep_key").alias("doc_id"), "text")), "near-rows")
    rows = near.groupBy(F.col("doc_id").alias("_keep_row")).agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("_keep_times"))
    ids = keyed.select("_keep_key", "doc_id").distinct()
    rows = stored(rows.join(ids, F.col("_keep_row") == F.col("_keep_key")).drop("_keep_key"), "keyed-rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_keep_row", "_keep_times")).alias("first"))
    first = stored(first.select("first._keep_row", "first._keep_times"), "first-rows")
    kept = keyed.join(first, F.col("_keep_key") == F.col("_keep_row"))
    once = kept.where("_keep_times = 1").select(docs.columns)
    # Only repeated rows are shuffled once more, after a reduction where they are.
    least = stored(kept.where("_keep_times > 1"), "repeated-rows").groupBy("_keep_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(least.select("row.*"))
