"""Window functions over long series, evaluated block by block.

A plain window ``PARTITION BY series ORDER BY ts`` puts a whole series into one
task, and one series may hold a large part of the data.  The helpers here split
each series into blocks of the order column (a calendar month, an hour, a slice
of the value range), run the window inside each block, and carry the little
state that crosses a block border (a running total, the last known value) in a
summary with one row per block.  The results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreshock.functions.expr import col
from foreshock.functions.reuse import join_back, keep


def time_block(ts: str | Column, unit: str = "month") -> Column:
    """Calendar block of a timestamp."""
    return F.date_trunc(unit, col(ts))


def carry_back(
    df: DataFrame, keys: Sequence[str], block: str, order: str, cols: Sequence[str]
) -> DataFrame:
    """Add ``prev_<c>``: value of ``c`` on the previous row of the same key."""
    keys = list(keys)
    inside = Window.partitionBy(*keys, block).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(block)
    last = df.groupBy(*keys, block).agg(
        F.max_by(F.struct(*cols), F.col(order)).alias("_last")
    )
    carried = last.select(*keys, block, F.lag("_last").over(across).alias("_carry"))
    out = df.withColumn("_rn", F.row_number().over(inside))
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(inside))
    out = join_back(out, carried, [*keys, block], "left")
    for c in cols:
        out = out.withColumn(
            f"prev_{c}", F.when(F.col("_rn") == 1, F.col(f"_carry.{c}")).otherwise(F.col(f"prev_{c}"))
        )
    return out.drop("_rn", "_carry")


def running_sum(
    df: DataFrame, keys: Sequence[str], block: str, order: str, sums: Mapping[str, Column]
) -> DataFrame:
    """Add one inclusive running total per entry of ``sums``, in ``order``."""
    keys = list(keys)
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    offsets = totals.select(
        *keys, block, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    out = df.select("*", *[F.sum(e).over(inside).alias(f"_c_{n}") for n, e in sums.items()])
    out = join_back(out, offsets, [*keys, block])
    return out.select(
        *df.columns, *[(F.col(f"_c_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], block: str, order: str, value: str
) -> DataFrame:
    """Add the nearest non-null observation at or before, and at or after, each row.

    New columns: ``lo_<order>``, ``lo_<value>``, ``hi_<order>``, ``hi_<value>``.
    """
    keys = list(keys)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    inside = Window.partitionBy(*keys, block).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, Window.unboundedFollowing)
    edges = df.groupBy(*keys, block).agg(
        F.max_by(point, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"),
        F.min_by(point, F.when(F.col(value).isNotNull(), F.col(order))).alias("_first"),
    )
    across = Window.partitionBy(*keys).orderBy(block)
    edges = edges.select(
        *keys,
        block,
        F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_back"),
        F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_fwd"),
    )
    out = df.select(
        "*",
        F.last(point, ignorenulls=True).over(upto).alias("_lo"),
        F.first(point, ignorenulls=True).over(onward).alias("_hi"),
    )
    out = join_back(out, edges, [*keys, block], "left")
    lo, hi = F.coalesce("_lo", "_back"), F.coalesce("_hi", "_fwd")
    return out.select(
        *df.columns,
        lo["o"].alias(f"lo_{order}"),
        lo["v"].alias(f"lo_{value}"),
        hi["o"].alias(f"hi_{order}"),
        hi["v"].alias(f"hi_{value}"),
    )


def with_halo(df: DataFrame, ts: str, before_s: float, after_s: float, block_s: int) -> DataFrame:
    """Copy each row into every block whose frames can see it.

    Adds ``block`` and ``owned``.  A frame reaching ``before_s`` back and
    ``after_s`` ahead can then be evaluated per ``(key, block)``; rows with
    ``owned`` false only feed frames of the neighbouring block and are dropped
    afterwards.
    """
    sec = F.unix_micros(F.col(ts)) / F.lit(1e6)
    first = F.floor((sec - F.lit(after_s)) / F.lit(block_s)).cast("long")
    last = F.floor((sec + F.lit(before_s)) / F.lit(block_s)).cast("long")
    own = F.floor(sec / F.lit(block_s)).cast("long")
    return df.select("*", own.alias("_own"), F.explode(F.sequence(first, last)).alias("block")).select(
        *df.columns, "block", (F.col("block") == F.col("_own")).alias("owned")
    )


def value_histogram(
    df: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, Column], slices: int = 64
) -> DataFrame:
    """Ordered histogram of ``value`` per key with exclusive running totals.

    Ties collapse into one row by a combining aggregate.  The distinct values of
    a key are then cut into about ``slices`` ranges at approximate quantiles, so
    no task sorts a whole key; the cuts decide only where work is split, never
    the result.  The histogram is read several times and therefore persisted.  For every entry of ``counts`` the output has ``<name>`` (total
    at this value) and ``<name>_before`` (total over smaller values), and
    ``<name>_all`` (total of the key).
    """
    keys = list(keys)
    hist = keep(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(e).alias(n) for n, e in counts.items()])
    )
    probs = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = hist.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), probs, F.lit(slices * 10)).alias("_cuts"),
    )
    v = F.col(value).cast("double")
    cut = join_back(hist, cuts, keys) if keys else hist.crossJoin(F.broadcast(cuts))
    cut = cut.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < v))).drop("_cuts")
    totals = cut.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(f"_t_{n}") for n in counts])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in counts],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in counts],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(n).over(inside).alias(f"_c_{n}") for n in counts])
    return join_back(local, offsets, [*keys, "_slice"]).select(
        *keys,
        value,
        *[c for n in counts for c in (
            F.col(n),
            (F.col(f"_o_{n}") + F.col(f"_c_{n}") - F.col(n)).alias(f"{n}_before"),
            F.col(f"{n}_all"),
        )],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key, one column per entry of ``probs``."""
    hist = value_histogram(df, keys, value, {"n": F.lit(1)})
    aggs = []
    for name, q in probs.items():
        h = (F.col("n_all") - F.lit(1)) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)

        def at(k: Column) -> Column:
            return F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(value)))

        share = F.max(h - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * share).alias(name))
    return hist.groupBy(*keys).agg(*aggs)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, value, avg_rank)``: tied values share their mean rank."""
    hist = value_histogram(df, keys, value, {"n": F.lit(1)})
    return hist.select(
        *keys, value, (F.col("n_before") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias("avg_rank")
    )
