"""Small Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400

# Coefficients of the erfc polynomial, Abramowitz and Stegun 7.1.26.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise ``ValueError`` naming every column of ``names`` missing from ``df``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; found {df.columns}")


def failing_rows(df: DataFrame, broken: Column, message: Column) -> DataFrame:
    """No rows of ``df``; raises ``message`` when any row is ``broken``.

    ``broken`` must read a column of each side of a preceding join, so that the
    optimizer cannot evaluate it before the join.
    """
    return df.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))


def rounded(c: str | Column, places: int = 6) -> Column:
    """Round for comparison across engines.

    The small shift keeps exact half-way decimals on one side in every engine
    and turns a negative zero into zero.
    """
    return F.round(col(c) + F.lit(1e-9), places)


def valid_sample(c: str | Column) -> Column:
    """A sample counts when it is neither missing, NaN nor zero; else NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (c != 0), c)


def safe_divide(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is zero."""
    return a / F.nullif(b, F.lit(0.0))


def zero_divide(a: Column, b: Column) -> Column:
    """``a / b`` with the convention that division by zero gives 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows with both values; NULL when either is constant."""
    x, y = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    return safe_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0 (error below 1.5e-7)."""
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + F.lit(a)) * k
    return poly * F.exp(-z * z)


def log_erfc(z: Column) -> Column:
    """ln of :func:`erfc`; falls with z however far out."""
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + F.lit(a)) * k
    return F.log(poly) - z * z


def epoch(c: str | Column) -> Column:
    """Seconds since 1970 as DOUBLE, keeping microseconds."""
    return F.unix_micros(col(c)).cast("double") / F.lit(1e6)


def day_start(c: str | Column) -> Column:
    return F.date_trunc("day", col(c))


def window_start(ts: str | Column, seconds: int) -> Column:
    """Start of the fixed window of ``seconds`` that holds ``ts``.

    Windows are aligned to midnight as long as the width divides a day, which
    :func:`check_divides_day` asserts.
    """
    return F.timestamp_seconds(F.floor(F.unix_seconds(col(ts)) / F.lit(seconds)) * F.lit(seconds))


def check_divides_day(seconds: int) -> None:
    if seconds <= 0 or SECONDS_PER_DAY % seconds:
        raise ValueError(f"window of {seconds} s must divide a day")


# Modulus and multipliers of the order key (largest prime below 2^31).
KEY_MODULUS = 2147483647
KEY_STEP, KEY_SEED_STEP, KEY_MIX = 48271, 69621, 16807


def shuffle_key(id_col: str | Column, seed: int | str | Column) -> Column:
    """Deterministic pseudo-random order key of an id under a seed, in [0, 2^31 - 1).

    Plain integer arithmetic, so any engine gives the same order; every product
    stays below 2^63.
    """
    m = F.lit(KEY_MODULUS).cast("long")
    seed = (F.lit(seed) if isinstance(seed, int) else col(seed)).cast("long")
    factor = (F.pmod(seed, m) * F.lit(KEY_SEED_STEP) + F.lit(KEY_STEP)) % m
    first = ((F.pmod(col(id_col).cast("long"), m) + F.lit(1)) * factor) % m
    return (first * F.lit(KEY_MIX) + F.lit(11)) % m


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation at ``x``; copies the known side when one is missing."""
    inner = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0.0)))
    return F.when(y0.isNull(), y1).when(y1.isNull(), y0).otherwise(inner)


def literal_table(spark: SparkSession, name: str, values: Sequence[object]) -> DataFrame:
    """One-column table of a short list of constants, without a Python worker."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
