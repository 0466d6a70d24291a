"""Column helpers for the rules that every operator shares: missing values, ties, degenerate statistics, random draws.

Missing is NULL throughout, never NaN; ties are broken by an id; division by zero is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nn(x: Column | str) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(col(x)), col(x))


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def avg_rank(value: Column, keys: list, descending: bool = False) -> Column:
    """Rank from 1 within keys, ties sharing their mean rank; NULL for NULL."""
    ahead = Window.partitionBy(*keys).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last())
    same = Window.partitionBy(*keys, value)
    return F.when(value.isNotNull(), F.rank().over(ahead) + (F.count("*").over(same) - 1) / 2.0)


def corr0(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the pairs without NULL; 0 with fewer than three, or where a side is constant. An aggregate."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count(x) < 3)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(flat, 0.0).otherwise(F.coalesce(r, F.lit(0.0)))


def p_from_counts(n_ge: Column, n: Column) -> Column:
    """(1 + draws at least as large) / (1 + draws), never 0; NULL without draws."""
    return F.when(n > 0, (1.0 + n_ge) / (1.0 + n))


def uniform(*parts: Column | str | int) -> Column:
    """A draw in [0, 1) named by its parts: the first 52 bits of an MD5, equal in any engine and for any partitioning."""
    text = F.concat_ws("|", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / 4503599627370496.0


def fast_uniform(*parts: Column | str | int) -> Column:
    """As uniform, by xxhash64: faster, and Spark's own."""
    bits = F.shiftrightunsigned(F.xxhash64(*((p if isinstance(p, Column) else F.lit(p)) for p in parts)), 11)
    return bits / float(1 << 53)


def null_non_finite(x: Column) -> Column:
    """NaN and infinities as NULL, as JSON has neither."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
