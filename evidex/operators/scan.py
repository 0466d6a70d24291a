"""Running values within a key that is too large for one task.

Rows of a key lie in parts, in order: ranges of sorted rows, or blocks of a file. A running value is what the earlier parts
of its key come to, plus a window within the part. What a part comes to is one row; these few rows are scanned by key, and
joined back by key and part, so that no task ever holds a whole key and no join key is hot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import cut

#: A part's value, and how values of parts come together.
Fold = tuple[Column, Callable[[Column], Column]]


def ranged(df: DataFrame, keys: tuple[str, ...], order: tuple[str | Column, ...]) -> DataFrame:
    """df with `part`: ranges of (keys, order), sorted, kept in the shared folder so that all reads agree on them."""
    by = [*keys, *order]
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()))


def within(keys: tuple[str, ...], order: tuple[str | Column, ...], part: str = "part"):
    """The rows of a part up to this one."""
    return Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def carry(df: DataFrame, keys: tuple[str, ...], part: str = "part", before: dict[str, Fold] | None = None, whole: dict[str, Fold] | None = None, derived: dict[str, Column] | None = None, nullable: bool = True) -> DataFrame:
    """df with a column for each name: `before` folds the parts ahead of the row's own (NULL in the first), `whole` all parts
    of its key, `derived` is worked out from these once a part. Null keys are a key; where there are none, `nullable` off
    lets joins share their shuffle with windows."""
    before, derived = before or {}, derived or {}
    folds = before | (whole or {})
    sums = df.groupBy(*keys, part).agg(*(value.alias(name) for name, (value, _) in folds.items()))
    all_parts = Window.partitionBy(*keys)
    ahead = all_parts.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    on = [*keys, part]
    sums = sums.select(*on, *(fold(F.col(n)).over(ahead if n in before else all_parts).alias(n) for n, (_, fold) in folds.items())).withColumns(derived)
    if not nullable:
        return df.join(sums, on)
    sums = sums.withColumnsRenamed({c: f"{c}__" for c in on})
    match = reduce(and_, (df[c].eqNullSafe(sums[f"{c}__"]) for c in on))
    return df.join(sums, match).drop(*(f"{c}__" for c in on))


def ranked(df: DataFrame, keys: tuple[str, ...], order: tuple[str | Column, ...], rank: str = "rank", n: str = "n") -> DataFrame:
    """df with `rank`, from 0 in the given order within keys, and `n`, the rows of the key."""
    r = ranged(df, keys, order)
    r = carry(r, keys, before={"before__": (F.count("*"), F.sum)}, whole={n: (F.count("*"), F.sum)})
    local = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    return r.withColumn(rank, F.coalesce("before__", F.lit(0)) + local - 1).drop("before__", "part")
