"""Rows told apart by what they hold, for stages that drop rows: doc_ids may be null, repeated or name several texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import cut

#: DuckDB SQL for crc32 of a short ASCII string, bit by bit.
CRC = "xor(list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT), lambda c, x: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, x)), 4294967295), 4294967295)"


def new_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted which no column of df has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_of_each(df: DataFrame, keys: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with the first row only, in the given order, for each of the keys; other rows all stay. Without keys, the usual
    case, df is not shuffled. keys: a table of the column `key`."""
    keys = cut(keys)
    if keys.isEmpty():
        return df
    (nth,) = new_names(df, "nth")
    some = df.join(keys, key, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return df.join(keys, key, "left_anti").unionByName(some.where(F.col(nth) == 1).drop(nth))
