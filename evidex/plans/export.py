"""JSON of results: NaN, infinities and missing values are null, timestamps ISO-8601."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex.functions.semantics import null_non_finite


def jsonable(x: Column, kind: T.DataType) -> Column:
    """x with what JSON lacks replaced, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return null_non_finite(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: jsonable(v, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(jsonable(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return x


def to_json(df: DataFrame, keys: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """(keys, json): each row as an object, nulls included; columns in drop are left out."""
    fields = [f for f in df.schema.fields if f.name not in drop]
    body = F.struct(*(jsonable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields))
    return df.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def nested(one: DataFrame, many: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """A row a key of `one`, with each table of many as an array of its rows in the order of their columns."""
    out = one
    for name, df in many.items():
        rest = [c for c in df.columns if c not in keys]
        out = out.join(df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), keys, "left")
    return out
