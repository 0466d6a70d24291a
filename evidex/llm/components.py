"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.session import cut


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _edges(df: DataFrame, u, v) -> DataFrame:
    return df.select(u.alias("u"), v.alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with an edge to another one; root is the component's smallest node.

    Every round hangs the neighbours of a node from the smallest one (minima are pre-aggregated before each
    shuffle, so a hub costs one row a task); rounds are about the logarithm of the longest path. Each round is
    cut by a checkpoint. Nulls, self loops and repeated edges are ignored; no edges give no rows.
    """
    a, b = F.col(a), F.col(b)
    e = cut(_edges(edges.where(a.isNotNull() & b.isNotNull()), F.greatest(a, b), F.least(a, b)))
    before = _signature(e)
    while before[0]:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _edges(both.where("v > u").join(low, "u"), F.col("v"), F.col("m"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
        e = cut(_edges(stars, F.col("s.u"), F.col("s.m")))
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
