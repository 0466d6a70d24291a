"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources share a budget of words by weight; a source whose share would exceed `most` times its size stops there, and what
is left is shared again by weight.
A source with target / size = copies takes every document floor(copies) times, whole, and samples the words that it still
lacks: a document's inclusion probability p grows with the square root of its size, so that the shortest texts are repeated
least, and is scaled so that the expected words are those that are lacking. Documents whose p would reach 1 are certain and
set apart. The others draw a uniform number from their doc_id and are ranked by its odds u / (1 - u) divided by their
inclusion odds p / (1 - p); the lowest ranks are taken until their words reach what is lacking.

No task sorts a source. Sizes are rounded down to eight classes a doubling, so the scale comes from a few hundred sums a
source. Ranks are cut into BUCKETS narrow buckets, whose words are summed before the shuffle, then the bucket in which the
source's budget ends is cut in the same way, until it holds few documents: only these are sorted, whatever the source's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of ranks at each step, and documents in the last one on average at most.
BUCKETS, BUCKET_DOCS = 1_024, 2_000
#: Rows up to which a counted table is broadcast.
SMALL_TABLE = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on key and seed only: 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """sources (source, source_size) with `target`. The table has a row a source, so its windows are small.

    Weights go by the source's rank by code point, null last, and repeat. Sources that stop at their limit are a prefix
    in the order of limit / weight, so one pass of running sums finds where resharing ends.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * most
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    shared = sources.select("source", "source_size", weight.alias("weight"), limit.alias("limit")).withColumn("level", level)
    stops = F.col("limit") <= F.col("level") * F.col("weight")
    last = F.min(F.when(~stops, F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level")))
    level = last.over(Window.partitionBy())["level"]
    return shared.withColumn("stops", stops).select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


def size_class(size: Column) -> Column:
    """The size with all but its four leading bits cleared."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def inclusion(sources: DataFrame, sized: DataFrame) -> DataFrame:
    """sources (source, lacks) with k, top and rest: p = k * sqrt(class) for classes up to top, those above are certain, and
    rest is what these leave of the words that are lacking. sized: (source, class, words), a few hundred rows a source."""
    s = sources.withColumnRenamed("source", "own_source")
    each = sized.join(s.select("own_source", "lacks"), sized["source"].eqNullSafe(s["own_source"]))
    by = Window.partitionBy("source")
    larger = F.sum("words").over(by.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1))
    spread = F.sum(F.col("words") * F.sqrt("class")).over(by.orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("rest", F.col("lacks") - F.coalesce(larger, F.lit(0))).withColumn("k", F.col("rest") / spread)
    best = each.where(F.col("k") * F.sqrt("class") < 1).groupBy("source").agg(F.max(F.struct("class", "k", "rest")).alias("x"))
    best = best.select(F.col("source").alias("own_source"), "x.k", F.col("x.class").alias("top"), "x.rest")
    return sources.join(best, sources["source"].eqNullSafe(best["own_source"]), "left").drop("own_source")


def placed(rows: DataFrame, goals: DataFrame, few: bool, buckets: int) -> DataFrame:
    """rows (source, size, u) with their source's goals, rank, its bucket, and whether an extra copy is certain."""
    g = goals.withColumnRenamed("source", "goal_source")
    out = rows.join(F.broadcast(g) if few else g, rows["source"].eqNullSafe(g["goal_source"])).drop("goal_source")
    sure = (F.col("size") > 0) & (F.col("class") > F.col("top"))
    p = F.when((F.col("size") > 0) & (F.col("class") <= F.col("top")) & (F.col("k") > 0), F.col("k") * F.sqrt("class"))
    out = out.withColumn("class", size_class(F.col("size"))).withColumn("certain", F.coalesce(sure, F.lit(False))).withColumn("p", p)
    out = out.withColumn("rank", F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    return out.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets))


def plan(own: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> tuple[DataFrame, bool, int]:
    """A row a source: source_size, target, whole, k, top, rest, and the bucket `end` in which its budget ends, with the words
    `before` it; whether these rows are few, and how many buckets there are. own: (source, size, u) of all documents."""
    sized = cut(own.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    sources = sized.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    goals = targets(sources, share, most, weights)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("whole", F.floor(copies)).withColumn("lacks", F.col("target") - F.floor(copies) * F.col("source_size"))
    goals = cut(inclusion(goals, sized.where("class > 0").select("source", "class", "words")).select("source", "source_size", "target", "whole", "k", "top", "rest"))
    few = goals.count() <= SMALL_TABLE
    steps = max(1, math.ceil(math.log(max(1, (sources.agg(F.max("n")).first()[0] or 1) / BUCKET_DOCS), BUCKETS)))
    goals = goals.withColumns({"end": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for step in range(1, steps + 1):
        rows = placed(own, goals, few, BUCKETS**step).where(F.floor(F.col("bucket") / BUCKETS) == F.col("end"))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("so_far"))
        sums = sums.withColumn("so_far", F.col("so_far") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ends = sums.where("so_far < rest and so_far + words >= rest").select(F.col("source").alias("end_source"), F.col("bucket").alias("end"), F.col("so_far").alias("before"))
        goals = goals.drop("end", "before")
        goals = cut(goals.join(ends, goals["source"].eqNullSafe(ends["end_source"]), "left").drop("end_source"))
    return goals, few, BUCKETS**steps


def decided(rows: DataFrame, goals: DataFrame, few: bool, buckets: int) -> tuple[DataFrame, DataFrame]:
    """rows with `times`, how often each is taken; and those in the bucket where their source's budget ends, undecided."""
    at = placed(rows, goals, few, buckets)
    last = F.coalesce(F.col("bucket") == F.col("end"), F.lit(False))
    extra = F.col("certain") | F.coalesce(F.col("bucket") < F.col("end"), F.lit(False))
    return at.where(~last).withColumn("times", F.col("whole") + extra.cast("long")), at.where(last)


def ending(at: DataFrame, *order: str) -> DataFrame:
    """The rows of the last buckets with `times`: the source's words come as near to its budget as whole documents allow."""
    so_far = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", *order).rowsBetween(Window.unboundedPreceding, 0))
    extra = F.abs(so_far - F.col("rest")) <= F.abs(so_far - F.col("size") - F.col("rest"))
    return at.withColumn("times", F.col("whole") + extra.cast("long"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The query's rows: doc_id, size, source_size, target and taken, the words that the mix takes, whole copies only.

    A null text has size 0 and is taken 0 words; documents without words are never sampled. Null is a source of its own,
    the last. A source without words has target 0. Repeated rows draw the same number and are taken or left one by one
    in any order, so the taken words are the same on each run; so are rows of a null doc_id. No documents give no rows.
    Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    own = cut(own.withColumn("u", uniform(F.col("doc_id"), seed)))
    known, last = decided(own, *plan(own, share, most, weights))
    out = known.unionByName(ending(last, "doc_id", "size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, with all columns, whatever their names.

    Rows go by doc_id, source and text; a null doc_id draws by source and text. Rows equal in these are taken equally often,
    the lesser. Those without words are left out. Only the rows in the last buckets are shuffled, not the texts.
    """
    whole_row = F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    key = F.xxhash64("doc_id", "source", "text")
    rows = docs.select(whole_row.alias("row"), key.alias("row_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.col("doc_id").alias("id"))
    rows = rows.withColumn("u", uniform(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row"), F.col("row_key").cast("string"))), seed))
    own = cut(rows.select("row_key", "id", "source", "size", "u"))
    goals = plan(own, share, most, weights)
    known, last = decided(rows.where("size > 0"), *goals)
    some = ending(decided(own, *goals)[1], "id", "size").groupBy("row_key").agg(F.min("times").alias("times"))
    out = known.select("row", "times").union(last.select("row", "row_key").join(some, "row_key").select("row", "times"))
    out = out.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return out.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))


def oracle_sql(share: float = 1.5, most: float = 2.0, seed: str = "mix") -> str:
    w1, w2, w3 = WEIGHTS
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size)::DOUBLE * {most}::DOUBLE AS lim,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN {w1}::DOUBLE WHEN 1 THEN {w2}::DOUBLE ELSE {w3}::DOUBLE END AS weight FROM d GROUP BY source),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * {share}::DOUBLE - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS k FROM s WINDOW o AS (ORDER BY lim / weight, encode(source) NULLS LAST)),
t AS (SELECT source, source_size, CASE WHEN lim <= level * weight THEN lim ELSE (SELECT arg_min(level, k) FROM l WHERE NOT lim <= level * weight) * weight END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM t),
h AS (SELECT *, floor(copies) AS whole, target - floor(copies) * source_size AS lacks FROM g),
e AS (SELECT *, (size >> greatest(length(bin(size)) - 4, 0)) << greatest(length(bin(size)) - 4, 0) AS class FROM d),
c AS (SELECT source, class, sum(size) AS words FROM e WHERE size > 0 GROUP BY source, class),
b AS (SELECT c.source, class, h.lacks - coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
    sum(words::DOUBLE * sqrt(class)) OVER (PARTITION BY c.source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spread FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source),
k AS (SELECT source, arg_max(rest / spread, class) AS k, max(class) AS top, arg_max(rest, class) AS rest FROM b WHERE rest / spread * sqrt(class) < 1 GROUP BY source),
f AS (SELECT e.*, h.source_size, h.target, h.whole, k.top, k.rest, CASE WHEN size > 0 AND class <= top AND k.k > 0 THEN k.k * sqrt(class) END AS p
    FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source LEFT JOIN k ON e.source IS NOT DISTINCT FROM k.source),
r AS (SELECT *, sum(CASE WHEN p IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY u / (1 - u) / (p / (1 - p)) NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM f)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND class > top THEN 1
    WHEN p IS NOT NULL AND so_far - size < rest AND (so_far < rest OR abs(so_far - rest) <= abs(so_far - size - rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
