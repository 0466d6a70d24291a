"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered, so equal blocks, and
only those, have equal names. Names of neighbours are then paired, the distinct pairs sorted and numbered in turn, until
a document is one name: two documents have the same name at the same level only if their texts are equal. No hash
decides: a hash only deals blocks to tasks and shortens the join key, and blocks whose hashes clash are joined by content.

A document with a name that occurs once is equal to none, and takes no further part. Numbers are dense within a bucket of
names and carry the bucket above, so that no task sees all names; a name that a third of all rows hold is one row there,
since equal names are gathered before each shuffle, and joins back to a hot name are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.rows import new_names, one_of_each
from evidex.session import cut

BLOCK_BYTES = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of names; a name is bucket * 2^40 + number.
BUCKETS = 1 << 16
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
ROW = ["doc_id", "rh"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() is faster and does the same where there is ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered(names: DataFrame, keys: list[str], bucket: Column, base: int = 0) -> DataFrame:
    """Distinct keys with `name`: their number in sorted order within the bucket, and the bucket above it."""
    w = Window.partitionBy("bucket").orderBy(*keys)
    return names.withColumn("bucket", F.pmod(bucket, F.lit(BUCKETS)) + base).withColumn("name", F.shiftleft(F.col("bucket").cast("long"), 40) + F.row_number().over(w)).drop("bucket")


def _sequences(named: DataFrame) -> DataFrame:
    """The names of each document in order, without documents that hold a name which occurs once (n = 1)."""
    gathered = named.groupBy(*ROW).agg(F.min("n").alias("n"), F.array_sort(F.collect_set(F.struct("at", "name"))).alias("s")).where("n > 1")
    return cut(gathered.select(*ROW, F.col("s.name").alias("names")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hashed=F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; see exact_duplicates. hashed may be any hash to long."""
    text = F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("raw")).withColumn("rh", F.xxhash64("raw"))
    last = (F.greatest(F.lit(1), F.ceil(F.length("raw") / block_bytes)) - 1).cast("int")
    block = F.expr(f"substring(raw, at * {block_bytes} + 1, {block_bytes})")
    blocks = rows.select(*ROW, "raw", F.explode(F.sequence(F.lit(0), last)).alias("at")).select(*ROW, "at", block.alias("block")).withColumn("h", hashed("block"))
    seen = blocks.groupBy("h", "block").agg(F.count("*").alias("n")).groupBy("h").agg((F.count("*") > 1).alias("clash"), F.sum("n").alias("n"))
    names = cut(numbered(seen, ["h"], F.col("h")))
    named = blocks.select(*ROW, "at", "h").join(names.where("not clash"), "h").select(*ROW, "at", "name", "n")
    clashing = names.where("clash").select("h")
    if not clashing.isEmpty():
        hard = blocks.join(clashing, "h")
        both = numbered(hard.groupBy("h", "block").agg(F.count("*").alias("n")), ["h", "block"], F.col("h"), BUCKETS)
        named = named.union(hard.join(both, ["h", "block"]).select(*ROW, "at", "name", "n"))
    identities, level = None, 0
    while True:
        now = _sequences(named)
        done = now.where(F.size("names") == 1).select(*ROW, F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        identities = done if identities is None else identities.union(done)
        now = now.where(F.size("names") > 1)
        if now.isEmpty():
            break
        pair = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("names") - 1, 1)), lambda i: F.struct(F.element_at("names", (2 * i + 1).cast("int")).alias("left"), F.coalesce(F.get("names", 2 * i + 1), F.lit(0)).alias("right")))
        pairs = now.select(*ROW, F.posexplode(pair).alias("at", "pair")).select(*ROW, "at", "pair.left", "pair.right")
        seen = numbered(pairs.groupBy("left", "right").agg(F.count("*").alias("n")), ["left", "right"], F.xxhash64("left", "right"))
        named = pairs.join(seen, ["left", "right"]).select(*ROW, "at", "name", "n")
        level += 1
    found = cut(rows.select(*ROW, F.sha2("raw", 256).alias("text_sha256")).join(identities, ROW, "left"))
    groups = found.where("name is not null").groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    alone = found.where("name is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    every = alone.union(found.where("name is not null").join(groups, ["level", "name"]).select(*out))
    return every.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.nullif("keep_id", F.lit(NO_ID)).alias("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, keep_id, group_size, kept, text_sha256, one for each row of docs.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and blank texts are compared like
    any other. Of equal texts the row with the largest doc_id stays; repeated rows share their doc_id and stay or go
    together. Null doc_ids rank below all others. No documents give no rows. Columns besides doc_id and text are not read.
    """
    return exact_groups(docs)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all columns, whatever their names. Rows go by doc_id
    and text; of repeated rows, or several of a null doc_id, one stays. No documents give no rows."""
    found = exact_groups(docs)
    sha, gone_sha, gone_id = new_names(docs, "sha", "gone_sha", "gone_id")
    keyed = docs.withColumn(sha, F.sha2(F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8"), 256))
    gone = found.where("not kept or kept is null and keep_id is not null").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    stay = keyed.join(gone, (F.col(sha) == F.col(gone_sha)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
    again = found.where("kept").groupBy("text_sha256").agg(F.count("*").alias("n")).where("n > 1").select(F.col("text_sha256").alias(sha))
    return one_of_each(stay, again, sha, ["text"]).select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
