"""A Merkle manifest of a dataset: one hash for all documents, and for each a proof that it belongs to it.

A leaf is the hash of a document's fields. Per source, leaves in doc_id order form a tree of runs of three, whose root is
the subroot; the subroots in source order form a tree above. Leaves are numbered by prefix sums over sorted ranges and
dealt in aligned blocks of 3^6: whole subtrees, whatever the source's size. In a task DuckDB climbs all its blocks at once,
a level a query (ordered string_agg, sha256), over Arrow tables. Spark combines the roots of blocks, one row for 729
leaves, level by level, and joins each block's proof above it to its leaves. No source, and not the whole, is ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.llm.rows import CRC
from evidex.session import cut, fresh_path, ship

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree within a block, of 3^6 leaves.
LEVELS = 6
#: Leaves that a task hands to DuckDB at once, but for the last block among them.
ROWS = 20_000
BLOCKS = "g string, b long, doc_id long, leaf string, other string, steps array<struct<left: string, right: string>>, top string"


def leaf_hash(**changed: Column) -> Column:
    """Hash of a row's fields: `-` for null, else the value's UTF-8 byte count, a colon and the value."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def group_name(source: Column) -> Column:
    """A source as a name that is never null and sorts as it does, null first."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with i, their number from 0 within g in the given order, and n, the rows of g. Sorted ranges are counted, and
    their counts summed; rows that are alike in all of `order` are dealt by where they came from, so none is too many."""
    rows = cut(rows.withColumn("tie", F.monotonically_increasing_id()))
    by = ["g", *order, "tie"]
    ranged = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    whole = Window.partitionBy("g")
    runs = ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    runs = runs.select("g", "part", (F.sum("c").over(whole.orderBy("part")) - F.col("c") - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return ranged.join(runs, ["g", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climb_blocks(table: pa.Table, levels: int) -> pa.Table:
    """(g, b, i, n, doc_id, leaf, other) of whole blocks, as BLOCKS: steps has the siblings on either side a level, top is
    the block's root, on its first leaf. A source of at most 3^levels leaves ends at its subroot."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    con.register("leaves", table)
    con.execute("CREATE TABLE nodes AS SELECT g, b, n, i AS j, leaf AS h FROM leaves")
    con.execute("CREATE TABLE proofs AS SELECT g, b, n, i, doc_id, leaf, other, CAST([] AS STRUCT(\"left\" VARCHAR, \"right\" VARCHAR)[]) AS steps FROM leaves")
    for level in range(levels):
        width = 3**level
        if not con.execute(f"SELECT count(*) FROM nodes WHERE n > {width}").fetchone()[0]:
            break
        con.execute(f"CREATE TABLE runs AS SELECT g, b, n, j // 3 AS j, sha256(string_agg(h, '' ORDER BY j)) AS h, list(h ORDER BY j) AS hs FROM nodes WHERE n > {width} GROUP BY g, b, n, j // 3")
        con.execute(f"""CREATE TABLE longer AS SELECT p.* REPLACE (CASE WHEN hs IS NULL THEN steps ELSE list_append(steps, struct_pack(
            "left" := array_to_string(hs[1 : i // {width} % 3], ''), "right" := array_to_string(hs[i // {width} % 3 + 2 : 3], ''))) END AS steps)
            FROM proofs p LEFT JOIN runs r ON p.g = r.g AND p.b = r.b AND p.i // {3 * width} = r.j""")
        con.execute(f"CREATE TABLE above AS SELECT g, b, n, j, h FROM runs UNION ALL FROM nodes WHERE n <= {width}")
        con.execute("DROP TABLE proofs; DROP TABLE nodes; DROP TABLE runs; ALTER TABLE longer RENAME TO proofs; ALTER TABLE above RENAME TO nodes")
    block = 3**levels
    out = con.cursor().sql(f"SELECT p.g, p.b, doc_id, leaf, other, steps, CASE WHEN i % {block} = 0 THEN h END AS top FROM proofs p JOIN nodes q ON p.g = q.g AND p.b = q.b").to_arrow_table()
    con.close()
    return out


def _blocks(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Climbs batches sorted by block, which are cut where a block begins."""
    fields = pa.schema([("g", pa.string()), ("b", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("other", pa.string()), ("steps", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("top", pa.string())])
    held: list[pa.RecordBatch] = []

    def climbed(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from climb_blocks(pa.Table.from_batches(some), levels).cast(fields).to_batches(max_chunksize=4096)

    for batch in batches:
        if sum(x.num_rows for x in held) >= ROWS:
            keys = list(zip(batch.column("g").to_pylist(), batch.column("b").to_pylist(), strict=True))
            last = (held[-1].column("g")[-1].as_py(), held[-1].column("b")[-1].as_py())
            start = next((k for k, key in enumerate(keys) if key != last), len(keys))
            held.append(batch.slice(0, start))
            batch = batch.slice(start)
            if batch.num_rows:
                yield from climbed(held)
                held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield from climbed(held)


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (g, i, n, h), n to a group: (g, i, steps) with the siblings at each level above, and (g, h) with the roots."""
    levels = [cut(nodes.select("g", "i", "n", "h", F.expr("cast(null as array<string>)").alias("hs")))]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("i", "h"))).alias("run")
        up = levels[-1].where("n > 1").groupBy("g", F.expr("i div 3").alias("up"), "n").agg(run)
        levels.append(cut(up.select("g", F.col("up").alias("i"), F.expr("(n + 2) div 3").alias("n"), F.sha2(F.array_join("run.h", ""), 256).alias("h"), F.col("run.h").alias("hs"))))
        most = (most + 2) // 3
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("steps")
    below, roots = None, None
    for level in reversed(levels):
        done = level.where("n = 1")
        roots = done.select("g", "h") if roots is None else roots.union(done.select("g", "h"))
        now = done.select("g", "i", none, "hs")
        if below is not None:
            at = F.expr("cast(i % 3 as int)")
            step = F.struct(F.array_join(F.slice("up_hs", F.lit(1), at), "").alias("left"), F.array_join(F.slice("up_hs", at + 2, F.lit(3)), "").alias("right"))
            above = below.select("g", F.col("i").alias("up"), F.col("steps").alias("up_steps"), F.col("hs").alias("up_hs"))
            some = level.where("n > 1").withColumn("up", F.expr("i div 3")).join(above, ["g", "up"])
            now = now.union(some.select("g", "i", F.concat(F.array(step), "up_steps").alias("steps"), "hs"))
        below = cut(now)
    return below.select("g", "i", "steps"), cut(roots)


def proofs(docs: DataFrame, other: Column | None = None, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """(doc_id, source_name, leaf, other, steps, subroot) of every row, and the root, None without rows. steps are the
    siblings left and right of the row's node, level by level from the leaf to the root. other: any hash to carry along.

    Leaves ascend by doc_id, null first, those of one doc_id by their hash; equal rows are leaves of their own. Null
    sources form a source of their own, the first.
    """
    ship(docs.sparkSession)
    hashes = docs.select(group_name(F.col("source")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("leaf"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    leaves = numbered(hashes, "doc_id", "leaf").withColumn("b", F.expr(f"i div {3**levels}"))
    dealt = leaves.select("g", "b", "i", "n", "doc_id", "leaf", "other").repartition("g", "b").sortWithinPartitions("g", "b", "i")
    blocks = cut(dealt.mapInArrow(lambda batches: _blocks(batches, levels), BLOCKS))
    tops = blocks.where("top is not null").select("g", F.col("b").alias("i"), F.count("*").over(Window.partitionBy("g")).alias("n"), F.col("top").alias("h"))
    outer, subroots = climb(tops)
    named = subroots.select(F.lit("").alias("g"), F.col("g").alias("source_name"), "h")
    named = cut(numbered(named, "source_name"))
    highest, root = climb(named)
    root = root.first()
    above = named.join(highest, ["g", "i"]).select(F.col("source_name").alias("g"), F.col("h").alias("subroot"), F.col("steps").alias("highest"))
    outer = outer.join(above, "g").select("g", F.col("i").alias("b"), F.concat("steps", "highest").alias("outer"), "subroot")
    joined = blocks.join(outer, ["g", "b"])
    return joined.select("doc_id", F.col("g").alias("source_name"), "leaf", "other", F.concat("steps", "outer").alias("steps"), "subroot"), root and root.h


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest_rows(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The query's rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one for each row of docs.

    folded_root is the root from the leaf as tampered with: where 2 divides crc32 of the decimal doc_id, the text is without
    its line feeds; a null text stays, and so does a row without doc_id. See proofs for ties and nulls. No documents give no
    rows; columns besides the five hashed are not read.
    """
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    rows, root = proofs(docs, leaf_hash(text=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))), levels)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded(F.col("other"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def write_manifest(docs: DataFrame, folder: str | None = None) -> tuple[str, str | None]:
    """Writes the proofs of docs as Parquet; returns the folder, by default a new one in the shared folder, and the root."""
    folder = folder or fresh_path(docs.sparkSession, "manifest")
    rows, root = proofs(docs)
    rows.drop("other").write.parquet(folder)
    return folder, root


def tampered(spark: SparkSession, docs: DataFrame, folder: str, root: str | None) -> DataFrame:
    """(doc_id, found) of what no longer agrees with a manifest: rows whose leaf is not in it (`changed`), leaves without a
    row (`missing`, counted: equal rows are leaves of their own), and proofs that don't fold to the root (`proof`)."""
    proved = spark.read.parquet(folder)
    now = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), group_name(F.col("source")).alias("source_name"), leaf_hash().alias("leaf")).agg(F.count("*").alias("here"))
    then = proved.groupBy("doc_id", "source_name", "leaf").agg(F.count("*").alias("there"))
    both = now.alias("a").join(then.alias("b"), F.expr("a.leaf = b.leaf and a.source_name = b.source_name and a.doc_id <=> b.doc_id"), "full_outer")
    differ = both.select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), (F.coalesce("here", F.lit(0)) - F.coalesce("there", F.lit(0))).alias("more")).where("more <> 0")
    wrong = proved.where(~folded(F.col("leaf"), F.col("steps")).eqNullSafe(F.lit(root)))
    return differ.select("doc_id", F.when(F.col("more") > 0, "changed").otherwise("missing").alias("found")).union(wrong.select("doc_id", F.lit("proof")))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT coalesce('1' || source, '0') AS g, doc_id, text, """ + CRC.format("doc_id::VARCHAR") + """ % 2 = 0 AS even,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents),
hashed AS (SELECT g, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS other FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
nodes AS (
  SELECT g, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 3, n),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 3, n),
low AS (
  SELECT l.g, l.i, lvl, coalesce(string_agg(h, '' ORDER BY x.i) FILTER (x.i < l.i // (3 ** lvl)::BIGINT), '') AS a, coalesce(string_agg(h, '' ORDER BY x.i) FILTER (x.i > l.i // (3 ** lvl)::BIGINT), '') AS b
  FROM leaves l JOIN nodes x ON l.g = x.g AND l.i // (3 ** (lvl + 1))::BIGINT = x.i // 3 AND x.n > 1 GROUP BY l.g, l.i, lvl),
high AS (
  SELECT s.g, lvl, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < s.i // (3 ** lvl)::BIGINT), '') AS a, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > s.i // (3 ** lvl)::BIGINT), '') AS b
  FROM subroots s JOIN tops x ON s.i // (3 ** (lvl + 1))::BIGINT = x.i // 3 AND x.n > 1 GROUP BY s.g, lvl),
lows AS (SELECT g, i, list(a || '|' || b ORDER BY lvl) AS steps FROM low GROUP BY g, i),
highs AS (SELECT g, list(a || '|' || b ORDER BY lvl) AS steps FROM high GROUP BY g),
every AS (
  SELECT doc_id, leaf, other, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, list_concat(coalesce(w.steps, []), coalesce(v.steps, [])) AS steps
  FROM leaves l JOIN subroots s ON l.g = s.g LEFT JOIN lows w ON l.g = w.g AND l.i = w.i LEFT JOIN highs v ON l.g = v.g),
done AS (
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
    list_reduce(steps, lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2)), other) AS folded_root FROM every)
SELECT *, folded_root = root AS verified FROM done
"""
