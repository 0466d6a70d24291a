"""Near-duplicates by SimHash fingerprints, searched in a Gray-order hierarchical index.

Fingerprints are linked when at most `radius` of their 64 bits differ. Two orders are searched: Gray order of the
fingerprints, and of the fingerprints turned by 32 bits. Of the two halves of a fingerprint one holds at most radius // 2
of the differences, so in one of the orders two linked fingerprints differ in that many of the first 32 bits at most.

* A run of neighbours in Gray order shares its leading bits. The upper nodes of the index are such runs, and Spark deals
  every distinct fingerprint to its own node and, as a query, to the other nodes whose shared bits differ from its own in
  no more bits than allowed. A node with over NODE_LIMIT fingerprints is parted by further bits, differences adding up,
  until none is larger; whatever the fingerprints, a task gets nodes of a bounded size.
* Within a node, fingerprints are sorted by Gray rank and the bits shared by a run of FANOUT neighbours are factored out
  into a node above it, level by level. A search adds up the differences from the root down and leaves a whole run as
  soon as they exceed what is allowed, or when run and query are linked already.

A task returns the links of a spanning forest only, never all pairs of a group; components.py joins the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.components import connected_components
from evidex.llm.rows import new_names, one_of_each
from evidex.session import cut, ship

#: Fingerprints in a node of the index that one task searches.
NODE_LIMIT = 16_384
#: Fingerprints from other nodes that one task searches in a node.
QUERY_LIMIT = 200_000
TASK_ROWS = 200_000
FANOUT = 8
#: Pairs of a query and a node that a search looks at in one step.
FRONTIER = 1 << 20
HALF = 32
#: Rows up to which a table of nodes is broadcast.
SMALL_TABLE = 50_000
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(raw: bytes, words_per_shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text: XXH64 (seed 42) of its word shingles, a bit for each majority; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    k = words_per_shingle
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else iter([b" ".join(words)])
    n = max(1, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        h = np.fromiter(map(_hash, shingles) if n - start <= 1 << 16 else (_hash(next(shingles)) for _ in range(1 << 16)), np.uint64, min(n - start, 1 << 16))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the unsigned fingerprint's bits as a long. Null texts count as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def flips(bits: int, most: int) -> list[int]:
    """The numbers of `bits` bits with at most `most` ones."""
    return [sum(1 << i for i in c) for k in range(min(bits, most) + 1) for c in combinations(range(bits), k)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    r = x.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Forest:
    """Components of row numbers, with vectorised merging."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            a, b = np.minimum(a, b), np.maximum(a, b)
            a, b = a[keep := a != b], b[keep]
            np.minimum.at(root, b, a)
            while not np.array_equal(up := root[root], root):
                root[:] = up


class GrayIndex:
    """Levels of nodes over fingerprints, which must be in Gray order; level 0 holds the fingerprints, each upper node a run
    of FANOUT nodes below."""

    def __init__(self, fps: np.ndarray):
        ones, some = fps.astype(np.uint64), fps.astype(np.uint64)
        levels = [(ones, np.full(len(fps), ~np.uint64(0)))]
        while len(ones) > FANOUT:
            at = np.arange(0, len(ones), FANOUT)
            ones, some = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)
            levels.append((ones, ~(ones ^ some)))
        #: value and own bits of each node: the bits shared in its run which no node above already holds
        self.levels = []
        for k, (value, shared) in enumerate(levels):
            above = np.repeat(levels[k + 1][1], FANOUT)[: len(value)] if k + 1 < len(levels) else np.uint64(0)
            self.levels.append((value, shared & ~above))

    def link(self, forest: Forest, rows: np.ndarray, queries: np.ndarray, radius: int) -> None:
        """Merges in forest each query with the fingerprints that differ from it in radius // 2 of the first HALF bits and in
        radius bits at most. rows: their numbers in the forest, those of the index before the others. The first queries are
        the index's own fingerprints, and look for those after them."""
        n_top, block = len(self.levels[-1][0]), max(1, FRONTIER // 64)
        for first in range(0, len(queries), block):
            mine = np.arange(first, min(first + block, len(queries)))
            group = forest.root[rows]
            low, high = [group[: len(self.levels[0][0])]], [group[: len(self.levels[0][0])]]
            for _ in self.levels[1:]:
                at = np.arange(0, len(low[-1]), FANOUT)
                low.append(np.minimum.reduceat(low[-1], at))
                high.append(np.maximum.reduceat(high[-1], at))
            apart = np.zeros(len(mine) * n_top, np.int8)
            self._descend(forest, rows, queries, radius, (low, high, group), len(self.levels) - 1, np.repeat(mine, n_top), np.tile(np.arange(n_top), len(mine)), apart, apart)

    def _descend(self, forest: Forest, rows: np.ndarray, queries: np.ndarray, radius: int, known: tuple, k: int, q: np.ndarray, node: np.ndarray, apart: np.ndarray, early: np.ndarray) -> None:
        """Searches queries q below the nodes of level k, from which they differ in `apart` bits so far, `early` of the first half."""
        low, high, group = known
        if len(q) > FRONTIER:
            for first in range(0, len(q), FRONTIER):
                now = slice(first, first + FRONTIER)
                self._descend(forest, rows, queries, radius, known, k, q[now], node[now], apart[now], early[now])
            return
        value, own = self.levels[k]
        n = len(self.levels[0][0])
        differs = (queries[q] ^ value[node]) & own[node]
        apart, early = apart + np.bitwise_count(differs).astype(np.int8), early + np.bitwise_count(differs >> np.uint64(HALF)).astype(np.int8)
        later = (q >= n) | (np.minimum((node + 1) * FANOUT**k, n) - 1 > q)
        keep = later & (apart <= radius) & (early <= radius // 2) & ~((low[k][node] == high[k][node]) & (low[k][node] == group[q]))
        q, node, apart, early = q[keep], node[keep], apart[keep], early[keep]
        if not len(q):
            return
        if not k:
            forest.merge(rows[q], rows[node])
            return
        node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        inside = node < len(self.levels[k - 1][0])
        q, apart, early = (np.repeat(x, FANOUT)[inside] for x in (q, apart, early))
        self._descend(forest, rows, queries, radius, known, k - 1, q, node[inside], apart, early)


def link_nodes(keys: list[np.ndarray], fps: np.ndarray, nodes: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, id of its root) of a spanning forest; nodes: the id of each row's fingerprint. Rows with equal keys are of
    one node: its own fingerprints make the index, in which they and the other rows are searched."""
    names, same = np.unique(nodes, return_inverse=True)
    forest = Forest(len(names))
    order = np.lexsort((gray_rank(fps), ~own, *keys))
    row, value, mine = same[order], fps[order], own[order]
    new = np.ones(len(fps), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    for s, e in zip(starts, np.r_[starts[1:], len(fps)], strict=True):
        members = s + int(mine[s:e].sum())
        if members > s and e - s > 1:
            GrayIndex(value[s:members]).link(forest, row[s:e], value[s:e], radius)
    linked = np.flatnonzero(forest.root != np.arange(len(names)))
    return names[linked], names[forest.root[linked]]


def parted(rows: DataFrame, depth: int, bits: int, radius: int) -> DataFrame:
    """rows (turned, at, apart, y, node) of nodes at a depth, dealt to the nodes `bits` bits below within what is allowed.

    Of two fingerprints in different nodes only the one with a 0 in the first bit in which they differ is sent to the other."""
    most = radius // 2 if depth + bits <= HALF else radius
    option = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("n"), F.lit(max(1, m.bit_length()) - 1).alias("top")) for m in flips(bits, most)))
    chunk = F.shiftrightunsigned(F.shiftleft("y", depth), 64 - bits)
    zero = F.expr("shiftrightunsigned(chunk, x.top)").bitwiseAND(F.lit(1).cast("long")) == 0
    allowed = (F.col("x.n") + F.col("apart") <= most) & ((F.col("apart") > 0) | (F.col("x.n") == 0) | zero)
    out = rows.withColumn("chunk", chunk).withColumn("x", F.explode(option)).where(allowed)
    at = F.shiftleft(F.col("at"), bits).bitwiseOR(F.col("chunk").bitwiseXOR(F.col("x.mask")))
    return out.select("turned", at.alias("at"), (F.col("apart") + F.col("x.n")).alias("apart"), "y", "node")


def dealt(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """(turned, depth, at, apart, y, node): the fingerprints of every node of both orders, apart = 0, and those to be searched in it.

    Depth and leading bits `at` name a node. y is the fingerprint as its order has it."""
    turned = F.expr(f"shiftleft(fp, {HALF}) | shiftrightunsigned(fp, {HALF})")
    both = F.explode(F.array(F.struct(F.lit(False).alias("turned"), F.col("fp").alias("y")), F.struct(F.lit(True).alias("turned"), turned.alias("y")))).alias("o")
    rows = nodes.where("node is not null").select("node", both).selectExpr("o.turned", "0L as at", "0 as apart", "o.y", "node")
    bits, depth, done = min(HALF, max(0, math.ceil(math.log2(max(1, n) / NODE_LIMIT)))), 0, []
    while True:
        if bits:
            rows, depth = parted(rows, depth, bits, radius), depth + bits
        full = rows.where("apart = 0").groupBy("turned", "at").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * NODE_LIMIT)
        full = cut(full.select(F.col("turned").alias("full_turned"), F.col("at").alias("full_at"), "rows"))  # at most n / NODE_LIMIT rows
        most = full.agg(F.max("rows")).first()[0]
        if most is None:
            done.append(rows.withColumn("depth", F.lit(depth)))
            return reduce(DataFrame.unionByName, done)
        some = F.broadcast(full) if full.count() <= SMALL_TABLE else full
        hit = (F.col("turned") == F.col("full_turned")) & (F.col("at") == F.col("full_at"))
        rows = cut(rows)
        done.append(rows.join(some, hit, "left_anti").withColumn("depth", F.lit(depth)))
        rows = rows.join(some, hit, "left_semi")
        bits = max(1, min(6, math.ceil(math.log2(most / NODE_LIMIT)), HALF - depth if depth < HALF else 64 - depth))


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): the ids of linked distinct fingerprints, enough to span every component. nodes: (fp, node), one row a fingerprint."""
    spark = nodes.sparkSession
    ship(spark)
    rows = dealt(nodes, nodes.count(), radius)
    where = ["turned", "depth", "at"]
    # a node that many queries reach is searched in parts, each with the whole of its own fingerprints
    sizes = cut(rows.groupBy(*where).agg(F.count("*").alias("n"), F.count_if(F.col("apart") > 0).alias("n_queries")))
    size = sizes.agg(F.sum("n")).first()[0] or 0
    many = sizes.where(F.col("n_queries") > QUERY_LIMIT).select(*where, F.ceil(F.col("n_queries") / (QUERY_LIMIT / 2)).cast("int").alias("parts"))
    part = F.lit(0)
    if not many.isEmpty():
        rows = rows.join(F.broadcast(many) if many.count() <= SMALL_TABLE else many, where, "left")
        parts = F.coalesce("parts", F.lit(1))
        part = F.explode(F.when(F.col("apart") > 0, F.array(F.pmod(F.xxhash64("y"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select(*where, part.alias("part"), "y", "node", (F.col("apart") == 0).alias("own"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_ROWS))
    rows = rows.repartition(tasks, *where, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        *keys, y, node, own = (t.column(i).to_numpy() for i in range(7))
        a, b = link_nodes(keys, y.view(np.uint64), node, own, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable over links, itself included.

    Null, empty and blank texts have fingerprint 0, linked like any other. Texts of one or two words have one shingle.
    Repeated rows give repeated results. Rows of a null doc_id keep it and take part in no search of their own: they get
    the component of the documents with their fingerprint, or null. Columns besides the two named are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = connected_components(links(nodes, radius), "a", "b").withColumnRenamed("node", "linked")
    named = nodes.join(roots, nodes.node == roots.linked, "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The query's rows: doc_id, fingerprint (16 lowercase hex digits) and component_id."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return simhash_components(docs, radius).select("doc_id", hexed, "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component one row, that of the smallest doc_id (null last), with all columns,
    whatever their names. Rows go by doc_id and text, so those of a null doc_id take part like any other; of repeated rows
    one stays. No documents give no rows."""
    (key,) = new_names(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = cut(simhash_components(keyed, radius, key).withColumnRenamed("doc_id", key))
    ids = keyed.select(key, F.col("doc_id").alias("own_id")).distinct()
    first = F.min(F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", key))
    stay = found.join(ids, key).groupBy("component_id").agg(first.alias("x")).select(F.col("x")[key].alias(key))
    again = found.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return one_of_each(keyed.join(stay, key, "left_semi"), again, key, ["text"]).select(*docs.columns)
