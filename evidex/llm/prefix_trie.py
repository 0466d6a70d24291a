"""The prefix trie of conversations, from their sorted order.

A conversation is the sequence of its turns' digests (128 bits of SHA-256 of role and text), 16 bytes a turn, so that byte
order keeps common beginnings together. Distinct sequences are sorted over ranges of keys; lcp is the number of turns that a
sequence shares with the one before it. A trie node is an interval of sequences that share its turns, bounded on both sides
by the nearest smaller lcp: the Cartesian tree over the lcp array, nodes of equal lcp merged. Sequences are taken in blocks
of at most 65,536, all blocks at once: nearest smaller values within a block come from one pass with a stack, and what
remains are the block's minima from its left end (intervals that began before it) and from its right end (those that go on
after it), as many as the block's turns are deep at most. These few rows, some for each block, are merged by the same pass.
Sums and minima over intervals are kept with the stack, so an interval's rows are read once. Edges longer than one turn are
expanded to one node a depth at the end; a node needs its parent's smallest member, which within a block is known when the
parent ends, and else comes by a join with the merged rows, by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.rows import CRC
from evidex.session import cut, ship

DIGEST = 16
#: Conversations copy the beginning of the one whose id is the multiple of this below theirs.
FAMILY, MOST_COPIED = 20, 4
BLOCK = 65_536
#: Ids of equal conversations that are one row on the way to their hash.
CHUNK = 4096
NO_ID = -(1 << 63)
EMPTY = hashlib.sha256(b"").hexdigest()
SEQUENCE = "key binary, words array<long>, n long, conv_id long, ends string"


def turn_digest() -> Column:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key, words) of every conversation: the first h turns of conv_id - conv_id % 20 in place of its own, h being
    crc32 of its decimal id, mod 4 (% is SQL's: -3 % 20 is -3). key has the digests of its turns, words the words of each."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.struct(F.col("turn"), turn_digest().alias("d"), words.alias("w")).alias("t"))
    own = cut(rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.expr("transform(t, x -> struct(x.d, x.w))").alias("t")))
    heads = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.slice("t", 1, MOST_COPIED - 1).alias("head"))
    h = F.when(F.col("conv_id") == NO_ID, 0).otherwise((F.crc32(F.col("conv_id").cast("string")) % MOST_COPIED).cast("int"))
    both = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(heads, "base", "left")
    t = F.when(F.col("h") == 0, F.col("t")).otherwise(F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("t", 1, 0)), F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1)))))
    return both.select("conv_id", t.alias("t")).select("conv_id", F.unhex(F.array_join(F.expr("transform(t, x -> hex(x.d))"), "")).alias("key"), F.col("t.w").alias("words"))


def decimal(conv_id: int) -> str:
    return "" if conv_id == NO_ID else str(conv_id)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (name, conv_id), one for up to CHUNK conversations of a name."""
    names = ["name", "key", "words", "first", "n", "ids"]
    held = None
    for b in batches:
        out = []
        for name, conv_id, key, words in zip(*(b.column(c).to_pylist() for c in ("name", "conv_id", "key", "words")), strict=True):
            if held and held[0] == name and len(held[3]) < CHUNK:
                held[3].append(conv_id)
                continue
            if held:
                out.append(held)
            held = (name, key, words, [conv_id])
        yield _chunk_rows(out, names)
    if held:
        yield _chunk_rows([held], names)


def _chunk_rows(some: list, names: list[str]) -> pa.RecordBatch:
    columns = [[x[0] for x in some], [x[1] for x in some], [x[2] for x in some], [x[3][0] for x in some], [len(x[3]) for x in some], [",".join(map(decimal, x[3])) for x in some]]
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks sorted by (name, first), one row a name: the hash of all ids takes one chunk after the other."""
    out, name, sha = [], None, None

    def rows() -> pa.RecordBatch:
        kinds = [("key", pa.binary()), ("words", pa.list_(pa.int64())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, (_, k) in enumerate(kinds)], [c for c, _ in kinds])

    for b in batches:
        for r in b.to_pylist():
            if r["name"] == name:
                sha.update(b"," + r["ids"].encode())
                out[-1][2] += r["n"]
                out[-1][4] = sha.hexdigest()
                continue
            if len(out) >= 1024:
                yield rows()
                out = []
            name, sha = r["name"], hashlib.sha256(r["ids"].encode())
            out.append([r["key"], r["words"], r["n"], r["first"], sha.hexdigest()])
    if out:
        yield rows()


def sequences(convs: DataFrame) -> DataFrame:
    """SEQUENCE: the distinct conversations with their count, smallest id and the hash of all their ids. Equal ones, however
    many, are dealt by id; only the hash itself has to take one text after the other, in chunks."""
    named = convs.withColumn("name", F.unhex(F.sha2("key", 256)))
    by = ["name", "conv_id"]
    chunks = named.select("name", "conv_id", "key", "words").repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, "name binary, key binary, words array<long>, first long, n long, ids string")
    return chunks.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_whole, SEQUENCE)


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


class Subtree:
    """An interval of sequences: n, tokens (n times words), fresh (words after the lcp), leaves and conv_id (the smallest) over
    all its sequences, and its children. Of its first sequence: words, running, by depth; base, those before its lcp; ends, the
    hash of its ids if it ends at this depth. left: it began in an earlier block, which knows the latter."""

    __slots__ = ("base", "children", "conv_id", "depth", "ends", "fresh", "items", "left", "leaves", "n", "tokens", "waiting", "words")

    def __init__(self, depth, n=0, tokens=0, fresh=0, leaves=0, conv_id=None, children=0, words=None, base=0, ends=None, left=False):
        self.depth, self.n, self.tokens, self.fresh, self.leaves, self.conv_id, self.children = depth, n, tokens, fresh, leaves, conv_id, children
        self.words, self.base, self.ends, self.left = words, base, ends, left
        self.waiting: list[list] = []  # nodes right below, which lack its smallest member
        self.items: list[tuple] = []  # the parts of blocks that it was merged from

    def add(self, o: Subtree, children: int) -> None:
        self.n, self.tokens, self.fresh, self.leaves, self.children = self.n + o.n, self.tokens + o.tokens, self.fresh + o.fresh, self.leaves + o.leaves, self.children + children
        self.conv_id = o.conv_id if self.conv_id is None else self.conv_id if o.conv_id is None else min(self.conv_id, o.conv_id)


class Sweep:
    """Intervals between nearest smaller values, by a stack of those that are open; `ended` gets the nodes of complete ones."""

    def __init__(self, ended: list[list]):
        self.ended = ended
        self.stack: list[Subtree] = []
        self.cur: Subtree | None = None
        self.lefts: list[Subtree] = []
        self.map: list[tuple] = []

    def boundary(self, x: int) -> None:
        """The next sequence shares x turns with the last: what is deeper ends."""
        if self.cur is not None and self.cur.depth == x:
            self.cur.leaves = 0
        while self.stack and self.stack[-1].depth > x:
            top = self.stack.pop()
            self._into(top)
            if top.left:
                self.lefts.append(top)
            else:
                self.cur = top
        if not self.stack or self.stack[-1].depth < x:
            self.stack.append(Subtree(x, left=self.cur is None))
        self._into(self.stack[-1])

    def _into(self, top: Subtree) -> None:
        c, self.cur = self.cur, None
        if c is None:
            return
        if top.words is None and not top.left:
            top.words, top.base, top.ends = c.words, c.base, c.ends if c.depth == top.depth else None
        top.add(c, c.depth > top.depth)
        if c.depth > top.depth:
            self._end(c, top)

    def _end(self, c: Subtree, parent: Subtree) -> None:
        """A node for each depth from right below the parent's to the interval's own. Saved: what all its sequences say from
        that depth on, less what the distinct nodes do."""
        for row in c.waiting:
            row[2] = c.conv_id
        self.ended += c.waiting
        self.map += [(*item, c.conv_id) for item in c.items]
        depth = np.arange(parent.depth + 1, c.depth + 1)
        above = c.words[np.maximum(depth - 1, 0)]
        saved = (c.tokens - c.n * above - (c.fresh + c.base - above)).tolist()
        rows = [[c.conv_id, d, c.conv_id, c.n, 1, c.leaves, v, EMPTY, None, None] for d, v in zip(depth.tolist(), saved, strict=True)]
        rows[-1][4], rows[-1][7] = c.children, c.ends or EMPTY
        rows[0][2] = None
        parent.waiting.append(rows[0])
        self.ended += rows[1:]


KINDS = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "block": pa.int64(), "item": pa.int64(), "left": pa.bool_(), "tokens": pa.int64(), "fresh": pa.int64(), "base": pa.int64(), "words": pa.list_(pa.int64())}
ROWS = ", ".join(f"{c} {dict(int64='long', string='string', bool='boolean').get(str(k), 'array<long>')}" for c, k in KINDS.items())


def _batches(rows: list[list], least: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows given as batches, once there are as many as `least`; short rows end in nulls."""
    if len(rows) < least:
        return
    for at in range(0, len(rows), 8192):
        some = rows[at : at + 8192]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in some], k) for i, k in enumerate(KINDS.values())], list(KINDS))
    rows.clear()


def _open(s: Subtree, block: int, item: int) -> list[list]:
    """An interval that goes beyond its block, and the nodes that wait for its smallest member."""
    for row in s.waiting:
        row[8:10] = block, item
    words = None if s.words is None else s.words[: max(s.depth, 0) + 1].tolist()
    return [*s.waiting, [s.conv_id, s.depth, None, s.n, s.children, s.leaves, None, s.ends, block, item, s.left, s.tokens, s.fresh, s.base, words]]


def _sweep_blocks(batches: Iterator[pa.RecordBatch], firsts: dict[int, int], lasts: dict[int, int], size: int) -> Iterator[pa.RecordBatch]:
    """ROWS of a sorted range, in blocks. firsts, lasts: by range, the lcp before its first sequence and after its last."""
    out: list[list] = []
    sweep, key, block, held = Sweep(out), None, -1, 0

    def close(x: int) -> None:
        sweep.boundary(x)
        for item, s in enumerate(sweep.lefts + sweep.stack):
            out.extend(_open(s, block, item))

    for b in batches:
        for r in b.to_pylist():
            x = firsts[r["part"]] if key is None else common(key, r["key"])
            if key is None or held == size:
                if key is not None:
                    close(x)
                    yield from _batches(out)
                block = r["part"] << 32 if key is None else block + 1
                sweep, held = Sweep(out), 0
            sweep.boundary(x)
            words = np.r_[0, np.cumsum(r["words"], dtype=np.int64)]
            base = int(words[max(x, 0)])
            sweep.cur = Subtree(len(words) - 1, r["n"], r["n"] * int(words[-1]), int(words[-1]) - base, 1, r["conv_id"], 0, words, base, r["ends"])
            key, part, held = r["key"], r["part"], held + 1
        yield from _batches(out, 8192)
    if key is not None:
        close(lasts[part])
    yield from _batches(out)


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of intervals of several blocks, and, with a null depth, the smallest member that each open interval leads to."""
    out: list[list] = []
    sweep = Sweep(out)

    def mapped() -> None:
        out.extend([None, None, conv_id, None, None, None, None, None, block, item] for block, item, conv_id in sweep.map)
        sweep.map.clear()

    for b in batches:
        for r in b.to_pylist():
            if r["left"]:
                sweep.boundary(r["depth"])
                sweep.stack[-1].add(Subtree(r["depth"], r["n_convs"], r["tokens"], r["fresh"], r["n_leaves"], r["conv_id"]), r["n_children"])
            else:
                sweep.stack.append(Subtree(r["depth"], r["n_convs"], r["tokens"], r["fresh"], r["n_leaves"], r["conv_id"], r["n_children"], np.array(r["words"]), r["base"], r["ends_sha256"]))
            sweep.stack[-1].items.append((r["block"], r["item"]))
        mapped()
        yield from _batches(out, 8192)
    for s in sweep.stack:  # what is above the root
        out += s.waiting
        sweep.map += [(*item, None) for item in s.items]
    mapped()
    yield from _batches(out)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, last = None, None
    for b in batches:
        if b.num_rows:
            part, first = b.column("part")[0].as_py(), b.column("key")[0].as_py() if first is None else first
            last = b.column("key")[-1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], ["part", "first", "last"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lcp = [common(x, y) for x, y in zip(b.column("last").to_pylist(), b.column("first").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("after"), pa.array(lcp, pa.int64())], ["part", "after", "lcp"])


def _borders(ranged: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """By range, the lcp before its first sequence and after its last: two numbers a task."""
    spark = ranged.sparkSession
    edges = cut(ranged.mapInArrow(_edges, "part long, first binary, last binary"))
    parts = sorted(r.part for r in edges.select("part").collect())
    firsts, lasts = dict.fromkeys(parts, -1), dict.fromkeys(parts, -1)
    after = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part long, after long")
    pairs = after.join(edges.select("part", "last"), "part").join(edges.select(F.col("part").alias("after"), "first"), "after")
    for r in pairs.select("part", "after", "last", "first").mapInArrow(_shared, "part long, after long, lcp long").collect():
        lasts[r.part] = firsts[r.after] = r.lcp
    return firsts, lasts


def prefix_trie(turns: DataFrame, block: int = BLOCK, rebuild: Callable[[DataFrame], DataFrame] = rebuilt) -> DataFrame:
    """The query's rows, one for each distinct beginning of a rebuilt conversation: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; those of one turn (repeated rows too, which stay) by their digest. A null role or
    text is empty. Rows without conv_id are one conversation, which copies nothing, is smaller than all others, shows as null
    and is an empty string in the list that is hashed. A conversation's digests, 24 bytes a turn, are one row. No turns give
    no rows. Columns besides conv_id, turn, role and text are not read. rebuild: gives (conv_id, key, words), as rebuilt does.
    """
    ship(turns.sparkSession)
    ranged = sequences(rebuild(turns)).repartitionByRange("key").sortWithinPartitions("key")
    ranged = cut(ranged.withColumn("part", F.spark_partition_id().cast("long")))
    firsts, lasts = _borders(ranged)
    swept = cut(ranged.mapInArrow(lambda batches: _sweep_blocks(batches, firsts, lasts, block), ROWS))
    merged = cut(swept.where("left is not null").repartition(1).sortWithinPartitions("block", "item").mapInArrow(_merge_blocks, ROWS))
    nodes = swept.where("left is null")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = merged.where("depth is null").select("block", "item", F.col("parent_conv_id").alias("above"))
    waiting = nodes.where("block is not null").join(parents, ["block", "item"]).withColumn("parent_conv_id", F.col("above"))
    every = nodes.where("block is null").select(names).union(waiting.select(names)).union(merged.where("depth is not null").select(names))
    return every.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("conv_id", "parent_conv_id")})


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k, d, w FROM (
    SELECT conv_id, turn, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS d,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations)),
ids AS (SELECT DISTINCT conv_id, """ + CRC.format("conv_id::VARCHAR") + """ % 4 AS h FROM t),
whole AS (
  SELECT i.conv_id, k, d, w FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 20 AND k <= h
  UNION ALL SELECT i.conv_id, k + 1000000, d, w FROM ids i JOIN t ON t.conv_id = i.conv_id AND k > h),
paths AS (
  SELECT i.conv_id, coalesce(list(d ORDER BY k) FILTER (d IS NOT NULL), []) AS ds, coalesce(list(w ORDER BY k) FILTER (d IS NOT NULL), []) AS ws
  FROM ids i LEFT JOIN whole USING (conv_id) GROUP BY i.conv_id),
visits AS (SELECT conv_id, depth, ds[1:depth] AS path, depth = len(ds) AS ends, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS w FROM (SELECT *, unnest(range(len(ds) + 1)) AS depth FROM paths)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS saved, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM visits GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
each AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.path),
ups AS (SELECT path[1:a] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS a FROM each) GROUP BY 1)
SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, e.ends_sha256
FROM each e JOIN ups u ON e.path = u.path LEFT JOIN nodes p ON e.depth > 0 AND p.path = e.path[1:e.depth - 1]
"""
