import hashlib
import zlib
from collections import defaultdict

import pytest
from evidex.llm import merkle as M
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def brute_tree(nodes):
    """The root, and for each node its siblings (left, right), level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            steps[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], steps


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        text = r[1]
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        by[r[3]].append((r[0], brute_leaf(*r), brute_leaf(r[0], text, *r[2:])))
    trees, subroots = {}, []
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_tree([x[1] for x in by[s]])
        subroots.append(trees[s][0])
    root, above = brute_tree(subroots)
    out = []
    for s, high in zip(sources, above):
        for (doc_id, leaf, other), low in zip(by[s], trees[s][1]):
            fold = other
            for left, right in low + high:
                fold = h(left, fold, right)
            out.append((doc_id, leaf, trees[s][0], root, h(*(a + b for a, b in low + high)), fold, fold == root))
    return sorted(out, key=repr)


def rows_of(n):
    out = [(k, f"line {k}\nand more" if k % 4 else f"one line {k}", "en", f"s{k % 7 and 'hot' or k % 5}", k) for k in range(n)]
    out += [(n, None, None, None, None), (n + 1, "", "", "", 0), (None, "no\nid", "en", "shot", 3), (None, "no\nid", "en", "shot", 3), (None, None, None, None, None)]
    out += [(5, "again\n", "de", "shot", 1), (5, "again\n", "de", "shot", 1), (6, "\u00e9" * 50_000 + "\n", "fr", "\u00fc", 9), (7, "x", "en", "\U0001f600", 1)]
    return out


@pytest.mark.parametrize(("n", "levels"), [(90, 1), (90, 2), (300, 6), (0, 6)])
def test_rows_equal_brute_force(spark, n, levels):
    """Blocks of 3, 9 and 729: sources of many blocks, of one, and of a last block with a lone leaf."""
    rows = rows_of(n)
    got = M.manifest_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), levels).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_no_rows_and_one_row(spark):
    assert M.manifest_rows(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(3, "a\nb", "en", "s", 3)]
    assert [tuple(r) for r in M.manifest_rows(spark.createDataFrame(one, SCHEMA)).collect()] == brute(one)


def test_clashing_columns(spark):
    rows = rows_of(20)
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("g", "b", "i", "n", "leaf", "other", "steps", "top", "tie", "at", "part", "root", "subroot"):
        docs = docs.withColumn(c, F.lit("x"))
    assert sorted((tuple(r) for r in M.manifest_rows(docs).collect()), key=repr) == brute(rows)


def test_blocks_are_cut_where_they_begin(monkeypatch):
    """Batches end within blocks; each block still reaches DuckDB whole."""
    import pyarrow as pa

    monkeypatch.setattr(M, "ROWS", 4)
    leaves = [("1a", k // 3, k, 11, k, h(str(k)), "") for k in range(11)]
    table = pa.table(dict(zip(("g", "b", "i", "n", "doc_id", "leaf", "other"), map(list, zip(*leaves)))))
    out = pa.Table.from_batches(M._blocks(iter(table.to_batches(max_chunksize=2)), 1)).to_pylist()
    tops = {r["b"]: r["top"] for r in out if r["top"]}
    assert tops == {b: h(*(x[5] for x in leaves[3 * b : 3 * b + 3])) for b in range(4)}
    assert sorted(r["doc_id"] for r in out) == list(range(11))


def test_written_manifest_finds_changes(spark):
    rows = rows_of(30)
    docs = spark.createDataFrame(rows, SCHEMA)
    folder, root = M.write_manifest(docs)
    assert M.tampered(spark, docs, folder, root).collect() == []
    edited = docs.where("doc_id is null or doc_id <> 8").withColumn("text", F.when(F.col("doc_id") == 9, "new").otherwise(F.col("text"))).union(spark.createDataFrame([(77, "added", "en", "s", 1)], SCHEMA))
    assert sorted(map(tuple, M.tampered(spark, edited, folder, root).collect())) == [(8, "missing"), (9, "changed"), (9, "missing"), (77, "changed")]
    assert {r.found for r in M.tampered(spark, docs, folder, h("other")).collect()} == {"proof"}
