import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from evidex.llm import exact_dedup as X
from evidex.llm import mixing as M
from pyspark.sql import functions as F


def low(t):
    return (t or "").translate(str.maketrans(X.UPPER, X.LOWER))


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.pmod(F.length(c).cast("long"), F.lit(3).cast("long"))])
def test_exact_groups_equal_brute_force(spark, hashed):
    rng = random.Random(2)
    base = ["", None, " ", "a", "A", "É", "é", "x" * 40, "x" * 41, "ab" * 500, "ab" * 499 + "ac"] + ["".join(rng.choice("ab") for _ in range(rng.choice([7, 8, 9, 60]))) for _ in range(25)]
    texts = base + [(t or "").upper() for t in rng.sample(base, 20)] + base[:12]
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, name string, at int").repartition(3)
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[low(t)].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in X.exact_groups(docs, block_bytes=8, hashed=hashed).collect()}
    assert got == want
    kept = X.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "A"), (3, "a"), (None, "b"), (5, "c"), (5, "d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in X.exact_duplicates(docs).collect())
    assert got == sorted([("None", "3", 3, False), ("3", "3", 3, True), ("3", "3", 3, True), ("None", "None", 1, True), ("5", "5", 1, True), ("5", "5", 1, True)])
    assert X.exact_duplicates(docs.limit(0)).collect() == []


def fill(sizes, weights, total, most):
    """Resharing round by round."""
    out, live, left = {}, set(sizes), total
    while live:
        level = left / sum(weights[s] for s in live)
        stop = {s for s in live if level * weights[s] > most * sizes[s]}
        if not stop:
            return out | {s: level * weights[s] for s in live}
        for s in stop:
            out[s] = most * sizes[s]
            left -= out[s]
        live -= stop
    return out


def brute_extra(docs, lacks):
    """(doc_id) taken once more, of docs {doc_id: size}: the scale by bisection, then Pareto ranks over all documents."""
    cls = {i: n >> max(0, n.bit_length() - 4) << max(0, n.bit_length() - 4) for i, n in docs.items() if n}
    low, high = 0.0, 1.0
    for _ in range(200):
        k = (low + high) / 2
        low, high = (k, high) if sum(min(1, k * c**0.5) * docs[i] for i, c in cls.items()) < lacks else (low, k)
    p = {i: high * c**0.5 for i, c in cls.items()}
    sure = {i for i in p if p[i] >= 1 - 1e-12}
    left, out = lacks - sum(docs[i] for i in sure), set(sure)
    u = {i: (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in p}
    for i in sorted(p.keys() - sure, key=lambda i: (u[i] / (1 - u[i]) / (p[i] / (1 - p[i])), i)):
        if left <= 0 or abs(left - docs[i]) > left:
            break
        out.add(i)
        left -= docs[i]
    return out


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_DOCS", 20)
    monkeypatch.setattr(M, "BUCKETS", 4)
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None, "é"]), "w " * rng.choice([0, 1, 5, 30, 200]), 7) for i in range(2000)]
    rows += [(5000, "tiny", "one", 7), (5001, "blank", " ", 7), (5002, "blank", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target int").repartition(4)
    got = {r.doc_id: r for r in M.mix(docs).collect()}
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = defaultdict(int)
    for i, s, t, _ in rows:
        r = got[i]
        assert r.size == len((t or "").split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    mine, shares = defaultdict(dict), defaultdict(list)
    for i, s, t, _ in rows:
        mine[s][i] = len((t or "").split())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 100.5
        whole = int(want[s] // sizes[s]) if sizes[s] else 0
        extra = brute_extra(mine[s], want[s] - whole * sizes[s]) if want[s] - whole * sizes[s] > 1e-6 else set()
        assert {i: n * (whole + (i in extra)) for i, n in mine[s].items()} == {i: got[i].taken for i in mine[s]}
        for i, n in mine[s].items():
            if extra and n:
                shares[s, n].append(i in extra)
    # long texts are sampled more often than short ones, but no size is left out or, in some source, all certain
    odds = {s: [np.mean(shares[s, n]) for n in (1, 5, 30, 200)] for s in {s for s, _ in shares} if (s, 5) in shares}
    assert odds and all(a[0] <= a[2] and a[1] < a[3] for a in odds.values()) and any(0 < a[1] < a[3] < 1 or a[3] == 1 > a[1] > 0 for a in odds.values())
    again = {r.doc_id: r.taken for r in M.mix(docs.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r.doc_id] += 1
    assert all(copies[i] * r.size == r.taken for i, r in got.items())
    assert M.mix(docs.limit(0)).collect() == []


def test_mixed_documents_with_clashing_names_and_null_ids(spark):
    rows = [(None if i % 7 == 0 else i, f"s{i % 3}", "w " * (i % 11), i, "x") for i in range(300)]
    docs = spark.createDataFrame(rows + rows[1:4], "doc_id long, source string, text string, times int, copy_ string").withColumn("row", F.lit(1)).withColumn("u", F.lit("u")).withColumn("Size", F.lit(2))
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("copy_ <> 'x' or row <> 1 or u <> 'u'").count() == 0
    got = mixed.groupBy("times").count().collect()
    assert sum(r["count"] for r in got if r.times % 7 == 0) > 10  # rows of null doc_ids are sampled one by one
    assert len({r["count"] for r in got if r.times % 7 == 0 and r.times % 11}) > 1
    assert M.mixed_documents(docs.limit(0)).collect() == []
    assert M.mixed_documents(docs.where("text is null or text = ''")).collect() == []


def test_mix_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "s", "a b"), (1, "s", "a b"), (None, "t", "c")], "doc_id long, source string, text string")
    assert sorted(r.size for r in M.mix(docs).collect()) == [1, 2, 2]
