import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from evidex.llm import sketch as S
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def brute_likeness(a, b):
    a, b = Counter(S.paragraphs(a)), Counter(S.paragraphs(b))
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 1.0


def brute(rows):
    """FOUND of rows in descending order of doc_id (ids told apart here), without the fingerprints."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        a, b = a or "", b or ""
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        out.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), brute_likeness(a, e), brute_likeness(a, b)))
    return out


def words(rng, n):
    return " ".join(rng.choice(["so", "is", "it", "then", "now.", "here,", "é!", "\n", "\n\n"]) for _ in range(n))


def test_peeling_recovers_what_differs():
    """Differences of any size, in one batch: each is found exactly, with its side."""
    rng = np.random.default_rng(0)
    left, right = [], []
    for n in [0, 1, 2, 5, 30, 300, 5000]:
        for common in (0, 1, 100):
            keys = np.unique(rng.integers(0, 1 << 63, 2 * n + common, np.uint64))
            left.append(keys[: n + common])
            right.append(np.r_[keys[:common], keys[n + common :]])
    seen = {}
    for pairs, owner, key, sign in S.differences(left, right):
        for k, pair in enumerate(pairs):
            seen[pair] = {(int(x), int(s)) for x, s in zip(key[owner == k], sign[owner == k])}
    for k, (a, b) in enumerate(zip(left, right)):
        assert seen[k] == {(int(x), 1) for x in np.setdiff1d(a, b)} | {(int(x), -1) for x in np.setdiff1d(b, a)}


def test_equal_texts_have_equal_fingerprints():
    a, b = S.digests("one\n\ntwo\none"), S.digests(" one\ntwo \n one ")
    assert S.fingerprints([a, S.digests("x")])[0] == S.fingerprints([b])[0] != S.fingerprints([S.digests("one\ntwo")])[0]


def test_changed_paragraphs():
    old = "\n".join(f"line {k}" for k in range(400))
    new = old.replace("line 7\n", "").replace("line 200\n", "line two hundred\nline 201\n")
    assert S.changed_paragraphs(old, new) == (["line 7", "line 200"], ["line two hundred", "line 201"])
    assert S.changed_paragraphs("", "") == ([], [])


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(k * 3, words(rng, rng.choice([0, 1, 5, 60, 400]))) for k in range(60)]
    rows[9] = (rows[9][0], rows[8][1])
    rows += [(1000, None), (1001, ""), (None, "no id\nat all"), (1002, "long line " * 30_000), (-5, "\U0001f600" * 7)]
    got = S.edited_likeness(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, n, sha, edited, following in brute(rows):
        r = by[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert (r.near_edited, r.near_next) == pytest.approx((edited, following))
    texts = {i: t or "" for i, t in rows}
    prints = {i: S.fingerprints([S.digests(t)])[0] for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in by.items()} == prints


def test_few_rows_repeats_and_clashing_columns(spark):
    assert S.edited_likeness(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = S.edited_likeness(spark.createDataFrame([(4, "a b\nc d")], SCHEMA)).collect()
    assert [(r.doc_id, r.n_chars, r.near_next, r.edited_sha256) for r in lone] == [(4, 7, 1.0, hashlib.sha256(b"a b\na b").hexdigest())]
    rows = [(1, "x\ny")] * 5 + [(None, "x\ny")] * 3 + [(1, "other")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("h", "tie", "z", "part", "first", "last", "after", "fingerprint", "n_chars"):
        docs = docs.withColumn(c, F.lit("x"))
    got = S.edited_likeness(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == {(1, 3): 5, (None, 3): 3, (1, 5): 1}
    assert Counter(r.near_next for r in got) == {1.0: 7, 0.0: 2}
