import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from evidex.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = defaultdict(list)
    for i, x in enumerate(ids):
        low[find(i)].append(x)
    return {x: min(low[find(i)]) for i, x in enumerate(ids)}


def ball(rng, centre, n, flips):
    return [centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, flips))) for _ in range(n)]


@pytest.mark.parametrize("flips", [2, 5, 9])
@pytest.mark.parametrize("frontier", [1 << 20, 100])
def test_index_finds_every_link(flips, frontier, monkeypatch):
    """Two orders in one task: with either alone some links are lost, with both none is."""
    monkeypatch.setattr(S, "FRONTIER", frontier)
    rng = random.Random(flips)
    fps = ball(rng, 0xF0F0F0F0F0F0F0F0, 300, flips) + [rng.getrandbits(64) for _ in range(200)]
    fps = np.array(sorted(set(fps)), np.uint64)
    turned, n = np.repeat([False, True], len(fps)), len(fps)
    y = np.r_[fps, fps << np.uint64(32) | fps >> np.uint64(32)]
    a, b = S.link_nodes([turned], y, np.tile(np.arange(n), 2), np.ones(2 * n, bool), 3)
    got = S.Forest(n)
    got.merge(a, b)
    want = brute_components(list(range(n)), [int(x) for x in fps])
    assert [want[i] for i in range(n)] == [want[r] for r in got.root]
    assert len(np.unique(got.root)) == len(set(want.values()))


def test_deal_brings_each_linked_pair_together_once(spark, monkeypatch):
    """In each order, two fingerprints within what it allows meet in one node: one of them its own, the other at most once."""
    monkeypatch.setattr(S, "NODE_LIMIT", 6)
    rng = random.Random(3)
    fps = sorted(set(ball(rng, 0x123456789ABCDEF0, 60, 4) + [rng.getrandbits(64) for _ in range(120)]))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    rows = S.dealt(nodes, len(fps), 3).collect()
    assert max(r.depth for r in rows) > 32
    held = defaultdict(lambda: ([], []))
    for r in rows:
        held[r.turned, r.depth, r.at][r.apart > 0].append(r.node)
    assert max(len(own) for own, _ in held.values()) <= 12
    met = defaultdict(int)
    for (turned, *_), (own, other) in held.items():
        for k, i in enumerate(own):
            for j in own[:k] + other:
                met[turned, min(i, j), max(i, j)] += 1
    assert set(met.values()) == {1}
    for i, x in enumerate(fps):
        for j in range(i):
            d = x ^ fps[j]
            if d.bit_count() <= 3:
                assert (d >> 32).bit_count() > 1 or met[False, j, i] == 1
                assert (d & (1 << 32) - 1).bit_count() > 1 or met[True, j, i] == 1


def test_links_come_from_the_tree(spark, monkeypatch):
    """Without the tree's search nothing is linked."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(300) if k != i)) for i in range(4)], "doc_id long, text string")
    nodes = S.fingerprints(docs).groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "node")
    own = [(r.fp % (1 << 64), r.node) for r in nodes.collect()]
    y, ids = np.array([x for x, _ in own], np.uint64), np.array([i for _, i in own])
    found = S.link_nodes([np.zeros(len(y), int)], y, ids, np.ones(len(y), bool), 12)
    monkeypatch.setattr(S.GrayIndex, "link", lambda *a: None)
    assert len(found[0]) > 0 and len(S.link_nodes([np.zeros(len(y), int)], y, ids, np.ones(len(y), bool), 12)[0]) == 0


@pytest.mark.parametrize("limit", [20_000, 4])
def test_components_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "NODE_LIMIT", limit)
    monkeypatch.setattr(S, "QUERY_LIMIT", limit)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "One", "one", "two words", "É à Ü", "x" * 5000]
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([8, 60, 300]))
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += texts[10:14]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(range(len(fps)), fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(fps))}
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "other"), (5, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in S.near_duplicates(docs).collect()) == [(0, 0), (0, 5), (5, 5), (5, 5)]
