import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from evidex.llm import prefix_trie as T
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        out[c] = (own.get(c - int(math.fmod(c, 20)), [])[:h] if h else []) + turns[h:]
    return out


def brute(rows):
    convs = brute_rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    key = lambda c: (c is not None, c or 0)
    low = {p: min(m, key=key) for p, m in members.items()}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join("" if c is None else str(c) for c in sorted(m, key=key) if len(convs[c]) == len(p))
        out.append((low[p], len(p), low[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in T.prefix_trie(df, **kw).collect()), key=repr)


def talk(rng, n, ids=None):
    """Conversations over few texts, so that many beginnings are shared."""
    rows = []
    for c in ids or range(n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "a b", "a b c\n d", "  "])))
    return rows


@pytest.mark.parametrize("block", [1, 2, 7, 65_536])
def test_rows_equal_brute_force(spark, block):
    """Blocks of one sequence leave everything to the merging of blocks, large ones nothing within a range."""
    rows = talk(random.Random(block), 130)
    assert got(spark, rows, block=block) == brute(rows)


def test_nulls_ties_repeats_and_long(spark):
    rows = talk(random.Random(5), 45)
    rows += [(None, 0, "user", "a"), (None, None, None, None), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, None, "bot", "first")]
    rows += [(200, t, None, "w " * (t % 3)) for t in range(300)] + [(201, t, None, "w " * (t % 3)) for t in range(290)] + [(202, 0, "user", "long " * 50_000)]
    rows += [(-3, 0, "user", "a"), (-20, 0, "bot", "z"), (-20, 1, "bot", "z"), (403, 0, "user", "one")]
    assert got(spark, rows) == brute(rows)


def test_turnless_only(spark):
    """A conversation whose base is absent and which is shorter than what it would copy has no turns left."""
    c = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    assert got(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_equal_conversations_in_chunks(spark):
    """More equal conversations than a chunk of ids takes; the hash goes over all ids in numeric order."""
    rows = [(c, 0, "user", "a b") for c in range(0, 20 * 5000, 20)]
    assert got(spark, rows) == brute(rows)


def test_no_turns_and_clashing_columns(spark):
    assert got(spark, []) == []
    rows = talk(random.Random(2), 25)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "words", "t", "d", "h", "base", "head", "name", "part", "block", "item", "n", "ends", "depth"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted((tuple(r) for r in T.prefix_trie(df).collect()), key=repr) == brute(rows)


def test_common_turns():
    rng = np.random.default_rng(1)
    a = rng.bytes(16 * 5)
    for n in range(6):
        assert T.common(a, a[: 16 * n] + rng.bytes(32)) == n
        assert T.common(a, a[: 16 * n]) == n
    assert T.common(a[:20], a[:17] + b"x" * 20) == 1
