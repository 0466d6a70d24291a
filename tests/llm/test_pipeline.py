"""Each stage against a brute-force version on its own input, and the pipeline as a whole."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as C
import pytest
from evidex.llm import quality_rules
from pyspark.sql import functions as F
from test_dedup_and_mixing import fill, low
from test_simhash import brute_components, brute_fingerprint

pytest.importorskip("public_tokenizers")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng, words, rows = random.Random(11), [f"the{i}a" for i in range(300)], []
    for i in range(40):
        text = " ".join(["The", *rng.choices([*words, "of", "and", "to", "in"], k=rng.choice([30, 60, 120])), "end."])
        copies = [text, text.upper().capitalize() if i % 7 == 0 else text, text.replace(text.split()[5], "changed")] if i % 5 == 0 else [text]
        rows += [(t, rng.choice(["hot", "hot", "b", None])) for t in copies]
    rows += [("### *** $$$ ||| " * 20, "b"), (None, "b"), ("", "hot"), ("few words", "b")]
    ids = rng.sample(range(1000), len(rows))
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in zip(ids, rows, strict=True)], SHAPE).repartition(3).cache()


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages(spark, docs):
    stages = dict(C.STAGES)
    kept = stages["quality_rules"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    assert ids(kept) == ids(quality_rules.judged(docs).where("kept"))
    exact = stages["exact_dedup"](spark, kept, "").cache()
    last = {}
    for r in kept.collect():
        last[low(r.text)] = max(last.get(low(r.text), -1), r.doc_id)
    assert ids(exact) == sorted(last.values()) and exact.columns == docs.columns
    near = stages["near_dedup"](spark, exact, "").cache()
    rows = exact.collect()
    roots = brute_components([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows])
    assert ids(near) == sorted(set(roots.values())) and near.columns == docs.columns
    mixed = stages["mixing"](spark, near, "").cache()
    assert mixed.columns == docs.columns
    sizes, taken = defaultdict(int), Counter()
    for r in near.collect():
        sizes[r.source] += len(r.text.split())
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    assert max(Counter(ids(mixed)).values()) <= 2 and all(abs(taken[s] - want[s]) <= 62 for s in sizes)
    packed = stages["packing"](spark, mixed, "")
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).collect()
    copies = Counter(ids(mixed))
    assert {r.doc_id: r.n for r in whole} == {r.doc_id: r.d * copies[r.doc_id] for r in whole} and {r.doc_id for r in whole} == set(copies)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = C.run(spark, str(tmp_path))
    assert out.count() > 0 and [s for s, _ in C.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"] and C.ORACLE_SQL is None


def test_stages_with_null_and_repeated_ids(spark):
    rng = random.Random(12)

    def text(n=60):
        return " ".join(["The", *(f"the{rng.randrange(9000)}a" for _ in range(n)), "of and to in end."])

    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b.upper()), (1, c), (1, c), (1, d), (2, d), (3, e), (3, "### *** " * 20), (None, "### " * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SHAPE).repartition(2)
    stages = dict(C.STAGES)

    def out(stage, df):
        got = stages[stage](spark, df, "")
        assert got.columns == docs.columns
        return Counter((r.doc_id, low(r.text)) for r in got.collect())

    assert out("quality_rules", docs) == Counter((i, low(t)) for i, t in rows if "###" not in t)
    good = docs.where("text not like '%###%'")
    want = Counter((i, low(t)) for i, t in [(None, a), (None, b), (1, c), (2, d), (3, e)])
    assert out("exact_dedup", good) == want
    near = out("near_dedup", good.where("text = lower(text) or text like 'The%'"))
    assert near == Counter((i, low(t)) for i, t in [(None, a), (None, b), (1, c), (1, d), (3, e)])
    assert set(out("mixing", good.dropDuplicates(["doc_id", "text"]))) <= {(i, low(t)) for i, t in rows}
    assert any(i is None for i, _ in out("mixing", good))


def test_stages_with_clashing_columns_and_no_rows(spark, docs):
    names = ["row_key", "text_key", "sha", "gone_sha", "gone_id", "nth", "u", "size", "times", "copy_", "fp", "component_id", "text_sha256", "kept", "bucket", "target", "ROW"]
    long = " ".join(f"the{i % 977}a of" for i in range(20_000)) + "."
    rows = spark.createDataFrame([(5000, long, "en", "hot", len(long))], SHAPE)
    wide = docs.union(rows)
    for k in names:
        wide = wide.withColumn(k, F.lit(k))
    wide = wide.cache()
    for name, stage in C.STAGES[:-1]:
        plain, got = stage(spark, wide.select(*docs.columns), ""), stage(spark, wide, "")
        assert got.columns == wide.columns, name
        assert ids(got) == ids(plain) and got.where(" or ".join(f"`{k}` <> '{k}'" for k in names)).isEmpty(), name
        assert stage(spark, wide.limit(0), "").collect() == [], name
    stage = C.STAGES[-1][1]
    assert sum(r.length for r in stage(spark, wide, "").where("doc_id = 5000").collect()) == stage(spark, wide, "").where("doc_id = 5000").first().doc_tokens > 20_000
    assert stage(spark, wide.limit(0), "").collect() == []
