import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from evidex.llm import packing, token_files  # noqa: E402
from evidex.llm import tokens as T  # noqa: E402

ODD = ["", " ", "\n", "a\t\n\nb  c", "\x1cx !\x1c?", "  lead", " trail ", "\n\n", "a ́b é ΑΣ Σ", "it's don't 'S 12 345", "x\r\ny z　w", "<|endoftext|> a<|endoftext|>b", "É" * 3000, "one two\nthree"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_give_the_ids_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 64)
    enc, rng = T.Encoder(public_tokenizers.path(name)), random.Random(3)
    texts = ODD + ["".join(rng.choice("ab cD\n\t .,'é漢1\x1f ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for t in texts:
        assert enc.ids(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows(spark):
    texts = [None, *ODD, "word " * 4000, *("alpha beta gamma " * k for k in range(1, 60))]
    ids = random.Random(1).sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True)), spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, start int").repartition(3)


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    data, docs = rows(spark)
    enc, start, want = T.Encoder(path).tokenizer, 0, {}
    for doc_id, text in sorted(data):
        ids = [*enc.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(docs, path).collect()}
    assert got == want
    assert token_files.token_files(docs.limit(0), path).collect() == []
    twice = spark.createDataFrame([(None, "a"), (4, "b"), (4, "b")], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in token_files.token_files(twice, path).orderBy("start").collect()] == [(None, 0), (4, 2), (4, 4)]


def test_packing_places_each_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    data, docs = rows(spark)
    enc = T.Encoder(path).tokenizer
    ids = {i: [*enc.encode(t or "", add_special_tokens=False).ids, 1] for i, t in data}
    out, got = packing.pack_documents(docs, path).collect(), defaultdict(list)
    seqs = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        got[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(got[i]):
            assert start == at and n > 0
            at += n
        assert at == len(x)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048 and at.bit_count() == 1 and len(s) <= packing.Limits().segments
    heads = {i: len(enc.encode(t.partition("\n")[0], add_special_tokens=False).ids) if t and t.partition("\n")[0].strip() and t.partition("\n")[2].strip() else 0 for i, t in data}
    bearing = defaultdict(int)
    for r in out:
        bearing[r.sequence_id] += max(0, r.start + r.length - max(r.start, heads[r.doc_id]))
    assert max(bearing.values()) <= packing.Limits().loss_tokens and any(heads.values())
    assert packing.pack_documents(docs.limit(0), path).collect() == []


@pytest.mark.parametrize("cut", [True, False])
def test_vector_limits_hold(cut):
    rng, limits = random.Random(5), packing.Limits(100, 6, 40)
    tokens = [rng.randint(1, 160 if cut else 90) for _ in range(400)]
    loss = [rng.randint(0, min(t, 200 if cut else 40)) for t in tokens]
    seqs = packing.pack(tokens, loss, limits, cut)
    seen = defaultdict(set)
    for pieces in seqs:
        assert sum(n for _, _, n in pieces) <= 100 and len(pieces) <= 6
        bearing = sum(max(0, start + n - max(start, tokens[i] - loss[i])) for i, start, n in pieces)
        assert bearing <= 40
        for i, start, n in pieces:
            assert not seen[i] & set(range(start, start + n))
            seen[i] |= set(range(start, start + n))
    assert all(len(seen[i]) == t for i, t in enumerate(tokens))
    if not cut:
        assert all(len(s) <= sum(tokens) for s in seqs) and len(seqs) < 1.35 * max(sum(tokens) / 100, len(tokens) / 6, sum(loss) / 40)
        with pytest.raises(ValueError):
            packing.pack([101], [1], limits, cut=False)
    assert packing.pack([], [], limits, cut) == []


def test_all_three_limits_bind_and_sequences_are_few():
    """Examples with prompts as in a corpus: close to the bound that each limit gives, and each limit changes the result."""
    rng = random.Random(8)
    tokens = [min(20_000, int(rng.lognormvariate(6.3, 1.1)) + 1) for _ in range(1500)] + [rng.randint(1, 20) for _ in range(300)]
    loss = [n - min(n - 1, rng.randint(0, 250)) for n in tokens]
    limits = packing.Limits()
    seqs = packing.pack(tokens, loss, limits)

    def bearing(pieces):
        return sum(max(0, start + n - max(start, tokens[i] - loss[i])) for i, start, n in pieces)

    assert all(sum(n for _, _, n in s) <= limits.tokens and len(s) <= limits.segments and bearing(s) <= limits.loss_tokens for s in seqs)
    bound = max(-(-sum(tokens) // limits.tokens), -(-len(tokens) // limits.segments), -(-sum(loss) // limits.loss_tokens))
    assert bound <= len(seqs) < 1.1 * bound
    wide = packing.pack(tokens, loss, packing.Limits(segments=10**6, loss_tokens=10**6))
    assert any(len(s) > limits.segments for s in wide) and any(bearing(s) > limits.loss_tokens for s in wide)


def test_words_of_letters_need_the_model_alone():
    enc, rng = T.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    letters = [chr(c) for c in range(0x250) if len(chr(c).lower()) == 1 and chr(c).isalpha()]  # a dotted capital I is asked whole
    calls, whole = [], enc.bare.encode
    enc.bare.encode = enc.spaced.encode = lambda part: calls.append(part) or whole(part)
    for _ in range(500):
        text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 20))) + rng.choice(["", "", ",", "."]) for _ in range(8))
        assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert set(calls) <= {"\n", ",", ".", ""}
    assert not T.Encoder(public_tokenizers.path("word_bpe_49k.json")).bare.letters  # folds case, so it is asked whole


def test_folded_words_of_letters_need_the_model_alone():
    """With case and normal form C folded, words of Latin letters in any case go to the model in small letters."""
    enc, rng = T.Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(7)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    plain = [c for c in letters if len(c.lower()) == 1 and c.lower() < "ɐ"]
    calls, whole = [], enc.bare.encode
    enc.bare.encode = lambda part: calls.append(part) or whole(part)

    def same(some, ends=("", "", ",", ".")):
        text = " ".join("".join(rng.choices(some, k=rng.randint(1, 20))) + rng.choice(ends) for _ in range(8))
        assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)

    for _ in range(500):
        same(plain)
    assert set(calls) <= {",", "."}
    for _ in range(500):  # letters that grow, marks that combine, other scripts and what splits words
        same([*letters, *"aeoAEOİİ̧́̈Σσς漢ⅷ1'-_ⱥⱦK"], ("", "'s", "'ll", "<|endoftext|>"))
    for c in letters:
        assert enc.ids(c).tolist() == enc.tokenizer.encode(c, add_special_tokens=False).ids, repr(c)
    assert T.Encoder(public_tokenizers.path("byte_bpe_50k.json")).bare.folded is None


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("end_id", [0, 1 << 16])
def test_blocks_of_texts_give_the_ids_of_whole_texts(name, end_id, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 64)
    monkeypatch.setattr(T, "BLOCK_BYTES", 900)
    enc, rng = T.Encoder(public_tokenizers.path(name)), random.Random(11)
    letters = ["ab cD\n\t .,'é漢1\x1f ", "aé \n.,|$", "a\x85\xa0\u1680\u2005\u2028\u202f\u205f\u3000 \nà.", "x😀Ā\u0300Σİ \n!;"]
    texts = [None, *ODD, "a|b.c <|endoftext|>.", "x\n\xa0y", "word " * 300]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for some in letters for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array([*range(len(texts))][i : i + n], pa.int64()), pa.array(texts[i : i + n], pa.string())], ["i", "t"]) for i, n in [(0, 0), (0, 5), (5, 0), (5, len(texts))]]
    got, sizes = {}, []
    for own, block in T.blocks(batches):
        ids, ends = enc.many(block, end_id)
        sizes.append(len(block))
        for i, a, b in zip(own.to_pylist(), [0, *ends], ends, strict=False):
            got[i] = ids[a:b].tolist()
    for i, t in enumerate(texts):
        assert got.pop(i) == [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], repr(t)
    assert not got and sum(sizes) == len(texts) and 5 < len(sizes) < len(texts) / 4


def test_a_block_asks_for_each_different_part_once(monkeypatch):
    """The cost of a word that occurs again: none in Python, so that the corpus's size is Arrow's to go through."""
    enc, asked = T.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    monkeypatch.setattr(T.Encoder, "_part", lambda self, part, whole=T.Encoder._part: asked.append(part) or whole(self, part))
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choices(["alpha", "beta,", "gamma."], k=9)) for _ in range(50)) for _ in range(40)]
    ids, ends = enc.many(pa.array(texts, pa.large_string()), 0)
    want = [x for t in texts for x in [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    assert ids.tolist() == want and len(ends) == len(texts)
    assert sorted(asked) == sorted(["alpha", " alpha", "beta", " beta", "gamma", " gamma", ",", ".", "\n"])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_first_lines_of_a_block(name):
    enc, rng = T.Encoder(public_tokenizers.path(name)), random.Random(13)
    texts = [*ODD, "a \nb", "a\xa0\nb", "\n\na", "é,\nb.\n"] + ["".join(rng.choice("ab \n\n é\xa0\x1c.") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    ids, ends, heads = enc.many_with_heads(pa.array(["left out", *texts], pa.large_string())[1:], 1)
    for t, a, b, head in zip(texts, [0, *ends], ends, heads, strict=False):
        first, _, rest = t.partition("\n")
        assert ids[a:b].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1], repr(t)
        assert head == (len(enc.tokenizer.encode(first, add_special_tokens=False).ids) if first.strip() and rest.strip() else 0), repr(t)
