"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

The patterns find e-mail addresses, IP addresses, card and phone numbers. Each such value is a protected entity. A term
near an entity reveals it as far as the two occur together more than chance has it: with p over documents,
PMI(t, e) = log2(p(t, e) / (p(t) p(e))), against the entity's information IC(e) = -log2 p(e). Where PMI / IC reaches
GENERALISE the term is replaced by a word for its shape, from REMOVE on it is removed, in documents that hold the entity.
Most personal data stands in one or two texts, which is little to go by. So a pair counts only where it reveals SURE of
the entity's information even with the lower bound of its co-occurrence (of a Poisson count, at 90 %) in place of the
count: a term that one text has beside the entity must then be rare in a large corpus, and the more texts show the pair,
the more common the term may be.

Counts are over all documents, and all in one unit: texts, of which exact copies and most near copies are one, as they
share the least hash of their runs of four words.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.rows import new_names
from evidex.session import cut, ship

KINDS = ("email", "ip", "card", "phone")
NEAR_WORDS = 6
GENERALISE, REMOVE = 0.8, 0.95
SURE = 0.65
#: Bits of the filter that leaves words out of the count; what it lets through wrongly is joined away.
FILTER_BITS = 1 << 24
#: Words whose hash a task remembers.
KNOWN_WORDS = 500_000
#: Rows up to which a counted table is broadcast.
SMALL_TABLE = 50_000
_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"[^\x20\x09-\x0D]+")
_edges = ".,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    d = [int(x) for x in digits[::-1]]
    return sum(d[::2] + [x // 5 + 2 * x % 10 for x in d[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; each scan takes time in proportion to the text."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _local.match(text, start - 1):
            start -= 1
        m = _domain.match(text, at) if start < at else None
        if m:
            out.append(("email", start, last := m.end()))
        at = text.find("@", max(at + 1, last))
    for m in _ip.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(text):
        if 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _phone.finditer(text):
        if 8 <= sum("0" <= x <= "9" for x in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def term(word: str) -> str:
    """A word as it is counted: without marks at its edges, in lower case."""
    return word.strip(_edges).lower()


def text_key(text: str | bytes) -> int:
    """A hash of a text, the one which Spark's xxhash64 gives."""
    return (xxhash.xxh64_intdigest(text, 42) ^ 1 << 63) - (1 << 63)


def text_group(raw: bytes) -> int:
    """The least hash of a UTF-8 text's runs of four words, which copies share, and near copies mostly."""
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in raw.split()], np.uint64)
    n, runs = max(1, len(words) - 3), np.zeros(1, np.uint64)
    for i in range(min(4, len(words))):
        runs = (runs ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        runs = runs ^ runs >> np.uint64(29)
    return int(runs.min().astype(np.int64))


def contexts(text: str, spans: list[tuple[str, int, int]], near: int = NEAR_WORDS) -> list[tuple[str, str]]:
    """(entity, term): terms of the `near` words before and after each entity. Words of the entities themselves are none."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in _word.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken = {term(w) for k, a, b in spans for w in _word.findall(text[a:b])}
    out = set()
    for kind, start, end in spans:
        first, last = bisect_right(ends, start), bisect_left(starts, end)
        around = [text[a:b] for a, b in words[max(0, first - near) : first] + words[last : last + near]]
        entity = f"{kind}:{re.sub('[^a-z0-9@.]', '', text[start:end].lower())}"
        out |= {(entity, t) for t in map(term, around) if t and t not in taken}
    return sorted(out)


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, key long, t string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<string>, near array<struct<entity:string,term:string>>, text_group long"


def base_rows(docs: DataFrame) -> DataFrame:
    """The base result of each row, the entities in it and the terms near them; key is a hash of the text. Only rows with
    such terms keep their text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("t", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", pa.string()), ("entities", pa.list_(pa.string())), ("near", pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))), ("text_group", pa.int64())])
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                spans = base_spans(text)
                near = contexts(text, spans)
                row = {"doc_id": doc_id, "key": text_key(text), "t": text if near else None, "text_group": text_group(text.encode()), "base": _join(spans), "base_sha256": hashlib.sha256(_join(spans).encode()).hexdigest()}
                row |= {f"n_{k}": sum(s[0] == k for s in spans) for k in KINDS}
                rows.append(row | {"entities": sorted({e for e, _ in near}), "near": [dict(zip(("entity", "term"), x, strict=True)) for x in near]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.mapInArrow(run, FOUND)


def holders(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, n): how many texts hold each term of `wanted` (h), a term's hash. docs: (t).

    What is shuffled is such terms with the group of the text that holds them; texts stay where they are. A filter of a fixed
    size spares the words that are not wanted; what it lets through wrongly does no harm."""
    bit = F.pmod(F.col("h"), F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from 1
    filled = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in filled.collect():  # FILTER_BITS / 32768 rows of 4 KB at most
        first = (r.bucket - 1) * 4096
        bits[first : first + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    bits = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int | None] = {}

        def found(word: bytes) -> int | None:
            t = term(word.decode())
            h = text_key(t)
            at = h % FILTER_BITS
            return h if t and bits.value[at >> 3] >> (at & 7) & 1 else None

        for b in batches:
            terms, groups = [], []
            for text in b.column(0).cast(pa.large_binary()):
                text = text.as_py() or b""
                here = set()
                for word in set(text.split()):
                    if word not in known:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        known[word] = found(word)
                    here.add(known[word])
                here.discard(None)
                if here:
                    terms += here
                    groups += [text_group(text)] * len(here)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(groups, pa.int64())], ["h", "g"])

    return docs.select("t").mapInArrow(run, "h long, g long").distinct().groupBy("h").agg(F.count("*").alias("n"))


def at_least(count: Column) -> Column:
    """The lower bound of a Poisson mean after this count, at 90 % (Wilson and Hilferty's approximation)."""
    return count * F.pow(F.greatest(F.lit(0.0), 1 - 1 / (9 * count) - 1.2816 / (3 * F.sqrt(count))), 3)


def revealing_terms(docs: DataFrame, found: DataFrame, sure: float = SURE) -> DataFrame:
    """(entity, term, share): terms whose share of the entity's information reaches GENERALISE, and `sure` at the least."""
    held = found.where("t is not null")
    n_texts = F.count_distinct("text_group")
    pairs = held.select("text_group", F.explode("near").alias("x")).groupBy("x.entity", "x.term").agg(n_texts.alias("together"))
    entities = held.select("text_group", F.explode("entities").alias("entity")).groupBy("entity").agg(n_texts.alias("n_entity"))
    pairs = cut(pairs.join(entities, "entity").withColumn("h", F.xxhash64("term")))
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(1.0).alias("share"))
    n = max(2, found.agg(n_texts).first()[0])

    def share(together: Column, n_term: str) -> Column:
        information = F.log2(n / F.col("n_entity"))
        pmi = F.log2(n * together / (F.greatest(n_term, "together") * F.col("n_entity")))
        return F.when(information > 0, pmi / information).otherwise(0.0)

    def reveals(n_term: str) -> Column:
        return (share(F.col("together"), n_term) >= GENERALISE) & (share(at_least(F.col("together")), n_term) >= sure)

    # most terms are too common by what the texts with entities show, and need no counting elsewhere
    pairs = pairs.join(holders(held, pairs.select("h").distinct()).withColumnRenamed("n", "n_held"), "h").where(reveals("n_held"))
    pairs = cut(pairs)
    counted = pairs.join(holders(docs, pairs.select("h").distinct()), "h").where(reveals("n"))
    return counted.select("entity", "term", share(F.col("together"), "n").alias("share"))


def term_spans(text: str, terms: dict[str, float]) -> list[tuple[str, int, int]]:
    """Spans of the terms in a text, outside base spans: kind `removed` or `generalised` by what they reveal."""
    taken, out = sorted((a, b) for _, a, b in base_spans(text)), []
    ends = list(accumulate((b for _, b in taken), max))
    starts = [a for a, _ in taken]
    for m in _word.finditer(text):
        word = m[0]
        share = terms.get(term(word))
        if share is not None:
            start = m.start() + len(word) - len(word.lstrip(_edges))
            end = start + len(word.strip(_edges))
            before = bisect_left(starts, end)  # base spans that begin before the word ends
            if not before or ends[before - 1] <= start:
                out.append(("removed" if share >= REMOVE else "generalised", start, end))
    return sorted(out)


def general(word: str) -> str:
    """What stands for a generalised term: its shape."""
    return "[number]" if any(map(str.isdigit, word)) else "[name]" if word[:1].isupper() else "[word]"


def sanitise(text: str, spans: str) -> str:
    """The text with base spans replaced by their kind, generalised terms by their shape, and removed ones left out."""
    marks, last, out = sorted(((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))), 0, []
    for a, b, k in marks:
        if a < last:
            b = max(b, last)
            out.append(f"[{k}]" if k in KINDS and b > last else "")
        else:
            out += [text[last:a], f"[{k}]" if k in KINDS else general(text[a:b]) if k == "generalised" else ""]
        last = b
    return "".join([*out, text[last:]])


def revealed(d: DataFrame, found: DataFrame, sure: float = SURE) -> DataFrame:
    """(key, size, more): the term spans of each text that has any; key and size, its length, tell texts apart."""
    held = cut(revealing_terms(d, found, sure))
    texts = found.where("t is not null").select("key", F.char_length("t").alias("size"), "t", "entities")
    each = texts.select("key", "size", F.explode("entities").alias("entity")).distinct().join(held, "entity")
    each = each.groupBy("key", "size", "term").agg(F.max("share").alias("share"))
    each = each.groupBy("key", "size").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms"))
    texts = texts.select("key", "size", "t").join(each, ["key", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [_join(term_spans(text, dict(terms))) for text, terms in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(more, pa.string())], ["key", "size", "more"])

    return texts.mapInArrow(run, "key long, size int, more string").where("more <> ''").dropDuplicates(["key", "size"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """The query's rows: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, for every row of docs.

    spans holds the base spans, then those of `generalised` and `removed` terms. Null and empty texts have no spans. Spans go
    by the text alone: repeated rows get equal results, rows of one doc_id with different texts their own. Copies count as one
    text. A null doc_id stays null. No documents give no rows. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = cut(base_rows(d))
    more = cut(revealed(d, found, sure))
    few = F.broadcast(more) if more.count() <= SMALL_TABLE else more
    both = found.withColumn("size", F.char_length("t")).join(few, ["key", "size"], "left")
    return both.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.concat_ws(",", F.nullif("base", F.lit("")), "more").alias("spans"))


def sanitised_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text sanitised by the spans found: a row for each row, with all columns; null texts stay null.

    Rows go by their texts. Columns of the caller's may have any names."""
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    d = docs.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    more = cut(revealed(d, cut(base_rows(d))))
    key, size, extra = new_names(docs, "key", "size", "more")
    more = more.toDF(key, size, extra)
    few = F.broadcast(more) if more.count() <= SMALL_TABLE else more

    @F.pandas_udf("string")
    def clean(texts: pd.Series, extra: pd.Series) -> pd.Series:
        return pd.Series([t and sanitise(t, ",".join(filter(None, [_join(base_spans(t)), x]))) for t, x in zip(texts, extra, strict=True)], dtype=object)

    both = docs.join(few, (own == F.col(key)) & (F.char_length(docs[text_col]) == F.col(size)), "left")
    return both.select(*(clean(docs[c], F.col(extra)).alias(c) if c == text_col else docs[c] for c in docs.columns))
