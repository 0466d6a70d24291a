import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from evidex.llm import html_extract as H
from evidex.llm import licenses as L
from evidex.llm import pii as P
from evidex.llm import quality_model as Q
from evidex.llm import quality_rules as R
from pyspark.sql import functions as F

TEXTS = [None, "", " \n\t", "one", "a b c d e f g h " * 3 + "tail", "line one\nline one\n \nline two\r\nline one", "# * & <x> | %", "w " * 30, "x" * 5000, "é ü\x0b\x0cß " * 9]


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= set(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_quality_base_columns(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in R.judged(docs).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}
    assert R.judged(docs.limit(0)).collect() == []
    assert R.keep_good(docs).columns == docs.columns


def test_quality_rules_find_junk(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = R.judged(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(x.quality, x.kept): x["count"] for x in r}
    assert n[1, True] > 0.97 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) < 0.1 * n[0, False]


def test_personal_data_base_spans():
    text = "mail a.b@c-d.example.org, x@y or @z.w and q@r.s@t.u; 1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 4111 1111 1111 1111 4111111111111112 +1 (017) 555-7713. +12"
    got = {}
    for k, a, b in P.base_spans(text):
        got.setdefault(k, []).append(text[a:b])
    assert got == {"email": ["a.b@c-d.example.org", "q@r.s"], "ip": ["1.2.3.4", "5.6.7.8"], "phone": ["+1 (017) 555-7713"]}
    assert [t[a:b] for t in ["x 4111 1111 1111 1111 y", "4111-1111-1111-1112", "4111111111111111!", "41111111111111110000"] for k, a, b in P.base_spans(t)] == ["4111 1111 1111 1111", "4111111111111111"]
    simple = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, found):
        digits = [int(x) for x in found if x in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    rng, hits = random.Random(9), Counter()
    for n in range(6000):
        t = "".join(rng.choice(("a1@@..- 2", "0123456789012345678901234567890123456789 -+(.", "12.3.")[n % 3]) for _ in range(rng.randint(1, 60)))
        spans = P.base_spans(t)
        for kind, pattern in simple.items():
            want = [m.span() for m in re.finditer(pattern, t) if passes(kind, m[0])]
            assert [(a, b) for k, a, b in spans if k == kind] == want, t
            hits[kind] += len(want)
    assert min(hits[k] for k in simple) > 20
    assert P.base_spans("a" * 200_000) == [] and P.base_spans("1" * 200_000) == []


def test_personal_data_terms(spark):
    rng = random.Random(2)
    noise = [f"n{i}x" for i in range(500)]
    rows = []
    for i in range(300):
        words = rng.choices(noise, k=30)
        if i % 50 == 0:
            words[10:10] = ["Contact", "Zebulon,", "zeb@corp.example.com"]
        rows.append((i, " ".join(words), "x"))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "none here", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = {}
    for r in P.find_personal_data(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2 and got[0][0] == got[0][1]
    for i, text, _ in rows:
        if i is None or i >= 1000:
            continue
        r = got[i][0]
        if i % 50 == 0:
            at = text.index("Zebulon")
            assert f"removed:{at}:{at + 7}" in r.spans and r.spans.startswith("email:") and r.n_email == 1
            assert "zeb" not in P.sanitise(text, r.spans).lower() and "[email]" in P.sanitise(text, r.spans)
            base = r.spans.split(",")[0]
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        else:
            assert r.spans == ""
    clean = P.sanitised_documents(docs)
    assert clean.columns == docs.columns and clean.where("text like '%Zebulon%'").count() == 0
    assert P.find_personal_data(docs.limit(0)).collect() == []


def test_licence_rules(spark):
    texts = [None, "", "Foo bar.\nLicensed under the Apache License, Version 2.0.\nMore.", "This work is licensed under the GNU General Public License, version 3. (or, at your option) any later version.", "Licensed under CC BY-NC 4.0. Released under the MIT License.", "All licence terms unknown here.", "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.n_unknown) for r in L.scan(docs).collect()}
    assert got == {0: ("", "", 0), 1: ("", "", 0), 2: ("ApacheRef2", "Apache-2.0", 0), 3: ("GplRef3,GplLater", "GPL-3.0-or-later", 0), 4: ("CcByNcRef,MitRef", "MIT,CC-BY-NC", 0), 5: ("", "", 1), 6: ("MitGrant", "MIT", 0)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This is GPL version 3 software.", "GPL-3.0"),
        ("under the GNU General Public License (GPL) version 3", "GPL-3.0"),
        ("Licence: GPL version 2 or later", "GPL-2.0-or-later"),
        ("GPLv2+ applies", "GPL-2.0-or-later"),
        ("LGPL version 2.1", "LGPL-2.1"),
        ("LGPL-3.0-or-later", "LGPL-3.0-or-later"),
        ("BSD 3-Clause License", "BSD-3-Clause"),
        ("New BSD license", "BSD-3-Clause"),
        ("the two-clause BSD licence", "BSD-2-Clause"),
        ("a BSD-style license", "BSD"),
        ("Apache 2.0 license", "Apache-2.0"),
        ("Apache-2.0", "Apache-2.0"),
        ("ASL 2.0", "Apache-2.0"),
        ("runs on the Apache 2.4 server", ""),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0,Classpath-exception-2.0"),
        ("GPL v2 with the Classpath Exception", "GPL-2.0,Classpath-exception-2.0"),
        ("It is not licensed under the GPL v3.", ""),
        ("Not available under the MIT License but under the Apache License 2.0", "Apache-2.0"),
        ("wir gehen mit dem Hund", ""),
    ],
)
def test_usual_phrases(spark, text, want):
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.licenses == want


def test_licenses_of_no_rows_repeats_and_long_texts(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "word " * 40_000 + ". Released under the MIT License. " + "word " * 40_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, None)], "doc_id long, text string")
    for c in ("s", "ids", "rest", "r0", "licenses", "n_unknown"):
        docs = docs.withColumn(c, F.lit("GPL-3.0"))
    assert sorted((r.doc_id or 0, r.licenses, r.n_unknown) for r in L.scan(docs).collect()) == [(0, "MIT", 0), (1, "MIT", 0), (1, "MIT", 0), (2, "", 0)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>One<br><p>Two  <i>th</i>ree &lt;b&gt;<div class="comments">rude</div><aside>side</aside><p>Four</article><footer>&copy; host</footer></body></html>"""


def test_article_text():
    assert H.main_text(PAGE, None) == "Head & line One Two three <b> Four"
    assert H.main_text("", None) == "" and H.main_text("<p", None) == "" and H.main_text("plain &am", None) == "plain &am"
    assert H.main_text("<article><p>cut &amp", None) == "cut &"
    assert H.main_text('<main>a<article class="x">b</article></main>', None) == "b"
    assert H.main_text("<!-- open <p>x", None) == "" and H.main_text("<div>a<!-- b -->c</div><a href='x>y", None).startswith("ac")


def stream(rng, n=12, letters=3):
    texts = [[rng.randrange(letters) for _ in range(rng.randint(0, 30))] for _ in range(n)]
    return texts, np.array(sum(texts, []), np.int64), np.repeat(np.arange(n), [len(s) for s in texts])


def test_suffix_array_is_sorted_to_the_end():
    for seed in range(5):
        rng = random.Random(seed)
        texts, tokens, owner = stream(rng)
        texts += [texts[0]]
        tokens, owner = np.r_[tokens, texts[0]].astype(np.int64), np.r_[owner, [12] * len(texts[0])].astype(np.int64)
        ends = np.cumsum([len(s) for s in texts])
        suffixes = [(tokens[i : ends[owner[i]]].tolist(), i) for i in range(len(tokens))]
        assert [i for _, i in sorted(suffixes)] == H.suffix_array(tokens, owner).tolist()


@pytest.mark.parametrize("run", [1, 2, 3, 6])
def test_shared_runs_are_those_of_brute_force(run):
    texts, tokens, owner = stream(random.Random(run))
    want = {}
    for k, s in enumerate(texts):
        for i in range(len(s) - run + 1):
            want.setdefault(tuple(s[i : i + run]), set()).add(k)
    starts, pages = H.shared_runs(tokens, owner, run)
    assert {tuple(tokens[i : i + run].tolist()): n for i, n in zip(starts, pages)} == {k: len(v) for k, v in want.items()} and len(starts) == len(want)


def brute_extract(pages, run, share, least):
    """Texts of (page, host, html) with one host's passages counted by hand; markup as `blocks` reads it."""
    hosts = {}
    for _, host, html in pages:
        hosts.setdefault(host, set()).add(H.page_text(html))
    out = {}
    for i, host, html in pages:
        every = [t.split() for t in sorted(hosts[host])]
        lines = [set(t.split("\n")) for t in hosts[host]]
        holds = lambda ws: sum(any(t[k : k + len(ws)] == ws for k in range(len(t) - len(ws) + 1)) for t in every)  # noqa: B023, E731
        found = H.blocks(html)
        zones = {z for z, _ in found}
        own = "article" if "article" in zones else "plain"
        need = max(share * len(every), least) if own == "plain" else max(share * len(every), least, H.FIRM, H.FIRM_SHARE * len(every))
        flat = " ".join(t for _, t in found).split()
        hit = [k for k in range(len(flat) - run + 1) if len(every) >= least and holds(flat[k : k + run]) >= need]
        kept, at = [], 0
        for zone, text in found:
            ws = text.split()
            start, at = at, at + len(ws)
            if zone != own:
                continue
            if len(ws) < run:
                if not any(k <= start and k + run >= at for k in hit) and (len(every) < least or sum(text in x for x in lines) < need):
                    kept.append(text)
                continue
            over = {k + d for k in hit if k >= start and k + run <= at for d in range(run)}
            if left := [w for k, w in enumerate(ws) if start + k not in over]:
                kept.append(" ".join(left))
        out[i] = " ".join(kept)
    return out


@pytest.mark.parametrize(("host_tokens", "small"), [(10**6, None), (60, None), (60, 0)])
def test_extract_equals_brute_force(spark, host_tokens, small):
    """Pages of few words with and without an article, so that passages of three words are shared by chance in every way."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    rows = []
    for i in range(40):
        body = "".join(f"<div>{say(rng.choice([1, 2, 3, 5, 9]))}</div>" for _ in range(rng.randint(0, 5)))
        body += f"<article><p>{say(9)}</p><p>same words here for all</p><p>{say(2)}</p></article>" if i % 3 == 0 else ""
        rows.append((i, f"http://h{i % 3 and 1}/{i}", f"<div>menu one</div>{body}<div>foot of {say(1)}</div>"))
    rows += [(90, "http://h1/9", rows[1][2]), (91, "http://h1/8", "<p>lone</p>" * 30), (92, "http://two/1", "<p>x y z</p>"), (93, "http://two/2", "<p>x y z</p><p>own</p>"), (94, "http://one/1", "<p>x y z</p>")]
    want = brute_extract([(i, u.split("/")[2], h) for i, u, h in rows], 3, H.SHARE, H.LEAST)
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), run_length=3, host_tokens=host_tokens, small=small)
    assert {r.page_id: r.text for r in got.collect()} == want


@pytest.mark.parametrize(("host_tokens", "passes"), [(10**6, 2), (20, 3)])
def test_pages_are_parsed_once_for_the_array_and_once_for_the_text(spark, monkeypatch, host_tokens, passes):
    """And once more where chunks only name candidates; hosts are measured without parsing, by what they show."""
    seen, whole = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *a, **k: (seen.append("html" in df.columns), whole(df, *a, **k))[1])
    rng = random.Random(6)
    rows = [(i, f"http://h/{i}", f"<script>{'x ' * 400}</script><!-- {'y ' * 99} --><p>{' '.join(rng.choices('abcdefgh', k=20))}</p>") for i in range(8)]
    want = brute_extract([(i, "h", h) for i, _, h in rows], 3, H.SHARE, H.LEAST)
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), run_length=3, host_tokens=host_tokens).collect()
    assert {r.page_id: r.text for r in got} == want and sum(seen) == passes


@pytest.mark.parametrize("letters", [1, 3, 70_000])
def test_short_and_wide_streams_are_sorted(letters):
    """Fewer tokens than one number holds, and so many different ones that it holds few."""
    for n in (0, 1, 2, 5, 40):
        rng = random.Random(n)
        texts = [[rng.choice([0, letters - 1, rng.randrange(letters)]) for _ in range(rng.randint(1, 9))] for _ in range(n)]
        tokens, owner = np.array(sum(texts, []), np.int64), np.repeat(np.arange(n), [len(t) for t in texts])
        ends = np.cumsum([len(t) for t in texts])
        assert [i for _, i in sorted((tokens[i : ends[owner[i]]].tolist(), i) for i in range(len(tokens)))] == H.suffix_array(tokens, owner).tolist()


def test_runs_are_found_by_their_words():
    rng = random.Random(9)
    words = [rng.choice(["a", "é", "漢字", "x" * 3000, "\x1c", "ab"]) for _ in range(200)]
    runs = H.Runs(" ".join(words), 3)
    by = {}
    for i in range(198):
        assert runs.words(i) == " ".join(words[i : i + 3]) and by.setdefault(runs.words(i), int(runs.keys[i])) == int(runs.keys[i])
    assert len(set(by.values())) == len(by)
    wanted = {k: p for p, k in list(by.items())[::2]}
    assert runs.hits(wanted, np.sort(np.array(list(wanted)))) == [i for i in range(198) if runs.words(i) in wanted.values()]
    assert H.Runs("", 3).hits(wanted, np.sort(np.array(list(wanted)))) == [] and runs.hits({}, np.zeros(0, np.int64)) == []


def test_halves_of_passages_are_none(spark):
    """Six words that pages 1-3 share and six that pages 3-5 share stand side by side on page 3: no longer passage repeats."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rng = random.Random(1)
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6))
    texts = {1: f"{a} {own()}", 2: f"{a} {own()}", 3: f"{a} {b}", 4: f"{own()} {b}", 5: f"{own()} {b}"}
    for tag in ("article", "div"):
        rows = [(i, f"http://h/{i}", f"<{tag}>{t}</{tag}>") for i, t in texts.items()]
        assert {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == texts


def test_two_unlike_pages_have_no_candidates(spark):
    rng = random.Random(2)
    pages = [("h", " ".join(f"w{rng.randrange(10**6)}" for _ in range(5000))) for _ in range(2)]
    assert H.boilerplate(spark.createDataFrame(pages, "host string, html string")).count() == 0
    long = [("h", "<p>the very same words of a house that each of its pages has</p>" + p) for _, p in pages]
    assert 0 < H.boilerplate(spark.createDataFrame(long, "host string, html string")).count() < 20


@pytest.mark.parametrize("host_tokens", [10**6, 50])
def test_host_boilerplate_goes(spark, host_tokens):
    rng = random.Random(3)
    rows = []
    for i in range(20):
        own = [f"w{rng.randrange(10**6)}" for _ in range(20)]
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<body><div>Welcome to the best site of all</div><div>{' '.join(own)}</div><div>Terms of use and imprint of the house</div></body>", " ".join(own)))
    rows += [(50, None, None, ""), (51, "x", "", ""), (0, rows[0][1], rows[0][2], rows[0][3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = H.extract(pages, host_tokens=host_tokens).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == {i: t for i, _, _, t in rows}
    assert H.extract(pages.limit(0)).collect() == []


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = Q.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "x " * 9000, 0.1), (1, None, 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1), (2, None), (2, 7), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.quality_scores(docs, one).collect())
    assert Q.quality_scores(docs.limit(0), one).collect() == []


def test_comment_articles_and_deep_lists():
    assert H.main_text('<article>own<article class="comment">rude</article> words</article>', None) == "own words"
    assert H.main_text('<article class="comment">own</article>', None) == "own"
    deep = "<article>" + "<div>" * 2500 + "a<aside>side</aside>b" + "</div>" * 2500 + "c</article>"
    assert H.main_text(deep, None) == "a b c"
    assert H.main_text('<article><ul><li class="promo">x<li>y</ul></article>', None) == "y"


@pytest.mark.parametrize("host_tokens", [10**6, 300])
def test_boilerplate_within_articles_goes(spark, host_tokens):
    rng = random.Random(4)
    rows, phrase = [], "as the old saying goes in this town"
    for i in range(24):
        w = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        shared = "a passage which a quarter of all articles of this host share in full word by word" if i % 4 == 0 else f"s{i}"
        own = f"{' '.join(w[:15])} {phrase} {' '.join(w[15:])}"
        notice = "get our letter with the best stories of the week every day before noon"
        html = f"<article><p>{own} {notice}</p><p>{shared}</p><p>Share this</p><p>All stories of the day in your mail box</p></article>"
        rows.append((i, f"http://h/{i}", html, f"{own} {shared}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string").repartition(3)
    got = {r.page_id: r.text for r in H.extract(pages, host_tokens=host_tokens).collect()}
    assert got == {i: t for i, _, _, t in rows}


def test_personal_data_terms_in_copies_and_signature_lines(spark):
    rng = random.Random(5)

    def text(n=60, *more):
        return " ".join([*(f"n{rng.randrange(5000)}x" for _ in range(n)), *more])

    held = [text(60, "call Quill, Quill 4711 zq at quill@corp.example.com") for _ in range(3)]
    line = [text(60, "signed by our clerk Orlan Vess under vess@corp.example.com any day") for _ in range(8)]
    once = text(60, "ask Nimbus for nim@corp.example.com")
    near = [once.replace(once.split()[5], f"edit{i}", 1) for i in range(8)]
    rows = [t for t in held for _ in range(40)] + line + near + [text() for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: P.sanitise(rows[r.doc_id], r.spans) for r in P.find_personal_data(docs).collect()}
    for i, _ in enumerate(rows[:120]):
        assert not {"Quill", "Quill,", "4711", "zq"} & set(got[i].split())
    assert all("Orlan" not in got[i] and "Vess" not in got[i] for i in range(120, 128))
    assert all("Nimbus" in got[i] for i in range(128, 136))


def brute_contexts(text, spans):
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    own = {P.term(w) for _, a, b in spans for w in text[a:b].split()}
    out = set()
    for k, a, b in spans:
        near = [w for w in words if w[1] <= a][-6:] + [w for w in words if w[0] >= b][:6]
        entity = k + ":" + re.sub("[^a-z0-9@.]", "", text[a:b].lower())
        out |= {(entity, P.term(text[x:y])) for x, y in near}
    return {(e, t) for e, t in out if t and t not in own}


def test_personal_data_equals_brute_force(spark):
    """Counts, shares, bounds and spans by plain loops over texts without near copies; names of single entities are found."""
    rng = random.Random(11)
    common = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        words = [rng.choice(common) for _ in range(rng.randint(30, 60))]
        if i % 30 == 0:
            words[12:12] = ["Mr", f"Nom{i}", "x" * 300, f"<n{i}@mail.example.com>,"]
        if i % 100 == 7:
            words[12:12] = ["Office", "of", "Verrault", "at", "+33 (140) 555-0199"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.spans for r in P.find_personal_data(docs).collect()}
    n, together, held, holds = len(rows), Counter(), Counter(), Counter()
    for _, text in rows:
        near = brute_contexts(text, P.base_spans(text))
        together.update(near)
        held.update({e for e, _ in near})
        holds.update({P.term(w) for w in text.split()})
    terms = {}
    for (e, t), k in together.items():
        low = k * max(0, 1 - 1 / (9 * k) - 1.2816 / (3 * k**0.5)) ** 3
        share, bound = (np.log2(n * x / (holds[t] * held[e])) / np.log2(n / held[e]) if x else -9 for x in (k, low))
        if share >= P.GENERALISE and bound >= P.SURE:
            terms.setdefault(e, {})[t] = share
    names = 0
    for i, text in rows:
        base = P.base_spans(text)
        mine = {}
        for e in {e for e, _ in brute_contexts(text, base)}:
            for t, share in terms.get(e, {}).items():
                mine[t] = max(share, mine.get(t, 0))
        want = [f"{k}:{a}:{b}" for k, a, b in base]
        more = []
        for m in re.finditer(r"\S+", text):
            word = m[0].strip(P._edges)
            if word.lower() in mine:
                a = m.start() + m[0].index(word)
                if not any(x < a + len(word) and a < y for _, x, y in base):
                    more.append(("removed" if mine[word.lower()] >= P.REMOVE else "generalised", a, a + len(word)))
                    names += word.startswith(("Nom", "Verrault"))
        assert got[i] == ",".join(want + [f"{k}:{a}:{b}" for k, a, b in sorted(more)])
        assert base or not got[i]
    assert names == 50 + 15


def test_personal_data_in_a_long_list_and_by_row(spark):
    long = " ".join(f"p{i}@mail.example.com" for i in range(20_000))
    assert len(P.base_spans(long)) == 20_000 and P.contexts(long, P.base_spans(long)) == []
    filler = [(i + 10, f"text {i} with nothing in it") for i in range(3)]
    rows = [(1, "write to a@b.org now"), (1, "or to c@d.org then"), (1, "or to c@d.org then"), (None, "x@y.org"), (2, None), (3, long), *filler]
    docs = spark.createDataFrame([(i, t, "k", 1, "m") for i, t in rows], "doc_id long, text string, key string, size int, MORE string")
    clean = P.sanitised_documents(docs)
    assert clean.columns == docs.columns
    out = sorted((r.doc_id or 0, r.text or "") for r in clean.where("doc_id is null or doc_id <> 3").collect())
    assert out == sorted([(1, "write to [email] now"), (1, "or to [email] then"), (1, "or to [email] then"), (0, "[email]"), (2, ""), *filler])
    assert clean.where("doc_id = 2 and text is null and key = 'k'").count() == 1
    assert P.sanitised_documents(docs.limit(0)).collect() == []


#: Headers as projects carry them, wrapped and commented, and the licence each stands for.
NOTICES = [
    ("Apache-2.0", "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"),
    ("GPL-3.0-or-later", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful.  See the\n * GNU General Public License for more details.\n *\n * You should have received a copy of the GNU General Public License\n * along with this program."),
    ("GPL-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "it under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation."),
    ("LGPL-2.1-or-later", "// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.\n"),
    ("LGPL-3.0", "Released under LGPLv3"),
    ("AGPL-3.0", "Released under the AGPLv3."),
    ("AGPL-3.0-or-later", "under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version."),
    ("GPL-3.0-or-later", "Published under GPLv3+"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright\n   notice.\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted.\n1. Redistributions of source code must retain the above copyright\nnotice.\n2. Redistributions in binary form must reproduce the above copyright notice."),
    ("MIT", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software.\n\nThe above copyright notice and this permission notice shall be\nincluded in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "the terms of the Eclipse Public License v. 2.0 which is available"),
    ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */\nint main() { return 0; }"),
    ("MIT,Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0\n// more"),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("GPL-3.0,GPL-2.0-or-later", "Under GPLv3. Also under the Apache kind of the GNU General Public License version 2 or later."),
    ("", "All rights reserved. Copyright (c) 2001 A. B."),
    ("", "The licence of a driver was taken. C++ or later was the choice."),
]


def test_licence_notices(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in L.scan(docs).collect()}
    wrong = {i: (want, got[i]) for i, (want, _) in enumerate(NOTICES) if sorted(filter(None, got[i].split(","))) != sorted(filter(None, want.split(",")))}
    assert not wrong
    # identifiers that a rule took stay apart: what stood on both sides of them is no sequence
    text = "Under GPL v3. Licensed under the Apache License, Version 2.0. Or, at your option, any later version."
    (r,) = L.scan(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()
    assert (r.doc_id, r.licenses) == (None, "Apache-2.0,GPL-3.0")


def test_quality_fit_equals_brute_force(spark):
    """The mixture over all documents one by one, in plain loops, and the verdicts that follow from it."""
    rng, words = random.Random(4), "the of and house river Tree stone walks in under a small green".split()
    texts = [*TEXTS]
    for i in range(250):
        t = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            t = [w.upper() + "!!" if rng.random() < 0.7 else "##" for w in t]
        if i % 9 == 0:
            t = t[:9] * 6
        lines = [" ".join(t[k : k + 12]) + rng.choice(["", "."]) for k in range(0, len(t), 12)]
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = R.judged(docs).collect()
    names = list(R.votes())
    votes = [[r[k] for k in names] for r in rows]
    prior, odds, before = 0.0, {k: {-1: -2.0, 0: 0.0, 1: 0.5} for k in names}, None

    def good(v):
        return 1 / (1 + np.exp(-(prior + sum(odds[k][x] for k, x in zip(names, v, strict=True)))))

    for _ in range(R.ROUNDS):
        p = [good(v) for v in votes]
        n = sum(p)
        counts = {k: {(c, x): 1 + sum((q if c else 1 - q) for q, v in zip(p, votes, strict=True) if v[i] == x) for c in (0, 1) for x in (-1, 1)} for i, k in enumerate(names)}
        prior = np.log((n + 1) / (len(votes) - n + 1))
        for k, c in counts.items():
            for x in (-1, 1):
                odds[k][x] = np.log(c[1, x] / (c[1, 1] + c[1, -1])) - np.log(c[0, x] / (c[0, 1] + c[0, -1]))
        if before is not None and abs(n - before) <= R.SETTLED * len(votes):
            break
        before = n
    for r, v in zip(rows, votes, strict=True):
        assert r.p_good == pytest.approx(good(v), abs=1e-9) and r.kept == (not r.base_failed and r.p_good >= 0.5)
    majority = [not r.base_failed and sum(v) > 0 for r, v in zip(rows, votes, strict=True)]
    assert 0 < sum(r.kept for r in rows) < sum(not r.base_failed for r in rows) and [r.kept for r in rows] != majority


def test_classifier_equals_brute_force(spark):
    """The discriminant from the rows themselves: means, shrunk covariances, densities."""
    rng = random.Random(6)
    texts = [None, "", "one"] + [" ".join(rng.choice(["word", "Other", "x1", "end."]) + ("!" if rng.random() < i % 2 / 2 else "") for _ in range(rng.randint(3, 80))) for i in range(200)]
    labels = [(i, i % 2) for i in range(3, 160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.score, r.predicted) for r in Q.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([Q.statistics((t or "").encode()) for t in texts])
    train = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    own = [np.array([x[i] for i, y in train if y == c]) for c in (0, 1)]
    d = x.shape[1]
    within = sum(np.cov(a.T, bias=True) * len(a) for a in own) / len(train) + 1e-6 * np.eye(d)
    density = []
    for a in own:
        s = (1 - Q.SHRINK_POOLED) * np.cov(a.T, bias=True) + Q.SHRINK_POOLED * within
        unit = np.sqrt(np.diag(within))
        r = s / np.outer(unit, unit)
        s = ((1 - Q.SHRINK_IDENTITY) * r + Q.SHRINK_IDENTITY * np.trace(r) / d * np.eye(d)) * np.outer(unit, unit)
        gap = x - a.mean(axis=0)
        far = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap)
        density.append(np.log((len(a) + 1) / (len(train) + 2)) - np.linalg.slogdet(s)[1] / 2 - far / 2)
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    assert all(got[i][0] == pytest.approx(want[i], abs=1e-6) and got[i][1] == int(got[i][0] >= Q.THRESHOLD) for i in range(len(texts)))
    assert Q.statistics(b"a b c d e a b c d f")[-1] > 0 and Q.statistics(b"ends here.          ")[13] == 1
