"""Main text of web pages: a suffix array over the pages of a host finds boilerplate, markup narrows down what is left.

A page's visible text is cut into blocks. The words of all blocks, those of the article element included, are a stream;
the streams of a host's different pages are joined and their suffixes sorted to the end. Neighbours in that order that
share RUN words or more are one passage, and the pages it stands on are counted; blocks of under RUN words are compared as
wholes. A passage counts as one only where all its words stand in a row elsewhere too: what two other pages share one half
each of is no passage. Outside of article elements, boilerplate is what a fiftieth of the host's different pages share, two
at least; within them only what half of these share, three at least, since articles may quote the same passage. A passage goes from
the block that it stands in, and a block of under RUN words goes where it stands in a passage. Of what is left, the text of the article (or main) element
is the main text, and on pages without one everything outside elements which the markup names as menu, footer, advert, form
or comment.

A host with over HOST_TOKENS words is sorted in chunks of pages; its words are estimated by the characters outside of tags,
so that pages need not be parsed for it: the number of chunks does not change results. What stands on a share of all pages stands on that share
of some chunk's pages, so the chunks name candidates, which are then counted over all pages of the host: the result is
that of one array. A host's candidates are at most the words of fifty of its pages, as each stands on a fiftieth of them, or
half its words where these are few. Hashes find passages, and their words decide.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.session import cut, ship

RUN = 12
#: The share of a host's different pages, and the least number, that make boilerplate; within articles.
SHARE, LEAST = 0.02, 2
FIRM_SHARE, FIRM = 0.5, 3
HOST_TOKENS = 500_000
#: Where hosts are measured: characters that count as a word, and roughly what a page does not show.
WORD_CHARS = 6
HIDDEN = r"(?is)<(script|style|noscript|template|iframe|svg|math|object|canvas|textarea|title|select)(?=[\s/>]).*?</\1|<!--.*?-->|<[^>]*>"
#: Passages, or hosts, up to which a table of them is broadcast; of about 0.1 KB each.
SMALL_TABLE = 200_000
#: Tasks that the pages of a host are dealt over, where passages are more.
DEALT = 64
_tag = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)(?:>|\Z)""", re.S)
_attribute = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: What stands in any attributes that can name boilerplate.
_telling = re.compile("class|id|role|style")
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form button dialog menu head".split())
HINTS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Elements that end those which may stay unclosed.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_raw_ends = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}


def is_boilerplate(name: str, attributes: str, nested: bool = False) -> bool:
    """Whether an element is menu, header, footer, advert, form, comment or hidden, by its name and attributes; an article
    element only where it is nested in another one, as comments are."""
    if name in BOILERPLATE:
        return True
    if not _telling.search(attributes) or name in ("html", "body", "main") or name == "article" and not nested:
        return False
    for key, value in _attribute.findall(attributes):
        value = value.strip("\"'").lower()
        if key in ("class", "id") and not HINTS.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
        if key == "hidden" or key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each visible block: zone is `article`, `main`, `named` (boilerplate by its markup) or `plain`."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []
    opened: dict[str, int] = {}
    zone, at = "plain", 0

    def pop() -> str:
        name, before = stack.pop()
        opened[name] -= 1
        return before

    def flush() -> None:
        if words := " ".join(entities.unescape("".join(text)).split()):
            out.append((zone, words))
        text.clear()

    while at < len(page):
        m = _tag.search(page, at)
        if not m:
            text.append(page[at:])
            break
        start = m.start()
        if start > at:
            text.append(page[at:start])
        at = m.end()
        closing, name, attributes = m.groups()
        if not name:
            continue
        name = name.lower()
        inline = name in INLINE
        if text and not inline:
            flush()
        if closing:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                zone = pop()
        elif name in RAW:
            end = _raw_ends[name].search(page, at)
            at = end.start() if end else len(page)
        elif name not in VOID and not attributes.endswith("/"):
            if stack and stack[-1][0] == "p" and not inline:
                zone = pop()
            for closed in CLOSES.get(name, ()):
                if stack and stack[-1][0] == closed:
                    zone = pop()
            stack.append((name, zone))
            opened[name] = opened.get(name, 0) + 1
            if is_boilerplate(name, attributes, opened.get("article", 0) > (name == "article")):
                flush()
                zone = "named"
            elif name in ("article", "main") and zone != "named":
                zone = "article" if name == "article" or zone == "article" else "main"
    flush()
    return out


def ends_of(owner: np.ndarray) -> np.ndarray:
    """Where the stream of each token ends."""
    return np.cumsum(np.bincount(owner))[owner] if len(owner) else owner


def suffix_array(tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order, by doubling; a suffix ends with its stream. tokens: the joined streams, as numbers
    from 0; owner: the stream of each token, ascending. Equal suffixes are in the order of their starts."""
    n, end = len(tokens), ends_of(owner)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(tokens.max() + 1).bit_length()
    size = max(1, 62 // bits)  # as many tokens as one number holds are compared at once
    own = tokens.astype(np.int64) + 1
    key, at = own.copy(), np.arange(n)
    for k in range(1, min(size, n)):
        key <<= bits
        key[: n - k] |= np.where(at[: n - k] + k < end[: n - k], own[k:], 0)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int64)  # where a suffix's group begins in the order
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    open_ = order[~(new & np.r_[new[1:], True])]  # suffixes that are not alone in their group, by group and start
    while len(open_):
        group = rank[open_]
        key = group * (n + 1)
        inside = open_ + size < end[open_]
        key[inside] += rank[open_[inside] + size] + 1
        by = np.argsort(key, kind="stable")
        open_, group, key = open_[by], group[by], key[by]
        at = np.arange(len(open_))
        starts, new = np.r_[True, np.diff(group) != 0], np.r_[True, np.diff(key) != 0]
        first = np.maximum.accumulate(np.where(starts, at, 0))
        order[group + at - first] = open_
        rank[open_] = group + np.maximum.accumulate(np.where(new, at, 0)) - first
        if new.sum() == starts.sum():  # a round that tells no more suffixes apart is the last
            break
        open_, size = open_[~(new & np.r_[new[1:], True])], 2 * size
    return order


def shared_runs(tokens: np.ndarray, owner: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, pages): a start of each passage of `run` tokens, and how many streams hold it. In suffix order, equal passages
    are neighbours whose common beginning has `run` tokens."""
    order = suffix_array(tokens, owner)
    order = order[order + run <= ends_of(owner)[order]]
    if not len(order):
        return order, order
    same = np.arange(1, len(order))  # those that begin like the one before, word by word
    for k in range(run):
        same = same[tokens[order[same] + k] == tokens[order[same - 1] + k]]
    new = np.ones(len(order), bool)
    new[same] = False
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    many = np.zeros(len(order), bool)
    many[same], many[same - 1] = True, True
    held_by = np.sort(group[many] * (owner[-1] + 1) + owner[order[many]])
    pages = np.bincount(held_by[np.r_[True, np.diff(held_by) != 0][: len(held_by)]] // (owner[-1] + 1), minlength=len(starts))
    return order[starts], np.maximum(pages, 1)


def run_keys(words: np.ndarray, run: int) -> np.ndarray:
    """A hash of each run of `run` words, by their hashes."""
    n = len(words) - run + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = words[:n].copy()
    for i in range(1, run):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
    return out.view(np.int64)


#: Random odd numbers: for each byte, and for its place in a word.
_bytes, _places = (np.random.default_rng(k).integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for k, n in ((1, 256), (2, 1024)))
_bytes[32] = 0


class Runs:
    """The runs of `run` words of a text whose words are parted by single spaces: a hash of each, and its words."""

    def __init__(self, text: str, run: int):
        self.data, self.run = text.encode(), run
        codes = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(codes == 32)
        self.starts, self.ends = np.zeros(len(gaps) + 1, np.int64), np.full(len(gaps) + 1, len(codes))
        self.starts[1:], self.ends[:-1] = gaps + 1, gaps
        if len(self.starts) < run:
            self.keys = np.zeros(0, np.int64)
            return
        lengths = self.ends - self.starts + 1  # with the space after a word, which counts nothing
        terms = np.zeros(len(codes) + 1, np.uint64)
        terms[:-1] = _bytes[codes]
        terms *= _places[(np.arange(len(terms)) - np.repeat(self.starts, lengths)) & 1023]
        self.keys = run_keys(np.add.reduceat(terms, self.starts), run)

    def words(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i + self.run - 1]].decode()

    def hits(self, wanted: dict[int, str], keys: np.ndarray) -> list[int]:
        """Where a wanted passage begins; keys: the hashes of all wanted ones, in order."""
        if not len(keys) or not len(self.keys):
            return []
        alike = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)] == self.keys).tolist()
        return [i for i in alike if wanted[int(self.keys[i])] == self.words(i)]


def block_key(block: str) -> int:
    """A hash of a short block, which no run has."""
    return xxhash.xxh3_64_intdigest("\n" + block) - (1 << 63)


def short_blocks(text: str, run: int) -> dict[int, str]:
    """The blocks of under `run` words by hash; blocks stand on lines of their own."""
    return {block_key(b): b for b in text.split("\n") if b and b.count(" ") + 1 < run}


def page_text(page: str) -> str:
    """All visible text, a block on each line."""
    return "\n".join(t for _, t in blocks(page))


def chunk_runs(texts: list[str], run: int, share: float, least: int) -> list[tuple[int, str, int]]:
    """(hash, passage, pages) of the passages of `run` words and the short blocks that `share` of the texts hold, `least` at
    least; a short block begins with a line feed."""
    need = max(share * len(texts), least)
    counts: dict[int, int] = {}
    named: dict[int, str] = {}
    for t in texts:
        for k, b in short_blocks(t, run).items():
            counts[k] = counts.get(k, 0) + 1
            named[k] = "\n" + b
    out = [(k, named[k], c) for k, c in counts.items() if c >= need]
    parted = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts if t], pa.large_string()), " ")
    words = parted.flatten()
    tokens = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(parted)), pc.list_value_length(parted).to_numpy())
    starts, pages = shared_runs(tokens, owner, run)
    for i, c in zip(starts[pages >= need].tolist(), pages[pages >= need].tolist(), strict=True):
        passage = " ".join(words[i : i + run].to_pylist())
        out.append((int(Runs(passage, run).keys[0]), passage, c))
    return out


def held(text: str, wanted: dict[int, str], keys: np.ndarray, run: int) -> list[str]:
    """Which of a host's passages, as `prepared`, a text holds."""
    runs = Runs(text.replace("\n", " "), run)
    short = {wanted[k] for k, b in short_blocks(text, run).items() if wanted.get(k) == "\n" + b}
    return sorted(short | {wanted[int(runs.keys[i])] for i in runs.hits(wanted, keys)})


Marks = tuple[np.ndarray, list[str], np.ndarray]


def prepared(marks: Marks) -> tuple[tuple[dict[int, str], np.ndarray], ...]:
    """A host's passages by hash, and their hashes in order: all of them, and those that go from articles too."""
    every = dict(zip(marks[0].tolist(), marks[1], strict=True))
    firm = {k: every[k] for k in marks[0][marks[2]].tolist()}
    return tuple((d, np.sort(np.fromiter(d, np.int64, len(d)))) for d in (every, firm))


def of_host(ready: dict[str, tuple | None], host: str, marks: Callable[[str], Marks | None]) -> tuple | None:
    """A host's marks as `prepared`, kept in `ready`, which is cleared when full."""
    if host not in ready:
        if len(ready) >= 256:
            ready.clear()
        some = marks(host)
        ready[host] = some and prepared(some)
    return ready[host]


KEYED = "host string, key long, text string, found array<string>"


def keyed_pages(batches: Iterator[pa.RecordBatch], marks: Callable[[str], Marks | None] | None, with_text: bool, run: int) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, int]] = set()
    ready: dict[str, tuple | None] = {}
    for b in batches:
        rows = []
        for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
            text = page_text(page.as_py() or "")
            key = xxhash.xxh3_64_intdigest(text) - (1 << 63)
            if (host, key) in seen:
                continue
            seen.add((host, key))
            found = None
            if marks and (some := of_host(ready, host, marks)):
                found = held(text, *some[0], run)
            rows.append((host, key, text if with_text else None, found))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "key", "text", "found"])


def _arrays(rows: list[tuple[int, str, bool]]) -> Marks:
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array([r[2] for r in rows], bool)


def with_marks(p: DataFrame, marks: DataFrame, each: Callable[[Iterator[pa.RecordBatch], Callable[[str], Marks | None]], Iterator[pa.RecordBatch]], schema: str, small: int | None = None) -> DataFrame:
    """each(batches of p, a host's marks) as a table. marks: (host, run, passage, firm). Up to SMALL_TABLE of them every task gets
    them once; beyond, pages are dealt by host, a host's over several tasks, and each task gets a host's marks ahead of its pages."""
    if marks.count() <= (SMALL_TABLE if small is None else small):
        by: dict[str, list] = {}
        for r in marks.select("host", "run", "passage", "firm").collect():
            by.setdefault(r.host, []).append((r.run, r.passage, r.firm))
        shared = p.sparkSession.sparkContext.broadcast({h: _arrays(rows) for h, rows in by.items()})
        return p.mapInArrow(lambda batches: each(batches, lambda host: shared.value.get(host)), schema)
    deal = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal_")
    rows = F.collect_list(F.struct("run", "passage", "firm")).alias("marks_")
    first = marks.groupBy("host").agg(rows).select("host", deal, "marks_")
    pages = p.select(*p.columns, F.pmod(F.xxhash64("html"), F.lit(DEALT)).cast("int").alias("deal_")).withColumn("marks_", F.lit(None).cast(first.schema["marks_"].dataType))
    for c, kind in p.dtypes:
        if c != "host":
            first = first.withColumn(c, F.lit(None).cast(kind))
    dealt = pages.unionByName(first).repartition("host", "deal_").sortWithinPartitions("host", "deal_", F.col("marks_").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, Marks] = {}

        def parts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                heads = np.flatnonzero(b.column("marks_").is_valid().to_numpy(zero_copy_only=False)).tolist()
                for i, until in zip([-1, *heads], [*heads, b.num_rows], strict=True):
                    if i >= 0:
                        now.clear()
                        now[b.column("host")[i].as_py()] = _arrays([(m["run"], m["passage"], m["firm"]) for m in b.column("marks_")[i].as_py()])
                    if until > i + 1:
                        yield b.slice(i + 1, until - i - 1)

        yield from each(parts(), now.get)

    return dealt.mapInArrow(run, schema)


def boilerplate(p: DataFrame, run_length: int = RUN, host_tokens: int = HOST_TOKENS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, run, passage, pages, host_n): passages and short blocks, by hash and words, which a share of the host's different pages hold.
    p: (host, html)."""
    ship(p.sparkSession)
    seen = F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, " ")
    sizes = p.select("host", seen.alias("seen_")).select("host", F.xxhash64("seen_").alias("seen_"), F.length("seen_").alias("n")).groupBy("host", "seen_").agg(F.max("n").alias("n"), F.count("*").alias("rows")).groupBy("host")
    chunks = F.greatest(F.lit(1), F.ceil(F.sum("n") / (host_tokens * WORD_CHARS))).cast("long").alias("chunks")
    hosts = cut(sizes.agg(F.sum("rows").alias("rows"), chunks).where(F.col("rows") >= least).select("host", "chunks"))
    few = F.broadcast(hosts) if hosts.count() <= SMALL_TABLE else hosts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, texts = None, None, []

        def result() -> pa.RecordBatch:
            # Of a chunk of several, a passage may be on fewer pages here than on the whole host.
            found = [(None, None, len(texts)), *chunk_runs(texts, run_length, share, least if at[2] == 1 else 1)]
            keys, passages, pages = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(found), pa.string()), pa.array(keys, pa.int64()), pa.array(passages, pa.string()), pa.array(pages, pa.int64())], ["host", "run", "passage", "pages"])

        for b in batches:
            for host, chunk, key, chunks, text in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if (host, chunk, chunks) != at:
                    if texts:
                        yield result()
                    at, last, texts = (host, chunk, chunks), None, []
                if key != last:
                    texts.append(text.as_py())
                    last = key
        if texts:
            yield result()

    texts = p.select("host", "html").mapInArrow(lambda batches: keyed_pages(batches, None, True, run_length), KEYED)
    each = texts.join(few, "host").select("host", F.pmod("key", "chunks").alias("chunk"), "key", "chunks", "text")
    found = cut(each.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "key").mapInArrow(run, "host string, run long, passage string, pages long"))
    whole = found.where("passage IS NULL").groupBy("host").agg(F.sum("pages").alias("host_n")).join(few, "host")  # a row a chunk says how many pages it has
    hosts = cut(whole.where(F.col("host_n") >= least))
    few = F.broadcast(hosts) if hosts.count() <= SMALL_TABLE else hosts
    found = found.where("passage IS NOT NULL").join(few, "host")
    enough = F.col("pages") >= F.greatest(F.lit(float(least)), F.col("host_n") * F.lit(share))
    names = ["host", "run", "passage", "pages", "host_n"]
    out = found.where("chunks = 1").where(enough).select(names)
    if hosts.where("chunks > 1").isEmpty():
        return out
    wanted = cut(found.where("chunks > 1").select("host", "run", "passage").distinct())
    large = p.select("host", "html").join(few, "host").where("chunks > 1").select("host", "html")
    find = lambda batches, marks: keyed_pages(batches, marks, False, run_length)
    holds = with_marks(large, wanted.withColumn("firm", F.lit(False)), find, KEYED).select("host", "key", "found").dropDuplicates(["host", "key"])
    counted = holds.select("host", F.explode("found").alias("passage")).groupBy("host", "passage").agg(F.count("*").alias("pages"))
    return out.union(counted.join(wanted, ["host", "passage"]).join(few, "host").where(enough).select(names))


def extract(pages: DataFrame, run_length: int = RUN, host_tokens: int = HOST_TOKENS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int | None = None) -> DataFrame:
    """The query's rows: page_id, url, text and n_chars of every page.

    Character references are decoded, white space within a block becomes one space, and blocks are joined by one. A null or
    empty page, and one without visible text, has an empty text. Pages that are copies of each other are no evidence of
    boilerplate, and get equal texts; repeated rows give repeated results. A null url is a host of its own. Unclosed
    tags, quotes and comments end with the page. No pages give no rows. Columns besides the three named are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    gone = cut(boilerplate(p, run_length, host_tokens))
    firm = (F.col("pages") >= FIRM) & (F.col("pages") >= F.col("host_n") * FIRM_SHARE)
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch], marks: Callable[[str], Marks | None]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple | None] = {}
        for b in batches:
            texts = []
            for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                texts.append(main_text(page.as_py() or "", of_host(ready, host, marks), run_length))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return with_marks(p, gone.withColumn("firm", firm), run, "page_id long, url string, text string, n_chars long", small)


def main_text(page: str, marks: tuple | None, run: int = RUN) -> str:
    """The page's main text; marks: the host's boilerplate, as `prepared`."""
    found = blocks(page)
    zones = {z for z, _ in found}
    own = "article" if "article" in zones else "main" if "main" in zones else "plain"
    if marks is None:
        return " ".join(t for z, t in found if z == own)
    wanted, keys = marks[own != "plain"]
    runs = Runs(" ".join(t for _, t in found), run)
    hits, at, kept = runs.hits(wanted, keys), 0, []
    for zone, text in found:
        start, at = at, at + text.count(" ") + 1
        if zone != own:
            continue
        if at - start < run:  # goes where it stands in one passage, or is one
            if bisect_right(hits, start) == bisect_left(hits, at - run) and wanted.get(block_key(text)) != "\n" + text:
                kept.append(text)
            continue
        inside = np.array(hits[bisect_left(hits, start) : bisect_right(hits, at - run)], np.int64) - start  # only passages within the block part it
        if not len(inside):
            kept.append(text)
            continue
        over = np.zeros(at - start + 1, np.int64)
        over[inside] += 1
        over[inside + run] -= 1
        left = [w for w, n in zip(text.split(" "), np.cumsum(over[:-1]).tolist(), strict=True) if not n]
        if left:
            kept.append(" ".join(left))
    return " ".join(kept)
