"""Fingerprints of documents whose difference can be read: invertible Bloom lookup tables of paragraph digests.

A text is a set of 64-bit digests, one for each paragraph; the k-th copy of a paragraph has a digest of its own. A sketch has
three subtables of cells; a digest goes to one cell of each, and a cell holds how many digests came, their xor and the xor of
their checks. Cells of one text minus those of another leave only what differs: a cell with one digest left gives it away,
it is taken out of its other cells, and so on (peeling) until nothing is left, or the sketch was too small and twice the cells
are tried. The number of digests recovered gives the share of paragraphs that two texts have in common.

Lines are paragraphs; of a long line, sentences are. A fingerprint is the smallest sketch, so that its length doesn't grow with
the text, and likeness is found with as many cells as it takes. Many pairs are peeled at once, as arrays.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.session import cut, ship

#: Cells of a subtable in a fingerprint.
CELLS = 4
#: Code points of a line beyond which its sentences are paragraphs, and of a sentence beyond which its clauses are.
LONG_LINE, LONG_SENTENCE = 100, 200
SENTENCE, CLAUSE = re.compile(r"(?<=[.!?])[ \t]+"), re.compile(r"(?<=[,;:])[ \t]+")
#: Characters of texts that a task takes at once.
CHARS = 4_000_000
FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SWEPT = FOUND + ", part long, first binary, last binary"


def paragraphs(text: str) -> list[str]:
    out: list[str] = []
    for line in text.split("\n"):
        for sentence in SENTENCE.split(line) if len(line) > LONG_LINE else [line]:
            out += CLAUSE.split(sentence) if len(sentence) > LONG_SENTENCE else [sentence]
    return [y for x in out if (y := x.strip())]


def paragraph_digests(text: str) -> list[tuple[str, int]]:
    """A text's paragraphs in order, each with its 64-bit digest; each copy of a paragraph has its own."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        k = seen[p] = seen.get(p, -1) + 1
        out.append((p, xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"), k)))
    return out


def digests(text: str) -> np.ndarray:
    return np.unique(np.array([d for _, d in paragraph_digests(text)], np.uint64))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Well-mixed 64 bits of each number (the finaliser of a well-known generator)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """For each digest, its cell in each of the three subtables."""
    return np.stack([mixed(keys, 3 * cells + t) % np.uint64(cells) + np.uint64(t * cells) for t in range(3)]).astype(np.int64)


class Sketches:
    """As many sketches of 3 * cells cells as `n`, as flat arrays."""

    def __init__(self, n: int, cells: int):
        self.cells, self.width = cells, 3 * cells
        self.count, self.key, self.check = np.zeros(n * self.width, np.int64), np.zeros(n * self.width, np.uint64), np.zeros(n * self.width, np.uint64)

    def put(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Adds digests (sign 1) or takes them away (-1), each to the sketch of its owner."""
        at, check = cells_of(keys, self.cells) + owner * self.width, mixed(keys, 0)
        for t in at:
            np.add.at(self.count, t, sign)
            np.bitwise_xor.at(self.key, t, keys)
            np.bitwise_xor.at(self.check, t, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the sketches as far as it goes: (owner, digest, sign) of what was found, and which sketches are empty."""
        owners, keys, signs = [], [], []
        live = np.flatnonzero(self.count)
        while True:
            live = live[np.abs(self.count[live]) == 1]
            live = live[self.check[live] == mixed(self.key[live], 0)]
            if not len(live):
                break
            # A digest that two cells give away is taken once.
            live = live[np.lexsort((live // self.width, self.key[live]))]
            owner, key, sign = live // self.width, self.key[live], self.count[live]
            new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
            owner, key, sign = owner[new], key[new], sign[new]
            self.put(owner, key, -sign)
            owners, keys, signs = [*owners, owner], [*keys, key], [*signs, sign]
            live = np.unique(cells_of(key, self.cells) + owner * self.width)
        empty = ~(self.count.astype(bool) | self.key.astype(bool)).reshape(-1, self.width).any(axis=1)
        none = np.empty(0, np.int64)
        return np.concatenate([none, *owners]), np.concatenate([none.astype(np.uint64), *keys]), np.concatenate([none, *signs]), empty

    def encoded(self) -> list[str]:
        """Each sketch as a string."""
        dtype = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        cells = np.empty(len(self.count), dtype)
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check & np.uint64(0xFFFFFFFF)
        raw = cells.tobytes()
        size = self.width * dtype.itemsize
        return [base64.b85encode(raw[i : i + size]).decode() for i in range(0, len(raw), size)]


def flat(sets: Sequence[np.ndarray], which: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The digests of many texts in one array, and the text of each."""
    some = sets if which is None else [sets[i] for i in which]
    return np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate([np.empty(0, np.uint64), *some])


def fingerprints(sets: Sequence[np.ndarray], cells: int = CELLS) -> list[str]:
    s = Sketches(len(sets), cells)
    s.put(*flat(sets), 1)
    return s.encoded()


def differences(left: Sequence[np.ndarray], right: Sequence[np.ndarray], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, owner, digest, sign): what each text of a pair has and the other lacks, from sketches of `cells`, then of twice
    as many for pairs whose sketch didn't empty. pair lists those solved in a round; owner counts within it."""
    pairs = np.arange(len(left))
    while len(pairs):
        s = Sketches(len(pairs), cells)
        s.put(*flat(left, pairs), 1)
        s.put(*flat(right, pairs), -1)
        owner, key, sign, empty = s.peel()
        solved = empty[owner]
        yield pairs[empty], (np.cumsum(empty) - 1)[owner[solved]], key[solved], sign[solved]
        pairs, cells = pairs[~empty], 2 * cells


def likeness(left: Sequence[np.ndarray], right: Sequence[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """For each pair of texts, the paragraphs in both over those in either, 1 for two without any."""
    out = np.ones(len(left))
    total = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64)
    for pairs, owner, _, _ in differences(left, right, cells):
        d = np.bincount(owner, minlength=len(pairs))
        n = total[pairs]
        out[pairs] = np.where(n > 0, (n - d) / np.maximum(n + d, 1), 1.0)
    return out


def changed_paragraphs(old: str, new: str) -> tuple[list[str], list[str]]:
    """The paragraphs of two versions of a text that only the old and only the new one has, read from their sketches."""
    a, b = paragraph_digests(old), paragraph_digests(new)
    gone: set[int] = set()
    came: set[int] = set()
    for _, _, key, sign in differences([digests(old)], [digests(new)]):
        gone |= set(key[sign > 0].tolist())
        came |= set(key[sign < 0].tolist())
    return [p for p, d in a if d in gone], [p for p, d in b if d in came]


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as many characters of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(ids: list, texts: list[str]) -> list[pa.Array]:
    """FOUND, as columns, of all texts but the last, each followed by the next one."""
    new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    sets, changed = [digests(t) for t in texts], [digests(t) for t in new]
    own = sets[:-1]
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
    return [pa.array(ids[: len(new)], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(sha, pa.string()), pa.array(fingerprints(own), pa.string()), pa.array(fingerprints(changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, sets[1:]))]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    pack = zstandard.ZstdCompressor(3).compress
    for b in batches:
        z = pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("tie"), z], ["doc_id", "h", "tie", "z"])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SWEPT of sorted rows: FOUND of all but a range's last, and a row with its first and last text for its neighbours."""
    unpack, part = zstandard.ZstdDecompressor().decompress, TaskContext.get().partitionId()
    names = [c.split()[0] for c in SWEPT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
    ids: list = []
    texts: list[str] = []
    first = last = None

    def done() -> pa.RecordBatch:
        found = compared(ids, texts)
        del ids[:-1], texts[:-1]
        return pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(found[0]), k) for k in kinds[7:])], names)

    for b in batches:
        chars = 0
        for doc_id, z in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), strict=True):
            first, last = z if first is None else first, z
            ids.append(doc_id)
            texts.append(unpack(z).decode("utf-8", "surrogatepass"))
            chars += len(texts[-1])
            if chars > CHARS:
                yield done()
                chars = 0
        if len(ids) > 1:
            yield done()
    if ids:
        row = [ids[-1], None, None, None, None, None, None, part, first, last]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND of rows that carry the next text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for r in b.to_pylist():
            texts = [unpack(r[c]).decode("utf-8", "surrogatepass") for c in ("last", "following")]
            yield pa.RecordBatch.from_arrays(compared([r["doc_id"]], texts), [c.split()[0] for c in FOUND.split(", ")])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one for each
    row of docs.

    The next document is that of the next smaller doc_id, after the smallest the first; a lone one follows itself. Null
    doc_ids come last; rows of one doc_id are in the order of a hash of their texts. A null text is empty; two texts
    without paragraphs are alike by 1. No documents give no rows. Columns besides doc_id and text are not read.

    Texts are sorted over ranges of ids, compressed, in one shuffle; a range's last text meets the first of the next one
    by a join of one row a range.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"), "text")
    packed = rows.mapInArrow(_packed, "doc_id long, h long, tie long, z binary")
    by = [F.desc("doc_id"), F.asc("h"), F.asc("tie")]
    swept = cut(packed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_swept, SWEPT))
    edges = swept.where("part is not null").select("part", "doc_id", "first", "last")
    parts = sorted(r.part for r in edges.select("part").collect())  # one a task
    order = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, after long")
    pairs = order.join(edges.select("part", "doc_id", "last"), "part").join(edges.select(F.col("part").alias("after"), F.col("first").alias("following")), "after")
    return swept.where("part is null").select(*(c.split()[0] for c in FOUND.split(", "))).union(pairs.select("doc_id", "last", "following").mapInArrow(_joined, FOUND))
