"""A regularised quadratic discriminant for text quality.

Each class has a Gaussian over transformed document statistics. Its covariance is shrunk towards the pooled one and then
towards a multiple of the identity, and factored once (Cholesky); a score is the logistic of the difference of the two log
densities, each half the squared Mahalanobis distance and the log determinant, plus the log prior odds. Class moments are
sums over all labelled training rows, taken about their common mean, as differences of large sums would lose digits; only
these sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.quality_rules import FUNCTION_WORDS
from evidex.session import cut, ship

#: Shares of the pooled covariance and of the scaled identity.
SHRINK_POOLED, SHRINK_IDENTITY = 0.3, 0.05
THRESHOLD = 0.3
FEATURES = ("words", "chars_word", "spread", "upper", "digits", "symbols", "stops", "shouts", "bars", "spaces", "function", "distinct", "dup_lines", "closed", "line_words", "wide", "entropy", "repeats")
_function = frozenset(w.encode() for w in FUNCTION_WORDS)
_letters = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_sets = {"upper": bytes(range(65, 91)), "digits": b"0123456789", "symbols": b"#*$%&<>@^~_=+{}[]\\/", "stops": b".,;:", "shouts": b"!?", "bars": b"|"}
_members = {k: np.frombuffer(v, np.uint8) for k, v in _sets.items()}
_closing = b".!?:;"


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text; all defined for a text without words."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, letters = len(words), int(counts[_letters].sum())
    share = {k: float(counts[m].sum()) for k, m in _members.items()}
    sizes = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    p = counts[counts > 0] / max(1, len(raw))
    root = lambda a, b: (a / b) ** 0.5 if b else 0.0  # noqa: E731  of a share, whose square root varies more evenly
    fours = len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))
    return [
        np.log1p(n),
        np.log1p(sizes.mean()),
        np.log1p(sizes.std()),
        root(share["upper"], letters),
        *(root(share[k], len(raw)) for k in ("digits", "symbols", "stops", "shouts", "bars")),
        root(counts[32] + counts[9], len(raw)),
        root(sum(map(_function.__contains__, raw.lower().split())), n),
        root(len(set(words)), n),
        root(len(lines) - len(set(lines)), len(lines)),
        root(sum(x.rstrip()[-1:] in _closing for x in lines), len(lines)),
        np.log1p(n / max(1, len(lines))),
        root(counts[128:].sum(), len(raw)),
        float(-(p * np.log2(p)).sum()) / 8,
        root(n - 3 - fours, n - 3) if n > 3 else 0.0,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): x holds FEATURES of the whole text; a null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or b"") for t in b.column(1).cast(pa.large_binary())], float).reshape(-1)
            at = np.arange(b.num_rows + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(x))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """For each class: its mean, the inverse of its covariance's Cholesky factor, and log prior - log determinant / 2."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of x."""
        d = [self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def fit(labelled: DataFrame, pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY) -> Discriminant:
    """The discriminant of (y, x) rows, y 0 or 1. A class without rows takes the pooled moments and a prior near 0."""
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    centre = [float(v or 0) for v in labelled.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k))).first()]
    x = [F.col("x")[i] - m for i, m in enumerate(centre)]
    sums = [F.count("*"), *(F.sum(v) for v in x), *(F.sum(x[i] * x[j]) for i, j in pairs)]
    rows = {int(r[0]): [float(v or 0) for v in r[1:]] for r in labelled.groupBy("y").agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).collect()}
    n, means, scatter = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for c, v in rows.items():
        n[c], means[c] = v[0], np.array(v[1 : k + 1]) / v[0]
        for (i, j), s in zip(pairs, v[k + 1 :], strict=True):
            scatter[c, i, j] = scatter[c, j, i] = s - v[0] * means[c, i] * means[c, j]
    total = max(n.sum(), 1.0)
    within = scatter.sum(axis=0) / total + 1e-6 * np.eye(k)
    for c in (0, 1):
        if not n[c]:
            means[c] = means[1 - c]
    factors, offsets = [], []
    for c in (0, 1):
        s = (1 - pooled) * (scatter[c] / n[c] if n[c] else within) + pooled * within
        # the identity is taken in units of each statistic, so that their scales don't matter
        scale = np.sqrt(np.diag(within))
        r = s / np.outer(scale, scale)
        r = (1 - identity) * r + identity * np.trace(r) / k * np.eye(k)
        low = np.linalg.cholesky(r * np.outer(scale, scale))
        factors.append(np.linalg.inv(low))
        offsets.append(np.log((n[c] + 1) / (total + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(means + np.array(centre), np.array(factors), np.array(offsets))


def train_rows(doc_id) -> F.Column:
    """Whether labels of this document may be learnt: crc32 of its doc_id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The query's rows: doc_id, held_out, score and predicted, for every row of docs.

    Null and empty texts are scored like any other, by their statistics. Labels that are null, or other than 0 and 1, are
    not learnt; a document labelled twice counts twice; without any label every score is 0.5. Repeated rows get equal
    scores, and a null doc_id, which has no label, stays null. Of docs, only doc_id and text are read.
    """
    x = cut(features(docs))
    y = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("y"))
    y = y.where(train_rows(F.col("label_id")))
    model = fit(x.join(y, x["doc_id"] == y["label_id"]).select("y", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (~train_rows(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
