"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one sequence at a time: of the examples that still fit it takes the one whose demand,
weighed by how scarce each resource is, has the largest dot product with what the sequence has left. Where examples may
be cut, what no example fits takes the longest beginning of one that does.

A document is an example of instruction data: its first line is the prompt, whose tokens bear no loss, and the rest with the
end id is the answer. A document of one line bears loss as a whole. Tasks pack blocks of a bounded number of ids, straight
from the encoder: nothing is shuffled, and no group is gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.tokens import blocks, encoder
from evidex.session import ship

BLOCK_TOKENS, BLOCK_EXAMPLES = 1 << 20, 8192


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 16
    loss_tokens: int = 1920


def pack(tokens: list[int], loss: list[int], limits: Limits, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, length) that hold each token of every example once.

    loss[i]: how many tokens at the end of example i bear loss. With cut, a sequence that stays short is parted into
    lengths that are powers of two, so that it needs no padding; without, an example beyond a limit raises ValueError.
    """
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    sequences: list[list[tuple[int, int, int]]] = []
    left: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (tokens, loss) -> the (example, start) that need so much

    for i, (n, bearing) in enumerate(zip(tokens, loss, strict=True)):
        start = 0
        while n > limits.tokens or bearing > limits.loss_tokens:
            if not cut:
                raise ValueError(f"example {i} is larger than a sequence")
            size = min(n, limits.tokens, n - bearing + limits.loss_tokens)
            if size == limits.tokens:
                sequences.append([(i, start, size)])
            else:
                left.setdefault((size, max(0, size - n + bearing)), []).append((i, start))
            start, n, bearing = start + size, n - size, min(bearing, n - size)
        if n:
            left.setdefault((n, bearing), []).append((i, start))
    keys = sorted(left, reverse=True)
    n_of, loss_of = (np.array([k[c] for k in keys], np.int64) for c in (0, 1))
    count = np.array([len(left[k]) for k in keys], np.int64)
    scarce = np.array([(n_of * count).sum(), count.sum(), (loss_of * count).sum()]) / most
    weight = scarce / max(scarce.max(initial=0), 1e-12) / most**2
    place = {k: j for j, k in enumerate(keys)}

    def take(j: int, size: int) -> tuple[int, int, int]:
        """The first `size` tokens of an example of key j; the rest goes back."""
        nonlocal n_of, loss_of, count
        n, bearing = keys[j]
        i, start = left[keys[j]].pop()
        count[j] -= 1
        room[:] -= (size, 1, max(0, size - n + bearing))
        if size < n:
            rest = (n - size, min(bearing, n - size))
            left.setdefault(rest, []).append((i, start + size))
            if rest not in place:
                place[rest] = len(keys)
                keys.append(rest)
                if len(keys) > len(count):
                    n_of, loss_of, count = (np.concatenate([x, np.zeros(len(keys), np.int64)]) for x in (n_of, loss_of, count))
                n_of[place[rest]], loss_of[place[rest]] = rest
            count[place[rest]] += 1
        return i, start, size

    while (live := count > 0).any():
        if live.mean() < 0.5:
            keys = [keys[j] for j in np.flatnonzero(live)]
            n_of, loss_of, count = n_of[live], loss_of[live], count[live]
            place = {k: j for j, k in enumerate(keys)}
        room, now = most.astype(np.int64), []
        while room[1]:
            fits = (count > 0) & (n_of <= room[0]) & (loss_of <= room[2])
            if fits.any():
                score = n_of * (weight[0] * room[0]) + loss_of * (weight[2] * room[2])
                j = int(np.where(fits, score, -1.0).argmax())
                now.append(take(j, keys[j][0]))
                continue
            begin = np.where(count > 0, np.minimum(n_of - loss_of + room[2], room[0]), 0)
            j = int(begin.argmax())
            if not cut or begin[j] <= 0:
                break
            now.append(take(j, int(begin[j])))
        sequences += powers(now) if cut and sum(x[2] for x in now) != limits.tokens else [now]
    return sequences


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces, cut into sequences whose lengths are powers of two, the longest first."""
    total, out, queue = sum(x[2] for x in pieces), [], pieces[::-1]
    while total:
        room = 1 << total.bit_length() - 1
        total, now = total - room, []
        while room:
            i, start, n = queue.pop()
            size = min(n, room)
            now.append((i, start, size))
            room -= size
            if n > size:
                queue.append((i, start + size, n - size))
        out.append(now)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of a document: where it lies in the document and in its sequence, and the crc32 of its ids.

    A null text counts as empty and has the one id end_id, which bears loss. A repeated row is packed as
    often as it occurs. Sequence ids are unique, not dense: the task's number, then a count. A null doc_id stays null.
    No documents give no pieces. Columns besides the two named are not read.
    """
    ship(docs.sparkSession)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def flush(ids: list[np.ndarray], heads: list[int], doc_ids: list, first: int) -> tuple[pa.RecordBatch, int]:
        sizes = [len(x) for x in ids]
        sequences = pack(sizes, [n - h for n, h in zip(sizes, heads, strict=True)], limits)
        rows = []
        for k, pieces in enumerate(sequences):
            offset = 0
            for i, start, n in pieces:
                rows.append((doc_ids[i], start, n, zlib.crc32(ids[i][start : start + n].astype("<u4").tobytes()), sizes[i], first + k, offset))
                offset += n
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), first + len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, next_id = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        ids, heads, doc_ids, n = [], [], [], 0
        for own, texts in blocks(batches):
            all_ids, ends, first_lines = enc.many_with_heads(texts, end_id)
            for doc_id, part, head in zip(own.to_pylist(), np.split(all_ids, ends[:-1]), first_lines.tolist(), strict=True):
                ids.append(part)
                heads.append(head)
                doc_ids.append(doc_id)
                n += len(part)
                if n >= BLOCK_TOKENS or len(ids) >= BLOCK_EXAMPLES:
                    out, next_id = flush(ids, heads, doc_ids, next_id)
                    yield out
                    ids, heads, doc_ids, n = [], [], [], 0
        if ids:
            yield flush(ids, heads, doc_ids, next_id)[0]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, PIECES)
