"""Token ids as flat files of unsigned integers, with 64-bit document offsets beside them.

For each range of doc_ids: `ids-*.bin` holds the ids (unsigned 16-bit where the vocabulary allows, else 32-bit, little
endian), `index-*.bin` holds n + 1 offsets (unsigned 64-bit, in ids from the file's start) and n doc_ids (signed 64-bit).
A task writes under a name of its own, and only files named in the manifest count, so a lost or repeated task leaves no
wrong data. Where a range starts in the whole corpus comes from prefix sums over the manifest, one row a file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.tokens import blocks, encoder
from evidex.session import cut, fresh_path, ship

#: Stands for a null doc_id in an index file.
NULL_ID = np.iinfo(np.int64).min
MANIFEST = "range int, ids_path string, index_path string, dtype string, n_docs long, n_tokens long"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, any that Arrow reads, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the folder is mounted, read whole from other stores."""
    at, path = file_system(uri)
    if not at.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(at, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with at.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, adds end_id to each, writes the files in ascending doc_id order; returns the manifest.

    A null text counts as empty (its only id is end_id). Null doc_ids come first. Rows of one doc_id are neighbours, in
    the order of their texts. Documents without rows give a manifest without rows. Columns besides the two named are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        dtype = enc.dtype_with(end_id)
        at, base = file_system(folder)
        at.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        ids_path, index_path = f"{folder}/ids-{name}.bin", f"{folder}/index-{name}.bin"
        offsets, doc_ids, n_tokens = [np.zeros(1, np.int64)], [np.empty(0, np.int64)], 0
        with at.open_output_stream(file_system(ids_path)[1]) as out:
            for own, texts in blocks(batches):
                ids, ends = enc.many(texts, end_id)
                out.write(ids)
                offsets.append(n_tokens + ends)
                doc_ids.append(own.fill_null(NULL_ID).to_numpy())
                n_tokens += len(ids)
        offsets = np.concatenate(offsets).astype("<u8")
        with at.open_output_stream(file_system(index_path)[1]) as out:
            out.write(offsets.tobytes())
            out.write(np.concatenate(doc_ids).tobytes())
        if len(offsets) > 1:
            row = [[TaskContext.get().partitionId()], [ids_path], [index_path], [dtype.str], [len(offsets) - 1], [n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], ["range", "ids_path", "index_path", "dtype", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return cut(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "t").mapInArrow(run, MANIFEST))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all documents before it."""
    spark = manifest.sparkSession
    ship(spark)
    files, base = [], 0
    for r in sorted(manifest.collect()):  # a row a file, as many as the tasks that wrote them
        files.append((r.ids_path, r.index_path, r.dtype, r.n_docs, base))
        base += r.n_tokens
    listed = spark.createDataFrame(files, "ids_path string, index_path string, dtype string, n_docs long, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            ids, index = mapped(r["ids_path"], r["dtype"]), mapped(r["index_path"], "<u8")
            offsets, doc_ids = index[: r["n_docs"] + 1], index[r["n_docs"] + 1 :].view("<i8")
            for first in range(0, r["n_docs"], 4096):
                at = offsets[first : first + 4097].astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                own = doc_ids[first : first + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=np.asarray(own == NULL_ID)), pa.array(at[:-1] + r["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """The query's rows: writes the files into the shared folder and reads them back."""
    spark = docs.sparkSession
    return read_tokens(write_tokens(docs, fresh_path(spark, "token-files"), tokenizer_path, end_id))
