"""Dealing whole texts out in chunks.

Several operators look at whole texts more than once. They deal documents by a
hash of (id, text) into chunks of about ``CHUNK_BYTES``, so that one chunk fits
a Python worker whatever the size of the input, and every later step that
addresses the same chunk reuses the one shuffle of the texts.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.session import pinned_path

#: Text bytes a chunk holds on average. The number of chunks grows with the input.
CHUNK_BYTES = 12 << 20


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    """One per ``chunk_bytes`` of text, and never fewer than the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-total // chunk_bytes))


def dealt(docs: DataFrame, n: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, id, text): null ids stay null, null texts become empty.

    The text takes part in the hash so that many rows with one id, or none,
    still spread; only wholly equal rows must meet.
    """
    key, body = F.col(id_col).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.pmod(F.xxhash64(key, body), F.lit(n)).cast("int").alias("chunk"),
                       key.alias("id"), body.cast("binary").alias("body"))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, and a lost executor costs no recomputation of what came before."""
    path = pinned_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``table``, in buckets of ``key``: grouping by the key then moves no row of it.
    The catalog entry is dropped at once; the frame keeps the files and the buckets."""
    spark, label = df.sparkSession, f"llm_{name}_{uuid.uuid4().hex[:12]}"
    path = pinned_path(spark, label)
    df.write.bucketBy(parts(spark), key).option("path", path).format("parquet").saveAsTable(label)
    found = spark.table(label)
    found.schema  # noqa: B018 - resolves the frame while the entry is there
    spark.sql(f"DROP TABLE {label}")
    return found


def binary_parts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end, and the n + 1 offsets between rows."""
    arrays = [c for c in column.chunks if len(c)]
    if not arrays:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bodies, ends, base = [], [np.zeros(1, np.int64)], 0
    for a in arrays:
        kind = np.int64 if pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type) else np.int32
        offsets = np.frombuffer(a.buffers()[1], kind)[a.offset:a.offset + len(a) + 1].astype(np.int64)
        data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
        bodies.append(data[offsets[0]:offsets[-1]])
        ends.append(offsets[1:] - offsets[0] + base)
        base += int(offsets[-1] - offsets[0])
    return np.concatenate(bodies), np.concatenate(ends)


def pack_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes end to end and n + 1 offsets. What one task packs stays below 2 GiB; more is an error."""
    if len(offsets) and int(offsets[-1]) >= 1 << 31:
        raise ValueError(f"{int(offsets[-1])} bytes for one binary column; use smaller chunks")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)),
                                  pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: its worker lives on, and other stages need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of [start, start + length) of every row, end to end."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - firsts, lengths)


def planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers as byte planes, compressed: high planes are nearly all zero."""
    import zstandard

    width = np.dtype(kind).itemsize
    return zstandard.compress(np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, width).T.tobytes(), 3)


def unplaned(data: bytes, kind: str = "<u4") -> np.ndarray:
    import zstandard

    found = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(found.T).view(kind).ravel()
