"""What the two vector searches share: clean rows, blocks of queries against all rows, and the merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector, or null if it is null or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, vector)


def clean(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector array<double>): rows that take part. Of rows with one id the smallest vector
    stands for the id; a null id takes no part."""
    found = rows.select(F.col(id_col).cast("long").alias("id"), finite(F.col(vector).cast("array<double>")).alias("vector"))
    return found.filter("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of a list column as a matrix; short rows end in zeros."""
    lists = column.combine_chunks()
    lengths = np.asarray(lists.value_lengths(), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, found by partition; of equals the first places count."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    return np.concatenate((above, np.flatnonzero(scores == edge)[:k - len(above)]))


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all partial results. Each task keeps at most k rows of a query before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
