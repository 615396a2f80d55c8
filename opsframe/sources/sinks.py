"""Literal rows, typed tables, append, views, stored aggregates and
conditional rewrites. Writes go under the shared checkpoint folder
(``spark.checkpoint.dir``) unless a path is given."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsframe.session import scratch_path
from opsframe.sources.tables import Tables


def rows_frame(spark: SparkSession, rows: Iterable[Sequence], schema: StructType | str) -> DataFrame:
    """``INSERT ... VALUES`` rows as a DataFrame (small literal input only)."""
    return spark.createDataFrame(list(rows), schema)


def enforce_not_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``NOT NULL`` columns. Parquet accepts nulls in a non-nullable
    field, so the check is an expression in the plan: the job fails when a
    null arrives, with no extra pass over the data."""
    schema = df.schema
    cols = list(cols) if cols is not None else [f.name for f in schema.fields if not f.nullable]
    if not cols:
        return df
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    guarded = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"NOT NULL violated in {cols}")))
    return df.filter(guarded)


def typed_table(spark: SparkSession, rows: Iterable[Sequence], schema: StructType) -> DataFrame:
    """A table with declared types whose non-nullable fields are enforced."""
    return enforce_not_null(rows_frame(spark, rows, schema))


def append(df: DataFrame, path: str) -> str:
    """Append rows to a parquet table."""
    df.write.mode("append").parquet(path)
    return path


def create_view(df: DataFrame, name: str) -> DataFrame:
    """``CREATE OR REPLACE VIEW`` -- a temp view over the (lazy) plan."""
    df.createOrReplaceTempView(name)
    return df


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """A stored aggregate (materialized view): write, then read the stored
    copy. A refresh is another call (overwrite)."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def rewrite_where(df: DataFrame, set_values: Mapping[str, object], predicate: Column) -> DataFrame:
    """``UPDATE t SET c = v WHERE pred`` as a projection (parquet has no
    in-place update); write the result to a new path with ``materialize``.
    Rows where the predicate is null keep their value, as in SQL."""
    out = df
    for c, v in set_values.items():
        val = v if isinstance(v, Column) else F.lit(v)
        out = out.withColumn(c, F.when(F.coalesce(predicate, F.lit(False)), val.cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out


def store_clustered(df: DataFrame, path: str, by: Sequence[str], bloom: Sequence[str] = (), row_group_bytes: int = 8 << 20) -> DataFrame:
    """A table for look-ups. Rows lie in the order of ``by`` (a range to each file, sorted inside), so a look-up on it reads the
    few row groups whose minimum and maximum admit the key; ``bloom`` columns get Parquet Bloom filters, so that a look-up on
    one of them skips the row groups that do not hold the key. Written once, read by plain filters."""
    out = df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", row_group_bytes)
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)
    return df.sparkSession.read.parquet(path)


def store_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """A table in buckets of ``key``, sorted inside: joins and groupings on the key move none of its rows. The
    catalog entry is needed to write it and dropped at once; the frame keeps files and buckets."""
    spark, label = df.sparkSession, f"bucketed_{name}_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, label)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(label)
    found = spark.table(label)
    found.schema  # noqa: B018 - resolves the frame while the entry is there
    spark.sql(f"DROP TABLE {label}")
    return found


def co_partitioned(t: Tables, keys: Mapping[str, str], buckets: int | None = None) -> Tables:
    """The tables of ``keys`` stored in equally many buckets of their keys, under their names; every report that reads them by
    name then joins them on these keys without a shuffle. Take 128-256 MB of table for each bucket."""
    n = buckets or int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return Tables(t.spark, t.folder, aliases={**t.aliases, **{name: store_bucketed(t[name], key, n, name) for name, key in keys.items()}})
