"""Window operators, written so that no single key -- however hot --
puts all its rows into one task.

* ``latest_per_key`` (W1): ``row_number() ... = 1``. Catalyst inserts a
  partial ``WindowGroupLimit`` below the shuffle, so every map task keeps
  one row per key before rows move.
* ``row_numbers`` (W2/W3) and ``surrogate_number`` (W4): kept numbers. A
  plain window would sort a whole key (or, for ``over ()``, the whole
  table) in one task. Instead rows are range-partitioned on
  (keys, order) -- a hot key spreads over many partitions -- numbered
  locally, and shifted by the count of the same key in earlier partitions.
  Only the first key of a partition gets a shift, from partitions whose last
  key it is (``carried``), so the shift table has at most one row per
  partition and is broadcast on that proof. The range-partitioned, numbered rows are pinned
  as a parquet table in the shared checkpoint folder (``session.pin``).
  Inputs of every size take this way.
* ``first_last_non_null`` (W5-W9): whole-partition ``first/last ignore
  nulls`` ordered by the value itself equal ``min``/``max``; computed as a
  partial aggregate and, when kept per row, joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.session import pin


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def order_spec(cols: Sequence, descending: bool = True, nulls_first: bool | None = None) -> list[Column]:
    """Sort columns with an explicit null placement.

    ``nulls_first=None`` follows the warehouse rule: DESC puts nulls first,
    ASC puts them last (Spark's own default differs for DESC).
    """
    nf = descending if nulls_first is None else nulls_first
    out = []
    for c in cols:
        if isinstance(c, Column):
            out.append(c)
            continue
        col = F.col(c)
        if descending:
            out.append(col.desc_nulls_first() if nf else col.desc_nulls_last())
        else:
            out.append(col.asc_nulls_first() if nf else col.asc_nulls_last())
    return out


def latest_per_key(df: DataFrame, keys: Sequence, order_by: Sequence[Column], rn_col: str = "_rn",
                   keep_rn: bool = False) -> DataFrame:
    """One row per key, first in ``order_by`` (give full tie-breaks)."""
    w = Window.partitionBy(*[_c(k) for k in keys]).orderBy(*order_by)
    out = df.withColumn(rn_col, F.row_number().over(w)).filter(F.col(rn_col) == 1)
    return out if keep_rn else out.drop(rn_col)


def ranged(df: DataFrame, sort_cols: list[Column], partitions: int | None) -> DataFrame:
    """Rows in one global order: pinned, with ``_pid`` (range partition) and ``_mid`` (row id, ascending with the order)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range partitioner samples its input in a separate job; shuffles
    # below are reused, so only the input's last stage runs twice.
    ranged = (df.repartitionByRange(n, *sort_cols)
              .sortWithinPartitions(*sort_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # Pin partition ids and positions as a table in the shared checkpoint
    # folder: every later read sees the same numbering, also after a lost
    # executor, and reads only the columns it needs.
    return pin(ranged, "ranged")


def surrogate_number(df: DataFrame, order_by: Sequence[Column], name: str = "row_number",
                     partitions: int | None = None) -> DataFrame:
    """``row_number() over (order by ...)`` without a single-task sort.

    Position inside a range partition comes from the row id's low bits; the
    offset of each partition is the count of all earlier partitions (one
    row per partition, broadcast).
    """
    r = ranged(df, list(order_by), partitions)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_pid", "_off")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33) + 1
    out = r.join(F.broadcast(offs), "_pid")
    return out.withColumn(name, (local + F.col("_off")).cast("long")).drop("_pid", "_mid", "_off")


def row_numbers(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], name: str = "row_number",
                partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by ...)`` kept per row.

    Give ``order_by`` a full tie-break, or numbers among ties are arbitrary
    (as they are in the source).
    """
    keys = list(keys)
    r = ranged(df, [F.col(k).asc_nulls_first() for k in keys] + list(order_by), partitions)
    numbered = r.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy("_mid")))
    # the last row of a partition tells how many rows its last key has there
    before = carried(numbered, keys, ["_local"])
    offs = before.groupBy("_pid", *keys).agg(F.sum("_held._local").alias("_off"))
    return (join_carried(numbered, offs, keys)
            .withColumn(name, (F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))).cast("long"))
            .drop("_pid", "_mid", "_local", "_off"))


def carried(rows: DataFrame, keys: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """(_pid, keys, _held): for partitions of ``ranged`` rows that begin with a key of earlier partitions, a row with the
    ``totals`` of each of these, as its last row has them (running values, ``rows`` being in order).

    Only the last key of a partition can go on into the next ones and only the first can come from before, so both sides of the
    join have one row for each partition; they come from one aggregate.
    """
    ends = rows.groupBy("_pid").agg(F.min(F.struct("_mid", *keys)).alias("_a"), F.max(F.struct("_mid", *keys, *totals)).alias("_b"))
    here = ends.select("_pid", *[F.col("_a")[k].alias(k) for k in keys])
    there = ends.select(F.col("_pid").alias("_from"), F.col("_b").alias("_held"))
    same = F.col("_from") < F.col("_pid")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_held")[k])
    return here.join(F.broadcast(there), same)


def join_carried(rows: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``before``, one row for each (_pid, keys) and one key a partition at most: broadcast on that bound."""
    other = before.select(F.col("_pid").alias("_c"), *[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)],
                          *[c for c in before.columns if c != "_pid" and c not in keys])
    same = F.col("_pid") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(other[f"_c{i}"])
    return rows.join(F.broadcast(other), same, "left").drop("_c", *[f"_c{i}" for i in range(len(keys))])


def first_last_non_null(df: DataFrame, keys: Sequence[str], value, condition: Column | None = None,
                        first_name: str = "first_value", last_name: str = "last_value") -> DataFrame:
    """Per key, the first and last non-null ``value`` in value order
    (``first_value/last_value(... ignore nulls)`` over the whole partition).
    One row per key (W9); use ``with_first_last`` to keep every row."""
    v = _c(value)
    if condition is not None:
        v = F.when(condition, v)
    return df.groupBy(*keys).agg(F.min(v).alias(first_name), F.max(v).alias(last_name))


def with_first_last(df: DataFrame, keys: Sequence[str], value, condition: Column | None = None,
                    first_name: str = "first_value", last_name: str = "last_value") -> DataFrame:
    """The same values attached to every row of the key (a join
    back on the key; AQE broadcasts the per-key table when it is small and
    splits a hot key of the large side otherwise). Null keys form one group,
    as a window partition would, so the join is null-safe."""
    per_key = first_last_non_null(df, keys, value, condition, first_name, last_name)
    renamed = per_key.select(*[F.col(k).alias(f"_flk{i}") for i, k in enumerate(keys)], first_name, last_name)
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(renamed[f"_flk{i}"])
        cond = c if cond is None else cond & c
    out = df.join(renamed, cond, "left")
    return out.drop(*[f"_flk{i}" for i in range(len(keys))])


def prefix_sum(df: DataFrame, order_by: Sequence[Column], value, name: str = "prefix_sum",
               inclusive: bool = False, partitions: int | None = None) -> DataFrame:
    """Running total of ``value`` over one global order
    (``sum(v) over (order by ... rows unbounded preceding ..)``) without a
    single-task window: totals inside each range partition, plus the sum of
    all earlier partitions (one row per partition, broadcast). Exclusive
    by default (the total of the rows strictly before)."""
    v = F.coalesce(_c(value), F.lit(0))
    upper = Window.currentRow if inclusive else -1
    r = ranged(df, list(order_by), partitions)
    local = F.coalesce(F.sum(v).over(Window.partitionBy("_pid").orderBy("_mid")
                                     .rowsBetween(Window.unboundedPreceding, upper)), F.lit(0))
    totals = r.groupBy("_pid").agg(F.sum(v).alias("_tot"))
    offs = totals.withColumn(
        "_off", F.coalesce(F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_pid", "_off")
    out = r.withColumn("_local", local).join(F.broadcast(offs), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_local")).drop("_pid", "_mid", "_off", "_local")
