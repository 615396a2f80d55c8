"""Aggregations. All are ``groupBy().agg()`` with partial
(map-side) aggregation, so a hot key is reduced inside every map task
before the shuffle and never gathers its raw rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.dates import week_start


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money_sum(x, scale: int = 6) -> Column:
    """Sum of a money column, exact: add as DECIMAL, return DOUBLE.

    Floating-point sums depend on the order rows arrive in; summing amounts of
    up to ``scale`` decimals as decimals gives the same answer on every engine
    and every partitioning.
    """
    return F.sum(_c(x).cast(f"decimal(28,{scale})")).cast("double")


def has_all(df: DataFrame, entity: str, item: str, required: Sequence, distinct: bool = False) -> DataFrame:
    """Relational division -- entities having every required item.

    ``WHERE item IN (...) GROUP BY entity HAVING COUNT(item) = n``. As in the
    source this counts rows, so it relies on (entity, item) being unique;
    ``distinct=True`` counts distinct items instead.
    """
    req = list(dict.fromkeys(required))
    counted = F.countDistinct(item) if distinct else F.count(item)
    return (df.filter(F.col(item).isin(req))
            .groupBy(entity)
            .agg(counted.alias("_n"))
            .filter(F.col("_n") == len(req))
            .select(entity))


def duplicates(df: DataFrame, keys: Sequence[str], count_col: str | None = None,
               changed_col: str | None = None, since=None, count_alias: str = "n") -> DataFrame:
    """Keys occurring more than once (``HAVING COUNT(c) > 1``),
    optionally only those whose ``max(changed_col) >= since`` (not projected)."""
    counted = F.count(count_col) if count_col else F.count(F.lit(1))
    aggs = [counted.alias(count_alias)]
    if changed_col is not None:
        aggs.append(F.max(changed_col).alias("_last"))
    out = df.groupBy(*keys).agg(*aggs).filter(F.col(count_alias) > 1)
    if changed_col is not None and since is not None:
        out = out.filter(F.col("_last") >= F.lit(since))
    return out.select(*keys, count_alias)


def count_by(df: DataFrame, keys: Sequence[str | Column], alias: str = "count") -> DataFrame:
    """Rows per key (keys may be expressions)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def counts_by_period(df: DataFrame, date_col: str, keys: Sequence[str], alias: str = "instances") -> DataFrame:
    """Rows per key by day, week (Monday) and month in one aggregation: each
    row is tagged with its three period starts and counted once per grain
    (a grouping-sets style explode; partial aggregation as usual)."""
    d = F.col(date_col).cast("date")
    periods = F.array(
        F.struct(F.lit("day").alias("grain"), d.alias("period_start")),
        F.struct(F.lit("week").alias("grain"), week_start(d).alias("period_start")),
        F.struct(F.lit("month").alias("grain"), F.trunc(d, "month").alias("period_start")))
    e = df.select(*keys, F.explode(periods).alias("_p"))
    return e.groupBy(*keys, F.col("_p.grain").alias("grain"), F.col("_p.period_start").alias("period_start")).agg(
        F.count(F.lit(1)).alias(alias))


def key_violations(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], sample: int = 3,
                   n_name: str = "copies", rank_name: str = "copy") -> DataFrame:
    """Rows that break the uniqueness of ``keys`` in any stored model -- for each key that occurs more than once the number of its
    rows and the first ``sample`` of them in ``order_by``; empty where the key is unique.

    Null keys count as one key, as in GROUP BY. The counts are a partial aggregate; of a hot key, every task keeps ``sample``
    rows before they move (WindowGroupLimit), and only keys that fail are looked up.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n_name)).filter(F.col(n_name) > 1)
    counts = counts.select(*[F.col(k).alias(f"_v{i}") for i, k in enumerate(keys)], n_name)
    first = Window.partitionBy(*keys).orderBy(*order_by)
    some = df.withColumn(rank_name, F.row_number().over(first)).filter(F.col(rank_name) <= sample)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & some[k].eqNullSafe(counts[f"_v{i}"])
    return some.join(counts, same).drop(*[f"_v{i}" for i in range(len(keys))])


class NotUnique(ValueError):
    """A stored model repeats a key that it declares unique."""


def assert_unique(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], sample: int = 3) -> DataFrame:
    """``df`` itself, or ``NotUnique`` with a few failing rows in its message."""
    failing = key_violations(df, keys, order_by, sample).limit(sample).collect()
    if failing:
        raise NotUnique(f"{', '.join(keys)} not unique: " + "; ".join(str(r.asDict()) for r in failing))
    return df
