"""J5 without its pairs: what the earlier (or later) rows of a key add up to, for each left row.

``summary_of_earlier`` answers "how many right rows of my key lie before me, and which are the two smallest different values among
them" without joining a single pair. Both sides go into one order (key, time) that is range-partitioned, so a key of any size
spreads over partitions. Inside a partition running aggregates per key give each left row its answer; what a key has in earlier
partitions comes from the last rows of these, one row a partition, and is broadcast on that proof.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.operators.windows import carried, join_carried, ranged


def _smallest_two(arrays: Column) -> Column:
    """The two smallest different values of an array with nulls."""
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(arrays))), 1, 2)


def summary_of_earlier(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_time: str, right_time: str, value: str,
                       strict: bool = False, later: bool = False, n_name: str = "n", least_name: str = "least",
                       partitions: int | None = None) -> DataFrame:
    """All columns of ``left`` with ``n``, the number of right rows with equal keys and ``right.t <= left.t`` (``<`` when strict;
    ``>=``, ``>`` for ``later``), and ``least``, the two smallest different non-null ``value``s of these rows, in order.

    Null keys and null times meet nothing, as in a join; rows without a match keep n = 0 and an empty array.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    mine = left.select(*[F.col(a).alias(k) for k, (a, _) in zip(keys, on)], F.col(left_time).alias("_t"), F.lit(True).alias("_left"),
                       F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    theirs = right.select(*[F.col(b).alias(k) for k, (_, b) in zip(keys, on)], F.col(right_time).alias("_t"), F.lit(False).alias("_left"),
                          F.col(value).alias("_v"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    whole = F.lit(True)
    for k in [*keys, "_t"]:
        whole = whole & F.col(k).isNotNull()
    time = F.col("_t").desc() if later else F.col("_t").asc()
    # at one time, the right rows come first unless they must not count
    side = F.col("_left").desc() if strict else F.col("_left").asc()
    r = ranged(mine.unionByName(theirs.filter(whole)), [*[F.col(k).asc_nulls_first() for k in keys], time, side], partitions)

    upto = Window.partitionBy("_pid", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_pid", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    # a value that is not the smallest so far is a candidate for the second place, and so is a smallest one that is beaten
    run = (r.withColumn("_n", F.count(F.when(~F.col("_left"), 1)).over(upto)).withColumn("_first", F.min("_v").over(upto))
           .withColumn("_old", F.min("_v").over(before))
           .withColumn("_next", F.when(F.col("_v") < F.col("_old"), F.col("_old")).when(F.col("_v") > F.col("_old"), F.col("_v")))
           .withColumn("_second", F.min("_next").over(upto)))

    # what earlier partitions hold of a partition's first key: their running values at their last rows
    held = (carried(run, keys, ["_n", "_first", "_second"]).groupBy("_pid", *keys)
            .agg(F.sum("_held._n").alias("_before_n"), F.collect_list(F.array("_held._first", "_held._second")).alias("_before")))
    joined = join_carried(run.filter("_left"), held, keys)
    none = F.array().cast(joined.schema["_before"].dataType.elementType)
    n = F.when(whole, F.col("_n") + F.coalesce("_before_n", F.lit(0))).otherwise(0).cast("long")
    least = F.concat(F.array("_first", "_second"), F.coalesce(F.flatten("_before"), none))
    return joined.select("_row.*", n.alias(n_name), F.when(whole, _smallest_two(least)).otherwise(none).alias(least_name))
