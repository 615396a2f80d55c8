import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.operators.windows import (
    first_last_non_null, latest_per_key, row_numbers, surrogate_number, with_first_last,
)


def skewed(spark, n=3000, seed=7):
    """One key holds a third of the rows; ties on t are broken by id."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        k = 0 if i % 3 == 0 else rnd.randint(1, 200)
        t = rnd.choice([None] + list(range(50)))
        data.append((i, k, t))
    return spark.createDataFrame(data, "id long, k long, t long")


def test_row_numbers_equal_window_on_hot_key(spark):
    df = skewed(spark)
    order = [F.col("t").desc_nulls_first(), F.col("id").asc()]
    got = row_numbers(df, ["k"], order, name="rn", partitions=6)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_row_numbers_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(1, None, 3), (2, None, 1), (3, 1, 2)], "id long, k long, t long")
    got = row_numbers(df, ["k"], [F.col("t").asc()], name="rn", partitions=2)
    assert sorted((r.id, r.rn) for r in got.collect()) == [(1, 2), (2, 1), (3, 1)]


def test_surrogate_number_is_global_row_number(spark):
    df = skewed(spark)
    order = [F.col("t").asc_nulls_last(), F.col("id").asc()]
    got = surrogate_number(df, order, name="n", partitions=5)
    want = df.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    assert sorted(got.select("id", "n").collect()) == sorted(want.select("id", "n").collect())
    assert got.count() == df.count()


def test_latest_per_key_desc_puts_nulls_first(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, None), (3, 2, 5), (4, 2, 7)], "id long, k long, t long")
    got = latest_per_key(df, ["k"], [F.col("t").desc_nulls_first(), F.col("id")])
    assert sorted(r.id for r in got.collect()) == [2, 4]


def test_first_last_equals_ignore_nulls_window(spark):
    df = skewed(spark)
    cond = F.col("id") % 2 == 0
    v = F.when(cond, F.col("t"))
    w = Window.partitionBy("k").orderBy(v.asc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = df.select("k", F.first(v, ignorenulls=True).over(w).alias("f"),
                     F.last(v, ignorenulls=True).over(w).alias("l")).distinct()
    got = first_last_non_null(df, ["k"], "t", cond, "f", "l")
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    kept = with_first_last(df, ["k"], "t", cond, "f", "l")
    assert kept.count() == df.count()


def test_prefix_sum_matches_running_window(spark):
    from opsframe.operators.windows import prefix_sum
    df = skewed(spark).withColumn("v", (F.col("id") % 7))
    order = [F.col("k").asc(), F.col("id").asc()]
    got = prefix_sum(df, order, "v", name="ps", partitions=5)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("ps", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert sorted(got.select("id", "ps").collect()) == sorted(want.select("id", "ps").collect())


def test_row_numbers_two_keys_with_nulls_range_path(spark):
    rnd = random.Random(11)
    data = [(i, rnd.choice([None, 0, 1]), rnd.choice([None, "a", "b"]) if i % 4 else "a", rnd.randint(0, 30))
            for i in range(1500)]
    df = spark.createDataFrame(data, "id long, k1 long, k2 string, t long")
    order = [F.col("t").desc_nulls_first(), F.col("id").asc()]
    got = row_numbers(df, ["k1", "k2"], order, name="rn", partitions=7)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*order)))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())
