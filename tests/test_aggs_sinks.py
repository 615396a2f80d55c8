import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType, IntegerType, LongType, StringType, StructField, StructType,
)

from opsframe.operators.aggs import duplicates, has_all
from opsframe.plans.admin import customer_view
from opsframe.sources import sinks


def test_has_all_counts_rows_unless_distinct(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "c")],
                               "e long, s string")
    assert sorted(r.e for r in has_all(df, "e", "s", ["a", "b"]).collect()) == [1, 2, 3]
    assert sorted(r.e for r in has_all(df, "e", "s", ["a", "b"], distinct=True).collect()) == [1, 3]


def test_duplicates_with_recent_change(spark):
    df = spark.createDataFrame([("v1", 1), ("v1", 9), ("v2", 1), ("v2", 2), ("v3", 9)], "vin string, d long")
    got = duplicates(df, ["vin"], count_col="vin", changed_col="d", since=5, count_alias="n")
    assert [(r.vin, r.n) for r in got.collect()] == [("v1", 2)]


# The only rows the reference gives: five customers and three nations.
CUSTOMER = StructType([
    StructField("customerid", LongType(), False), StructField("customername", StringType(), False),
    StructField("phone", StringType(), False), StructField("nationid", IntegerType(), False),
    StructField("marketsegment", StringType(), False), StructField("accountbalance", DecimalType(12, 2), False)])
NATION = StructType([StructField("nationid", IntegerType(), False), StructField("nationname", StringType(), False)])
CUSTOMER_ROWS = [
    (1, "Customer#000000001", "33-687-542-7601", 3, "HOUSEHOLD", 2788.52),
    (2, "Customer#000000002", "13-806-545-9701", 1, "MACHINERY", 591.98),
    (3, "Customer#000000003", "13-312-472-8245", 1, "HOUSEHOLD", 3332.02),
    (4, "Customer#000000004", "23-127-851-8031", 2, "MACHINERY", 9255.67),
    (5, "Customer#000000005", "13-137-193-2709", 1, "BUILDING", 5679.84),
]
NATION_ROWS = [(1, "UNITED STATES"), (2, "AUSTRALIA"), (3, "UNITED KINGDOM")]


def _customers(spark):
    from decimal import Decimal
    return sinks.typed_table(spark, [r[:5] + (Decimal(str(r[5])),) for r in CUSTOMER_ROWS], CUSTOMER)


def test_golden_bands(spark):
    c = _customers(spark)
    got = [r.incomegroup for r in customer_view(c).orderBy("customername").collect()]
    assert got == ["middle", "low", "middle", "high", "high"]


def test_golden_update_then_bands(spark):
    c = sinks.rewrite_where(_customers(spark), {"accountbalance": 1000}, F.col("marketsegment") == "BUILDING")
    got = {r.customername: (float(r.accountbalance), r.incomegroup) for r in customer_view(c).collect()}
    assert got["Customer#000000005"] == (1000.0, "high")
    assert got["Customer#000000004"] == (9255.67, "high")


def test_golden_stored_aggregate(spark):
    c = _customers(spark)
    n = sinks.typed_table(spark, NATION_ROWS, NATION)
    agg = (c.join(n, "nationid").groupBy("customername", "phone", "nationname", "marketsegment")
           .agg(F.sum("accountbalance").alias("accountbalance")))
    stored = sinks.materialize(agg, "customernation_mv")
    got = {r.customername: r.nationname for r in stored.collect()}
    assert len(got) == 5
    assert got["Customer#000000001"] == "UNITED KINGDOM"
    assert got["Customer#000000004"] == "AUSTRALIA"
    assert {got[f"Customer#00000000{i}"] for i in (2, 3, 5)} == {"UNITED STATES"}


def test_not_null_enforced_at_run_time(spark):
    schema = StructType([StructField("a", LongType(), False)])
    df = sinks.enforce_not_null(spark.createDataFrame([(1,), (2,)], "a long"), ["a"])
    assert df.count() == 2
    bad = sinks.enforce_not_null(spark.createDataFrame([(1,), (None,)], "a long"), [f.name for f in schema.fields])
    with pytest.raises(Exception):
        bad.collect()


def test_append_adds_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "a long")
    sinks.append(df, path)
    sinks.append(df, path)
    assert spark.read.parquet(path).count() == 2


def test_counts_by_period(spark):
    import datetime as dt

    from opsframe.operators.aggs import counts_by_period
    df = spark.createDataFrame([("h", dt.date(2024, 1, 1)), ("h", dt.date(2024, 1, 3)), ("h", dt.date(2024, 2, 5))],
                               "hub string, day date")
    got = {(r.grain, str(r.period_start)): r.instances for r in counts_by_period(df, "day", ["hub"]).collect()}
    assert got[("week", "2024-01-01")] == 2 and got[("month", "2024-01-01")] == 2
    assert got[("day", "2024-02-05")] == 1 and got[("week", "2024-02-05")] == 1
