from pyspark.sql import functions as F

from opsframe.functions import to_int
from opsframe.sources.tables import Tables, bare_name, lookup, resolve

from .conftest import SF_SMALL


def test_bare_name_strips_schema_and_quotes():
    assert bare_name('"warehouse"."analytics"."Orders"') == "orders"
    assert bare_name("analytics.orders") == "orders"
    assert bare_name("`orders`") == "orders"


def test_resolver_names_roles_and_frames(spark):
    sub = spark.createDataFrame([(1,)], "x long")
    t = Tables(spark, SF_SMALL, aliases={"ref:rpt_orders": "orders", "source:tiny": sub})
    assert t['"warehouse"."analytics"."orders"'].columns == t["orders"].columns
    assert t["ref:rpt_orders"].count() == t["orders"].count()
    assert t["source:tiny"].count() == 1
    assert set(resolve(spark, SF_SMALL, ["region", "nation"])) == {"region", "nation"}


def test_lookup_pushes_filter_to_scan(spark):
    t = Tables(spark, SF_SMALL)
    df = lookup(t["orders"], F.col("o_orderkey") == 5).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_to_int_is_null_on_dirty_text(spark):
    df = spark.createDataFrame([("12",), ("",), ("x1",)], "s string")
    assert [r.v for r in df.select(to_int("s").alias("v")).collect()] == [12, None, None]


def test_scans_are_kept_per_resolver_and_see_a_changed_file(spark, tmp_path):
    from opsframe.sources.tables import Tables

    spark.range(3).write.parquet(f"{tmp_path}/orders.parquet")
    first = Tables(spark, str(tmp_path))
    assert first["orders"] is first["orders"] and first["orders"].count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert Tables(spark, str(tmp_path))["orders"].count() == 5
