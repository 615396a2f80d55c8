"""Operator-level reports: one per operator whose behavior needs its own
check (fan-out, null handling, numbering, boundaries), on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import any_true, boundary_diff, zone_date
from opsframe.operators.aggs import count_by
from opsframe.operators.joins import contains_join, join_earlier, left_join_where, semi
from opsframe.operators.sets import union_distinct
from opsframe.operators.windows import (
    first_last_non_null, latest_per_key, row_numbers, surrogate_number, with_first_last,
)
from opsframe.plans.qa import advent_service_data
from opsframe.session import scratch_path
from opsframe.sources.sinks import append, enforce_not_null
from opsframe.sources.tables import Tables

LINE_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def j5_orders_with_earlier_lines(t: Tables) -> DataFrame:
    """Each order with every line of it shipped on or before the order date."""
    o = t["orders"].select("o_orderkey", "o_orderdate")
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate")
    j = join_earlier(o, li, [("o_orderkey", "l_orderkey")], right_time="l_shipdate", left_time="o_orderdate")
    return j.select("o_orderkey", "o_orderdate", "l_linenumber", "l_shipdate")


def j6_customers_urgent_orders(t: Tables) -> DataFrame:
    """Customers left-joined to their urgent, non-pending orders (the
    condition in ON filters the right side only; every customer stays)."""
    c = t["customer"].select("c_custkey")
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    pred = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "P")
    return left_join_where(c, o, [("c_custkey", "o_custkey")], pred).select("c_custkey", "o_orderkey")


def j9_not_in_with_null(t: Tables) -> DataFrame:
    """NOT IN against a subquery holding a null -- always empty."""
    return advent_service_data(t, null_line=7)


def j14_names_inside_names(t: Tables) -> DataFrame:
    """Customer names that contain a supplier's number, its last digit left open (a LIKE pattern)."""
    a = t["customer"].select(F.col("c_name").alias("text_name"))
    b = t["supplier"].select(F.concat(F.lit("#"), F.substring("s_name", 10, 8), F.lit("_")).alias("pattern_name"))
    return contains_join(a, "text_name", b, "pattern_name")


def w1_latest_line_per_order(t: Tables) -> DataFrame:
    """The latest-shipped line per order; the remaining columns break ties."""
    li = t["lineitem"]
    order = [F.col("l_shipdate").desc_nulls_first()] + [F.col(c).asc() for c in LINE_COLS if c not in ("l_orderkey", "l_shipdate")]
    return latest_per_key(li, ["l_orderkey"], order)


def w2_order_rank_per_customer(t: Tables) -> DataFrame:
    """Every order numbered within its customer, latest first."""
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    return row_numbers(o, ["o_custkey"], [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").asc()],
                       name="rn")


def w4_order_number(t: Tables) -> DataFrame:
    """One running number over all orders by date and key."""
    o = t["orders"].select("o_orderkey", "o_orderdate")
    return surrogate_number(o, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], name="rn")


def _urgent() -> F.Column:
    return F.col("o_orderpriority") == "1-URGENT"


def w5_first_last_kept(t: Tables) -> DataFrame:
    """first/last urgent order date per customer on every order row."""
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    out = with_first_last(o, ["o_custkey"], "o_orderdate", _urgent(), "first_urgent", "last_urgent")
    return out.select("o_orderkey", "o_custkey", "first_urgent", "last_urgent")


def w9_first_last_collapsed(t: Tables) -> DataFrame:
    """The same, one row per customer."""
    o = t["orders"]
    return first_last_non_null(o, ["o_custkey"], "o_orderdate", _urgent(), "first_urgent", "last_urgent")


def t4_minute_boundaries(t: Tables) -> DataFrame:
    """T4: per user, minute and day boundaries between first and last event."""
    g = t["events"].groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select("user_id", boundary_diff("MINUTE", "first_ts", "last_ts").alias("minutes"),
                    boundary_diff("MINUTE", "last_ts", "first_ts").alias("minutes_back"),
                    boundary_diff("HOUR", "first_ts", "last_ts").alias("hours"),
                    boundary_diff("DAY", "first_ts", "last_ts").alias("days"))


def t7_events_per_local_day(t: Tables, zone="America/new_york") -> DataFrame:
    """Events per calendar day in a zone (stored times are UTC)."""
    e = t["events"]
    return e.groupBy(zone_date("ts", zone).alias("local_date")).agg(F.count(F.lit(1)).alias("events"))


def u1_object_names(t: Tables) -> DataFrame:
    """Names of suppliers UNION names of the suppliers that lines name."""
    named = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    return union_distinct(t["supplier"].select(F.col("s_name").alias("name")), t["lineitem"].select(named.alias("name")))


def f14_flagged_lines(t: Tables) -> DataFrame:
    """Lines with any of three flags, and the flags as booleans (a null flag counts as false)."""
    flags = {"returned": F.col("l_returnflag") == "R", "discounted": F.when(F.col("l_linenumber") != 3, F.col("l_discount") > 0.07),
             "large": F.col("l_quantity") > 45}
    li = t["lineitem"].select("l_orderkey", "l_linenumber", *[v.alias(c) for c, v in flags.items()])
    return li.filter(any_true(*flags)).select("l_orderkey", "l_linenumber", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def w8_first_last_over_groups(t: Tables) -> DataFrame:
    """first/last urgent day of the customer on every row of a grouped query (orders per customer, day and priority)."""
    grouped = t["orders"].groupBy("o_custkey", "o_orderdate", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    return with_first_last(grouped, ["o_custkey"], "o_orderdate", _urgent(), "first_urgent", "last_urgent")


def s2_three_part_name(t: Tables) -> DataFrame:
    """A quoted three-part name read as its table."""
    return count_by(t['"dev"."public"."orders"'], ["o_orderstatus"], "orders")


def s3_role_reference(t: Tables) -> DataFrame:
    """S3: two role names bound to a table and to a frame."""
    roles = Tables(t.spark, t.folder, aliases={"role:buyers": "customer", "role:places": t["nation"]})
    joined = roles["role:buyers"].join(roles["role:places"], F.col("c_nationkey") == F.col("n_nationkey"))
    return count_by(joined, ["n_name"], "buyers")


def s7_appended_orders(t: Tables) -> DataFrame:
    """Orders written by status in two appends to one table, keys NOT NULL, then counted."""
    path = scratch_path(t.spark, "appended_orders")
    orders = enforce_not_null(t["orders"].select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    append(orders.filter("o_orderstatus = 'F'"), path)
    append(orders.filter("o_orderstatus <> 'F'"), path)
    return count_by(t.spark.read.parquet(path), ["o_orderstatus"], "orders")


def j10_customers_with_urgent_orders(t: Tables) -> DataFrame:
    """Customers whose key is among those of urgent orders (many orders per customer)."""
    urgent = t["orders"].filter(_urgent())
    return semi(t["customer"].select("c_custkey", "c_name"), urgent, [("c_custkey", "o_custkey")])
