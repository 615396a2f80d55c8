"""Entries of the stored-data operators: typed loads, repeated batches, refreshed aggregates, updates, look-ups,
co-partitioned tables, ids that stay, and checks of stored models. Each writes its tables under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.operators.aggs import key_violations, money_sum
from opsframe.operators.ids import register, stable_ids
from opsframe.operators.prefix import summary_of_earlier
from opsframe.plans import field_service, recon
from opsframe.session import scratch_path
from opsframe.sources import sinks, standins as S, typed
from opsframe.sources.stored import StoredAggregate, StoredTable
from opsframe.sources.tables import Tables
from opsframe.sources.typed import Declared

# Declared types of the document list.
DOCUMENTS = (Declared("doc_id", "int8"), Declared("lang", "char", 5), Declared("source", "varchar", 4),
             Declared("n_chars", "int2"), Declared("pages", "numeric", 6, 2))


def _loaded(t: Tables) -> DataFrame:
    docs = t["documents"].select("doc_id", "lang", "source", "n_chars", F.round(F.col("n_chars") / F.lit(7.0), 2).alias("pages"))
    path = scratch_path(t.spark, "documents")
    typed.store(docs, DOCUMENTS, path)
    return t.spark.read.parquet(path)


def s6_typed_documents(t: Tables) -> DataFrame:
    """Documents that fit their declared types, as stored."""
    return typed.stored(_loaded(t), DOCUMENTS)


def s6_rejected_documents(t: Tables) -> DataFrame:
    """Each fault of the documents that do not."""
    found = typed.rejected(_loaded(t))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "column", "rule", F.when(F.col("column") != "pages", F.col("value")).alias("value"))


def s7_repeated_batches(t: Tables) -> DataFrame:
    """Orders in two batches, one of them sent again, counted once."""
    table = StoredTable(t.spark, scratch_path(t.spark, "orders"))
    orders = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    table.append(orders.filter("o_orderstatus = 'F'"), "finished")
    table.append(orders.filter("o_orderstatus <> 'F'"), "open")
    table.append(orders.filter("o_orderstatus = 'F'"), "finished")
    return table.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), money_sum("o_totalprice").alias("total"))


def s7_moved_table(t: Tables) -> DataFrame:
    """A table like another takes over its rows, twice asked and once done; what both hold then."""
    old, new = StoredTable(t.spark, scratch_path(t.spark, "old_customers")), StoredTable(t.spark, scratch_path(t.spark, "new_customers"))
    old.append(S.customers(t).select("customerid", "marketsegment"), "all")
    new.create_like(old)
    new.append_from(old)
    new.append_from(old)
    held = new.read().withColumn("held_by", F.lit("new")).unionByName(old.read().withColumn("held_by", F.lit("old")))
    return held.groupBy("held_by", "marketsegment").agg(F.count(F.lit(1)).alias("customers"))


def s9_refreshed_balances(t: Tables) -> DataFrame:
    """R30's aggregate, refreshed after a first batch of customers, a second one and an update."""
    customers, nations = S.customers(t), S.nations(t)
    table = StoredTable(t.spark, scratch_path(t.spark, "customers"))
    view = StoredAggregate(table, scratch_path(t.spark, "balances"), ["customername", "phone", "nationname", "marketsegment"],
                           {"accountbalance": F.col("accountbalance")}, prepare=lambda rows: rows.join(nations, "nationid"))
    table.append(customers.filter("accountbalance < 5000"), "lower", by=["marketsegment"])
    view.refresh()
    table.append(customers.filter("not coalesce(accountbalance < 5000, false)"), "others", by=["marketsegment"])
    view.refresh()
    table.update({"accountbalance": 1000}, F.col("marketsegment") == "BUILDING")
    view.refresh()
    return view.read().withColumn("accountbalance", F.col("accountbalance").cast("double"))


def s10_updated_files(t: Tables) -> DataFrame:
    """The balance of one segment set, in the files that hold the segment."""
    table = StoredTable(t.spark, scratch_path(t.spark, "segments"))
    table.append(S.customers(t).select("customerid", "marketsegment", "accountbalance"), "all", by=["marketsegment"], ranges=8)
    table.update({"accountbalance": 1000}, F.col("marketsegment") == "BUILDING")
    return table.read()


def w4_stable_ids(t: Tables) -> DataFrame:
    """Customers numbered from the early orders, then from all of them; the first numbers stay."""
    registry = StoredTable(t.spark, scratch_path(t.spark, "customer_ids"))
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    register(orders.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")), ["o_custkey"], registry, "early", name="customer_id")
    return stable_ids(orders, ["o_custkey"], registry, "all", name="customer_id").select("o_orderkey", "o_custkey", "customer_id")


def r14_repeated_inventory(t: Tables) -> DataFrame:
    """R14 over a stored model that does repeat its key: expenses by inventory, three of each inventory's rows."""
    expenses = sinks.materialize(recon.clean_expense(t).select("inventoryid", "maintid", "cost"), "expenses")
    return key_violations(expenses, ["inventoryid"], [F.col("maintid").asc()], sample=3)


def j5_earlier_lines_summary(t: Tables) -> DataFrame:
    """J5 by prefix aggregates: how many lines of each order were shipped on or before its date, and their two lowest prices."""
    orders = t["orders"].select("o_orderkey", "o_orderdate")
    lines = t["lineitem"].select("l_orderkey", "l_shipdate", "l_extendedprice")
    found = summary_of_earlier(orders, lines, [("o_orderkey", "l_orderkey")], "o_orderdate", "l_shipdate", "l_extendedprice")
    return found.select("o_orderkey", F.col("n").alias("n_earlier"), F.get("least", F.lit(0)).alias("lowest"), F.get("least", F.lit(1)).alias("second"))


def _clustered_orders(t: Tables, by: str, bloom: str) -> DataFrame:
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    return sinks.store_clustered(orders, scratch_path(t.spark, "clustered"), [by], [bloom])


def s4_clustered_lookup(t: Tables, customer: int = 700) -> DataFrame:
    """A customer's orders from a table in the customers' order."""
    return _clustered_orders(t, "o_custkey", "o_orderkey").filter(F.col("o_custkey") == customer)


def s4_bloom_lookup(t: Tables, keys: tuple[int, ...] = (77, 7077)) -> DataFrame:
    """Orders by a key that the table is not sorted by, through its Bloom filters."""
    return _clustered_orders(t, "o_custkey", "o_orderkey").filter(F.col("o_orderkey").isin(*keys))


def _shared_order_key(t: Tables) -> Tables:
    """Orders and lines stored in buckets of the order key, under their own names."""
    return sinks.co_partitioned(t, {"orders": "o_orderkey", "lineitem": "l_orderkey"})


def j3_bucketed_driver_day(t: Tables) -> DataFrame:
    """R3 over tables that share the partitioning of the order key."""
    return field_service.r3_driver_day(_shared_order_key(t))


def j3_bucketed_appointments(t: Tables) -> DataFrame:
    """R4 over tables that share the partitioning of the order key."""
    return field_service.r4_appointment_detail(_shared_order_key(t))
