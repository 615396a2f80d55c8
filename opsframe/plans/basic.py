"""Single-table and look-up reports: R1, R2, R6, R15, R18, R19, R21, R22, R24, R32."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import day_of
from opsframe.operators.aggs import count_by, duplicates, has_all
from opsframe.operators.joins import ratio_to_days_before, unmatched
from opsframe.sources import standins as S
from opsframe.sources.tables import Tables, lookup

# The required skills of the division report.
REQUIRED_SKILLS = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def r1_candidates_with_all_skills(t: Tables, required=REQUIRED_SKILLS) -> DataFrame:
    """R1 (A12, F3, O1): candidates holding every required skill, by id."""
    return has_all(S.candidates(t), "candidate_id", "skill", required).orderBy("candidate_id")


def r2_unmatched(t: Tables) -> DataFrame:
    """R2 (J8, O1): documents without any label row."""
    docs = t["documents"].select("doc_id")
    return unmatched(docs, t["labels"].select("doc_id"), ["doc_id"]).orderBy("doc_id")


# --- R6: year-to-date figures (A1-A3, F5, F6); one scalar report each
def r6_calls_sum(t: Tables, since="2000-12-31") -> DataFrame:
    c = S.daily_calls(t)
    return c.filter(F.col("date") > F.lit(since).cast("date")).agg(F.sum("inbound_calls").alias("inbound_calls"))


def r6_distinct_envelopes(t: Tables, since="1998-12-31", via="Shippo") -> DataFrame:
    e = S.sent_envelopes(t)
    return (e.filter((F.col("created_date") > F.lit(since).cast("timestamp_ntz")) & (F.col("sent_via_c") == via))
            .agg(F.countDistinct("name").alias("envelopes")))


def r6_document_count(t: Tables, since="2024-01-15") -> DataFrame:
    d = S.crm_documents(t)
    return d.filter(F.col("created_date") > F.lit(since).cast("timestamp_ntz")).agg(F.count("id").alias("documents"))


def r6_distinct_cases(t: Tables, since="2000-12-31") -> DataFrame:
    c = S.crm_cases(t)
    return c.filter(F.col("created_date") > F.lit(since).cast("timestamp_ntz")).agg(F.countDistinct("id").alias("cases"))


def r6_payment_count(t: Tables, since="1998-12-31") -> DataFrame:
    p = S.crm_payments(t)
    return p.filter(F.col("created_date") > F.lit(since).cast("timestamp_ntz")).agg(F.count("salesforce_id").alias("payments"))


def r6_plates_mailed(t: Tables, since="1998-12-31") -> DataFrame:
    tr = S.titles_registrations(t)
    return (tr.filter((F.col("created_date") > F.lit(since).cast("timestamp_ntz"))
                      & F.col("registration_and_plates_mailed_date_c").isNotNull())
            .agg(F.count("id").alias("plates_mailed")))


def r15_duplicate_vins(t: Tables, record_type="outbound", changed_since="1998-12-20") -> DataFrame:
    """R15 (A13): VINs with more than one record and a change since a date."""
    tr = S.titles_registrations(t).filter(F.col("record_type_id") == record_type)
    out = duplicates(tr, ["vin_c"], count_col="vin_c", changed_col="last_modified_date",
                     since=F.lit(changed_since).cast("timestamp_ntz"), count_alias="vin_count")
    return out


def a13_duplicate_lines(t: Tables, since="2000-01-01") -> DataFrame:
    """A13 on lineitem: (order, line) pairs present more than once, last shipped since a date."""
    return duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"], changed_col="l_shipdate",
                      since=F.lit(since).cast("timestamp_ntz"), count_alias="n")


def r18_snapshot_ratio(t: Tables, days: int = 7) -> DataFrame:
    """R18 (T3, A6, A10, T6, J11, T21, O2): daily row count against the count
    ``days`` earlier."""
    daily = count_by(t["events"], [day_of("ts").alias("curr_date")], "curr_count")
    out = ratio_to_days_before(daily, "curr_date", "curr_count", days)
    return (out.select("curr_date", "curr_count", "prev_date", "prev_count", "ratio")
            .orderBy(F.col("curr_date").desc_nulls_first()))


def r19_rows_per_inventory(t: Tables) -> DataFrame:
    """R19 (A6, A9): rows per inventory id (an order is a row of a customer's inventory)."""
    return count_by(t["orders"].select(F.col("o_custkey").alias("inventoryid")), ["inventoryid"], "count")


def r21_distinct_record_types(t: Tables) -> DataFrame:
    """R21 (A14)."""
    return S.titles_registrations(t).select("record_type_id").distinct()


def r21_distinct_type_names(t: Tables) -> DataFrame:
    """R21 (A14)."""
    return S.task_types(t).select(F.col("category").alias("name")).distinct()


def r22_row_lookup(t: Tables, completed_after="2001-06-01") -> DataFrame:
    """R22 (S4): whole rows by a date predicate (money returned as DOUBLE,
    like every other report)."""
    rows = lookup(S.expenses(t), F.col("workcompletedon") > F.lit(completed_after).cast("timestamp_ntz"))
    return rows.withColumn("cost", F.col("cost").cast("double"))


def r22_inventory_lookup(t: Tables, inventoryid=1) -> DataFrame:
    """R22 (S4): rows of one inventory item."""
    return lookup(S.expenses(t), F.col("inventoryid") == inventoryid).withColumn("cost", F.col("cost").cast("double"))


def r22_vin_lookup(t: Tables, vin="VIN-1") -> DataFrame:
    """R22 (S4): title records of one vehicle."""
    return lookup(S.titles_registrations(t), F.col("vin_c") == vin)


def r22_appointment_lookup(t: Tables, number="SA-1") -> DataFrame:
    """R22 (S4): one appointment by its number."""
    return lookup(S.service_appointments(t), F.col("appointment_number") == number)


def r24_recent_queries(t: Tables, k: int = 100) -> DataFrame:
    """R24 (O5): the k most recent log entries. ``orderBy().limit()`` plans a
    per-partition top-k and a merge (TakeOrderedAndProject), no full sort."""
    q = S.query_log(t)
    return q.orderBy(F.col("starttime").desc_nulls_first(), F.col("query").desc()).limit(k)


def r32_running(t: Tables, status="Running") -> DataFrame:
    """R32 (F1, P1): entries with a given status."""
    a = S.activity(t)
    return a.filter(F.col("status") == status).select("user_name", "db_name", "pid", "query")
