"""CRM and mail reports: R5 outbound calls, R7 lifecycle, R8-R10 mail and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import boundary_diff, zone_date
from opsframe.operators.windows import latest_per_key
from opsframe.sources import standins as S
from opsframe.sources.tables import Tables


def outbound_calls_daily(t: Tables, zone="America/new_york", since="2024-01-01") -> DataFrame:
    """R5 (J1, J15, J4, A7, T7, T17, F12): per opportunity-day outbound calls
    counted on the zone's calendar (tasks are stored in UTC). Days with no
    call are dropped by the filter on the coalesced count."""
    s = S.crm_snapshot(t)
    tk = S.tasks(t).filter((F.col("task_subtype") == "Call") & (F.col("direction_c") == "Outbound"))
    tk = tk.select(F.col("what_id"), F.col("id"), zone_date("created_date", zone).alias("local_date"))
    calls = (s.select("opportunity_id", "date")
             .join(tk, (tk.what_id == s.opportunity_id) & (tk.local_date == s.date))
             .groupBy("opportunity_id", "date")
             .agg(F.countDistinct("id").alias("outbound_calls")))
    c = calls.select(F.col("opportunity_id").alias("c_opp"), F.col("date").alias("c_date"), "outbound_calls")
    j = s.filter(F.col("date") > F.lit(since).cast("date")).join(
        c, (F.col("c_opp") == F.col("opportunity_id")) & (F.col("c_date") == F.col("date")), "left")
    out = j.select("date", "opportunity_id", "raw_status", "delivery_date", "is_delivered", "derived_status",
                   F.coalesce(F.col("outbound_calls"), F.lit(0)).alias("outbound_calls"))
    return out.filter(F.col("outbound_calls") > 0)


def r5_outbound_calls_total(t: Tables, **kw) -> DataFrame:
    """The total of the daily outbound calls (A1 over A7)."""
    return outbound_calls_daily(t, **kw).agg(F.sum("outbound_calls").alias("outbound_calls"))


def r7_mean_lifecycle(t: Tables, since="2024-01-01", excluded_subtype="Email") -> DataFrame:
    """R7 (J7, A8, A17, T5, A4): mean days between first and last activity per
    opportunity. The source's left join is made inner by its WHERE."""
    o = S.crm_opportunities(t)
    tk = S.tasks(t).filter((F.col("activity_date_time_c") > F.lit(since).cast("timestamp_ntz"))
                           & (F.col("task_subtype") != excluded_subtype))
    life = (o.join(tk, tk.what_id == o.id)
            .groupBy("opportunity_id_c")
            .agg(F.min("activity_date_time_c").alias("first_date"), F.max("activity_date_time_c").alias("last_date"))
            .withColumn("lifecycle", boundary_diff("DAY", "first_date", "last_date")))
    return life.agg(F.avg("lifecycle").alias("avg_lifecycle"))


def r8_last_document_date(t: Tables, status="DELIVERED") -> DataFrame:
    """R8 (J2, J7, A8, A9, P3): latest document date per transaction group."""
    tr, tx, ts = S.mail_transactions(t), S.mail_transaction_xref(t), S.mail_tracking_statuses(t)
    ts = ts.filter(F.col("status") == status)            # J7
    j = (tr.join(tx, tx.vrm_transaction_id == tr.vrm_transaction_id, "left")
         .join(ts, ts.vrm_transaction_id == tr.vrm_transaction_id))
    return (j.groupBy(tx.vin.alias("VIN"), tx.inventory_id.alias("Inventory ID"),
                      tx.opportunity_id.alias("Opportunity ID"), tr.tracking_number.alias("Envelope Tracking Number"),
                      tr.mail_group_alias.alias("Mail Group"))
            .agg(F.max(tr.updated_at).alias("Document Received Date")))


def r9_first_scan(t: Tables, file_type="turbo_scan") -> DataFrame:
    """R9 (J2, A8, P3): first scan per opportunity."""
    f, fx = S.scan_files(t).filter(F.col("file_type") == file_type), S.scan_files_xref(t)
    j = f.join(fx, fx.file_id == f.file_id, "left")
    return j.groupBy(fx.reference_id.alias("Opportunity ID (dmv)")).agg(F.min(f.created).alias("Date Scanned"))


def r9_document_instances(t: Tables, association_types=("vin",), service_user="sfp_service") -> DataFrame:
    """R9 (J2, J7, P3, P7): document instances by association type."""
    di, dd = S.document_instances(t), S.document_definitions(t)
    ea = S.envelope_associations(t).filter(F.col("association_type").isin(*association_types))  # J7
    j = (di.join(dd, dd.document_definition_id == di.document_definition_id, "left")
         .join(ea, ea.envelope_id == di.envelope_id))
    upd = F.when((di.updated_by != service_user) & di.updated_by.isNotNull(), di.updated_by)
    return j.select(di.machine_name.alias("Station"), di.created_by.alias("Person"), upd.alias("Updated By"),
                    di.updated.alias("Updated Date"), dd.name.alias("Document Type"),
                    ea.associated_id.alias("Opportunity ID (sfp)"))


def compliance_status(physical, outbound, inbound, after) -> F.Column:
    """P10: complete when the physical title arrived after ``after`` and the
    flips are either both after it, both missing, or only the inbound one
    present; incomplete otherwise (an outbound flip with no inbound is
    incomplete)."""
    a = F.lit(after).cast("timestamp_ntz")
    return (F.when((physical > a) & (outbound > a) & (inbound > a), "complete")
            .when((physical > a) & outbound.isNull() & inbound.isNull(), "complete")
            .when((physical > a) & outbound.isNull() & (inbound > a), "complete")
            .otherwise("incomplete"))


def r10_title_compliance(t: Tables, record_type="inbound", created_since="1996-01-01",
                         complete_after="1996-01-01 00:00:00") -> DataFrame:
    """R10 (W1, P10, F2, F5): latest title record per VIN with its compliance."""
    tr = S.titles_registrations(t).filter(
        (F.col("is_deleted") != "true") & (F.col("record_type_id") == record_type)
        & (F.col("created_date") >= F.lit(created_since).cast("timestamp_ntz")))
    out = tr.select(
        "opportunity_c", "vin_c", "created_date",
        F.col("physical_title_received_date_c").alias("physical_title_received_date"),
        F.col("inbound_flip_received_date_c").alias("inbound_flip_received_date"),
        "outbound_flip_sent_date_c",
        compliance_status(F.col("physical_title_received_date_c"), F.col("outbound_flip_sent_date_c"),
                          F.col("inbound_flip_received_date_c"), complete_after).alias("compliance_status"))
    latest = latest_per_key(out, ["vin_c"], [F.col("created_date").desc_nulls_first(), F.col("opportunity_c").desc()],
                            rn_col="row", keep_rn=True)
    return latest.select(F.col("row").cast("long").alias("row"), "opportunity_c", "vin_c", "physical_title_received_date",
                         "inbound_flip_received_date", "outbound_flip_sent_date_c", "compliance_status")
