"""QA reports: R16 theoretical margin, R17 repair orders, R20 vendor tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import typed_null
from opsframe.operators.joins import distinct_lookup, join_earlier, left_outer, not_in, star_left, unmatched
from opsframe.sources import standins as S
from opsframe.sources.tables import Tables

# Repair-order numbers that are not real orders.
PLACEHOLDER_RO_NUMBERS = ("", "NO_RO", "CANCEL_PART", "NO_STOCK_ID", "NO_COST", "OLD_ACCIDENT")


# R17's columns of repair orders and of their lines.
ORDER_COLUMNS = ("vin", "repair_order_number", "status", "open_date", "closed_date", "accounting_date", "mileage_in", "mileage_out", "advisor")
LINE_COLUMNS = ("job_number", "concern", "cause", "correction", "status", "sale_type", "sub_sale_type", "department")
SD_COLUMNS = (*(f"ro_{c}" for c in ORDER_COLUMNS), *(f"rli_{c}" for c in LINE_COLUMNS))

# R20's columns of vendor tasks, in the report's order; those without a value are typed nulls (P5).
TASK_COLUMNS = ("taskowner", "taskdescription", "tasktype", "taskstatus", "taskenteredon", "taskcompletedon", "inventoryid", "taskid",
                "taskstartedon", "taskvendorid", "priority", "taskreadyforpickupon", "taskvendorstatus", "taskvendorcomment",
                "taskvendorapprovedon", "taskestimatedreadytime", "estimatedcost", "resourceid", "estimatedhours", "inttaskerid",
                "exttaskerid", "enteredby", "passed", "reasoncodeid", "adventronumber", "bookdate", "senttobookingon")
EMPTY_TASK_COLUMNS = {"taskvendorwaitingonapprovaldate": "timestamp_ntz", "taskapprovalcomment": "string", "taskapprovedby": "string", "parenttaskid": "bigint"}


def partner_rows(t: Tables) -> DataFrame:
    """Partner of every grouped source (before the DISTINCT)."""
    r = S.partner_sources(t).filter(F.col("source_grouped").isNotNull())
    p = S.partners(t).withColumnRenamed("partner_id", "p_partner_id")
    j = r.join(p, F.col("p_partner_id") == F.col("partner_id"), "left")
    return j.select("partner_id", "source_grouped", F.col("name").alias("partner_name"))


def r16_theoretical_margin(t: Tables) -> DataFrame:
    """R16 (A14, J16, P6): margin rows with the partner of their source. The
    look-up is DISTINCT on (partner, source, name); a source with several
    partners repeats the row (kept, as in the source)."""
    evcm = S.evcm(t)
    pl = partner_rows(t).withColumnRenamed("source_grouped", "pl_source")
    j = distinct_lookup(evcm, pl, [("source_grouped", "pl_source")], ["partner_id", "partner_name"])
    total = (F.col("vin_count") * F.col("theoretical_max_evcm")).alias("total_theoretical_max_evcm")
    return j.select(*evcm.columns, total, "partner_name")


def _open_repair_orders(t: Tables, null_line: int | None = None) -> DataFrame:
    """Repair orders not yet in the other system (J9, null-aware NOT IN)."""
    ro = S.repair_orders(t)
    ro = ro.select(*[F.col(c).alias(f"ro_{c}") for c in ORDER_COLUMNS])
    return not_in(ro, "ro_repair_order_number", S.closed_repair_orders(t, null_line), "adventronumber")


def _with_lines(open_ro: DataFrame, t: Tables) -> DataFrame:
    rli = S.repair_order_lines(t)
    rli = rli.select(F.col("repair_order_number").alias("rli_ro"), *[F.col(c).alias(f"rli_{c}") for c in LINE_COLUMNS])
    return left_outer(open_ro, rli, [("ro_repair_order_number", "rli_ro")]).drop("rli_ro")  # many lines per order


def advent_service_data(t: Tables, null_line: int | None = None) -> DataFrame:
    """Open repair orders with their lines."""
    return _with_lines(_open_repair_orders(t, null_line), t)


def r17_open_repair_orders(t: Tables, null_line: int | None = None) -> DataFrame:
    """R17 (J9, J5, J2, P2, O3): open repair orders (with their lines) and
    every stock record of the VIN received on or before the opening (all
    earlier, fan-out kept), with the inventory of that stock.

    Both left joins may meet a hot key on their multi-row side, so both are
    skew-safe (``left_outer``, salted). The stock join reads only
    repair-order columns and runs first (the two left joins commute)."""
    open_ro = _open_repair_orders(t, null_line)
    ai = S.stock_received(t).withColumnRenamed("vin", "ai_vin")
    inv = S.inventory(t).select("inventoryid", "adventstockid")
    j = join_earlier(open_ro, ai, [("ro_vin", "ai_vin")], right_time="received_date", left_time="ro_open_date")
    j = _with_lines(j, t)
    j = j.join(inv, F.col("stock_number") == F.col("adventstockid"), "left")
    return (j.select("inventoryid", "stock_number", F.col("received_date").alias("stocked_date"), *SD_COLUMNS)
            .orderBy("ro_vin", "ro_repair_order_number", "rli_job_number"))


def r20_vendor_tasks_without_closed_order(t: Tables, status=10, excluded_vendor=44) -> DataFrame:
    """R20 (J3, J8, F2, F4, F6, P5): booked vendor tasks with a real RO number
    that has no closed order. LEFT JOIN ... IS NULL is written as an anti-join."""
    tb = S.vendor_tasks(t)
    tb = tb.filter((F.col("taskstatus") == status) & (F.col("taskvendorid") != excluded_vendor)
                   & F.col("adventronumber").isNotNull() & ~F.col("adventronumber").isin(*PLACEHOLDER_RO_NUMBERS))
    tb = unmatched(tb, S.closed_orders(t), [("adventronumber", "adventronumber")])
    tt = S.task_types(t).select(F.col("id").alias("tt_id"), F.col("type").alias("task_name"), F.col("category").alias("recon_type"))
    inv = S.inventory(t).select(F.col("inventoryid").alias("inv_id"), "vin")
    ven = S.vendors(t).select(F.col("vendorid"), F.col("name").alias("vendor_name"))
    j = star_left(tb, [(tt, [("tasktype", "tt_id")]), (inv, [("inventoryid", "inv_id")]),
                       (ven, [("taskvendorid", "vendorid")])])
    return j.select("vin", *TASK_COLUMNS, *[typed_null(kind).alias(c) for c, kind in EMPTY_TASK_COLUMNS.items()],
                    "task_name", "recon_type", "vendor_name")
