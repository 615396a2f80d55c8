"""Stand-in tables: the business tables the reports read, derived from the
given tables (FIXTURES.md part 3). Each is a lazy projection/aggregate of a
parquet scan, so its size grows with the data and filters placed on it reach
the scan. The DuckDB oracle derives the same tables with the same rules.

Derivation rules (fixed values of the fixtures; both sides use them):
``o_orderkey % 1440`` minutes after midnight for appointment starts, seven
times that for ends; orders with status P have no end; lineitem rows with
return flag N have no assignment time; suppliers with key divisible by 10
have no name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.sources.tables import Tables


def _plus(unit: str, qty, ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add(unit, qty if isinstance(qty, Column) else F.lit(qty), ts)


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---------------------------------------------------------------- skills
def candidates(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("skill")).distinct()


# ------------------------------------------------------- field service
def service_appointments(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("SA-"), _s("o_orderkey")).alias("appointment_number"),
        F.col("o_orderkey").alias("parent_record_id"),
        F.col("o_custkey").alias("account_id"),
        F.concat(F.lit("TRK-"), _s(F.dayofyear("o_orderdate") % 40)).alias("truck_number_c"),
        F.lpad(_s((F.col("o_custkey") * 37) % 100000), 5, "0").alias("postal_code"),
        F.when(F.col("o_orderstatus") == "F", "Completed").otherwise("Scheduled").alias("status"),
        F.col("o_orderdate").alias("created_date"),
        _plus("MINUTE", F.col("o_orderkey") % 1440, "o_orderdate").alias("actual_start_time"),
        F.when(F.col("o_orderstatus") != "P",
               _plus("MINUTE", (F.col("o_orderkey") * 7) % 1440, "o_orderdate")).alias("actual_end_time"),
    )


def work_orders(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("delivery_order_c"),
        F.when(F.col("o_orderstatus") == "F", "Completed").otherwise("Open").alias("status"),
    )


def accounts(t: Tables) -> DataFrame:
    return t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def delivery_orders(t: Tables) -> DataFrame:
    o, c, n = t["orders"], t["customer"], t["nation"]
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    transit = (F.when(F.col("o_orderpriority") == "1-URGENT", "delivery_to_customer")
               .when(F.col("o_orderpriority") == "2-HIGH", "pickup_from_customer")
               .when(F.col("o_orderpriority") == "3-MEDIUM", "buyback")
               .otherwise("wholesale"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.lower("n_name").alias("managing_hub_facility_code_c"),
        transit.alias("transit_type_c"),
        F.when(F.col("o_totalprice") >= 250000, "retail").otherwise("wholesale").alias("vehicle_grade_c"),
        ((F.col("o_orderkey") % 2) == 0).alias("is_last_mile_c"),
    )


def assigned_resources(t: Tables) -> DataFrame:
    li = t["lineitem"]
    return li.select(
        F.col("l_orderkey").alias("service_appointment_id"),
        F.col("l_suppkey").alias("service_resource_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("created_date"),
    )


def service_resources(t: Tables) -> DataFrame:
    s = t["supplier"]
    return s.select(F.col("s_suppkey").alias("id"),
                    F.when((F.col("s_suppkey") % 10) != 0, F.col("s_name")).alias("name"))


# ------------------------------------------------------ calls and CRM
def _task_subtype() -> Column:
    return (F.when(F.col("event_type").isin("click", "view"), "Call")
            .when(F.col("event_type") == "signup", "Email")
            .otherwise("Meeting"))


def tasks(t: Tables) -> DataFrame:
    e = t["events"]
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("what_id"),
        _task_subtype().alias("task_subtype"),
        F.when(F.col("event_type") == "click", "Outbound").otherwise("Inbound").alias("direction_c"),
        F.col("ts").alias("created_date"),
        F.col("ts").alias("activity_date_time_c"),
    )


def crm_snapshot(t: Tables) -> DataFrame:
    e = t["events"]
    g = (e.groupBy(F.col("user_id").alias("opportunity_id"), F.to_date("ts").alias("date"))
         .agg(F.min("event_type").alias("raw_status"),
              F.max("event_type").alias("derived_status"),
              F.bool_or(F.col("event_type") == "purchase").alias("is_delivered")))
    return g.withColumn("delivery_date", F.date_add("date", 3))


def crm_opportunities(t: Tables) -> DataFrame:
    return t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("opportunity_id_c"))


def daily_calls(t: Tables) -> DataFrame:
    li = t["lineitem"]
    return li.select(F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("int").alias("inbound_calls"))


def sent_envelopes(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.concat(F.lit("ENV-"), _s("o_custkey")).alias("name"),
                    F.col("o_orderdate").alias("created_date"),
                    F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Shippo").otherwise("Mail").alias("sent_via_c"))


def crm_documents(t: Tables) -> DataFrame:
    return t["events"].select(F.col("event_id").alias("id"), F.col("ts").alias("created_date"))


def crm_cases(t: Tables) -> DataFrame:
    return t["lineitem"].select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("created_date"))


def crm_payments(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("salesforce_id"),
                    F.col("o_orderdate").alias("created_date"))


# ------------------------------------------------------------- titles
def titles_registrations(t: Tables) -> DataFrame:
    o = t["orders"]
    k = F.col("o_orderkey")
    d = "o_orderdate"
    return o.select(
        k.alias("id"),
        F.concat(F.lit("VIN-"), _s("o_custkey")).alias("vin_c"),
        F.concat(F.lit("OPP-"), _s(k)).alias("opportunity_c"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "inbound").otherwise("outbound").alias("record_type_id"),
        F.when(F.col("o_orderstatus") == "P", "true").otherwise("false").alias("is_deleted"),
        F.col(d).alias("created_date"),
        _plus("DAY", k % 400, d).alias("last_modified_date"),
        F.when(k % 5 != 0, _plus("DAY", 10, d)).alias("physical_title_received_date_c"),
        F.when(k % 3 != 0, _plus("DAY", 20, d)).alias("inbound_flip_received_date_c"),
        F.when(k % 4 != 0, _plus("DAY", 15, d)).alias("outbound_flip_sent_date_c"),
        F.when(k % 7 != 0, _plus("DAY", 30, d)).alias("registration_and_plates_mailed_date_c"),
    )


# ---------------------------------------------------- mail carrier
def mail_transactions(t: Tables) -> DataFrame:
    li = t["lineitem"]
    return li.select(F.col("l_orderkey").alias("vrm_transaction_id"),
                     F.concat(F.lit("TRK-"), _s("l_partkey")).alias("tracking_number"),
                     F.col("l_shipdate").alias("updated_at"),
                     F.concat(F.lit("MG-"), F.col("l_linestatus")).alias("mail_group_alias"))


def mail_transaction_xref(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("vrm_transaction_id"),
                    F.concat(F.lit("VIN-"), _s("o_custkey")).alias("vin"),
                    F.col("o_custkey").alias("inventory_id"),
                    F.concat(F.lit("OPP-"), _s("o_orderkey")).alias("opportunity_id"))


def mail_tracking_statuses(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("vrm_transaction_id"),
                    F.when(F.col("o_orderstatus") == "F", "DELIVERED").otherwise("IN_TRANSIT").alias("status"))


def scan_files(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("file_id"),
                    F.when(F.col("o_orderstatus") == "F", "turbo_scan").otherwise("upload").alias("file_type"),
                    F.col("o_orderdate").alias("created"))


def scan_files_xref(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("file_id"),
                    F.concat(F.lit("OPP-"), _s("o_custkey")).alias("reference_id"))


def document_instances(t: Tables) -> DataFrame:
    li = t["lineitem"]
    upd = (F.when(F.col("l_returnflag") == "N", F.lit("sfp_service"))
           .when(F.col("l_returnflag") == "A", F.concat(F.lit("U-"), _s(F.col("l_suppkey") % 50))))
    return li.select(F.concat(F.lit("ST-"), _s(F.col("l_suppkey") % 20)).alias("machine_name"),
                     F.concat(F.lit("U-"), _s(F.col("l_partkey") % 50)).alias("created_by"),
                     upd.alias("updated_by"),
                     F.col("l_shipdate").alias("updated"),
                     F.col("l_partkey").alias("document_definition_id"),
                     F.col("l_orderkey").alias("envelope_id"))


def document_definitions(t: Tables) -> DataFrame:
    return t["part"].select(F.col("p_partkey").alias("document_definition_id"), F.col("p_type").alias("name"))


def envelope_associations(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("envelope_id"),
                    F.concat(F.lit("OPP-"), _s("o_custkey")).alias("associated_id"),
                    F.when(F.col("o_orderstatus") == "P", "deal").otherwise("vin").alias("association_type"))


# ------------------------------------------------- recon cost model
def expenses(t: Tables) -> DataFrame:
    o = t["orders"]
    k = F.col("o_orderkey")
    recon = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return o.select(
        k.alias("maintid"),
        F.col("o_custkey").alias("inventoryid"),
        (k % 30).alias("vendorid"),
        (k % 9).alias("typeid"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("cost"),
        F.col("o_orderdate").alias("droppedoffon"),
        F.col("o_orderpriority").alias("comment"),
        F.concat(F.lit("PO-"), _s(k)).alias("po"),
        F.when(F.col("o_orderstatus") == "O", "Ebay Listingal").otherwise("Standard").alias("mainttype"),
        F.when(recon, 2).otherwise(1).alias("mainttypecategoryid"),
        F.when(recon, "Recon").otherwise("Other").alias("maint_category_name"),
        F.lit(5).alias("accttypecategoryid"),
        F.lit("Cost of Sales").alias("acct_category_name"),
        F.concat(F.lit("expense "), _s(k)).alias("description"),
        F.when(k % 3 != 0, _plus("DAY", 5, "o_orderdate")).alias("workcompletedon"),
    )


def inventory(t: Tables) -> DataFrame:
    c = t["customer"]
    return c.select(F.col("c_custkey").alias("inventoryid"),
                    F.concat(F.lit("VIN-"), _s("c_custkey")).alias("vin"),
                    F.concat(F.lit("STK-"), _s("c_custkey")).alias("adventstockid"),
                    _plus("DAY", F.col("c_custkey") % 1000, F.lit("1995-01-01").cast("timestamp_ntz")).alias("tdapurchaseddate"))


def stock_number_lookup(t: Tables) -> DataFrame:
    c = t["customer"]
    return c.select(F.col("c_custkey").alias("inventoryid"),
                    F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.concat(F.lit("STK-"), _s("c_custkey"))).alias("stock_number"))


def recon_tasks(t: Tables) -> DataFrame:
    o = t["orders"]
    k = F.col("o_orderkey")
    return o.select(
        k.alias("taskid"),
        F.col("o_custkey").alias("inventoryid"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(57)).otherwise((k % 50 + 11).cast("int")).alias("tasktype"),
        F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("taskstatus"),
        (F.col("o_custkey") % 100).alias("taskvendorid"),
        F.col("o_orderdate").alias("taskenteredon"),
        F.when(F.col("o_orderstatus") != "P", _plus("DAY", k % 30, "o_orderdate")).alias("taskcompletedon"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").alias("passed"),
        F.col("o_orderpriority").alias("taskvendorcomment"),
    )


def task_types(t: Tables) -> DataFrame:
    p = t["part"]
    size = F.col("p_size")
    kind = (F.when(size % 8 == 0, F.concat(F.lit("we owe - "), _s(size)))
            .when(size % 4 == 0, F.concat(F.lit("We Owe - "), _s(size)))
            .otherwise(F.concat(F.lit("Type "), _s(size))))
    cat = (F.when(size % 6 == 0, "Recon").when(size % 6 == 1, "Mechanical").when(size % 6 == 2, "Cosmetic")
           .when(size % 6 == 3, "Sales").when(size % 6 == 4, "Quality").otherwise("Inspection"))
    return p.select((size + 10).alias("id"), kind.alias("type"), cat.alias("category")).distinct()


def task_labor(t: Tables) -> DataFrame:
    li = t["lineitem"]
    deleted = F.when(F.col("l_returnflag") == "N", True).when(F.col("l_linestatus") == "O", False)
    return li.select(
        F.col("l_orderkey").alias("taskid"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"),
        (F.col("l_quantity").cast("decimal(18,2)") * 100).cast("decimal(18,2)").alias("estimatedcost"),
        F.col("l_quantity").cast("decimal(18,2)").alias("hour"),
        (F.col("l_quantity") + 1).cast("decimal(18,2)").alias("estimatedhour"),
        deleted.alias("isdeleted"),
        (F.col("l_linenumber") % 2 == 0).alias("isdisclosed"),
        (F.col("l_linenumber") % 3 == 0).alias("isperformwork"),
        F.col("l_shipdate").alias("completedon"),
    )


def parts_requests(t: Tables) -> DataFrame:
    li = t["lineitem"]
    quote = F.when(F.col("l_discount") > 0.08, True).when(F.col("l_discount") >= 0.02, False)
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("taskid"),
        (F.col("l_partkey") % 10).alias("parttypeid"),
        F.col("l_suppkey").alias("orderedfromvendorid"),
        F.col("l_linenumber").alias("requeststatus"),
        _plus("DAY", -3, "l_shipdate").alias("enteredon"),
        F.col("l_shipdate").alias("receivedon"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("cancelledon"),
        F.concat(F.lit("part "), _s("l_partkey")).alias("description"),
        F.col("l_linestatus").alias("partsnotes"),
        F.when(F.col("l_linenumber") == 1, "NO_RO").when(F.col("l_linenumber") == 2, "")
        .otherwise(F.concat(F.lit("RO-"), _s("l_orderkey"))).alias("adventronumber"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("totalcost"),
        quote.alias("quoteind"),
        _plus("DAY", 1, "l_shipdate").alias("senttobookingon"),
        F.when(F.col("l_linenumber") != 5, _plus("DAY", 2, "l_shipdate")).alias("bookedon"),
        F.concat(F.lit("INV-"), _s("l_suppkey"), F.lit("-"), _s("l_linenumber")).alias("partvendorinvoicenumber"),
        F.when(F.col("l_linenumber") != 4, F.col("l_suppkey")).alias("invoicefileid"),
    )


def invoice_downloads(t: Tables) -> DataFrame:
    """Downloads of invoice files: one per part of the lines' suppliers (many per file)."""
    li = t["lineitem"]
    return li.select(F.col("l_suppkey").alias("invoicefileid"), F.col("l_shipdate").alias("datedownloaded"))


def part_credits(t: Tables) -> DataFrame:
    """Credit lines against parts requests: the discount given on a line."""
    li = t["lineitem"]
    amount = -(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("partrequestid"), amount.alias("amount"))


def part_types(t: Tables) -> DataFrame:
    p = t["part"]
    return p.select((F.col("p_size") % 10).alias("id"),
                    F.concat(F.lit("PT-"), _s(F.col("p_size") % 10)).alias("typename")).distinct()


def vendors(t: Tables) -> DataFrame:
    return t["supplier"].select(F.col("s_suppkey").alias("vendorid"), F.col("s_name").alias("name"))


def remote_recon(t: Tables) -> DataFrame:
    o = t["orders"]
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("VIN-"), _s("o_custkey")).alias("vin"),
        F.concat(F.lit("SITE-"), _s(k % 5)).alias("recon_site"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice").cast("decimal(18,2)")).alias("actual_recon_cost"),
        F.col("o_orderdate").alias("created_time"),
        F.when(k % 2 == 0, F.col("o_orderdate")).alias("rqc_pass_date"),
        _plus("DAY", 1, "o_orderdate").alias("zoned_date"),
    )


def cost_summary(t: Tables) -> DataFrame:
    o = t["orders"]
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return (o.groupBy(F.col("o_custkey").alias("inventoryid"))
            .agg(F.sum(F.when(F.col("o_orderstatus") == "O", price)).alias("totallaborcost"),
                 F.sum(F.when(F.col("o_orderstatus") == "P", price)).alias("totalpartscost"),
                 F.sum(F.when(F.col("o_orderstatus") != "F", price).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("totalcosts")))


def sf_delivery_orders(t: Tables) -> DataFrame:
    o = t["orders"]
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("PRD-"), _s("o_custkey")).alias("vehicle_c"),
        F.concat(F.lit("OPP-"), _s(k)).alias("opportunity_c"),
        F.concat(F.lit("CAR-"), _s(k % 7)).alias("carrier_c"),
        F.col("o_totalprice").alias("delivery_cost_c"),
        F.col("o_orderpriority").alias("vehicle_info_c"),
        F.when(F.col("o_orderstatus") == "O", "Outbound").otherwise("Inbound").alias("type_c"),
        F.when(k % 3 == 0, "Active").when(k % 3 == 1, "Legacy").otherwise("Draft").alias("shipment_record_type"),
        ((F.col("o_orderstatus") == "P") & (k % 2 == 0)).alias("is_deleted"),
        F.col("o_orderdate").alias("created_date"),
        _plus("DAY", 1, "o_orderdate").alias("actual_pickup_date_c"),
        _plus("DAY", 4, "o_orderdate").alias("actual_delivery_date_c"),
    )


def products(t: Tables) -> DataFrame:
    c = t["customer"]
    return c.select(F.concat(F.lit("PRD-"), _s("c_custkey")).alias("id"), _s("c_custkey").alias("inventory_id_c"))


def deals(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("sale_number"),
                    F.concat(F.lit("STK-"), _s("o_custkey")).alias("stock_number"),
                    (F.col("o_orderkey") % 5).cast("int").alias("type"),
                    F.col("o_orderdate").alias("sale_date"),
                    _plus("DAY", 7, "o_orderdate").alias("ready_for_funding_date"))


def deal_adds(t: Tables) -> DataFrame:
    li = t["lineitem"]
    return li.select(F.col("l_orderkey").alias("sale_number"),
                     F.when(F.col("l_linenumber") <= 2, "SHIPPING").otherwise("OTHER").alias("code"),
                     F.concat(F.lit("add "), _s("l_linenumber")).alias("description"))


def deal_opportunities(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.concat(F.lit("OPP-"), _s("o_orderkey")).alias("id"), F.col("o_orderkey").alias("advent_sale_number_c"))


# ------------------------------------------------------- QA checks
def _partner(p_brand: str, p_size: str) -> Column:
    return F.concat(F.lit("P-"), F.col(p_brand), F.lit("-"), _s(F.col(p_size) % 3))


def partner_sources(t: Tables) -> DataFrame:
    """Three partners to a brand; a ninth of the parts name no source."""
    p = t["part"]
    return p.select(_partner("p_brand", "p_size").alias("partner_id"),
                    F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).alias("source_grouped"))


def partners(t: Tables) -> DataFrame:
    p = t["part"]
    return p.select(_partner("p_brand", "p_size").alias("partner_id"),
                    F.concat(F.lit("Partner "), F.col("p_brand"), F.lit(" "), _s(F.col("p_size") % 3)).alias("name")).distinct()


def evcm(t: Tables) -> DataFrame:
    p = t["part"]
    key, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return p.select(_plus("DAY", size, F.lit("1998-01-01").cast("timestamp_ntz")).alias("csv_upload_date"),
                    F.concat(F.lit("M"), _s(size % 7)).alias("rooftop_market_code"),
                    F.col("p_brand").alias("source_grouped"),
                    F.col("p_type").alias("sub_source"),
                    F.concat(F.lit("S"), _s(key % 50)).alias("state"),
                    F.lpad(_s(key % 100000), 5, "0").alias("clean_zipcodes"),
                    F.concat(F.lit("DMA "), _s(key % 210)).alias("dma"),
                    size.alias("vin_count"),
                    (size % 5).alias("count_of_positive_evcm"),
                    (size * 4).alias("all_combination_count"),
                    (price / 2).alias("base_avg_evcm"),
                    (price / 4).alias("current_avg_evcm"),
                    price.alias("theoretical_max_evcm"),
                    (key % 3).alias("unplaced_negative_evcm_count"),
                    (key % 4).alias("unplaced_neutral_evcm_count"),
                    (key % 5).alias("unplaced_positive_evcm_count"),
                    (price / 8).alias("unplaced_avg_evcm"),
                    F.when(size % 2 == 0, "sold").otherwise("open").alias("sale_status_flag"))


def repair_orders(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.col("o_orderkey").alias("repair_order_number"),
                    F.concat(F.lit("VIN-"), _s("o_custkey")).alias("vin"),
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_orderdate").alias("open_date"),
                    F.when(F.col("o_orderstatus") == "F", _plus("DAY", 2, "o_orderdate")).alias("closed_date"),
                    F.when(F.col("o_orderstatus") == "F", _plus("DAY", 3, "o_orderdate")).alias("accounting_date"),
                    (F.col("o_custkey") % 100000).alias("mileage_in"),
                    (F.col("o_custkey") % 100000 + F.col("o_orderkey") % 50).alias("mileage_out"),
                    F.col("o_orderpriority").alias("advisor"))


def repair_order_lines(t: Tables) -> DataFrame:
    li = t["lineitem"]
    return li.select(F.col("l_orderkey").alias("repair_order_number"),
                     F.col("l_linenumber").alias("job_number"),
                     F.concat(F.lit("concern "), _s("l_partkey")).alias("concern"),
                     F.concat(F.lit("cause "), _s("l_suppkey")).alias("cause"),
                     F.concat(F.lit("correction "), _s("l_linenumber")).alias("correction"),
                     F.col("l_linestatus").alias("status"),
                     F.when(F.col("l_linestatus") == "O", "retail").otherwise("internal").alias("sale_type"),
                     F.concat("l_returnflag", "l_linestatus").alias("sub_sale_type"),
                     F.col("l_returnflag").alias("department"))


def closed_repair_orders(t: Tables, null_line: int | None = None) -> DataFrame:
    """Closed RO numbers: orders with a returned line. ``null_line`` turns
    the key of that line number into null (the NOT IN null trap)."""
    li = t["lineitem"].filter(F.col("l_returnflag") == "R")
    key = F.col("l_orderkey")
    if null_line is not None:
        key = F.when(F.col("l_linenumber") != null_line, key)
    return li.select(key.alias("adventronumber"))


def stock_received(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(F.concat(F.lit("VIN-"), _s("o_custkey")).alias("vin"),
                    F.concat(F.lit("STK-"), _s("o_custkey")).alias("stock_number"),
                    _plus("DAY", 3, "o_orderdate").alias("received_date"))


def vendor_tasks(t: Tables) -> DataFrame:
    li = t["lineitem"]
    ro = (F.when(F.col("l_linenumber") == 7, F.lit("NO_RO"))
          .when(F.col("l_linenumber") == 6, F.lit(""))
          .otherwise(_s("l_orderkey")))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("taskid"),
        (F.col("l_partkey") % 50 + 11).cast("int").alias("tasktype"),
        F.when(F.col("l_linestatus") == "O", 10).otherwise(3).alias("taskstatus"),
        F.col("l_shipdate").alias("taskenteredon"),
        _plus("DAY", 2, "l_shipdate").alias("taskcompletedon"),
        F.col("l_partkey").alias("inventoryid"),
        F.col("l_suppkey").alias("taskvendorid"),
        F.col("l_returnflag").alias("taskvendorcomment"),
        F.col("l_extendedprice").alias("estimatedcost"),
        F.when(F.col("l_returnflag") == "A", "Yes").otherwise("No").alias("passed"),
        ro.alias("adventronumber"),
        (F.col("l_suppkey") % 100).alias("taskowner"),
        F.concat(F.lit("task "), _s("l_partkey")).alias("taskdescription"),
        _plus("DAY", 1, "l_shipdate").alias("taskstartedon"),
        (F.col("l_linenumber") % 3).alias("priority"),
        _plus("DAY", 3, "l_shipdate").alias("taskreadyforpickupon"),
        F.col("l_linestatus").alias("taskvendorstatus"),
        F.when(F.col("l_returnflag") == "A", _plus("DAY", 1, "l_shipdate")).alias("taskvendorapprovedon"),
        _plus("DAY", 4, "l_shipdate").alias("taskestimatedreadytime"),
        (F.col("l_partkey") % 1000).alias("resourceid"),
        F.col("l_linenumber").alias("estimatedhours"),
        (F.col("l_orderkey") % 500).alias("inttaskerid"),
        F.col("l_suppkey").alias("exttaskerid"),
        (F.col("l_orderkey") % 100).alias("enteredby"),
        (F.col("l_linenumber") % 5).alias("reasoncodeid"),
        _plus("DAY", 5, "l_shipdate").alias("bookdate"),
        _plus("DAY", 4, "l_shipdate").alias("senttobookingon"),
    )


def closed_orders(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.filter(F.col("o_orderstatus") == "F").select(_s("o_orderkey").alias("adventronumber"))


# -------------------------------------------------------- admin
def connection_log(t: Tables) -> DataFrame:
    e = t["events"]
    ev = (F.when(F.col("event_type") == "signup", "initiating session")
          .when(F.col("event_type") == "error", "disconnecting session")
          .otherwise("authenticated"))
    return e.select(F.col("ts").alias("recordtime"),
                    F.concat(F.lit("user_"), _s("user_id")).alias("username"),
                    F.lit("dev").alias("dbname"),
                    F.concat(F.lit("10.0.0."), _s(F.col("user_id") % 250)).alias("remotehost"),
                    (F.col("event_id") % 60000 + 1024).alias("remoteport"),
                    ev.alias("event"),
                    (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("pid"))


def query_log(t: Tables) -> DataFrame:
    e = t["events"]
    return e.select(F.col("user_id").alias("userid"),
                    F.col("event_id").alias("query"),
                    (F.col("user_id") % 10).alias("pid"),
                    F.col("props").alias("substring"),
                    F.col("ts").alias("starttime"),
                    _plus("SECOND", F.floor(F.col("value")).cast("int"), "ts").alias("endtime"),
                    F.floor(F.col("value") * 1000).cast("long").alias("elapsed"),
                    F.when(F.col("event_type") == "error", 1).otherwise(0).alias("aborted"))


def activity(t: Tables) -> DataFrame:
    e = t["events"]
    return e.select(F.concat(F.lit("user_"), _s("user_id")).alias("user_name"),
                    F.lit("dev").alias("db_name"),
                    F.col("user_id").alias("pid"),
                    F.col("props").alias("query"),
                    F.when(F.col("event_type") == "view", "Running").otherwise("Done").alias("status"))


def catalog_users(t: Tables) -> DataFrame:
    """Users for the membership report: one per supplier."""
    s = t["supplier"]
    return s.select(F.col("s_suppkey").alias("usesysid"), F.col("s_name").alias("usename"))


def catalog_groups(t: Tables) -> DataFrame:
    """Groups with member arrays: one group per order. Its members are the
    order's customer and a neighbouring key, with the customer repeated --
    arrays built per row (three elements), never gathered from a group."""
    o = t["orders"]
    c = F.col("o_custkey")
    return o.select(F.concat(F.lit("grp_"), _s("o_orderkey")).alias("groname"),
                    F.array(c, c + F.col("o_orderkey") % 3, c).alias("grolist"))


def member_users(t: Tables) -> DataFrame:
    """Users for the membership report: one per customer."""
    c = t["customer"]
    return c.select(F.col("c_custkey").alias("usesysid"), F.col("c_name").alias("usename"))


def acl_objects(t: Tables) -> DataFrame:
    """pg_class stand-in: one object per supplier, owned by its nation, with an access list for the nation and the supplier."""
    s, n = t["supplier"], t["nation"]
    letters = F.substring(F.lit("rwadRxtXUCT"), F.lit(1), (F.col("s_suppkey") % 11 + 1).cast("int"))
    acl = F.array(F.concat(F.col("n_name"), F.lit("="), letters, F.lit("/"), F.lower("n_name")),
                  F.concat(F.lit("group "), F.col("s_name"), F.lit("=r/"), F.lower("n_name")))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("oid"), F.lower("s_name").alias("relname"), F.lit("r").alias("relkind"),
        F.col("s_nationkey").alias("relowner"), F.col("s_nationkey").alias("relnamespace"),
        F.when(F.col("s_suppkey") % 6 != 5, acl).alias("relacl"))


def acl_users(t: Tables) -> DataFrame:
    return t["nation"].select(F.col("n_nationkey").alias("usesysid"), F.lower("n_name").alias("usename"))


def acl_namespaces(t: Tables) -> DataFrame:
    return t["nation"].select(F.col("n_nationkey").alias("oid"), F.concat(F.lit("ns_"), F.lower("n_name")).alias("nspname"))


def acl_groups(t: Tables) -> DataFrame:
    """Groups: one per nation and one per supplier."""
    of_nations = t["nation"].select(F.col("n_name").alias("groname"), F.array(F.col("n_nationkey").cast("long")).alias("grolist"))
    return of_nations.unionByName(t["supplier"].select(F.col("s_name").alias("groname"), F.array(F.col("s_suppkey")).alias("grolist")))


def column_acls(t: Tables) -> DataFrame:
    """Column-level access lists: one column per line on its supplier's object."""
    li = t["lineitem"]
    acl = F.when(F.col("l_tax") >= 0.05, F.array(F.concat(F.lit("u"), _s("l_partkey"), F.lit("=r/owner"))))
    return li.select(F.col("l_suppkey").alias("attrelid"), F.concat_ws("_", F.lit("c"), _s("l_orderkey"), _s("l_linenumber")).alias("attname"), acl.alias("attacl"))


def customers(t: Tables) -> DataFrame:
    c = t["customer"]
    return c.select(F.col("c_custkey").alias("customerid"),
                    F.col("c_name").alias("customername"),
                    F.concat(_s(F.col("c_nationkey") + 10), F.lit("-"), _s("c_custkey")).alias("phone"),
                    F.col("c_nationkey").alias("nationid"),
                    F.col("c_mktsegment").alias("marketsegment"),
                    F.col("c_acctbal").alias("accountbalance"))


def nations(t: Tables) -> DataFrame:
    return t["nation"].select(F.col("n_nationkey").alias("nationid"), F.col("n_name").alias("nationname"))
