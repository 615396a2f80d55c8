"""Reconditioning-cost and shipping-expense models: R11-R14.

Inventory ids are 64-bit here: the source casts them with ``::int``, but
at the target scale keys pass 2**31 and a 32-bit cast would fail the job
(ANSI) or lose the id.

R11 follows the source's CTE chain (clean expenses -> per-inventory
expense, labor cost per task group, recon dates per inventory, parts,
remote sites, reported costs, concessions) with every stage a lazy
DataFrame; its final step is computed from per-inventory aggregates
instead of the source's per-inventory product (``recon_model``).

Where the source numbers rows with ``row_number() over ()`` (W4) the order
is unspecified; here it is the report's natural key with full tie-breaks,
numbered without a single-task sort (``surrogate_number``; for R11, a
``prefix_sum`` of the rows each inventory stands for).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions import concat_strict, false_or_null, nvl, present_nonzero, to_int
from opsframe.operators.joins import join_earlier, left_join_where, star_left
from opsframe.operators.prefix import summary_of_earlier
from opsframe.operators.windows import prefix_sum, row_numbers, surrogate_number
from opsframe.session import pin
from opsframe.sources import standins as S
from opsframe.sources.tables import Tables

# Task categories counted as reconditioning, the task ids the
# source also admits (Q4), excluded statuses, and the recon task type.
RECON_CATEGORIES = ("Recon", "Quality", "Mechanical", "Cosmetic", "State Inspection", "Info-Only", "Inspection")
RECON_TASK_IDS = (56, 57)
BOOKED_STATUSES = (1, 4, 7)
RECON_TASK_TYPE = 57
CANCELLED_REQUEST_STATUSES = (3, 4, 5)


def _day(date: str) -> Column:
    """Start of a day. ``date(ts) >= d`` equals ``ts >= d``, and the plain form reaches the scan."""
    return F.lit(date).cast("date").cast("timestamp_ntz")


def clean_expense(t: Tables) -> DataFrame:
    """System-prefixed id; a listing expense with no completion
    date takes its drop-off date."""
    e = S.expenses(t)
    wc = (F.when((F.col("mainttype") == "Ebay Listingal") & F.col("workcompletedon").isNull(), F.col("droppedoffon"))
          .otherwise(F.col("workcompletedon")))
    return e.select(concat_strict("dms", F.col("maintid")).alias("maintid"), "inventoryid", "vendorid", "typeid",
                    "cost", "droppedoffon", "comment", "po", "mainttype", "mainttypecategoryid",
                    "maint_category_name", "accttypecategoryid", "acct_category_name", "description",
                    wc.alias("workcompletedon"))


def inventory_clean_expense(t: Tables) -> DataFrame:
    return (clean_expense(t).filter(F.col("maint_category_name") == "Recon")
            .groupBy("inventoryid").agg(F.sum("cost").alias("total_actual_pre_advent_recon_cost")))


def _recon_filter(tt_category: Column, taskid: Column, task_ids: tuple[int, ...] = RECON_TASK_IDS) -> Column:
    return tt_category.isin(*RECON_CATEGORIES) | taskid.isin(*task_ids)


def recon_labor(t: Tables, task_ids: tuple[int, ...] = RECON_TASK_IDS) -> DataFrame:
    """Open reconditioning tasks with their type and their labor rows that are not deleted."""
    tasks, tt = S.recon_tasks(t).alias("tasks"), S.task_types(t).alias("tt")
    tld = S.task_labor(t).filter(~F.col("isdeleted") & false_or_null(F.col("isdeleted"))).alias("tld")
    j = (tasks.join(tt, F.col("tasks.tasktype") == F.col("tt.id"), "left")
         .join(tld, F.col("tasks.taskid") == F.col("tld.taskid")))
    return j.filter(_recon_filter(F.col("tt.category"), F.col("tasks.taskid"), task_ids)
                    & ~F.col("tasks.taskstatus").isin(*BOOKED_STATUSES))


def recon_cost_data(t: Tables) -> DataFrame:
    """Labor sums per task group (A5, A11, J7). ``not tld.isdeleted`` drops
    null flags, which also makes the labor join inner. The source's window
    dates here are never read (Q13) and are left out."""
    j = recon_labor(t)
    keys = [F.col("tasks.inventoryid").alias("inventoryid"), F.col("tasks.taskid").alias("taskid"),
            F.col("tasks.tasktype").alias("tasktype"), F.col("tt.type").alias("type"),
            F.col("tt.category").alias("category"), F.col("tasks.taskvendorid").alias("taskvendorid"),
            F.col("tasks.taskenteredon").alias("taskenteredon"), F.col("tasks.taskvendorcomment").alias("taskvendorcomment"),
            F.col("tasks.passed").alias("passed"), F.col("tasks.taskcompletedon").alias("taskcompletedon")]
    return j.groupBy(*keys).agg(
        F.sum("tld.estimatedcost").alias("task_total_estimated_recon_cost"),
        F.sum("tld.cost").alias("task_total_actual_recon_cost"),
        F.sum("tld.estimatedhour").alias("task_total_estimated_recon_hours"),
        F.sum("tld.hour").alias("task_total_actual_recon_hours"))


def recon_aggregate_data(t: Tables, tasked_since="1996-01-01", task_ids: tuple[int, ...] = RECON_TASK_IDS) -> DataFrame:
    """Per inventory: first tasked date and first/last recon completion
    (W5-W9). The source computes whole-partition first/last_value windows
    ordered by the value and then DISTINCTs them to one row per inventory;
    that is exactly min/max per inventory, computed here as one partial
    aggregate (a hot inventory never lands whole in one task)."""
    tasks, tt = S.recon_tasks(t).alias("tasks"), S.task_types(t).alias("tt")
    j = tasks.join(tt, F.col("tasks.tasktype") == F.col("tt.id"), "left")
    j = j.filter(_recon_filter(F.col("tt.category"), F.col("tasks.taskid"), task_ids)
                 & (F.col("tasks.taskenteredon") >= _day(tasked_since)))
    recon_done = F.when(F.col("tasks.tasktype") == RECON_TASK_TYPE, F.col("tasks.taskcompletedon"))
    return j.groupBy(F.col("tasks.inventoryid").alias("inventoryid")).agg(
        F.min("tasks.taskenteredon").alias("first_recon_tasked_date"),
        F.min(recon_done).alias("first_recon_date"),
        F.max(recon_done).alias("last_recon_date"))


def recon_dates(t: Tables, settings: ReconSettings) -> DataFrame:
    """What R11 reads of the vendor-lane costs: the dates of inventories that have any labor group.
    The sums are not read there (``inventory_vl_costs`` has them)."""
    with_labor = recon_labor(t, settings.task_ids).select(F.col("tasks.inventoryid").alias("inventoryid")).distinct()
    dates = recon_aggregate_data(t, settings.tasked_since, settings.task_ids)
    return dates.join(with_labor, "inventoryid", "left_semi")


def inventory_vl_costs(t: Tables, **kw) -> DataFrame:
    """Sum of task-group sums per inventory with its recon dates."""
    rcd, rad = recon_cost_data(t), recon_aggregate_data(t, **kw)
    j = rcd.join(rad, "inventoryid", "left")
    return j.groupBy("inventoryid", "first_recon_tasked_date", "first_recon_date", "last_recon_date").agg(
        F.sum("task_total_estimated_recon_cost").alias("total_estimated_recon_cost"),
        F.sum("task_total_actual_recon_cost").alias("total_vl_actual_recon_cost"),
        F.sum("task_total_estimated_recon_hours").alias("total_estimated_recon_hours"),
        F.sum("task_total_actual_recon_hours").alias("total_actual_recon_hours"))


def ro_parts(t: Tables, received_since="1996-01-01", invalid_task=4157350) -> DataFrame:
    """Parts requests with type, vendor and a text key."""
    a = S.parts_requests(t).alias("a")
    b = S.part_types(t).alias("b")
    ven = S.vendors(t).alias("ven")
    tk = S.recon_tasks(t).filter(~F.col("taskstatus").isin(*BOOKED_STATUSES)).alias("t")   # J7
    a = a.filter((F.col("receivedon") >= _day(received_since)) & F.col("cancelledon").isNull()
                 & (F.col("taskid") != invalid_task) & (F.col("adventronumber") != "NO_RO")
                 & ~F.col("requeststatus").isin(*CANCELLED_REQUEST_STATUSES) & false_or_null(F.col("quoteind")))
    j = (a.join(b, F.col("a.parttypeid") == F.col("b.id"), "left")
         .join(ven, F.col("ven.vendorid") == F.col("a.orderedfromvendorid"), "left")
         .join(tk, F.col("t.taskid") == F.col("a.taskid")))
    key = concat_strict(F.col("a.enteredon"), F.col("a.taskid"), F.col("a.description"),
                        F.col("a.orderedfromvendorid"), F.col("a.partsnotes"), F.col("a.id"))
    return j.select("a.*", F.col("b.typename"), F.col("ven.name").alias("ordered_from_vendor"), key.alias("primary_key"))


def inventory_ro_parts(t: Tables, **kw) -> DataFrame:
    rop = ro_parts(t, **kw)
    tasks = S.recon_tasks(t).select("taskid", "inventoryid")
    j = rop.join(tasks, "taskid", "left")
    return j.groupBy("inventoryid").agg(F.sum("totalcost").cast("double").alias("total_ro_parts_cost"))


def remote_recon_site_total_recon(t: Tables, passed_since="1996-01-01", how: str = "left") -> DataFrame:
    """Remote recon costs matched to every inventory record of the same VIN
    purchased before the remote record was created (J5: all earlier, not
    the nearest; fan-out kept)."""
    rr = S.remote_recon(t).filter(
        F.col("actual_recon_cost").isNotNull()
        & (F.coalesce("rqc_pass_date", "zoned_date") >= _day(passed_since)))
    inv = S.inventory(t).select(F.col("vin").alias("inv_vin"), "inventoryid", "tdapurchaseddate")
    j = join_earlier(rr, inv, [("vin", "inv_vin")], right_time="tdapurchaseddate", left_time="created_time",
                     strict=True, how=how)
    return j.select("inventoryid", "recon_site", "actual_recon_cost")


def remote_costs(t: Tables, passed_since="1996-01-01") -> DataFrame:
    """(rr_inv, rr, rr_n): per inventory the number of its remote rows (``remote_recon_site_total_recon``) and the two smallest
    different costs among them, without the rows: every inventory record asks what its VIN's later remote records add up to."""
    remote = S.remote_recon(t).filter(F.col("actual_recon_cost").isNotNull() & (F.coalesce("rqc_pass_date", "zoned_date") >= _day(passed_since)))
    remote = remote.select("vin", "created_time", F.col("actual_recon_cost").cast("double").alias("cost"))
    inv = S.inventory(t).select(F.col("vin").alias("inv_vin"), "inventoryid", "tdapurchaseddate")
    found = summary_of_earlier(inv, remote, [("inv_vin", "vin")], "tdapurchaseddate", "created_time", "cost", strict=True, later=True)
    found = found.filter("n > 0")
    counts = found.groupBy("inventoryid").agg(F.sum("n").alias("rr_n"))
    # of an inventory with several records, the two smallest of their two smallest
    apart = found.select("inventoryid", F.explode("least").alias("remote")).distinct()
    first = Window.partitionBy("inventoryid").orderBy("remote")
    two = (apart.withColumn("_rn", F.row_number().over(first)).filter("_rn <= 2").groupBy(F.col("inventoryid").alias("rr_inv"))
           .agg(F.array_sort(F.collect_list(F.struct("remote"))).alias("rr")))
    return two.join(counts, F.col("rr_inv") == F.col("inventoryid")).drop("inventoryid")


def vl_reported_costs(t: Tables, purchased_since="1996-01-01") -> DataFrame:
    vlc = S.cost_summary(t).alias("vlc")
    inv = S.inventory(t).filter(F.col("tdapurchaseddate") >= _day(purchased_since)).alias("inv")  # J7
    j = vlc.join(inv, F.col("inv.inventoryid") == F.col("vlc.inventoryid"))
    return j.filter(F.col("vlc.totalcosts") != 0).select("vlc.*")


def concessions_costs(t: Tables, excluded_vendor=44, type_pattern="We Owe -%", task_ids: tuple[int, ...] = RECON_TASK_IDS) -> DataFrame:
    """Customer concessions per task group (several rows per inventory, Q11)."""
    tasks, tt = S.recon_tasks(t).alias("tasks"), S.task_types(t).alias("tt")
    tld = S.task_labor(t).alias("tld")
    j = (tasks.join(tt, F.col("tasks.tasktype") == F.col("tt.id"), "left")
         .join(tld, F.col("tasks.taskid") == F.col("tld.taskid")))
    j = j.filter(~F.col("tld.isdeleted")
                 & (~F.col("tld.isdisclosed") | (F.col("tld.isdisclosed") & F.col("tld.isperformwork")))
                 & _recon_filter(F.col("tt.category"), F.col("tasks.taskid"), task_ids)
                 & (F.col("tasks.taskvendorid") != excluded_vendor)
                 & F.col("tt.type").ilike(type_pattern))
    keys = [F.col("tasks.inventoryid").alias("inventoryid"), F.col("tasks.taskid").alias("taskid"),
            F.col("tasks.tasktype").alias("tasktype"), F.col("tt.type").alias("type"),
            F.col("tt.category").alias("category"), F.col("tasks.taskcompletedon").alias("taskcompletedon"),
            F.col("tld.completedon").alias("completedon")]
    g = j.groupBy(*keys).agg(F.sum("tld.cost").cast("double").alias("actual_customer_concession_cost"))
    return g.select("inventoryid", "actual_customer_concession_cost")


def _cost(exp_total: Column, labor: Column, parts: Column, remote: Column) -> Column:
    """Total recon cost. Null when every part is missing or zero;
    the remote-site cost counts only when there is no expense total."""
    dms = nvl(exp_total.cast("double"), 0)
    base = dms + nvl(labor, 0) + nvl(parts, 0)
    return (F.when(base + nvl(remote, 0) == 0, F.lit(None).cast("double"))
            .when(exp_total.isNull(), nvl(remote, 0) + dms + nvl(labor, 0) + nvl(parts, 0))
            .otherwise(base))


# column order of the R11 model: the source numbers its rows with
# ``row_number() over ()`` (order left open) and keeps, per inventory, the
# row with the latest recon date; both are fixed here to this order
R11_ORDER = ("inventoryid", "cost", "dms_cost", "vl_labor_cost", "parts_manager_cost", "remote_recon_cost",
             "actual_customer_concession_cost", "droppedoffon", "workcompletedon", "first_recon_date",
             "vlc_total_labor_cost", "vlc_total_parts_cost", "vlc_total_costs")


@dataclass(frozen=True)
class ReconSettings:
    """R11's cut-off dates and fixed choices, one per place where the source writes them."""

    tasked_since: str = "1996-01-01"
    passed_since: str = "1996-01-01"
    purchased_since: str = "1996-01-01"
    excluded_vendor: int = 44
    type_pattern: str = "We Owe -%"
    task_ids: tuple[int, ...] = RECON_TASK_IDS


def _two_smallest(df: DataFrame, key: str, order: Column, field: str, name: str) -> DataFrame:
    """(key, name, name_n): the two smallest ``order`` structs of a key with different first fields (``field``),
    and the number of rows. A key with any number of rows sends two to a task."""
    rows = df.select(key, order.alias("_o"))
    apart = rows.groupBy(key, F.col("_o")[field].alias("_v")).agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_n"))
    n = apart.groupBy(key).agg(F.sum("_n").alias(f"{name}_n"))
    first = Window.partitionBy(key).orderBy("_o")
    two = (apart.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= 2)
           .groupBy(key).agg(F.array_sort(F.collect_list("_o")).alias(name)))
    return two.join(n.withColumnRenamed(key, "_k2"), F.col(key) == F.col("_k2")).drop("_k2")


def recon_model(t: Tables, settings: ReconSettings = ReconSettings()) -> DataFrame:
    """R11's final star join, one row per inventory, without its fan-out.

    Inventory rows, stock numbers, reported costs, remote-site rows and
    concessions may all repeat for an inventory, and the source multiplies them
    before it numbers the rows and keeps one. Here each is reduced on its own:

    * the kept row is the first by (cost, labor, parts, remote cost, concession, ...). Cost is base
      (expenses + labor + parts) plus, without an expense total, the remote cost, and null where base and
      remote cost add up to zero. So it is made of one of the two smallest bases and one of the two
      smallest remote costs (the second for when the smallest pair adds up to zero), and the
      smallest concession;
    * its number is one plus the product rows of all earlier inventories,
      a prefix sum over the products of the counts.

    No pairs beyond two times two are made, however often a row repeats. The source's join to
    per-inventory parts costs is never read and cannot change row counts, so it is left out.
    """
    inv = S.inventory(t).groupBy("inventoryid").agg(F.count(F.lit(1)).alias("inv_n"))
    snl = (S.stock_number_lookup(t).filter(F.col("stock_number").isNotNull())
           .groupBy(F.col("inventoryid").alias("snl_inv")).agg(F.count(F.lit(1)).alias("snl_n")))
    exp = inventory_clean_expense(t).withColumnRenamed("inventoryid", "exp_inv")
    dates = recon_dates(t, settings).withColumnRenamed("inventoryid", "ivl_inv")
    rr = remote_costs(t, settings.passed_since)
    cc = (concessions_costs(t, settings.excluded_vendor, settings.type_pattern, settings.task_ids)
          .groupBy(F.col("inventoryid").alias("cc_inv"))
          .agg(F.min(nvl(F.col("actual_customer_concession_cost"), 0).cast("double")).alias("conc"), F.count(F.lit(1)).alias("cc_n")))
    exp_total = F.col("total_actual_pre_advent_recon_cost")
    vlc = vl_reported_costs(t, purchased_since=settings.purchased_since).withColumnRenamed("inventoryid", "vlc_inv")
    # a reported row without labor and parts counts only beside an expense total or a remote row
    usable = F.col("totallaborcost").isNotNull() | F.col("totalpartscost").isNotNull()
    number = lambda c: F.col(c).cast("double")
    last = lambda c: F.struct(number(c).isNull().alias("none"), number(c).alias("value"))  # noqa: E731 nulls last
    order = F.struct((nvl(number("totallaborcost"), 0) + nvl(number("totalpartscost"), 0)).alias("base"),
                     nvl(number("totallaborcost"), 0).alias("labor"), nvl(number("totalpartscost"), 0).alias("parts"),
                     last("totallaborcost").alias("l"), last("totalpartscost").alias("p"), last("totalcosts").alias("c"))
    some = _two_smallest(vlc.filter(usable), "vlc_inv", order, "base", "some")
    blank = _two_smallest(vlc.filter(~usable), "vlc_inv", order, "base", "blank").withColumnRenamed("vlc_inv", "blank_inv")

    j = star_left(inv.join(snl, F.col("inventoryid") == F.col("snl_inv")),                 # J7: stock number not null
                  [(exp, [("inventoryid", "exp_inv")]), (dates, [("inventoryid", "ivl_inv")]), (rr, [("inventoryid", "rr_inv")]),
                   (cc, [("inventoryid", "cc_inv")]), (some, [("inventoryid", "vlc_inv")]), (blank, [("inventoryid", "blank_inv")])])
    also = present_nonzero(exp_total) | F.col("rr_n").isNotNull()
    n_some, n_blank = (F.coalesce(F.col(c), F.lit(0)) for c in ("some_n", "blank_n"))
    n_vlc = F.when(also, F.greatest(n_some + n_blank, F.lit(1))).otherwise(n_some)
    j = j.withColumn("vlc_n", n_vlc).filter("vlc_n > 0")
    no_costs = F.struct(F.lit(0.0).alias("base"), F.lit(0.0).alias("labor"), F.lit(0.0).alias("parts"),
                        *[F.struct(F.lit(True).alias("none"), F.lit(None).cast("double").alias("value")).alias(c) for c in "lpc"])
    none = F.array().cast(j.schema["some"].dataType)
    reported = F.concat(F.coalesce("some", none), F.when(also, F.coalesce("blank", none)).otherwise(none))
    reported = F.when(F.size(reported) > 0, reported).otherwise(F.array(no_costs))
    remote = F.coalesce("rr", F.array(F.struct(F.lit(None).cast("double").alias("remote"))))

    def row(v: Column, r: Column) -> Column:
        cost = _cost(exp_total, v["labor"], v["parts"], r["remote"])
        return F.struct(cost.isNull().alias("cnull"), cost.alias("cost"), v["labor"].alias("labor"), v["parts"].alias("parts"),
                        nvl(r["remote"], 0).alias("remote"), v["l"].alias("l"), v["p"].alias("p"), v["c"].alias("c"))

    best = F.array_min(F.flatten(F.transform(reported, lambda v: F.transform(remote, lambda r: row(v, r)))))
    j = j.withColumn("best", best)
    product = F.lit(1)
    for c in ("inv_n", "snl_n", "vlc_n", "rr_n", "cc_n"):
        product = product * F.coalesce(F.col(c), F.lit(1))
    return j.select(
        F.col("inventoryid").cast("long").alias("inventoryid"),
        F.col("best.cost").alias("cost"),
        nvl(exp_total.cast("double"), 0).alias("dms_cost"),
        F.col("best.labor").alias("vl_labor_cost"),
        F.col("best.parts").alias("parts_manager_cost"),
        F.col("best.remote").alias("remote_recon_cost"),
        F.coalesce(F.col("conc"), F.lit(0.0)).alias("actual_customer_concession_cost"),
        F.col("first_recon_tasked_date").alias("droppedoffon"),
        F.lit("Recon").alias("mainttype"),
        F.lit(2).alias("mainttypecategoryid"),
        F.lit("Recon").alias("maint_category_name"),
        F.col("last_recon_date").alias("workcompletedon"),
        F.col("first_recon_date").alias("first_recon_date"),
        F.col("best.l.value").alias("vlc_total_labor_cost"),
        F.col("best.p.value").alias("vlc_total_parts_cost"),
        F.col("best.c.value").alias("vlc_total_costs"),
        product.alias("_pairs"),
    )


def r11_recon_cost(t: Tables, settings: ReconSettings = ReconSettings()) -> DataFrame:
    """One recon-cost row per inventory, with the source's surrogate id
    (W4) and row order (W1) -- see ``recon_model``."""
    # the range partitioner reads its input twice: the model is written first
    numbered = prefix_sum(pin(recon_model(t, settings), "recon_model"), [F.col("inventoryid").asc_nulls_last()], "_pairs", name="_before")
    # the model has one row an inventory: the first of the rows it stands for
    return numbered.withColumn("row_order", F.lit(1).cast("long")).select(
        concat_strict("advent_recon_", F.col("_before") + 1).alias("maintid"),
        "inventoryid", "cost", "dms_cost", "vl_labor_cost", "parts_manager_cost", "remote_recon_cost",
        "actual_customer_concession_cost", "droppedoffon", "mainttype", "mainttypecategoryid",
        "maint_category_name", "workcompletedon", "first_recon_date", "vlc_total_labor_cost",
        "vlc_total_parts_cost", "vlc_total_costs", "row_order")


def r14_unique_inventory(t: Tables) -> DataFrame:
    """R14 (W1, A13): inventories with more than one R11 row -- expected empty."""
    from opsframe.operators.aggs import duplicates
    return duplicates(recon_model(t), ["inventoryid"], count_col="inventoryid", count_alias="n")


def r12_inbound_shipping(t: Tables, inventory_id: str | None = None) -> DataFrame:
    """R12 (J2, J7, W2, W3, W4, P4): inbound shipping expenses. The source's
    masked test filter on one inventory id is ``inventory_id`` (off by default)."""
    d = S.sf_delivery_orders(t).filter(~F.col("is_deleted") & (F.col("type_c") == "Inbound")).alias("d")
    p = S.products(t).alias("p")
    if inventory_id is not None:
        p = p.filter(F.col("inventory_id_c") == inventory_id)
    inv = S.inventory(t).select("inventoryid").alias("inv")
    snl = S.stock_number_lookup(t).filter(F.col("stock_number").isNotNull()).alias("snl")
    j = (d.join(p, F.col("p.id") == F.col("d.vehicle_c"))
         .join(inv, F.col("inv.inventoryid") == to_int(F.col("p.inventory_id_c"), "long"))
         .join(snl, F.col("snl.inventoryid") == F.col("inv.inventoryid")))
    rows = j.select(
        to_int(F.col("p.inventory_id_c"), "long").alias("inventoryid"),
        F.col("d.id").alias("_did"),
        F.col("d.created_date").alias("_created"),
        F.col("d.carrier_c").alias("vendorid"),
        F.lit(350).alias("typeid"),
        F.col("d.delivery_cost_c").cast("double").alias("cost"),
        F.col("d.actual_pickup_date_c").alias("droppedoffon"),
        F.col("d.vehicle_info_c").alias("comment"),
        F.lit("Inbound Shipping").alias("mainttype"),
        F.lit(1).alias("mainttypecategoryid"),
        F.lit("SG&A").alias("maint_category_name"),
        F.lit("Shipping").alias("acct_category_name"),
        F.col("d.actual_delivery_date_c").alias("workcompletedon"))
    rows = surrogate_number(rows, [F.col("_did").asc()], name="_n")
    rows = row_numbers(rows, ["inventoryid"], [F.col("_created").desc_nulls_first(), F.col("_did").asc()], name="row_order")
    return rows.select(concat_strict("advent_shipping_inbound_", F.col("_n")).alias("maintid"),
                       "inventoryid", "vendorid", "typeid", "cost", "droppedoffon", "comment", "mainttype",
                       "mainttypecategoryid", "maint_category_name", "acct_category_name", "workcompletedon",
                       "row_order")


def r13_outbound_shipping(t: Tables, inventory_id: int | None = None, shipping_code="SHIPPING",
                          excluded_deal_type=4, record_types=("Active", "Legacy")) -> DataFrame:
    """R13 (J3, J6, J7, W2, W4, P4): outbound shipping expenses. The deal and
    delivery-order conditions sit in the ON clauses (J6), so they filter
    those sides before their left joins."""
    adds = S.deal_adds(t).filter(F.col("code") == shipping_code).alias("adds")
    ad = S.deals(t)
    inv = S.inventory(t).select("inventoryid", "adventstockid")
    if inventory_id is not None:
        inv = inv.filter(F.col("inventoryid") == inventory_id)
    snl = S.stock_number_lookup(t).filter(F.col("stock_number").isNotNull()).select(F.col("inventoryid").alias("snl_inv"))
    o = S.deal_opportunities(t)
    od = S.sf_delivery_orders(t).select(F.col("opportunity_c"), F.col("delivery_cost_c"), F.col("shipment_record_type"))
    ad = ad.select(F.col("sale_number").alias("ad_sale_number"), "stock_number", "type", "sale_date",
                   "ready_for_funding_date")
    # both look-ups are keyed (one deal per sale, one delivery order per opportunity)
    j = left_join_where(adds, ad, [("sale_number", "ad_sale_number")], F.col("type") != excluded_deal_type,
                        right_unique=True)
    j = j.join(inv, F.col("adventstockid") == F.col("stock_number"))     # J7 via snl
    j = j.join(snl, F.col("snl_inv") == F.col("inventoryid"))
    j = j.join(o, F.col("advent_sale_number_c") == F.col("ad_sale_number"), "left")
    j = left_join_where(j, od, [("id", "opportunity_c")], F.col("shipment_record_type").isin(*record_types),
                        right_unique=True)
    rows = j.select(
        F.col("inventoryid").cast("long").alias("inventoryid"),
        F.lit(352).alias("typeid"),
        F.col("delivery_cost_c").cast("double").alias("cost"),
        F.col("sale_date").alias("droppedoffon"),
        F.lit("Outbound Shipping").alias("mainttype"),
        F.lit(1).alias("mainttypecategoryid"),
        F.lit("SG&A").alias("maint_category_name"),
        F.lit("Shipping").alias("acct_category_name"),
        F.col("description").alias("description"),
        F.col("ready_for_funding_date").alias("workcompletedon"),
        F.col("sale_number").alias("_sale"))
    tie = [F.col("_sale").asc(), F.col("description").asc_nulls_last(), F.col("cost").asc_nulls_last()]
    rows = surrogate_number(rows, [F.col("inventoryid").asc_nulls_last(), *tie], name="_n")
    rows = row_numbers(rows, ["inventoryid"], [F.col("droppedoffon").desc_nulls_first(), *tie, F.col("_n").asc()],
                       name="row_order")
    return rows.select(concat_strict("advent_shipping_outbound_", F.col("_n")).alias("maintid"),
                       "inventoryid", "typeid", "cost", "droppedoffon", "mainttype", "mainttypecategoryid",
                       "maint_category_name", "acct_category_name", "description", "workcompletedon", "row_order")


# Fixed value: the vendor name used for parts not ordered through a vendor.
DEFAULT_PARTS_VENDOR = "ADVANCE AUTO PARTS INC"


def x6_parts_accrual(t: Tables, task_status=3, own_vendor_type=1) -> DataFrame:
    """X6 (parts accrual; cancelled in the source, built as written): parts
    requests of completed tasks with no repair order yet, their credits
    (pre-aggregated per request, then a left join), grouped on a CASE and a
    cast; final cost is ``sum(coalesce(cost + credit, cost))``."""
    r = S.parts_requests(t).filter(
        ~F.col("requeststatus").isin(*CANCELLED_REQUEST_STATUSES) & (F.col("quoteind") == F.lit(False))
        & ((F.col("adventronumber") == "") | F.col("adventronumber").isNull()) & (F.col("totalcost") > 0)).alias("r")
    tk = S.recon_tasks(t).filter(F.col("taskstatus") == task_status).alias("t")
    rs = S.inventory(t).select(F.col("inventoryid").alias("rs_inv"), "vin")
    inv = S.inventory(t).select(F.col("inventoryid").alias("inv_inv"), "adventstockid")
    first = (S.invoice_downloads(t).groupBy(F.col("invoicefileid").alias("f_id"))
             .agg(F.min("datedownloaded").alias("first_download_date")))
    credits = S.part_credits(t).groupBy("partrequestid").agg(F.sum("amount").alias("total_credit"))
    v = S.vendors(t).select(F.col("vendorid").alias("v_id"), F.col("name").alias("v_name"))
    tv = S.vendors(t).select(F.col("vendorid").alias("tv_id"), F.col("name").alias("tv_name"))
    j = (r.join(tk, F.col("r.taskid") == F.col("t.taskid"))
         .join(rs, F.col("t.inventoryid") == F.col("rs_inv"))
         .join(inv, F.col("inv_inv") == F.col("t.inventoryid"))
         .join(credits, F.col("partrequestid") == F.col("r.id"), "left")
         .join(v, F.col("r.orderedfromvendorid") == F.col("v_id"), "left")
         .join(tv, F.col("t.taskvendorid") == F.col("tv_id"), "left")
         .join(first, F.col("r.invoicefileid") == F.col("f_id"), "left"))
    vendor = F.when(F.col("r.parttypeid") == own_vendor_type, F.col("v_name")).otherwise(F.lit(DEFAULT_PARTS_VENDOR))
    keys = [F.col("r.id").cast("string").alias("document_number"), F.col("r.taskid").alias("taskid"),
            F.col("tv_name").alias("task_vendor"), vendor.alias("vendor_name"),
            F.col("t.taskcompletedon").alias("task_first_completed_on"), F.col("vin"), F.col("adventstockid"),
            F.col("r.cancelledon").alias("cancelled_on"), F.col("t.taskstatus").alias("task_status"),
            F.col("r.receivedon").alias("received_on"), F.col("r.senttobookingon").alias("approved_date"), F.col("r.bookedon").alias("booked_date"),
            F.col("r.partvendorinvoicenumber").alias("part_vendor_invoice_number"), F.col("first_download_date")]
    cost = F.col("r.totalcost")
    return j.groupBy(*keys).agg(
        F.sum(cost).cast("double").alias("total_cost"),
        F.sum(F.coalesce(cost + F.col("total_credit"), cost)).cast("double").alias("final_cost"))


def clean_expenses(t: Tables) -> DataFrame:
    """Every clean expense with its prefixed id and completion date."""
    return clean_expense(t).select("maintid", "inventoryid", "mainttype", "droppedoffon", "workcompletedon", F.col("cost").cast("double").alias("cost"))


def keyed_parts_requests(t: Tables) -> DataFrame:
    """Parts requests of open tasks with type, vendor and text key."""
    return ro_parts(t).select("id", "taskid", "typename", "ordered_from_vendor", "primary_key")


def vendor_lane_costs(t: Tables) -> DataFrame:
    """Sums of task-group sums per inventory, with its recon dates."""
    costs = inventory_vl_costs(t)
    sums = [c for c in costs.columns if c.startswith("total_")]
    return costs.select(*[F.col(c).cast("double").alias(c) if c in sums else F.col(c) for c in costs.columns])
