"""Field-service reports: R3 driver day, R4 appointment detail, X1 quick turnaround."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import at_most_flag, boundary_diff, left_chars, when_only
from opsframe.operators.aggs import counts_by_period
from opsframe.operators.joins import left_outer, within_after
from opsframe.operators.windows import latest_per_key
from opsframe.sources import standins as S
from opsframe.sources.tables import Tables

# Transit types of outbound and inbound appointments.
OUTBOUND = "delivery_to_customer"
INBOUND = ("buyback", "pickup_from_customer")


def _appointment_resources(t: Tables) -> DataFrame:
    """sa -> assigned resources -> named resources. The source writes left
    joins; its WHERE (end time and name not null) makes them inner (J7)."""
    sa, ar, sr = S.service_appointments(t), S.assigned_resources(t), S.service_resources(t)
    ar = ar.withColumnRenamed("created_date", "ar_created")
    return (sa.join(ar, ar.service_appointment_id == sa.id)
            .join(sr, sr.id == ar.service_resource_id)
            .filter(sr.name.isNotNull()))


def driver_day(t: Tables) -> DataFrame:
    """Per driver and end date: first start, first end, and the minute
    boundaries between them (A8, A10, A17, T4). Partial aggregation: a
    busy driver is reduced map-side."""
    j = _appointment_resources(t).filter(F.col("actual_end_time").isNotNull())
    g = (j.groupBy(F.col("name"), F.to_date("actual_end_time").alias("end_date"))
         .agg(F.min("actual_start_time").alias("first_sa_start"),
              F.min("actual_end_time").alias("first_sa_end")))
    return g.withColumn("duration", boundary_diff("MINUTE", "first_sa_start", "first_sa_end"))


def last_resource(t: Tables) -> DataFrame:
    """Latest assigned named resource per appointment (W1, J18). Null
    assignment times sort first under DESC, as in the source dialect; the
    name breaks ties so the pick is deterministic."""
    j = _appointment_resources(t).select("appointment_number", "name", "ar_created")
    return latest_per_key(j, ["appointment_number"],
                          [F.col("ar_created").desc_nulls_first(), F.col("name").asc()]).select("appointment_number", "name")


def _customer_columns(transit, name, sa_created, sa_end, sa_start):
    out_name = when_only(transit == OUTBOUND, name)
    in_name = when_only(transit.isin(*INBOUND), name)
    return [
        out_name.alias("outbound_service_appointment_customer_name"),
        when_only(out_name.isNotNull(), sa_created).alias("outbound_service_appointment_creation_date"),
        when_only(out_name.isNotNull(), sa_end).alias("outbound_service_appointment_completion_date"),
        in_name.alias("inbound_service_appointment_customer_name"),
        when_only(in_name.isNotNull(), sa_start).alias("inbound_service_appointment_pickup_date"),
    ]


def r3_driver_day(t: Tables, limit_minutes: int = 120) -> DataFrame:
    """One row per completed last-mile appointment x assigned resource,
    with the latest driver, customer columns by direction, and the flag
    for a first-end-to-first-start gap of at most ``limit_minutes`` (Q1:
    inclusive, negative gaps pass)."""
    sa = S.service_appointments(t).alias("sa")
    wo = S.work_orders(t).filter(F.col("status") == "Completed").alias("wo")       # J7: WHERE makes it inner
    acc = S.accounts(t).alias("acc")
    de = S.delivery_orders(t).filter(F.col("is_last_mile_c")).alias("del")         # J7
    ar = S.assigned_resources(t).alias("ar")
    sr = S.service_resources(t).alias("sr")
    dd = driver_day(t).alias("dd")
    lr = last_resource(t).alias("lr")                                               # row = 1 already

    j = (sa.join(wo, F.col("wo.id") == F.col("sa.parent_record_id"))
         .join(acc, F.col("acc.id") == F.col("sa.account_id"), "left")
         .join(de, F.col("del.id") == F.col("wo.delivery_order_c"))
         # An appointment with no assignment has no latest driver and is
         # dropped by the lr join below, so this left join is an inner one
         # (and AQE may split a hot appointment on either side)
         .join(ar, F.col("ar.service_appointment_id") == F.col("sa.id"))
         .join(sr, F.col("sr.id") == F.col("ar.service_resource_id"), "left")
         .join(dd, (F.col("dd.name") == F.col("sr.name")) & (F.col("dd.first_sa_start") == F.col("sa.actual_start_time")), "left")
         .join(lr, F.col("lr.appointment_number") == F.col("sa.appointment_number")))  # J7: lr.name not null
    return j.select(
        F.upper(F.col("del.managing_hub_facility_code_c")).alias("delivery_order_managing_hub"),
        F.col("sa.appointment_number").alias("service_appointment"),
        F.col("lr.name").alias("assigned_resource"),
        F.col("sa.truck_number_c").alias("service_resource_truck_id"),
        *_customer_columns(F.col("del.transit_type_c"), F.col("acc.name"), F.col("sa.created_date"),
                           F.col("sa.actual_end_time"), F.col("sa.actual_start_time")),
        left_chars(F.col("sa.postal_code"), 3).alias("sub_zip_code"),
        F.col("del.vehicle_grade_c").alias("vehicle_grade"),
        at_most_flag(F.col("dd.duration"), limit_minutes).alias("less_than_two_hours"),
    )


def r4_appointment_detail(t: Tables, appointment_number: str | None = None) -> DataFrame:
    """R4 (J16, J3, J7, P7, P12, F3, F7): appointments with their distinct
    assigned drivers, inbound/outbound customer columns; last-mile and a
    known transit type. ``appointment_number`` narrows to one appointment
    (the source's masked constant); by default every appointment."""
    sa = S.service_appointments(t)
    if appointment_number is not None:
        sa = sa.filter(F.col("appointment_number") == appointment_number)
    ser, aar = S.service_resources(t), S.assigned_resources(t)
    # distinct (driver, appointment, resource). The source left-joins the
    # drivers to their assignments; a driver without one has a null
    # appointment and can never meet an appointment below, so the join is
    # inner here (J7). Each side is made distinct by itself: their join then is,
    # and no task groups the joined rows, names and all, once more.
    ser = ser.select("id", "name").distinct()
    d = aar.select("service_appointment_id", "service_resource_id").distinct()
    appt_res = (ser.join(d, ser.id == d.service_resource_id)
                .select(F.col("name").alias("ar_name"), F.col("service_appointment_id").alias("ar_appt"),
                        F.col("service_resource_id").alias("ar_res")))
    # several drivers per appointment: a hot appointment must not sit in one task
    sa = left_outer(sa, appt_res, [("id", "ar_appt")]).alias("sa")
    wo = S.work_orders(t).alias("wo")
    acc = S.accounts(t).alias("acc")
    de = (S.delivery_orders(t)
          .filter(F.col("transit_type_c").isin(OUTBOUND, *INBOUND) & F.col("is_last_mile_c"))
          .alias("del"))
    j = (sa.join(wo, F.col("wo.id") == F.col("sa.parent_record_id"))
         .join(acc, F.col("acc.id") == F.col("sa.account_id"), "left")
         .join(de, F.col("del.id") == F.col("wo.delivery_order_c")))
    return j.select(
        F.col("del.managing_hub_facility_code_c").alias("delivery_order_managing_hub"),
        F.col("sa.appointment_number").alias("service_appointment"),
        F.col("sa.ar_name").alias("driver_name"),
        F.col("sa.truck_number_c").alias("service_resource_truck_id"),
        F.col("sa.actual_end_time").alias("actual_end_time"),
        F.col("sa.actual_start_time").alias("actual_start_time"),
        *_customer_columns(F.col("del.transit_type_c"), F.col("acc.name"), F.col("sa.created_date"),
                           F.col("sa.actual_end_time"), F.col("sa.actual_start_time")),
        F.col("del.vehicle_grade_c").alias("vehicle_grade"),
        F.col("del.transit_type_c").alias("transit_type_c"),
    )


def x1_quick_turnaround(t: Tables, within_minutes: int = 120, first="purchase", then="signup") -> DataFrame:
    """X1 on events: a ``then`` event within ``within_minutes`` after a
    ``first`` event of the same user on the same day (bucketed range join)."""
    e = t["events"].select("event_id", "user_id", "ts", "event_type", F.to_date("ts").alias("day"))
    a = e.filter(F.col("event_type") == first).select(
        F.col("user_id").alias("a_user"), F.col("day").alias("a_day"), F.col("event_id").alias("first_event_id"),
        F.col("ts").alias("first_ts"))
    b = e.filter(F.col("event_type") == then).select(
        F.col("user_id").alias("b_user"), F.col("day").alias("b_day"), F.col("event_id").alias("then_event_id"),
        F.col("ts").alias("then_ts"))
    j = within_after(a, b, [("a_user", "b_user"), ("a_day", "b_day")], "first_ts", "then_ts", within_minutes)
    return j.select(F.col("a_user").alias("user_id"), F.col("a_day").alias("day"), "first_event_id", "then_event_id",
                    "first_ts", "then_ts")


def _directed_appointments(t: Tables, people: bool = True) -> DataFrame:
    """Appointments with their truck, hub, direction and zip, and, with ``people``, the
    latest driver and the customer (look-ups of one row each, so they change no row count)."""
    sa = S.service_appointments(t)
    de = S.delivery_orders(t)
    wo = S.work_orders(t).select(F.col("id").alias("wo_id"), "delivery_order_c")
    j = (sa.join(wo, F.col("wo_id") == sa.parent_record_id)
         .join(de, de.id == F.col("delivery_order_c")))
    named = []
    if people:
        lr = last_resource(t).withColumnRenamed("appointment_number", "lr_appt")
        acc = S.accounts(t).select(F.col("id").alias("acc_id"), F.col("name").alias("customer_name"))
        j = (j.join(lr, F.col("lr_appt") == sa.appointment_number, "left")
             .join(acc, F.col("acc_id") == sa.account_id, "left"))
        named = [F.col("name").alias("driver"), F.col("customer_name")]
    direction = (F.when(de.transit_type_c == OUTBOUND, "outbound")
                 .when(de.transit_type_c.isin(*INBOUND), "inbound"))
    return j.select(sa.appointment_number, sa.truck_number_c.alias("truck"),
                    F.upper(de.managing_hub_facility_code_c).alias("hub"), direction.alias("direction"),
                    de.vehicle_grade_c.alias("vehicle_grade"), left_chars(sa.postal_code, 3).alias("sub_zip"),
                    sa.actual_start_time, sa.actual_end_time, *named)


def x1_outbound_then_inbound(t: Tables, within_minutes: int = 120) -> DataFrame:
    """X1 as written down: an inbound appointment whose actual start is at
    most ``within_minutes`` after the actual end of an outbound one, same
    driver, same truck, same day."""
    d = _directed_appointments(t).filter(F.col("driver").isNotNull())
    out = d.filter((F.col("direction") == "outbound") & F.col("actual_end_time").isNotNull()).select(
        F.col("appointment_number").alias("outbound_appointment"), F.col("driver").alias("o_driver"),
        F.col("truck").alias("o_truck"), F.to_date("actual_end_time").alias("o_day"), F.col("hub"),
        F.col("actual_end_time").alias("outbound_end"))
    inb = d.filter((F.col("direction") == "inbound") & F.col("actual_start_time").isNotNull()).select(
        F.col("appointment_number").alias("inbound_appointment"), F.col("driver").alias("i_driver"),
        F.col("truck").alias("i_truck"), F.to_date("actual_start_time").alias("i_day"),
        F.col("actual_start_time").alias("inbound_start"))
    j = within_after(out, inb, [("o_driver", "i_driver"), ("o_truck", "i_truck"), ("o_day", "i_day")],
                     "outbound_end", "inbound_start", within_minutes)
    return j.select("outbound_appointment", "inbound_appointment", F.col("o_driver").alias("driver"),
                    F.col("o_truck").alias("truck"), F.col("o_day").alias("day"), "hub", "outbound_end", "inbound_start")


def x2_turnarounds_by_period(t: Tables) -> DataFrame:
    """Quick turnarounds (X1) per hub by day, week and month. The hub of
    a user is the nation of the customer with that key, as for delivery
    orders."""
    x = x1_quick_turnaround(t)
    c, n = t["customer"], t["nation"]
    hubs = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey"), F.upper("n_name").alias("hub"))
    x = x.join(hubs, x.user_id == hubs.c_custkey, "left")
    return counts_by_period(x, "day", ["hub"])


def x2_appointment_turnarounds_by_period(t: Tables) -> DataFrame:
    """X2 over the appointment form of X1, per managing hub."""
    return counts_by_period(x1_outbound_then_inbound(t), "day", ["hub"])


def x3_same_zip_share(t: Tables) -> DataFrame:
    """Share of completed outbound appointments for which an inbound
    appointment started in the same 3-digit zip on the same day (semi-join)."""
    d = _directed_appointments(t, people=False)
    out = d.filter((F.col("direction") == "outbound") & F.col("actual_end_time").isNotNull()).select(
        "sub_zip", F.to_date("actual_end_time").alias("day"))
    inb = (d.filter((F.col("direction") == "inbound") & F.col("actual_start_time").isNotNull())
           .select(F.col("sub_zip").alias("i_zip"), F.to_date("actual_start_time").alias("i_day")).distinct())
    flagged = out.join(inb, (F.col("sub_zip") == F.col("i_zip")) & (F.col("day") == F.col("i_day")), "left")
    agg = flagged.agg(F.count(F.lit(1)).alias("outbound_completed"),
                      F.count("i_zip").alias("with_inbound_nearby"))
    return agg.withColumn("share", F.try_divide(F.col("with_inbound_nearby").cast("double"),
                                                F.col("outbound_completed").cast("double")))


def x4_wholesale_inbound(t: Tables) -> DataFrame:
    """Wholesale-graded vehicles in inbound delivery orders, per hub."""
    de = S.delivery_orders(t).filter(F.col("transit_type_c").isin(*INBOUND) & (F.col("vehicle_grade_c") == "wholesale"))
    return de.groupBy(F.upper("managing_hub_facility_code_c").alias("hub")).agg(F.count(F.lit(1)).alias("wholesale_inbound"))


def x5_repeat_customers(t: Tables) -> DataFrame:
    """Customer names seen on more than one appointment or with more
    than one driver (distinct counts; partial aggregation on the pairs)."""
    d = _directed_appointments(t).filter(F.col("customer_name").isNotNull())
    g = d.groupBy("customer_name").agg(F.countDistinct("appointment_number").alias("appointments"),
                                      F.countDistinct("driver").alias("drivers"))
    return g.filter((F.col("appointments") > 1) | (F.col("drivers") > 1))
