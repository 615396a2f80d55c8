"""Source rules pinned on hand-made rows (survey Q-items)."""

import datetime as dt

from pyspark.sql import functions as F

from opsframe.plans.crm import compliance_status
from opsframe.plans.recon import _cost


def test_cost_rule_q5(spark):
    # exp, labor, parts, remote -> expected cost
    cases = [
        (None, None, None, None, None),     # everything missing: zero -> null
        (0.0, None, None, 0.0, None),       # all zero -> null
        (None, 10.0, 5.0, 7.0, 22.0),       # no expense total: remote counts
        (100.0, 10.0, 5.0, 7.0, 115.0),     # expense total present: remote ignored
        (None, None, None, 7.0, 7.0),       # only the remote site
        (0.0, None, None, 7.0, 0.0),        # total present (zero) -> remote ignored, sum 0 not null
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "e double, l double, p double, r double")
    got = [r.c for r in df.select(_cost(F.col("e"), F.col("l"), F.col("p"), F.col("r")).alias("c")).collect()]
    assert got == [c[4] for c in cases]


def test_compliance_status_p10(spark):
    t = dt.datetime(2000, 1, 1)
    cases = [
        (t, t, t, "complete"),        # all three after the bound
        (t, None, None, "complete"),  # physical only
        (t, None, t, "complete"),     # physical + inbound
        (t, t, None, "incomplete"),   # outbound without inbound
        (None, None, None, "incomplete"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "ph timestamp_ntz, ob timestamp_ntz, ib timestamp_ntz")
    got = [r.s for r in df.select(compliance_status(F.col("ph"), F.col("ob"), F.col("ib"),
                                                    "1996-01-01 00:00:00").alias("s")).collect()]
    assert got == [c[3] for c in cases]


def test_recon_model_keeps_one_row_when_inputs_repeat(spark, monkeypatch):
    """Repeated inventory, stock, cost, remote and concession rows: the kept row and
    its number equal those of the full product."""
    import itertools
    import math

    from opsframe.plans import recon
    from opsframe.plans.recon import S

    inv = [1, 2, 2, 3, 4, 5, 6]
    snl = [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (5, None), (6, "f"), (6, "f")]
    exp = {1: 10.0, 4: 0.0}
    vlc = [(1, 5.0, None, 9.0), (1, 5.0, 0.0, 8.0), (1, 1.0, 2.0, 3.0), (2, 4.0, -4.0, 1.0), (2, 3.0, 3.0, 2.0), (2, 3.0, 3.0, 2.0), (3, None, None, 7.0), (6, 2.0, 1.0, 1.0)]
    rr = [(2, 0.0), (2, 6.0), (2, 9.0), (3, 4.0), (3, 4.0), (6, -3.0), (6, 5.0)]
    cc = [(1, 3.0), (1, 1.0), (6, None)]
    dates = [(1, None, None, None), (6, None, None, None)]
    frame = spark.createDataFrame
    monkeypatch.setattr(S, "inventory", lambda t: frame([(i,) for i in inv], "inventoryid long"))
    monkeypatch.setattr(S, "stock_number_lookup", lambda t: frame(snl, "inventoryid long, stock_number string"))
    monkeypatch.setattr(recon, "inventory_clean_expense", lambda t: frame(list(exp.items()), "inventoryid long, total_actual_pre_advent_recon_cost double"))
    monkeypatch.setattr(recon, "recon_dates", lambda t, s: frame(
        dates, "inventoryid long, first_recon_tasked_date timestamp_ntz, first_recon_date timestamp_ntz, last_recon_date timestamp_ntz"))
    monkeypatch.setattr(recon, "vl_reported_costs", lambda t, **kw: frame(vlc, "inventoryid long, totallaborcost double, totalpartscost double, totalcosts double"))
    of = {i: [c for k, c in rr if k == i] for i, _ in rr}
    monkeypatch.setattr(recon, "remote_costs", lambda t, since: frame(
        [(i, [(c,) for c in sorted(set(cs))[:2]], len(cs)) for i, cs in of.items()], "rr_inv long, rr array<struct<remote:double>>, rr_n long"))
    monkeypatch.setattr(recon, "concessions_costs", lambda t, *a: frame(cc, "inventoryid long, actual_customer_concession_cost double"))

    nulls = lambda x: math.inf if x is None else x
    product = []
    for i, (si, stock) in itertools.product(inv, snl):
        if si != i or stock is None:
            continue
        for v, r, c in itertools.product([x[1:] for x in vlc if x[0] == i] or [(None,) * 3], [x[1] for x in rr if x[0] == i] or [None], [x[1] for x in cc if x[0] == i] or [None]):
            e = exp.get(i)
            if not (e or v[0] is not None or v[1] is not None or r is not None):
                continue
            base, remote = (e or 0) + (v[0] or 0) + (v[1] or 0), r or 0
            cost = None if base + remote == 0 else base + remote if e is None else base
            product.append((i, nulls(cost), e or 0, v[0] or 0, v[1] or 0, remote, c or 0, nulls(v[0]), nulls(v[1]), nulls(v[2])))
    product.sort()
    want = {}
    for n, row in enumerate(product, 1):
        want.setdefault(row[0], (f"advent_recon_{n}", *row))
    got = {r.inventoryid: (r.maintid, r.inventoryid, nulls(r.cost), r.dms_cost, r.vl_labor_cost, r.parts_manager_cost, r.remote_recon_cost,
                           r.actual_customer_concession_cost, nulls(r.vlc_total_labor_cost), nulls(r.vlc_total_parts_cost), nulls(r.vlc_total_costs))
           for r in recon.r11_recon_cost(None).collect()}
    assert got == want and recon.r14_unique_inventory(None).count() == 0


def test_remote_costs_equal_those_of_the_pairs(spark, monkeypatch):
    """Counts and two smallest costs per inventory are those of all (remote, inventory) pairs; half of all rows have one VIN, and
    no pair is made."""
    import datetime as dt
    import random

    from opsframe.plans import recon
    from opsframe.plans.recon import S

    rng = random.Random(4)
    day = lambda: dt.datetime(1996, 1, 1) + dt.timedelta(days=rng.randint(0, 60))
    vin = lambda: rng.choice(["hot", *[f"v{k}" for k in range(40)]] + ["hot"] * 40)
    inv = [(vin() if k % 17 else None, k % 300, day() if k % 13 else None) for k in range(400)]
    remote = [(vin() if k % 19 else None, day() if k % 23 else None, float(rng.randint(0, 30)) if k % 7 else None, day(), None, "s") for k in range(500)]
    monkeypatch.setattr(S, "inventory", lambda t: spark.createDataFrame(inv, "vin string, inventoryid long, tdapurchaseddate timestamp_ntz"))
    monkeypatch.setattr(S, "remote_recon", lambda t: spark.createDataFrame(
        remote, "vin string, created_time timestamp_ntz, actual_recon_cost double, rqc_pass_date timestamp_ntz, zoned_date timestamp_ntz, recon_site string"))
    pairs = {}
    for r in recon.remote_recon_site_total_recon(None, how="inner").collect():
        pairs.setdefault(r.inventoryid, []).append(r.actual_recon_cost)
    found = recon.remote_costs(None)
    got = {r.rr_inv: (r.rr_n, [x.remote for x in r.rr]) for r in found.collect()}
    assert got == {i: (len(cs), sorted(set(cs))[:2]) for i, cs in pairs.items()} and sum(map(len, pairs.values())) > 10_000
    plan = found._jdf.queryExecution().toString()
    assert "created_time" not in plan.split("Physical Plan")[-1]  # what is joined there comes from the pinned order


def test_r4_groups_no_joined_rows_and_keeps_one_row_a_driver(spark):
    """Repeated lines and suppliers name a driver once; the rows of drivers joined to assignments are not made distinct again."""
    import datetime as dt

    from opsframe.plans.field_service import r4_appointment_detail
    from opsframe.sources.tables import Tables
    day = dt.datetime(1996, 1, 2)
    t = Tables(spark, "/nowhere", aliases={
        "nation": spark.createDataFrame([(0, "NATION_0")], "n_nationkey int, n_name string"),
        "customer": spark.createDataFrame([(1, "C1", 0)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": spark.createDataFrame([(3, "S3"), (3, "S3"), (3, "S3b"), (10, "S10"), (None, "S")], "s_suppkey long, s_name string"),
        "orders": spark.createDataFrame([(k, 1, "F", 9.0, day, "1-URGENT") for k in (2, 4, 6)],
                                        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": spark.createDataFrame([(2, 3, "N", day), (2, 3, "R", day), (2, 10, "N", day), (4, None, "N", day), (None, 3, "N", day)],
                                          "l_orderkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp_ntz")})
    got = r4_appointment_detail(t)
    found = sorted(((r["service_appointment"], r["driver_name"]) for r in got.collect()), key=str)
    assert found == sorted([("SA-2", "S3"), ("SA-2", "S3b"), ("SA-2", None), ("SA-4", None), ("SA-6", None)], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Aggregate [ar_name" not in plan and "Aggregate [name#" not in plan
