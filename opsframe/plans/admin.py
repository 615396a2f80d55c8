"""Administrative reports over log, catalog and access-list tables: R23-R32.

The catalog tables are stand-ins derived from the data tables; the engine's
own catalog, users and grants are not modelled (README: not built).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import any_true, bands, concat_strict, decode_access
from opsframe.operators.aggs import money_sum
from opsframe.operators.joins import contains_join, member_join, not_in
from opsframe.operators.sets import union_distinct
from opsframe.sources import sinks
from opsframe.sources import standins as S
from opsframe.sources.tables import Tables

# System schemas left out of the grant listing.
SYSTEM_SCHEMAS = ("pg_catalog", "pg_toast", "information_schema")


def r23_open_sessions(t: Tables) -> DataFrame:
    """R23 (J9, O2): sessions initiated by a pid that never disconnected
    (Q8: by pid only)."""
    log = S.connection_log(t)
    opened = log.filter(F.col("event") == "initiating session")
    closed = log.filter(F.col("event") == "disconnecting session").select("pid")
    out = not_in(opened, "pid", closed, "pid")
    return (out.select("recordtime", "username", "dbname", "remotehost", "remoteport")
            .orderBy(F.col("recordtime").desc_nulls_first()))


def r25_user_groups(t: Tables) -> DataFrame:
    """R25 (J13, J10): users and the groups whose member array holds them."""
    users = S.member_users(t)
    # a name in the list of all names: any that is not null
    groups = S.catalog_groups(t).filter(F.col("groname").isNotNull())
    return member_join(users, "usesysid", groups, "grolist").select("usename", "groname")


def r26_column_acls(t: Tables, relnames=("supplier#000000001", "supplier#000000010", "supplier#000000003")) -> DataFrame:
    """R26 (J1, F3, F6, O3): columns with their own access list."""
    b = S.column_acls(t)
    c = S.acl_objects(t).select("oid", "relname")
    j = b.join(c, c.oid == b.attrelid).filter(F.col("relname").isin(*relnames) & F.col("attacl").isNotNull())
    return (j.select(F.array_join("attacl", "|").alias("attacl"), "attname", "relname")
            .orderBy("relname", "attname"))


def privilege_objects(t: Tables) -> DataFrame:
    """Tables (nations) UNION views (regions) with their full names."""
    n, r = t["nation"], t["region"]
    tabs = n.select(F.lit("nation").alias("schemaname"), F.lit("t").alias("obj_type"),
                    F.col("n_name").alias("objectname"),
                    concat_strict("nation", ".", F.col("n_name")).alias("fullobj"))
    views = r.select(F.lit("region").alias("schemaname"), F.lit("v").alias("obj_type"),
                     F.col("r_name").alias("objectname"),
                     concat_strict("region", ".", F.col("r_name")).alias("fullobj"))
    return union_distinct(tabs, views)


def privilege_grants(t: Tables) -> DataFrame:
    """Grants table: each supplier holds privileges on its nation (table)
    and its nation's region (view); flags by balance."""
    s, n, r = t["supplier"], t["nation"], t["region"]
    sn = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    bal = F.col("s_acctbal")
    flags = [F.lit(True).alias("sel"), (bal > 0).alias("ins"), (bal > 5000).alias("upd"),
             (bal > 8000).alias("del"), F.lit(False).alias("ref")]
    on_nation = sn.select(F.col("s_name").alias("usename"), concat_strict("nation", ".", F.col("n_name")).alias("fullobj"), *flags)
    on_region = sn.select(F.col("s_name").alias("usename"), concat_strict("region", ".", F.col("r_name")).alias("fullobj"), *flags)
    return on_nation.unionByName(on_region)


def r27_privilege_matrix(t: Tables, schemaname: str | None = None, usename: str | None = None) -> DataFrame:
    """R27 (U1, J12, F14, T9): user x object privileges with any flag true.

    The source crosses every user with every object and asks the engine
    for each flag. A pair with no grant has every flag false and is
    filtered out, so the same rows come from an equi-join of the grants
    table with objects and users -- no cartesian product."""
    objs = privilege_objects(t)
    users = S.catalog_users(t).select("usename")
    g = privilege_grants(t)
    j = g.join(objs, "fullobj").join(users, "usename")
    j = j.filter(any_true("sel", "ins", "upd", "del", "ref"))
    if schemaname is not None:
        j = j.filter(F.col("schemaname") == schemaname)
    if usename is not None:
        j = j.filter(F.col("usename") == usename)
    return j.select("schemaname", "objectname", "usename", "sel", "ins", "upd", "del", "ref")


def owned_objects(t: Tables) -> DataFrame:
    """Objects with owner, namespace and access list (J12 as the equi-join
    its WHERE makes it, J19: the user table in two roles)."""
    use = S.acl_users(t).select(F.col("usesysid").alias("u_id"), F.col("usename").alias("subject"))
    use2 = S.acl_users(t).select(F.col("usesysid").alias("u2_id"), F.col("usename").alias("owner"))
    nsp = S.acl_namespaces(t).select(F.col("oid").alias("ns_oid"), "nspname")
    c = S.acl_objects(t)
    j = (use.join(c, c.relowner == F.col("u_id"))
         .join(nsp, c.relnamespace == F.col("ns_oid"), "left")
         .join(use2, c.relowner == F.col("u2_id"), "left"))
    j = j.filter(~F.col("nspname").isin(*SYSTEM_SCHEMAS))
    return j.select("subject", F.col("nspname").alias("namespace"), F.col("relname").alias("item"),
                    F.col("relkind").alias("type"), "owner", "relacl")


def r28_group_grants(t: Tables, groname: str | None = None) -> DataFrame:
    """R28 (J12, J14, J19, T10-T15, T22): GRANT statements rebuilt from
    access lists for each group named in them (Q7: a name inside a longer
    name matches)."""
    objs = owned_objects(t).filter(F.col("relacl").isNotNull())
    objs = objs.withColumn("acl_text", F.array_join("relacl", "|"))
    groups = S.acl_groups(t).select("groname")
    if groname is not None:
        groups = groups.filter(F.col("groname") == groname)
    j = contains_join(objs, "acl_text", groups, "groname")
    stmt = concat_strict("grant ", decode_access(F.col("acl_text"), F.col("groname")),
                         " on ", F.col("namespace"), ".", F.col("item"), ' to "', F.col("groname"), '";')
    return j.select(F.col("acl_text").alias("relacl"), stmt.alias("grantsql"))


def customer_view(customers: DataFrame) -> DataFrame:
    """S8 body: customers with an income band."""
    return customers.select("customername", "phone", "marketsegment", "accountbalance",
                            bands("accountbalance").alias("incomegroup"))


def r29_customer_bands(t: Tables) -> DataFrame:
    """R29 (S8, P9)."""
    return sinks.create_view(customer_view(S.customers(t)), "customer_vw")


def r30_customer_nation_store(t: Tables) -> DataFrame:
    """R30 (J1, A5, S9): customer x nation balances, stored and read back."""
    c, n = S.customers(t), S.nations(t)
    agg = (c.join(n, "nationid")
           .groupBy("customername", "phone", "nationname", "marketsegment")
           .agg(money_sum("accountbalance").alias("accountbalance")))
    return sinks.materialize(agg, "customernation_mv")


def r31_update_then_bands(t: Tables, segment="BUILDING", balance=1000) -> DataFrame:
    """R31 (S10, P9): set the balance of one segment -- the table is rewritten
    to a new path, as parquet has no in-place UPDATE -- then band through
    the view (1000 -> high, Q6)."""
    c = sinks.rewrite_where(S.customers(t), {"accountbalance": balance}, F.col("marketsegment") == segment)
    return customer_view(sinks.materialize(c, "customer_updated"))
