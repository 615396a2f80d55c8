from pyspark.sql import functions as F

from opsframe.operators.joins import (
    contains_join, distinct_lookup, join_earlier, left_join_where, member_join, not_in, unmatched,
)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((v is None, v) for v in t))


def sql_not_in(spark, left, right):
    left.createOrReplaceTempView("l_")
    right.createOrReplaceTempView("r_")
    return spark.sql("select * from l_ where k not in (select k2 from r_)")


def test_not_in_matches_sql_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    cases = {
        "plain": [(2,), (5,)],
        "null_in_set": [(2,), (None,)],
        "empty": [],
        "only_null": [(None,)],
    }
    for name, vals in cases.items():
        right = spark.createDataFrame(vals, "k2 long")
        got = rows(not_in(left, "k", right, "k2"), "k")
        want = rows(sql_not_in(spark, left, right), "k")
        assert got == want, name


def test_unmatched_is_left_is_null(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    b = spark.createDataFrame([(2,), (2,), (4,)], "id long")
    assert rows(unmatched(a, b, ["id"]), "id") == [(1,), (3,)]


def test_join_earlier_keeps_fan_out(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 10), (1, 15), (1, 25), (2, 6)], "k2 long, t2 long")
    j = join_earlier(left, right, [("k", "k2")], right_time="t2", left_time="t")
    assert rows(j, "k", "t", "t2") == [(1, 10, 10), (1, 20, 10), (1, 20, 15), (2, 5, None)]
    js = join_earlier(left, right, [("k", "k2")], right_time="t2", left_time="t", strict=True)
    assert rows(js, "k", "t", "t2") == [(1, 10, None), (1, 20, 10), (1, 20, 15), (2, 5, None)]


def test_left_join_where_filters_right_before_join(spark):
    c = spark.createDataFrame([(1,), (2,)], "c long")
    o = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y")], "oc long, p string")
    j = left_join_where(c, o, [("c", "oc")], F.col("p") == "x")
    assert rows(j, "c", "p") == [(1, "x"), (2, None)]


def test_member_join_dedups_members(spark):
    users = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "id long, name string")
    groups = spark.createDataFrame([("g", [1, 1, 2]), ("h", [3]), ("e", [])], "g string, members array<long>")
    j = member_join(users, "id", groups, "members")
    assert rows(j, "name", "g") == [("u1", "g"), ("u2", "g"), ("u3", "h")]


def test_contains_join_equals_brute_force(spark):
    texts = ["NATION_1=rw/x|group A=r/x", "NATION_10=a/y", "ab_cd", "xyz", "EUROPE and ASIA", "a%b", "", "NATIONx1z"]
    names = ["NATION_1", "NATION_10", "b_c", "yz", "AS", "A", "%", "_", "NATION_2", "zzzz", "ION_1"]
    t = spark.createDataFrame([(s,) for s in texts], "text string")
    n = spark.createDataFrame([(s,) for s in names], "name string")
    got = rows(contains_join(t, "text", n, "name"), "text", "name")
    brute = rows(t.crossJoin(n).filter(F.expr("text like concat('%', name, '%')")), "text", "name")
    assert got == brute
    assert ("NATIONx1z", "NATION_1") in got  # '_' is a wildcard, as in the source


def test_distinct_lookup_fan_out(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "k2 long, v string")
    j = distinct_lookup(left, right, [("k", "k2")], ["v"])
    assert rows(j, "k", "v") == [(1, "a"), (1, "b"), (2, None)]


def test_within_after_equals_brute_force_on_hot_key(spark):
    import datetime as dt
    import random

    from opsframe.operators.joins import within_after
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    a = [(i, 0 if i % 3 == 0 else rnd.randint(1, 5), base + dt.timedelta(minutes=rnd.randint(0, 3000)))
         for i in range(300)]
    b = [(i, 0 if i % 2 == 0 else rnd.randint(1, 5), base + dt.timedelta(minutes=rnd.randint(0, 3000)))
         for i in range(300)]
    left = spark.createDataFrame(a, "a_id long, ka long, ta timestamp_ntz")
    right = spark.createDataFrame(b, "b_id long, kb long, tb timestamp_ntz")
    got = rows(within_after(left, right, [("ka", "kb")], "ta", "tb", 120, bucket_minutes=30), "a_id", "b_id")
    brute = rows(left.crossJoin(right).filter(
        (F.col("ka") == F.col("kb")) & (F.col("tb") >= F.col("ta"))
        & (F.col("tb") <= F.timestamp_add("MINUTE", F.lit(120), F.col("ta")))), "a_id", "b_id")
    assert got == brute and len(got) > 0


def test_left_outer_equals_left_join_with_hot_right_key(spark):
    import pytest

    from opsframe.operators.joins import left_outer
    left = spark.createDataFrame([(i % 7 if i % 5 else None, i if i % 11 else None) for i in range(60)], "k long, lt long")
    # key 0 holds a third of the right rows, some of them identical
    right = spark.createDataFrame([(0 if i % 3 == 0 else i % 9 if i % 13 else None, i if i % 2 else 7 if i % 17 else None) for i in range(300)], "rk long, rt long")
    plain = left.join(right, left.k == right.rk, "left")
    assert rows(left_outer(left, right, [("k", "rk")]), "k", "lt", "rk", "rt") == rows(plain, "k", "lt", "rk", "rt")
    for n in (300, 1):  # many right rows, and one
        some = right.filter("rk = 3 and rt = 7") if n == 1 else right
        extra = some.rt <= left.lt
        plain = left.join(some, (left.k == some.rk) & extra, "left")
        got = left_outer(left, some, [("k", "rk")], extra, first_right=F.min("rt"), matches_first=lambda j, first: first <= j["lt"])
        assert rows(got, "k", "lt", "rk", "rt") == rows(plain, "k", "lt", "rk", "rt")
    with pytest.raises(ValueError):
        left_outer(left, left, [("k", "k")])


def test_left_outer_shuffles_the_left_side_once(spark):
    from opsframe.operators.joins import left_outer
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # shows the reused exchange in the plan before it runs
    try:
        left, right = spark.range(1000).selectExpr("id as k", "id % 3 as v"), spark.range(5000).selectExpr("id % 700 as rk", "id as rt")
        plan = left_outer(left, right, [("k", "rk")])._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan and "LeftOuter" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_texts_send_only_keys_that_names_have_picked(spark):
    """Key rows of the texts are bounded by what the names can match, not by the texts' length."""
    from opsframe.operators.joins import _text_keys, contains_keys
    texts = spark.range(2000).select(F.col("id").alias("t"), F.concat(F.lit("some long text that all have, number "), F.format_string("%06d", "id")).alias("text"))
    names = spark.createDataFrame([(0, "number 0012"), (1, "_00077"), (2, "no such name"), (3, "1999")], "n long, name string")
    keys, choice = contains_keys(texts, "text", names, "name", "t", "n")
    assert choice.count() == 3  # no text holds what the third name needs
    every = texts.select(F.explode(_text_keys(F.col("text")))).count()
    assert keys.count() < every / 50
    plan = keys.groupBy("_g").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")  # the mask is applied below the shuffle
    found = contains_join(texts, "text", names, "name").groupBy("n").count()
    assert rows(found, "n", "count") == [(0, 100), (1, 11), (3, 1)]


def test_contains_join_steps_over_wildcards(spark):
    texts = ["NATION_1", "NATION_12", "NATIONX7", "ab", "a", "", None, "x_y%z", "aXb", "back\\slash", "NATION_1"]
    names = ["NATION_1", "NATION_7", "N_T", "_", "%", "", "a_b", "ab", "y%z", "b", "__", None, "ION%1", "q"]
    left = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    right = spark.createDataFrame([(n,) for n in names], "name string")
    left.createOrReplaceTempView("cj_l")
    right.createOrReplaceTempView("cj_r")
    want = spark.sql("select id, name from cj_l join cj_r on text like concat('%', name, '%')")
    assert rows(contains_join(left, "text", right, "name"), "id", "name") == rows(want, "id", "name")


def test_texts_and_names_meet_in_proportion_to_their_number(spark):
    """Numbered names meet the texts that hold their number, not all texts that share three of its digits."""
    from opsframe.operators.joins import contains_keys
    for n in (500, 2000):
        texts = spark.range(2 * n).select(F.col("id").alias("t"), F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("text"))
        names = spark.range(n // 10).select(F.col("id").alias("n"), F.concat(F.lit("#"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("_")).alias("name"))
        keys, choice = contains_keys(texts, "text", names, "name", "t", "n")
        assert n <= keys.join(choice, "_g").count() <= 2 * n


def test_contains_join_deals_copies_out(spark, monkeypatch):
    """Copies of texts and names meet once; the rows of a text with many matches come from several tasks."""
    from opsframe.operators import joins
    monkeypatch.setattr(joins, "MADE", 500)
    texts = spark.range(400).select("id", F.when(F.col("id") % 4 < 3, F.concat(F.lit("group A_"), F.col("id") % 2)).alias("text"))
    names = spark.range(60).select(F.col("id").alias("n"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("A_"), F.col("id") % 3)).alias("name"))
    got = joins.contains_join(texts, "text", names, "name")
    brute = texts.crossJoin(names).filter(F.expr("text like concat('%', name, '%')"))
    assert got.columns == ["id", "text", "n", "name"]
    assert rows(got, "id", "n") == rows(brute, "id", "n")
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == 4800 and max(per_task) < 3200  # 3,200 rows are of one text


def test_contains_join_keeps_names_shared_by_both_sides(spark):
    left = spark.createDataFrame([(1, "abcdefgh 12345"), (2, None)], "id long, name string")
    right = spark.createDataFrame([(7, "fgh"), (7, "fgh"), (8, "12_45"), (9, "fgj"), (9, None)], "id long, name string")
    got = contains_join(left, "name", right, "name")
    assert got.columns == ["id", "name", "id", "name"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "abcdefgh 12345", 7, "fgh")] * 2 + [(1, "abcdefgh 12345", 8, "12_45")]
