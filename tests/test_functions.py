import datetime as dt

from pyspark.sql import functions as F

from opsframe.functions import (
    at_most_flag, bands, boundary_diff, canonical_zone, char_in, concat_strict, decode_access,
    drop_first_char, false_or_null, like_contains, nvl, present_nonzero, ratio, split_part, zone_date,
)


def one(spark, col, schema, row):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first()["x"]


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_minute_boundaries_not_elapsed(spark):
    schema = "a timestamp_ntz, b timestamp_ntz"
    row = (ts("2024-01-01 10:00:59"), ts("2024-01-01 10:01:01"))
    assert one(spark, boundary_diff("MINUTE", "a", "b"), schema, row) == 1
    assert one(spark, boundary_diff("MINUTE", "b", "a"), schema, row) == -1
    # Spark's own difference counts whole elapsed minutes
    assert one(spark, F.timestamp_diff("MINUTE", F.col("a"), F.col("b")), schema, row) == 0


def test_day_boundaries(spark):
    schema = "a timestamp_ntz, b timestamp_ntz"
    row = (ts("2024-01-01 23:59:00"), ts("2024-01-02 00:01:00"))
    assert one(spark, boundary_diff("DAY", "a", "b"), schema, row) == 1
    assert one(spark, boundary_diff("HOUR", "a", "b"), schema, row) == 1
    assert one(spark, boundary_diff("MONTH", "a", "b"), schema, row) == 0


def test_zone_date_and_canonical_name(spark):
    assert canonical_zone("America/new_york") == "America/New_York"
    schema = "t timestamp_ntz"
    assert one(spark, zone_date("t", "America/new_york"), schema, (ts("2024-01-02 03:00:00"),)) == dt.date(2024, 1, 1)
    assert one(spark, zone_date("t", "America/new_york"), schema, (ts("2024-01-02 06:00:00"),)) == dt.date(2024, 1, 2)


def test_bands_boundaries(spark):
    schema = "v double"
    got = [one(spark, bands("v"), schema, (v,)) for v in (999.99, 1000.0, 1000.01, 4999.0, 5000.0, None)]
    assert got == ["low", "high", "middle", "middle", "high", "high"]


def test_flag_inclusive_and_negative(spark):
    schema = "d long"
    assert [one(spark, at_most_flag("d", 120), schema, (v,)) for v in (120, 121, -5, None)] == [1, None, 1, None]


def test_null_logic(spark):
    schema = "b boolean, x double"
    assert one(spark, false_or_null("b"), schema, (None, 1.0)) is True
    assert one(spark, false_or_null("b"), schema, (True, 1.0)) is False
    assert one(spark, present_nonzero("x"), schema, (None, 0.0)) is False
    assert one(spark, present_nonzero("x"), schema, (None, 2.0)) is True
    assert one(spark, nvl("x"), schema, (None, None)) == 0
    assert one(spark, ratio(F.lit(3), F.col("x")), schema, (None, 0.0)) is None
    assert one(spark, ratio(F.lit(3), F.col("x")), schema, (None, 2.0)) == 1.5


def test_text(spark):
    schema = "s string, n long"
    assert one(spark, concat_strict("dms", F.col("n")), schema, ("a", 7)) == "dms7"
    assert one(spark, concat_strict("dms", F.col("s")), schema, (None, 7)) is None
    assert one(spark, drop_first_char("s"), schema, (",select ,update ", 1)) == "select ,update "
    assert one(spark, split_part("s", "/", 3), schema, ("a/b", 1)) == ""
    assert one(spark, char_in("R", "s"), schema, ("rw", 1)) is False
    assert one(spark, like_contains(F.col("s"), F.lit("N_1")), schema, ("xNA1x", 1)) is True


def test_decode_access(spark):
    schema = "acl string, g string"
    row = ("NATION_1=rwd/africa|group AFRICA=r/africa", "NATION_1")
    assert one(spark, decode_access("acl", "g"), schema, row) == "select ,update ,delete "
    # Q7: a shorter name matches inside a longer one and reads its letters
    row = ("NATION_10=a/asia", "NATION_1")
    assert one(spark, decode_access("acl", "g"), schema, row) == "insert "
    row = ("NATION_10=RxtXUCT/asia", "NATION_10")
    assert one(spark, decode_access("acl", "g"), schema, row) == \
        "rule ,references ,trigger ,execute ,usage ,create ,temporary "


def test_boundaries_ignore_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        schema = "a timestamp_ntz, b timestamp_ntz"
        # 02:57 does not exist in Los Angeles on this day; zone-less values still differ by -54 minutes
        row = (ts("1997-04-06 03:51:00"), ts("1997-04-06 02:57:00"))
        assert one(spark, boundary_diff("MINUTE", "a", "b"), schema, row) == -54
        assert one(spark, boundary_diff("HOUR", "a", "b"), schema, row) == -1
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
