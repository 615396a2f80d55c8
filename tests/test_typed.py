"""Declared types at write: good rows stored, every fault listed once."""

from decimal import Decimal

import pytest

from opsframe.sources import typed
from opsframe.sources.typed import Declared

DECLARED = (Declared("id", "int8"), Declared("name", "varchar", 5), Declared("phone", "char", 4), Declared("nation", "int4"),
            Declared("small", "int2", nullable=True), Declared("balance", "numeric", 5, 2))
SCHEMA = "id long, name string, phone string, nation string, small string, balance string"
GOOD = [(1, "abcde", "12", "7", None, "999.994"), (2, "ab   ", "1234", "-2147483648", "32767", "-1.005"), (3, "abcde  ", "", " 5", "1.5", "0")]
BAD = [(4, "abcdef", "12345", "x", "40000", "1000"), (None, None, None, None, None, None), (5, "éééé", "ééé", "2147483648", "-32769", "999.995"),
       (6, "ok", "ok", "1", "1", "abc")]
FAULTS = [(4, "balance", "beyond numeric(5,2)", "1000"), (4, "name", "longer than 5 bytes", "abcdef"), (4, "nation", "not a number", "x"),
          (4, "phone", "longer than 4 bytes", "12345"), (4, "small", "beyond int2", "40000"), (5, "balance", "beyond numeric(5,2)", "999.995"),
          (5, "name", "longer than 5 bytes", "éééé"), (5, "nation", "beyond int4", "2147483648"), (5, "phone", "longer than 4 bytes", "ééé"),
          (5, "small", "beyond int2", "-32769"), (6, "balance", "not a number", "abc"),
          *[(None, c, "is null", None) for c in ("balance", "id", "name", "nation", "phone")]]


def test_good_rows_are_stored_and_faults_listed(spark, tmp_path):
    df = spark.createDataFrame([(*r, "extra") for r in GOOD + BAD], SCHEMA + ", more string")
    counts = typed.store(df, DECLARED, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    rows = {r.id: tuple(r)[1:] for r in typed.stored(back, DECLARED).collect()}
    assert rows == {1: ("abcde", "12  ", 7, None, Decimal("999.99")), 2: ("ab   ", "1234", -2147483648, 32767, Decimal("-1.01")),
                    3: ("abcde", "    ", 5, 2, Decimal("0.00"))}
    kinds = dict(typed.stored(back, DECLARED).dtypes)
    assert kinds == {"id": "bigint", "name": "string", "phone": "string", "nation": "int", "small": "smallint", "balance": "decimal(5,2)"}
    rejected = typed.rejected(back)
    got = sorted(((None if r.id is None else int(r.id), r.column, r.rule, r.value) for r in rejected.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == FAULTS
    assert {k: v for k, v in counts.items() if v} == {f"{c}: {rule}": sum(f[1:3] == (c, rule) for f in FAULTS) for _, c, rule, _ in FAULTS}
    first = rejected.filter("id = 4").first()
    assert (first.name, first.phone, first.balance) == ("abcdef", "12345", "1000")


def test_one_pass(spark, tmp_path):
    df = spark.createDataFrame(GOOD, SCHEMA)
    plan = typed.checked(df, DECLARED)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_no_rows_and_reserved_names(spark, tmp_path):
    counts = typed.store(spark.createDataFrame([], SCHEMA), DECLARED, str(tmp_path / "t"))
    assert set(counts.values()) == {0}
    with pytest.raises(ValueError):
        typed.checked(spark.createDataFrame([(1,)], "faults long"), [Declared("faults", "int8")])
