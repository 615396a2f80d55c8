"""Stored tables: repeated and half-written batches, updates of the touched files, refreshed aggregates, ids that stay."""

import hashlib
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opsframe.operators.aggs import NotUnique, assert_unique, key_violations
from opsframe.operators.ids import register, stable_ids
from opsframe.sources import sinks
from opsframe.sources.stored import Conflict, StoredAggregate, StoredTable


def values(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, g string, v double")


def digests(table):
    return {f: hashlib.md5(open(f"{table.folder.path}/data/{f}", "rb").read()).hexdigest() for f in table.manifest()["files"]}


def test_a_batch_counts_once(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"))
    first, second = [(1, "a", 1.0), (2, "b", 2.0)], [(3, "a", 3.0)]
    assert table.append(frame(spark, first), "one") == 1
    assert table.append(frame(spark, second), "two") == 2
    assert table.append(frame(spark, first), "one") == 2
    assert values(table.read()) == first + second and values(table.read(1)) == first


def test_a_half_written_batch_is_invisible(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, [(1, "a", 1.0)]), "one")
    # dies after its files are written, before the manifest
    monkeypatch.setattr(StoredTable, "commit", lambda *a, **kw: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.append(frame(spark, [(2, "b", 2.0)]), "two")
    monkeypatch.undo()
    # dies while it writes: a job whose tasks fail
    with pytest.raises(Exception):
        table.append(frame(spark, [(2, "b", 2.0)]).filter(F.raise_error(F.lit("lost")).isNull()), "two")
    assert values(table.read()) == [(1, "a", 1.0)] and table.version() == 1
    assert table.append(frame(spark, [(2, "b", 2.0)]), "two") == 2
    assert values(table.read()) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert table.vacuum() >= 1  # what the first attempt wrote
    there = {f"{d}/{f}" for d in table.folder.names("data") for f in table.folder.names(f"data/{d}") if f.endswith(".parquet")}
    assert there == set(table.manifest()["files"])
    assert values(table.read()) == [(1, "a", 1.0), (2, "b", 2.0)]


def test_two_writers(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, [(1, "a", 1.0)]), "one")
    seen = table.manifest()
    table.append(frame(spark, [(2, "b", 2.0)]), "two")
    with pytest.raises(Conflict):  # the version after the one it saw is taken
        table.append(frame(spark, [(3, "c", 3.0)]), "three", base=seen)
    with pytest.raises(Conflict):
        table.commit(seen, seen["schema"], [])
    table.append(frame(spark, [(3, "c", 3.0)]), "three")
    assert [r[0] for r in values(table.read())] == [1, 2, 3]


def test_other_columns_are_turned_down(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, [(1, "a", 1.0)]), "one")
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(1,)], "k long"), "two")
    with pytest.raises(ValueError):
        StoredTable(spark, str(tmp_path / "none")).read()


def test_a_table_moves_as_it_is(spark, tmp_path):
    old, new = StoredTable(spark, str(tmp_path / "old")), StoredTable(spark, str(tmp_path / "new"))
    rows = [(k, f"g{k % 3}", float(k)) for k in range(40)]
    old.append(frame(spark, rows), "one")
    assert new.create_like(old) == new.create_like(old) == 1 and new.read().count() == 0 and new.read().schema == old.read().schema
    new.append(frame(spark, [(100, "x", 1.0)]), "own")
    before = sorted(digests(old).values())
    new.append_from(old)
    assert old.read().count() == 0 and values(new.read()) == sorted([*rows, (100, "x", 1.0)])
    assert set(before) <= set(digests(new).values())  # the same files
    version = new.version()
    assert new.append_from(old) == version  # nothing left to move
    old.append(frame(spark, rows[:3]), "two")
    new.append_from(old)
    assert new.read().count() == 44
    with pytest.raises(ValueError):
        new.append_from(_other_columns(spark, tmp_path))


def _other_columns(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "other"))
    table.append(spark.createDataFrame([(1,)], "k long"), "one")
    return table


@pytest.mark.parametrize("step", ["second file", "publish new", "publish old"])
def test_a_move_that_breaks_off_goes_on(spark, tmp_path, monkeypatch, step):
    from opsframe.sources.stored import Folder

    old, new = StoredTable(spark, str(tmp_path / "old")), StoredTable(spark, str(tmp_path / "new"))
    rows = [(k, f"g{k % 8}", float(k)) for k in range(80)]
    old.append(frame(spark, rows), "one", by=["g"], ranges=4)
    new.create_like(old)
    take, publish, taken = Folder.take, Folder.publish, []

    def broken_take(self, other, name, to):
        taken.append(name)
        if step == "second file" and len(taken) == 2:
            raise RuntimeError("lost")
        return take(self, other, name, to)

    def broken_publish(self, name, text):
        if step == f"publish {'new' if self.path == new.folder.path else 'old'}":
            raise RuntimeError("lost")
        return publish(self, name, text)

    monkeypatch.setattr(Folder, "take", broken_take)
    monkeypatch.setattr(Folder, "publish", broken_publish)
    with pytest.raises(RuntimeError):
        new.append_from(old)
    monkeypatch.undo()
    new.append_from(old)
    assert values(new.read()) == sorted(rows) and old.read().count() == 0


def test_an_update_leaves_other_files_alone(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"))
    rows = [(k, f"g{k % 8}", float(k)) for k in range(800)] + [(900, None, 1.0)]
    table.append(frame(spark, rows), "all", by=["g"], ranges=5)
    before = digests(table)
    reader = table.read()
    assert len(before) > 2
    table.update({"v": 0}, F.col("g") == "g3")
    after = digests(table)
    kept = set(before) & set(after)
    assert len(kept) >= len(before) - 2 and all(before[f] == after[f] for f in kept)
    assert values(table.read()) == sorted([(k, g, 0.0 if g == "g3" else v) for k, g, v in rows], key=lambda r: r)
    assert values(reader) == sorted(rows)  # a reader of the version before
    assert table.update({"v": 1}, F.col("g") == "nothing") == 2 and digests(table) == after
    assert table.vacuum() == len(before) - len(kept)


def test_an_update_that_loses_starts_again(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, [(1, "a", 1.0)]), "one")
    plain, calls = StoredTable.touched, []

    def touched(self, predicate, last):
        if not calls:
            calls.append(1)
            table.append(frame(spark, [(2, "a", 2.0)]), "meanwhile")
        return plain(self, predicate, last)

    monkeypatch.setattr(StoredTable, "touched", touched)
    table.update({"v": 9}, F.col("g") == "a")
    assert values(table.read()) == [(1, "a", 9.0), (2, "a", 9.0)]


def balances(spark, tmp_path, **kw):
    table = StoredTable(spark, str(tmp_path / "rows"))
    return table, StoredAggregate(table, str(tmp_path / "sums"), ["g"], {"v": F.col("v"), "twice": F.col("v") * 2}, **kw)


def recomputed(table):
    out = {}
    for _, g, v in (tuple(r) for r in table.read().collect()):
        out.setdefault(g, []).append(v)
    return sorted(((g, *[None if all(x is None for x in vs) else sum(m * Decimal(str(x)) for x in vs if x is not None) for m in (1, 2)])
                   for g, vs in out.items()), key=str)


def stored(view):
    return sorted((tuple(r) for r in view.read().collect()), key=str)


@pytest.mark.parametrize("merge_after", [1, 2, 8])
def test_refreshed_sums_equal_recomputed_ones(spark, tmp_path, merge_after):
    rng = random.Random(merge_after)
    table, view = balances(spark, tmp_path, merge_after=merge_after)
    rows = lambda n: [(k, rng.choice(["a", "b", "c", None, f"x{n}"]), rng.choice([None, 0.1, 0.25, -3.5])) for k in range(60)]
    for n in range(4):
        table.append(frame(spark, rows(n)), f"batch{n}")
        if n == 2:
            table.update({"g": "b", "v": 0.3}, F.col("g") == "x1")
        view.refresh()
        assert stored(view) == recomputed(table)
        version = view.table.version()
        assert view.refresh() == version  # nothing new
    assert "x1" not in {r[0] for r in stored(view)}
    assert view.table.manifest()["more"]["source_version"] == table.version()


def test_only_new_files_are_read(spark, tmp_path):
    table, view = balances(spark, tmp_path)
    table.append(frame(spark, [(1, "a", 1.0), (2, "b", 2.0)]), "one")
    view.refresh()
    for f in table.manifest()["files"]:  # gone from the folder: a refresh that read them would fail
        os.remove(f"{table.folder.path}/data/{f}")
    table.append(frame(spark, [(3, "a", 3.0)]), "two")
    view.refresh()
    assert stored(view) == [("a", Decimal(4), Decimal(8)), ("b", Decimal(2), Decimal(4))]


def test_a_reader_sees_one_whole_version(spark, tmp_path):
    table, view = balances(spark, tmp_path, merge_after=1)
    table.append(frame(spark, [(1, "a", 1.0), (2, "b", 2.0)]), "one")
    view.refresh()
    reader = view.read()
    table.append(frame(spark, [(3, "a", 5.0), (4, "c", 5.0)]), "two")
    view.refresh()
    view.rebuild()
    assert [r[:2] for r in sorted(tuple(r) for r in reader.collect())] == [("a", 1), ("b", 2)]
    assert [r[:2] for r in stored(view)] == [("a", 6), ("b", 2), ("c", 5)]


def test_a_changed_look_up_means_a_rebuild(spark, tmp_path):
    table, names = StoredTable(spark, str(tmp_path / "rows")), StoredTable(spark, str(tmp_path / "names"))
    names.append(spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "g string, name string"), "one")
    view = StoredAggregate(table, str(tmp_path / "sums"), ["name"], {"v": F.col("v")}, prepare=lambda rows: rows.join(names.read(), "g"), lookups=[names])
    table.append(frame(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, "a", 4.0)]), "one")
    view.refresh()
    assert stored(view) == [("Alpha", Decimal(5)), ("Beta", Decimal(2))]
    names.update({"name": "Gamma"}, F.col("g") == "b")
    table.append(frame(spark, [(4, "b", 8.0)]), "two")
    view.refresh()
    assert stored(view) == [("Alpha", Decimal(5)), ("Gamma", Decimal(10))]
    version = view.table.version()
    assert view.refresh() == version


def test_two_refreshes_at_once_count_a_batch_once(spark, tmp_path, monkeypatch):
    table, view = balances(spark, tmp_path)
    table.append(frame(spark, [(1, "a", 1.0)]), "one")
    view.refresh()
    table.append(frame(spark, [(2, "a", 2.0)]), "two")
    plain, calls = StoredTable.write_files, []

    def write_files(self, df, label, *a):
        if label == "partial" and not calls:
            calls.append(1)
            balances(spark, tmp_path)[1].refresh()  # another process is faster
        return plain(self, df, label, *a)

    monkeypatch.setattr(StoredTable, "write_files", write_files)
    view.refresh()
    assert stored(view) == recomputed(table) == [("a", Decimal(3), Decimal(6))]


def test_files_vacuumed_before_the_refresh_mean_a_rebuild(spark, tmp_path):
    table, view = balances(spark, tmp_path)
    table.append(frame(spark, [(1, "a", 1.0), (2, "b", 2.0)]), "one")
    view.refresh()
    table.update({"v": 7.0}, F.col("g") == "a")
    table.vacuum()
    view.refresh()
    assert stored(view) == recomputed(table)


def test_ids_stay(spark, tmp_path):
    registry = StoredTable(spark, str(tmp_path / "ids"))
    early = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), (None, 1)], "g string, n int")
    first = {r.g: r.id for r in stable_ids(early, ["g"], registry, "early").collect()}
    assert sorted(first.values()) == [1, 2, 3] and first["a"] < first["b"]
    late = spark.createDataFrame([("aa", 1), ("b", 1), ("a", 7), ("c", 1), (None, 2), ("c", 2)], "g string, n int")
    found = stable_ids(late, ["g"], registry, "late").collect()
    assert len(found) == 6
    second = {r.g: r.id for r in found}
    assert {k: second[k] for k in first} == first and (second["aa"], second["c"]) == (4, 5)
    assert register(late, ["g"], registry, "late") == registry.version() == 2
    assert {r.g: r.id for r in stable_ids(late, ["g"], registry, "again").collect()} == second


def test_two_runs_never_give_one_id_twice(spark, tmp_path, monkeypatch):
    registry = StoredTable(spark, str(tmp_path / "ids"))
    of = lambda *gs: spark.createDataFrame([(g,) for g in gs], "g string")
    register(of("a"), ["g"], registry, "one")
    plain, calls = StoredTable.append, []

    def append(self, df, batch, **kw):
        if not calls:
            calls.append(1)
            register(of("x", "c"), ["g"], registry, "meanwhile")
        return plain(self, df, batch, **kw)

    monkeypatch.setattr(StoredTable, "append", append)
    register(of("b", "c"), ["g"], registry, "two")
    assert sorted(tuple(r) for r in registry.read().collect()) == [("a", 1), ("b", 4), ("c", 2), ("x", 3)]


def test_planted_duplicates_are_found(spark):
    rows = [(k, "x", float(k)) for k in range(50)] + [(7, "y", 0.5), (7, "z", 0.25), (7, "w", 9.0), (None, "n", 1.0), (None, "n", 2.0)]
    df = frame(spark, rows)
    found = values(key_violations(df, ["k"], [F.col("v").asc()], sample=2).select("k", "g", "v", "copies", "copy").filter("k is not null"))
    assert found == [(7, "y", 0.5, 4, 2), (7, "z", 0.25, 4, 1)]
    assert key_violations(df, ["k"], [F.col("v").asc()]).filter("k is null").count() == 2
    with pytest.raises(NotUnique, match="'copies': 4"):
        assert_unique(df.filter("k is not null"), ["k"], [F.col("v").asc()])
    clean = frame(spark, rows[:50])
    assert key_violations(clean, ["k"], [F.col("v").asc()]).count() == 0 and assert_unique(clean, ["k"], [F.col("v").asc()]) is clean


def rows_scanned(df):
    """Rows that the file scans of an executed frame gave out."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0

    def walk(node):
        nonlocal found
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return found


def test_look_ups_read_few_row_groups(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7919 % n).alias("other"), F.md5(F.col("id").cast("string")).alias("text"))
    table = sinks.store_clustered(df, str(tmp_path / "t"), ["k"], ["other"], row_group_bytes=64 << 10)
    by_key, by_other = table.filter("k = 123456"), table.filter("other = 5")
    assert rows_scanned(by_key) < n / 10 and [r.k for r in by_key.collect()] == [123456]
    # the column is spread over the whole table: minimum and maximum admit every row group, the Bloom filters few
    assert rows_scanned(by_other) < n / 4 and by_other.count() == 1
    plain = str(tmp_path / "plain")
    df.sample(1.0).repartition(4, F.rand(1)).write.parquet(plain)
    assert rows_scanned(spark.read.parquet(plain).filter("k = 123456")) > 10 * rows_scanned(by_key)


def test_a_shared_key_needs_no_shuffle(spark):
    from opsframe.plans import field_service
    from opsframe.sources.tables import Tables
    from tests.conftest import SF_SMALL

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = Tables(spark, SF_SMALL)
        shared = sinks.co_partitioned(t, {"orders": "o_orderkey", "lineitem": "l_orderkey"})
        moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        for report in (field_service.r3_driver_day, field_service.r4_appointment_detail):
            assert moved(report(shared)) <= moved(report(t)) - 2
        joined = shared["orders"].join(shared["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
        assert moved(joined) == 0 and joined.count() == t["lineitem"].count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
