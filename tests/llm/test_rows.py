"""Mixing and the vector searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import ann, mixing, topk
from opsframe.llm.components import components
from tests.llm import brute


def documents(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = None if k % 11 == 0 else f"s{min(k % 5, 3)}"
        rows.append((k, " ".join(["w"] * rng.randint(1, 30)), source, "x"))
    rows += [(n, None, "s1", "x"), (n + 1, " \n", "é", "x"), (None, "a b c", "s2", "x"), (7, rows[7][1], rows[7][2], "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, hash string")


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    rows, docs = documents(spark)
    got = mixing.drawn(docs, shards=8).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want, taken = brute.targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert len(r.copies) <= 2
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.copies)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= 10, (s, taken[s], t)
    again = mixing.drawn(docs.repartition(7), shards=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    rows, docs = documents(spark)
    drawn = {(r.id, r.source): len(r.copies) for r in mixing.drawn(docs, shards=4).collect()}
    mixed = mixing.mixed(docs, shards=4)
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[(r.doc_id, r.source)] = counts.get((r.doc_id, r.source), 0) + 1
    twice = {(7, rows[7][2])}
    assert {k: v for k, v in counts.items() if k not in twice} == {k: v for k, v in drawn.items() if v and k not in twice}


def _left_open(got):
    """Per source in a partial epoch: what is missing of its target, and its smallest document that could have filled it."""
    missing, unused = {}, {}
    for r in got:
        missing[r.source] = missing.get(r.source, r.target) - r.size * len(r.copies)
        if r.size and len(r.copies) <= int(r.target // r.source_size):
            unused[r.source] = min(unused.get(r.source, r.size), r.size)
    return {s: (missing[s], unused[s]) for s in unused}


def test_mix_goes_on_after_a_long_document(spark):
    rng = random.Random(5)
    # blocks of the production size, in each source a document of several of them
    rows = [(1000 * s + k, "w " * (120_000 if k == 0 else rng.randint(200, 1500)), f"s{s}") for s in range(9) for k in range(200)]
    got = mixing.drawn(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4).collect()
    left = _left_open(got)
    assert len(left) >= 3
    for s, (missing, smallest) in left.items():
        assert 0 <= missing < smallest, (s, missing, smallest)


def test_mix_passes_over_equal_rows_that_do_not_fit_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randint(3, 40)), f"s{k % 7}") for k in range(700)]
    docs = spark.createDataFrame(rows + rows[::2], "doc_id long, text string, source string")
    got = mixing.drawn(docs, shards=4).collect()
    copies = {}
    for r in got:
        assert copies.setdefault(r.id, r.copies) == r.copies
    twice = {r[0] for r in rows[::2]}
    for s, (missing, smallest) in _left_open(r for r in got if r.id not in twice).items():
        taken = sum(r.size * len(r.copies) for r in got if r.source == s)
        target = next(r.target for r in got if r.source == s)
        assert 0 <= target - taken < smallest, (s, target, taken, smallest)


def test_mixed_partitions_grow_with_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    rows, docs = documents(spark, n=1500)
    whole = mixing.mixed(docs, shards=8)  # a partition for each shard
    parts = [[tuple(r) for r in p] for p in whole.rdd.glom().collect()]
    assert len(parts) == 8 and all(parts)
    monkeypatch.setattr(mixing, "PIECE_BYTES", 1024)
    cut = mixing.mixed(docs, shards=8)
    pieces = [[tuple(r) for r in p] for p in cut.rdd.glom().collect()]
    k, total = len(pieces) // 8, sum(len(r[1] or "") for p in parts for r in p)
    assert k == -(-total // (8 * 1024)) > 1 and len(pieces) == 8 * k
    for shard, rows in enumerate(parts):  # the pieces of a shard end to end are its order
        assert [r for p in pieces[shard * k:shard * k + k] for r in p] == rows
    assert max(sum(len(r[1] or "") for r in p) for p in pieces) <= 4 * 1024


def test_splitting_tree_keeps_quotas(spark):
    quotas = {1: 40, 2: 13, 3: 1, 4: 0}
    for shards in (1, 2, 5, 8):
        found = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "place int, quota long"), shards).collect()
        per_source, per_shard = {}, {}
        for r in found:
            per_source[r.place] = per_source.get(r.place, 0) + r.quota
            per_shard[r.shard] = per_shard.get(r.shard, 0) + r.quota
            assert r.quota >= 0
        assert per_source == quotas
        assert len(per_shard) == shards and max(per_shard.values()) - min(per_shard.values()) <= 1
        for place in quotas:
            at = 0
            for r in sorted((r for r in found if r.place == place), key=lambda r: r.shard):
                assert r.first == at
                at += r.quota


def test_hypergeometric_draws(spark):
    """Drawn frequencies against exact chances."""
    from math import comb

    draws = spark.range(20_000).select(mixing._hypergeometric(F.lit(12).cast("long"), F.lit(5).cast("long"), F.lit(4).cast("long"),
                                                              (F.col("id") + 0.5) / 20_000).alias("x")).groupBy("x").count().collect()
    for r in draws:
        assert r["count"] / 20_000 == pytest.approx(comb(5, r.x) * comb(7, 4 - r.x) / comb(12, 4), abs=1e-3)


def test_empty_mix(spark):
    empty = documents(spark)[1].limit(0)
    assert mixing.drawn(empty).count() == 0
    assert mixing.mixed(empty).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=6)], k % 3) for k in range(300)]
    rows += [(300 + k, [1.0, 0.0, 0.0, 0.5, 0.0, 0.0], 0) for k in range(120)]
    rows += [(500, None, 0), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (600, [float("nan")] * 6, 0), (601, [float("inf")] + [0.0] * 5, 0),
             (650, [0.0] * 6, 0), (700, [], 0), (None, [1.0] * 6, 0), (750, [1.0, 2.0], 0), (10, [9.0] * 6, 0)]
    return rows


def usable(rows, zero: bool):
    best = {}
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not zero and not any(v):
            continue
        best[i] = min(best.get(i, v), v)
    return {i: np.array(v + [0.0] * (6 - len(v))) for i, v in best.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id int, vector int")


def test_top_k_is_exact(spark):
    rows = vectors()
    known = {i: np.floor(256 * v).astype(int) for i, v in usable(rows, True).items()}
    got = {}
    for r in topk.top_k(frame(spark, rows), F.col("id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (i for i in known if i % 50 == 0):
        want = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:5]
        assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert not got


def test_scores_beyond_64_bits_are_an_error(spark):
    of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_k(of([(0, [1e17, 1.0]), (1, [1e17, 2.0])]), F.col("id") == 0, k=5)
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_k(of([(0, [-1e9, 1.0]), (1, [1.0, 2.0])]), F.col("id") == 0, k=5)
    got = topk.top_k(of([(0, [4e6, 1.0]), (1, [-4e6, 2.0])]), F.col("id") == 0, k=5).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, -(256 * 4_000_000) ** 2 + 256 * 512)]


def test_neighbours(spark):
    rows = vectors()
    known = usable(rows, False)
    got = {}
    for r in ann.nearest(frame(spark, rows), F.col("id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in (i for i in known if i % 50 == 0):
        cosine = {i: float((v * known[q]).sum() / np.sqrt((v * v).sum()) / np.sqrt((known[q] ** 2).sum())) for i, v in known.items() if i != q}
        found = sorted(got.pop(q))
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(cosine[i], abs=1e-12) for _, i, s in found)
        want = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]
        hits, total = hits + len(set(want) & {i for _, i, _ in found}), total + 5
        if q in (350, 400):  # among equal vectors the smallest ids come
            assert [i for _, i, _ in found] == [300, 301, 302, 303, 304]
    assert not got and hits / total >= 0.9


def test_neighbours_in_stretches_of_a_fixed_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = frame(spark, [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(600)])
    want = sorted(map(tuple, ann.nearest(docs, F.col("id") % 3 == 0, 5).collect()))
    sizes, window = spark.sparkContext.accumulator(0), ann._window
    largest = 50

    def watched(half, keep):
        run = window(half, keep)

        def counted(q, r):
            if max(q.num_rows, r.num_rows) > largest:
                sizes.add(1)
            return run(q, r)

        return counted

    monkeypatch.setattr(ann, "STRETCH", 40, raising=False)
    monkeypatch.setattr(ann, "_window", watched)
    got = sorted(map(tuple, ann.nearest(docs, F.col("id") % 3 == 0, 5).collect()))
    assert sizes.value == 0
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (50, [0.0, -1.0], 0)]
    for found in (topk.top_k(frame(spark, rows), F.col("id") % 50 == 0, 5), ann.nearest(frame(spark, rows), F.col("id") % 50 == 0, 5)):
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    none = frame(spark, [(0, None, 0)])
    assert topk.top_k(none, F.col("id") % 50 == 0, 5).count() == 0
    assert ann.nearest(none, F.col("id") % 50 == 0, 5).count() == 0


def test_hilbert_keys_walk_the_grid():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
