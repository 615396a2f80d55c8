"""Summaries of earlier rows against the pairs they stand for."""

import random

import pytest

from opsframe.operators.prefix import summary_of_earlier


def expected(left, right, strict, later):
    out = []
    for i, (k, t) in left:
        met = [v for k2, t2, v in right if None not in (k, t, k2, t2) and k2 == k
               and ((t2 > t or (not strict and t2 == t)) if later else (t2 < t or (not strict and t2 == t)))]
        out.append((i, len(met), sorted({v for v in met if v is not None})[:2]))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_summary_equals_the_pairs(spark, strict, later, hot):
    rng = random.Random(hot * 4 + later * 2 + strict)
    key = lambda: None if rng.random() < 0.05 else 0 if hot and rng.random() < 0.6 else rng.randint(0, 12)
    time = lambda: None if rng.random() < 0.05 else rng.randint(0, 40)
    left = [(i, (key(), time())) for i in range(150)]
    right = [(key(), time(), rng.choice([None, *map(float, range(20))])) for _ in range(400)]
    mine = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in left], "i long, k long, t long, v string")
    theirs = spark.createDataFrame(right, "k2 long, t2 long, v2 double")
    found = summary_of_earlier(mine, theirs, [("k", "k2")], "t", "t2", "v2", strict, later, partitions=7)
    assert found.columns == ["i", "k", "t", "v", "n", "least"]
    assert sorted((r.i, r.n, r.least) for r in found.collect()) == expected(left, right, strict, later)


def test_empty_sides(spark):
    mine, theirs = spark.createDataFrame([(1, 5)], "k long, t long"), spark.createDataFrame([], "k2 long, t2 long, v2 double")
    assert [(r.n, r.least) for r in summary_of_earlier(mine, theirs, [("k", "k2")], "t", "t2", "v2").collect()] == [(0, [])]
    assert summary_of_earlier(mine.limit(0), theirs, [("k", "k2")], "t", "t2", "v2").count() == 0
