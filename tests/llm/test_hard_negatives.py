"""Hard negatives against a plain version; the bounds of the angles; awkward vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import hard_negatives as H
from opsframe.llm import queries
from tests.llm import brute


def rows_of(n=700, seed=6, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for k in range(n):
        v = (centres[k % 6] + rng.normal(size=width) * 0.4).astype(np.float32)
        rows.append((k, [float(x) for x in (np.round(v, 1) if k % 4 == 0 else v)], None if k % 29 == 0 else int(k % 6 if k % 5 else rng.integers(0, 10))))
    same = [1.0] * width
    rows += [(n + k, same, k % 3) for k in range(60)]  # ties
    rows += [(2000, [0.0] * width, 1), (2100, [], 2), (2200, [1.0, 2.0], 3), (2300, None, 1), (2400, [1.0, None], 1), (2500, [math.nan] * width, 1),
             (2600, [math.inf] * width, 1), (None, same, 1), (2700, [-1.0] * width, 9), (100, rows[100][1], rows[100][2]), (1, [9.0] * width, None), (2800, same, None)]
    return rows


def usable(rows, scale=256):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (v, label)), (v, label))
    width = max((len(v) for v, _ in best.values()), default=0)
    return {i: ([math.floor(scale * x) for x in v] + [0] * (width - len(v)), label) for i, (v, label) in best.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, label int, norm double, section string")


def got(df):
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()}


@pytest.mark.parametrize("section,block", [(8192, 1024), (40, 3)])
def test_all_hard_negatives(spark, monkeypatch, section, block):
    monkeypatch.setattr(H, "SECTION", section)
    monkeypatch.setattr(H, "BLOCK", block)
    rows = rows_of()
    known = usable(rows)
    found = H.mined(frame(spark, rows), F.col("id") % 20 == 0, F.col("label"))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute.hard_negatives(known, [i for i in known if i % 20 == 0], 5, 5, 80)
    assert got(found) == want and len(want) > 200


def test_other_shares(spark):
    rows = rows_of(200, 8)
    known = usable(rows)
    found = H.mined(frame(spark, rows), F.col("id") % 7 == 0, F.col("label"), positives=2, negatives=30, share=97)
    assert got(found) == brute.hard_negatives(known, [i for i in known if i % 7 == 0], 2, 30, 97)


def test_bounds_hold_and_skip_rows():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (500, 6)) // rng.integers(1, 40, (500, 1))
    rows[:50] = rows[50:100] * 2  # the same directions: angles of zero
    rows[3] = 0
    ways = rng.normal(size=(9, 6))
    ways /= np.linalg.norm(ways, axis=1)[:, None]
    norms = np.linalg.norm(rows, axis=1)
    angles = np.arccos(np.clip(rows @ ways.T / np.where(norms > 0, norms, 1)[:, None], -1, 1))
    narrow = []
    for i in range(500):
        low, high = H.score_bounds(norms[i], angles[i], norms, angles)
        scores = rows @ rows[i]
        assert (low <= scores).all() and (scores <= high).all()
        narrow.append(np.mean((high - low) < 1.5 * norms[i] * norms))
    assert np.mean(narrow) > 0.5


def test_large_components(spark):
    rows = [(0, [4e6, 1.0], 1), (1, [4e6, 2.0], 1), (2, [3.9e6, 0.0], 2)]
    found = H.mined(frame(spark, rows), F.col("id") == 0, F.col("label"))
    known = usable(rows)
    assert got(found) == brute.hard_negatives(known, [0], 5, 5, 80)
    with pytest.raises(ValueError, match="64-bit"):
        H.mined(frame(spark, [(0, [1e17, 1.0], 1), (1, [1e17, 2.0], 1)]), F.col("id") == 0, F.col("label"))


def test_registered_query(spark, tmp_path):
    rows = rows_of(900, 12)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    known = {i: (v, (x + 1) % 10 if i % 7 == 0 else x) for i, (v, x) in usable(rows).items()}
    assert got(queries.op13_hard_negatives(spark, str(tmp_path))) == brute.hard_negatives(known, [i for i in known if i % 100 == 0], 5, 5, 80)


def test_empty_and_alone(spark):
    assert H.mined(frame(spark, rows_of(200)).limit(0), F.col("id") == 0, F.col("label")).count() == 0
    assert H.mined(frame(spark, [(0, [1.0], 1)]), F.col("id") == 0, F.col("label")).count() == 0
    assert H.mined(frame(spark, [(0, [0.0], 1), (1, [0.0], 2), (2, [0.0], 1)]), F.col("id") == 0, F.col("label")).count() == 1
