"""Phrase collocations against a plain version; routes of hot words; slices of long texts."""

import random

import numpy as np
import pytest

from opsframe.llm import collocations as C
from opsframe.llm import queries
from tests.llm import brute


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é𝄞", "city-hall", "a\xa0b", "x" * 300, "Ünder", "don't", *[f"w{i}" for i in range(30)]]
    weights = [40, 25, 8, 8, 3, 2, 2, 1, 2, 2, *[1] * 30]
    rows = []
    for k in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for w in rng.choices(words, weights, k=rng.randint(0, 40)))
        rows.append((k, text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return [*rows, (None, rows[1][1], "en"), (1, rows[1][1], "en"), (n, None, "en"), (n + 1, "", None), (n + 2, " ,. \n", "de"), (n + 3, "the the the the " * 50, "en")]


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, lang string, phrase string")
    options = {"words": 3, "least": 5, "share": 50, "first": 40} | kw
    got = sorted(tuple(r) for r in C.collocations(docs, **options).collect())
    assert got == sorted(brute.collocations([(r[2], r[1]) for r in rows], **options))
    return got


def test_collocations(spark):
    assert len(check(spark, corpus())) > 60


@pytest.mark.parametrize("words", [2, 4])
def test_other_lengths(spark, words):
    check(spark, corpus(150), words=words, least=4, share=80)


def test_hot_words_are_routed_by_the_words_behind_them(spark, monkeypatch):
    """A third of all words is one, and most pairs are of hot words; results stay the same and no route is crowded."""
    monkeypatch.setattr(C, "OWNER_TOKENS", 64)
    monkeypatch.setattr(C, "CHUNK_BYTES", 2000)
    rows = corpus(300)
    check(spark, rows)
    rng = random.Random(9)
    wide = [(k, " ".join(x for i in range(60) for x in ("the", f"v{rng.randint(0, 5000)}")), "en") for k in range(100)]
    texts = spark.createDataFrame([(r[2], r[1].encode()) for r in wide], "lang string, body binary")
    sent = texts.mapInArrow(C._fragments(190, 3, {("en", "the")}), C._FRAGMENT).toPandas()
    held = [sum(C.unplaned(c).sum() for c in g.counts) for _, g in sent.groupby("owner")]
    assert sum(held) == 100 * 119 and max(held) < 6 * 119 * 100 / 190  # "the" begins half of all suffixes


def test_long_texts_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 500)
    rng = random.Random(4)
    text = "".join(rng.choice(["ab", "cd", "ef"]) + rng.choice([" ", " ", ", "]) for _ in range(20_000))
    check(spark, [(1, text, "en"), (2, "ab cd " * 800, "en"), (3, "é" * 3000, "en")])


def test_quicksort_groups(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 5, (2000, 3)).astype(np.int32)
    keys[keys[:, 1] == 0, 1:] = -1
    keys[keys[:, 2] == 0, 2] = -1
    weights = rng.integers(1, 4, 2000)
    want = {}
    for row, w in zip(keys.tolist(), weights.tolist()):
        for d in range(1, 4):
            if -1 not in row[:d - 1]:
                want[tuple(row[:d])] = want.get(tuple(row[:d]), 0) + w
    for least in (0, 60):
        got = {tuple(keys[r, :d].tolist()): (w, e) for d, rows, ws, es in C.partitioned(keys, weights, least) for r, w, e in zip(rows.tolist(), ws.tolist(), es.tolist())}
        assert got == {k: (w, k[-1] < 0) for k, w in want.items() if w >= least}


def test_exact_scores(spark):
    frame = spark.createDataFrame([(10**15, 10**15 + 7, 3 * 10**15)], "a long, l long, r long")
    a, l, r = 10**15, 10**15 + 7, 3 * 10**15
    assert frame.select(C._score(frame.a, frame.l, frame.r)).first()[0] == 1000000 * a * a // (l * r)


def test_empty_and_registered_query(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(none).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0
    rows = [(i, t, x) for i, t, x in corpus(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.op12_collocations(spark, str(tmp_path)).collect())
    assert got == sorted(brute.collocations([(r[2], r[1]) for r in rows], 3, 10, 50, 2000))
