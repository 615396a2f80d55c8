"""The registered queries as they are registered, over small tables, against plain versions."""

import hashlib
import math
import random
import struct
import zlib

import pytest

from opsframe.llm import html_text, queries, suffix_tree
from tests.llm import brute
from tests.llm.test_texts import labelled


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(31)
    docs, labels = labelled(160)
    docs += [(500 + k, docs[k][1]) for k in range(12)] + [(600, ""), (601, None), (602, "é𝄞 naïve\n" * 30), (603, "a" * 5000)]
    rows = [(i, t, rng.choice(["en", "fr", None]), f"s{i % 7}" if i % 9 else None, len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 4) for i in range(260)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(1, "u", "<p>a<p>b"), (2, None, None), (3, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    stored = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    return str(folder), rows, labels, stored, pages


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op2(spark, tables):
    folder, rows, *_ = tables
    got = queries.op2_mixing(spark, folder).collect()
    size = {r[0]: len(brute.WORD.findall(r[1] or "")) for r in rows}
    of = {}
    for r in rows:
        of[r[3]] = of.get(r[3], 0) + size[r[0]]
    want, taken, source = brute.targets(of), {}, {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], of[s]) and r.target == pytest.approx(want[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(rows)
    assert all(0 <= want[s] - taken[s] <= max(size.values()) for s in want)
    assert sorted(map(str, queries.op2_mixing(spark, folder).collect())) == sorted(map(str, got))


def test_op3(spark, tables):
    folder, rows, *_ = tables
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, folder).collect()}
    want = brute.tree_scores([(r[1], remainder(r[0], 5) != 1) for r in rows], suffix_tree.PSEUDO, suffix_tree.PENALTY)
    total = sum(w[0] for r, w in zip(rows, want) if remainder(r[0], 5) != 1)
    for r, (n, known, base, score) in zip(rows, want):
        g = got[r[0]]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (remainder(r[0], 5) == 1, n, known, total)
        assert g.base_score == pytest.approx(base) and g.score == pytest.approx(score, rel=1e-5)


def test_op4(spark, tables):
    folder, rows, labels, *_ = tables
    got = queries.op4_toxicity(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    marks, scores = {i: m for i, _, m in labels}, {r.doc_id: r.score for r in got if r.held_out}
    pairs = [scores[a] > scores[b] for a in scores for b in scores if marks.get(a) == 1 and marks.get(b) == 0]
    assert pairs and sum(pairs) > 0.9 * len(pairs)


def test_op5_and_op7(spark, tables):
    folder, *_, vectors, _ = tables
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    near, high, hits = {}, {}, 0
    for r in queries.op5_hilbert_neighbours(spark, folder).collect():
        near[r.query_id, r["rank"]] = (r.vec_id, r.score)
    for r in queries.op7_exact_top_k(spark, folder).collect():
        high[r.query_id, r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 260, 50):
        others = [i for i in vectors if i != q]
        for rank, i in enumerate(sorted(others, key=lambda i: (-dot(whole[q], whole[i]), i))[:5], 1):
            assert high[q, rank] == (i, dot(whole[q], whole[i]))
        cosine = {i: dot(vectors[q], vectors[i]) / math.sqrt(dot(vectors[q], vectors[q]) * dot(vectors[i], vectors[i])) for i in others}
        best = sorted(others, key=lambda i: (-cosine[i], i))[:5]
        found = [near[q, rank] for rank in range(1, 6)]
        assert all(s == pytest.approx(cosine[i]) for i, s in found)
        hits += len(set(best) & {i for i, _ in found})
    assert len(near) == len(high) == 30 and hits >= 27


def test_op6(spark, tables):
    folder, *_, pages = tables
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op6_html_text(spark, folder).collect()}
    assert got == {i: (None, None) if h is None else (html_text.extract(h), len(html_text.extract(h))) for i, _, h in pages}


def test_op8(spark, tables):
    folder, rows, *_ = tables
    kept = brute.kept_lines([r[:2] for r in rows], 40)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in queries.op8_line_dedup(spark, folder).collect()}
    for k, r in enumerate(rows):
        n = len((r[1] or "").split("\n"))
        assert got[r[0]] == ((None, 0, 0) if r[1] is None else ("\n".join(kept[k]), n, n - len(kept[k])))


def test_op10(spark, tables):
    import tiktoken

    folder, rows, *_ = tables
    words = queries.vocabulary()
    enc = tiktoken.Encoding("plain", pat_str=words.pattern, mergeable_ranks=words.ranks(), special_tokens={})
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, folder).collect()}
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
