"""Operators on texts, held against plain versions on small tables with the awkward cases."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import bpe, chunks, html_text, line_dedup, queries, simhash, suffix_dedup, suffix_tree, toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, chunk int, row string, cut string"


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "été", "naïve", "x"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(40)
    docs: list[tuple[int | None, str | None]] = [(k, prose(rng.randint(1, 60))) for k in range(30)]
    docs += [(30 + k, prose(10) + "\n" + passage + "\n" + prose(5)) for k in range(6)]
    docs += [(40, docs[3][1]), (41, docs[3][1]), (42, ""), (43, None), (None, passage), (44, "a" * 400), (45, "a" * 120 + "b" * 60)]
    docs += [(46, "one line\nanother line\n" * 5), (47, "another line\none line\nanother line\n"), (48, " \t\n"), (49, prose(3000))]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, 0, 1, 2, "r", "c") for k, (i, t) in enumerate(docs)], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def key(i):
    return (i is None, i or 0)


def test_repeated_bytes_go(spark, docs):
    got = suffix_dedup.repeated_removed(frame(spark, docs), depth=50).collect()
    want = brute.repeated_spans(docs, 50)
    assert sorted((key(r.id), bytes(r.kept), [[a, b] for a, b in zip(r.starts, r.ends)], r.n_bytes) for r in got) == \
        sorted((key(i), kept, spans, len((t or "").encode())) for (i, t), (spans, kept) in zip(docs, want))
    assert any(spans for spans, _ in want)


def test_repeated_bytes_with_one_id_in_several_rows(spark):
    rows = [(1, "x" * 60), (1, "x" * 60), (1, "y" * 70), (2, "y" * 70), (2, "x" * 55 + "z"), (None, "z" * 50), (None, "z" * 50)]
    got = suffix_dedup.repeated_removed(frame(spark, rows), depth=50).collect()
    want = brute.repeated_spans(rows, 50)
    assert sorted((key(r.id), bytes(r.kept)) for r in got) == sorted((key(i), kept) for (i, _), (_, kept) in zip(rows, want))


def test_windows_across_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(k, "".join(rng.choice("abcdefgh") for _ in range(200)) + shared + str(k) * k) for k in range(5)]
    got = {r.id: bytes(r.kept) for r in suffix_dedup.repeated_removed(frame(spark, rows), depth=50).collect()}
    assert got == {i: kept for (i, _), (_, kept) in zip(rows, brute.repeated_spans(rows, 50))}


def test_a_short_string_between_ever_new_surroundings(spark, monkeypatch):
    """Its fragments are as many as its surroundings; none of its windows meets more than its equals."""
    rng = random.Random(12)
    noise = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    hot = "the one string of them all"  # shorter than a window
    rows = [(k, noise(20) + hot.join(noise(60) for _ in range(25))) for k in range(400)]
    rows += [(500 + k, noise(30) + hot + "and what follows it here is the same again" + noise(30)) for k in range(5)] + [(600, rows[3][1][100:400])]
    want = {i: kept for (i, _), (_, kept) in zip(rows, brute.repeated_spans(rows, 50))}
    docs, crowds = frame(spark, rows), []
    for most in (1 << 17, 100):
        monkeypatch.setattr(suffix_dedup, "HOT_FRAGMENTS", most)
        assert {r.id: bytes(r.kept) for r in suffix_dedup.repeated_removed(docs, depth=50).collect()} == want
        n = 8
        texts = chunks.dealt(docs, n)
        marks = (texts.groupBy("chunk").applyInArrow(suffix_dedup._sent_anchors(n, 50, 20), suffix_dedup._MARKS)
                 .groupBy("dest").applyInArrow(suffix_dedup._repeated_anchors(most), suffix_dedup._REPEATED))
        sent = texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(suffix_dedup._sent_fragments(n, 50, 20), suffix_dedup._FRAGMENTS)
        met = {}
        for r in sent.select("dest", "anchors").collect():
            for a in np.frombuffer(r.anchors, "<u4").tolist():
                met[r.dest, a] = met.get((r.dest, a), 0) + 1
        crowds.append(max(met.values()))
    assert crowds[0] > 5000 and crowds[1] <= 100


def test_line_dedup(spark, docs):
    for long in (40, 25, 1, 200):
        got = line_dedup.deduplicated(frame(spark, docs), long).collect()
        kept = brute.kept_lines(docs, long)
        want = {docs[k][0]: "\n".join(x) for k, x in kept.items()}
        assert {r.doc_id: r.text for r in got if r.text is not None or r.doc_id != 43} == want
        assert {r.doc_id: (r.n_lines, r.n_removed) for r in got if r.doc_id != 43} == \
            {docs[k][0]: (docs[k][1].count("\n") + 1, docs[k][1].count("\n") + 1 - len(x)) for k, x in kept.items()}
        null = [r for r in got if r.doc_id == 43][0]
        assert null.text is None and null.n_lines == 0 and null.n_removed == 0 and (null.cut, null.row) == ("c", "r")


def test_runs_of_short_lines(spark):
    """Runs of any number of lines, empty ones among them; every way of being just long enough, or just too short."""
    rng = random.Random(2)
    pool = ["", "", "a", "bb", "ccc", "dddd", "e" * 9, "f" * 24, "g" * 39, "h" * 40]
    docs = [(k, "\n".join(rng.choices(pool, k=rng.randint(0, 40)))) for k in range(60)]
    song = "\n".join(f"la {k % 3}" for k in range(30))
    docs += [(100 + k, f"only here {k}\n{song}\nends {k}") for k in range(4)] + [(200, "\n" * 50), (201, "\n" * 60 + "x")]
    for long in (40, 12):
        got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), long).collect()}
        assert got == {docs[k][0]: "\n".join(x) for k, x in brute.kept_lines(docs, long).items()}
    assert got[101] == "only here 1\nends 1"


def test_short_lines_that_meet_by_chance_stay(spark):
    docs = [(1, "And ornd.\nEresnt.\nfirst of its kind, and long enough to count"), (2, "And ornd.\nEresnt.\nanother text, which is nobody's copy at all")]
    assert {r.doc_id: r.n_removed for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1: 0, 2: 0}


def test_rows_equal_in_id_and_text_are_one_document(spark):
    """Their suffixes are there once, however many rows there are."""
    text = "\n".join(f"a line that is long enough to count {k}" for k in range(6))
    sizes = []
    for copies in (10, 1000):
        rows = [(None, text)] * copies + [(1, text), (2, "one\ntwo")]
        docs = frame(spark, rows)
        ranks = line_dedup._ranked(line_dedup.line_ids(docs), ["line"], "ranks", once=True)
        sizes.append([ranks.count(), line_dedup.doubled(ranks, 1).count()])
        got = line_dedup.deduplicated(docs).collect()
        assert len(got) == copies + 2
        assert {(r.doc_id, r.text) for r in got} == {(None, ""), (1, text), (2, "one\ntwo")}
    assert sizes[0] == sizes[1]


def test_suffix_ranks_are_in_order(spark):
    rows = [(1, "b\na\nb\na"), (2, "a\nb\na\nc"), (3, "b\na")]
    ranks = line_dedup._ranked(line_dedup.line_ids(frame(spark, rows)), ["line"], "ranks", once=True)
    one = {(r["_id"], r.pos): r["rank"] for r in ranks.collect()}
    two = {(r["_id"], r.pos): r["rank"] for r in line_dedup.doubled(ranks, 1).collect()}
    assert set(two) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)}
    order = lambda p: (one[p], one[p[0], p[1] + 1])
    assert all((two[a] < two[b]) == (order(a) < order(b)) for a in two for b in two)


def test_simhash_components(spark, docs):
    got = simhash.near_duplicates(frame(spark, docs), words=4, distance=4).collect()
    fps = [brute.fingerprint(t, 4) for _, t in docs]
    root = brute.components(fps, 4)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root[k]] = min(x for x in (least.get(root[k], float("inf")), float("inf") if i is None else i))
    least = {r: None if i == float("inf") else i for r, i in least.items()}  # null: no row of the component has an id
    assert sorted((key(r.id), r.fp % (1 << 64), r.component) for r in got) == sorted((key(i), fps[k], least[root[k]]) for k, (i, _) in enumerate(docs))


def test_simhash_crowded_sections(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SECTION", 8)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash._components(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).collect()
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(r.fp % (1 << 64))
    want = {}
    for f, c in zip(fps, brute.components(fps, 4)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("entries, keys", [(1000, 5), (1 << 22, 5), (1 << 23, 15), (1 << 31, 35)])
def test_near_fingerprints_agree_on_some_choice_of_blocks(entries, keys):
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(4, entries)]
    assert len(masks) == keys and len(set(masks)) == keys
    rng = random.Random(entries)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 4))
        assert any(a & m == b & m for m in masks)


def test_simhash_with_longer_keys(spark, monkeypatch):
    """The same components whatever the number of blocks that must agree."""
    rng = random.Random(21)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 6))) for f in fps for _ in range(3)]
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    frame_of = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute.components([f & (1 << 64) - 1 for f in signed], 4)
    for entries in (1, 1 << 23, 1 << 31):
        plain = simhash.block_masks
        monkeypatch.setattr(simhash, "block_masks", lambda distance, _, e=entries: plain(distance, e))
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame_of, 4)).collect()}
        monkeypatch.setattr(simhash, "block_masks", plain)
        groups = {}
        for f, c in zip(signed, want):
            groups.setdefault(c, set()).add(roots.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_one_representative_for_each_component(spark, docs):
    rows = docs + [(41, docs[3][1]), (3, docs[3][1])]
    kept = simhash.representatives(frame(spark, rows), words=4, distance=4).collect()
    fps = [brute.fingerprint(t, 4) for _, t in rows]
    root = brute.components(fps, 4)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[root[k]] = min(best.get(root[k], (2, 0)), key(i))
    assert sorted(key(r.doc_id) for r in kept) == sorted(best.values())
    assert kept[0].chunk == 2


def test_bpe_round_trip(spark, docs):
    import tiktoken

    words = queries.vocabulary()
    rows = docs + [(50, "  two  spaces \n\n\tand tabs x 'tis don't 12345 Ⅷ 漢字 emoji 🙂🙂 end  "), (50, "again"), (51, "\u0000​")]
    enc = tiktoken.Encoding("plain", pat_str=words.pattern, mergeable_ranks=words.ranks(), special_tokens={})
    ids = bpe.encoded(frame(spark, rows), words)
    out = bpe.decoded(ids, words).collect()
    want = [(key(i), enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted((key(r.id), r.n_tokens, bytes(r.ids_bytes), bytes(r.decoded)) for r in out) == \
        sorted((i, len(x), struct.pack(f"<{len(x)}I", *x), b) for i, x, b in want)


def test_bpe_cuts_long_texts_where_nothing_crosses(monkeypatch):
    import regex

    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "'s", "12", "é", " ?!"]) for _ in range(4000))
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    split = regex.compile(queries.vocabulary().pattern).findall
    pieces = list(bpe._pieces(text))
    assert len(pieces) > 50 and [w for p in pieces for w in split(p)] == split(text)


def test_decoding_unknown_ids_fails(spark):
    wrong = spark.createDataFrame([(1, [5, 10_000_000]), (2, None)], "id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decoded(wrong, queries.vocabulary()).collect()
    fine = bpe.decoded(wrong.filter("id = 2"), queries.vocabulary(), keep_ids=True).collect()
    assert (fine[0].n_tokens, bytes(fine[0].decoded)) == (0, b"")


def test_suffix_tree_scores(spark, docs):
    got = suffix_tree.scored(frame(spark, docs), F.col("doc_id") % 5 != 1).collect()
    want = brute.tree_scores([(t, i is not None and i % 5 != 1) for i, t in docs], suffix_tree.PSEUDO, suffix_tree.PENALTY)
    a = sorted((key(r.id), r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    b = sorted((key(i), *w) for (i, _), w in zip(docs, want))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(x[3] == pytest.approx(y[3]) and x[4] == pytest.approx(y[4], rel=1e-5) for x, y in zip(a, b))
    assert any(x[4] > x[3] for x in a)


def test_suffix_tree_with_hot_words(spark, monkeypatch):
    """A word that a third of all tokens are, split over owners, has the same states; no owner holds all that follows it."""
    rng = random.Random(14)
    rows = [(k, " ".join(x for _ in range(rng.randint(1, 60)) for x in ("the", rng.choice(["of", f"w{int(rng.paretovariate(0.5)) % 400}", "of the", "cat sat on"])))) for k in range(150)]
    rows += [(200 + k, rows[k][1]) for k in range(20)] + [(300, ""), (301, None), (302, "the"), (303, "the the the the")]
    want = brute.tree_scores([(t, i % 5 != 1) for i, t in rows], suffix_tree.PSEUDO, suffix_tree.PENALTY)
    for most in (1 << 22, 60, 3):
        monkeypatch.setattr(suffix_tree, "HOT_TOKENS", most)
        got = {r.id: r for r in suffix_tree.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 5 != 1).collect()}
        for (i, _), (n, known, base, score) in zip(rows, want):
            assert (got[i].n_tokens, got[i].n_known) == (n, known)
            assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score, rel=1e-5, abs=1e-6), (most, i)
    assert any(w[3] > w[2] for w in want)


def test_suffix_tree_without_training(spark):
    got = suffix_tree.scored(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 2


def labelled(n=240):
    rng = random.Random(9)
    words = ["".join(rng.choice(["an", "er", "th", "in", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if k % 4 == 0:
            for _ in range(6):
                body[rng.randrange(len(body))] = rng.choice(["idiot", "moron", "scumbag"])
        docs.append((k, " ".join(body)))
        labels.append((k, 0, int(k % 4 == 0)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = labelled()
    docs += [(1000, ""), (1001, None), (None, docs[0][1]), (5, docs[5][1])]
    marks = spark.createDataFrame(labels + [(2000, 0, 1), (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    table = frame(spark, docs)
    model = toxicity.fit(table, marks, F.col("key") % 3 != 0)
    got = toxicity.scores(table, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score, r.id % 4 == 0) for r in got if r.id is not None and r.id < 1000 and r.id % 3 == 0]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum(a > b for a in toxic for b in clean) / len(toxic) / len(clean) > 0.9
    kept = toxicity.without_toxic(table, model, 0.3)
    assert kept.columns == table.columns
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted(key(r.id) for r in got if r.score < 0.3)


def test_toxicity_learns_from_long_documents(spark):
    """Labelled texts of any length count, and so does the end of a long one."""
    docs, labels = labelled()
    filler = "some quiet words that say nothing at all about anyone " * 700
    long = [(i, (filler + " " + (t + " ") * 40 if i % 2 else (t + " ") * 40 + filler)) for i, t in docs]
    assert min(len(t) for _, t in long) > toxicity.MAX_CHARS
    model = toxicity.fit(spark.createDataFrame(long, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.id: r.score for r in toxicity.scores(spark.createDataFrame(long, "doc_id long, text string"), model).collect()}
    marked = {i: m for i, _, m in labels if m is not None}
    pairs = [(found[i] > found[j]) for i in marked for j in marked if i in found and j in found and marked[i] == 1 and marked[j] == 0]
    assert np.mean(pairs) > 0.9


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """One row for an id, however often it is there; labels without a document take no place in the sample."""
    docs, labels = labelled()
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 30)
    monkeypatch.setattr(toxicity, "MAX_ORDINARY", 40)
    seen = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda toxic, ordinary: seen.append((len(toxic), len(ordinary))) or plain(toxic, ordinary))
    again = [(labels[0][0], f"{k} words of a row with the same id") for k in range(2000)]
    absent = [(10**6 + k, 0, k % 2) for k in range(3000)]
    toxicity.fit(spark.createDataFrame(docs + again, "doc_id long, text string"), spark.createDataFrame(labels + absent, "doc_id long, quality int, toxic int"))
    assert seen[-1] == (30, 40)


def test_toxicity_without_both_labels(spark):
    docs, labels = labelled(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-9 for r in toxicity.scores(frame(spark, docs), toxicity.fit(frame(spark, docs), none)).collect())
    only = spark.createDataFrame([(k, 0, 1) for k in range(5)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in toxicity.scores(frame(spark, docs), toxicity.fit(frame(spark, docs), only)).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>One</a>
<li>Two <ol start=3><li>a<li>b</ol><li>Three</ul></nav><p>Hello <b>bold</b>, world&amp;co<p>Second para<br>line two
<div hidden>no</div><div style="display: none">no</div><!-- no --><table><caption>Cap</caption><tr><th>Name<th>Value<tr><td>a<td>100<tr><td>longer name</td>
<td>2</td></tr><tr><td colspan=2>wide cell text</table>after<pre>  keep
   this</pre><details><summary>Sum</summary>no</details><hr>&copy; end</body></html>"""

SHOWN = """- One
- Two
  3. a
  4. b
- Three

Hello bold, world&co

Second para
line two

Cap
Name        | Value
a           | 100
longer name | 2
wide cell text

after

  keep
   this

Sum

---

© end"""


def test_html_layout():
    assert html_text.extract(PAGE) == SHOWN


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain", "plain"), ("a<b", "a"), ("<p>a</p></p>b", "a\n\nb"), ("<p>a<!-- b", "a"), ("x<br>y</br>z", "x\ny\nz"),
    ("<td>a</td><li>b", "a\n- b"), ("<div>" * 50_000 + "deep", "deep"), ("<table>" * 500 + "x", "x"), ("&lt;p&gt; &nbsp;", "<p>"),
    ("<script>a</script", ""), ("<ul><li>a<ul><li>b</ul></ul>", "- a\n  - b"), ("<table><tr><td>" + "w" * 500 + "<td>b<tr><td>c<td>d</table>", "w" * 500 + " | b\nc | d"),
])
def test_html_cases(html, text):
    assert html_text.extract(html) == text


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[dict[int, str]]:
    """Plain version: each cell written into all places of a grid that it spans; (row) column -> text of cells that start there."""
    grid: dict[tuple[int, int], str | None] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, wide, down in row:
            while (r, c) in grid:
                c += 1
            for i in range(down):
                for j in range(wide):
                    grid[r + i, c + j] = text if i == j == 0 else None
            c += wide
    return [{c: t for (r, c), t in sorted(grid.items()) if r == k and t is not None} for k in range(len(rows))]


def test_cells_that_span_rows_keep_their_columns():
    assert html_text.extract("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert html_text.extract("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"
    rng = random.Random(3)
    for _ in range(200):
        rows = [[(f"{r}{chr(97 + c)}", 1, rng.choice([1, 1, 1, 2, 3])) for c in range(rng.randint(1, 4))] for r in range(5)]
        found = []
        for line in html_text._placed(rows):
            at, cells = 0, {}
            for text, span in line:
                if text:
                    cells[at] = text
                at += span
            found.append(cells)
        assert found == _grid(rows)
    many = "<table>" + "<tr>" + "<td rowspan=9999 colspan=1000>x" * 50 + "<tr><td>y" * 3000 + "</table>"
    assert html_text.extract(many).count("y") == 3000


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((key(r.id), r.text) for r in html_text.extracted(pages).collect() if r.text is not None) == [((False, 1), SHOWN)] * 2 + [((False, 2), "")]
    assert [r.text for r in html_text.extracted(pages).filter("id is null").collect()] == [None]


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    words = queries.vocabulary()
    assert suffix_dedup.repeated_removed(empty).count() == 0
    assert line_dedup.deduplicated(empty).count() == 0
    assert simhash.near_duplicates(empty, 4, 4).count() == 0
    assert simhash.representatives(empty, 4, 4).count() == 0
    assert bpe.decoded(bpe.encoded(empty, words), words).count() == 0
    assert suffix_tree.scored(empty, F.lit(True)).count() == 0
    assert toxicity.scores(empty, toxicity.fit(empty, none)).count() == 0
    assert html_text.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_query_digests(spark, tmp_path, docs):
    """The registered queries' digest columns, from the operators' real results."""
    rows = [(i, t, "en", "s", 1) for i, t in docs if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute.repeated_spans([r[:2] for r in rows], 50)
    got = {r.doc_id: r for r in queries.QUERIES["op1_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    for (i, t, *_), (spans, kept) in zip(rows, want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len((t or "").encode()), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    hexes = {r.doc_id: r.fingerprint for r in queries.QUERIES["op9_simhash_near_dedup"](spark, str(tmp_path)).collect()}
    assert hexes == {i: f"{brute.fingerprint(t, 4):016x}" for i, t, *_ in rows}


def test_byte_planes():
    import numpy as np

    values = np.array([0, 1, 255, 256, 70_000, (1 << 32) - 1], np.uint64)
    assert (chunks.unplaned(chunks.planes(values)) == values).all()
    assert (chunks.unplaned(chunks.planes(values << np.uint64(20), "<u8"), "<u8") == values << np.uint64(20)).all()
