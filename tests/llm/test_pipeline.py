"""The pipeline, stage by stage, against plain versions; its stages on an empty table."""

import random
from collections import Counter

import corpus_pipeline
from opsframe.llm import mixing, queries, toxicity
from tests.llm import brute
from tests.llm.test_texts import labelled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    import tiktoken

    rng = random.Random(8)
    docs, labels = labelled(160)
    docs = [(i, t.replace(" ou ", "\n")) for i, t in docs]
    docs += [(500 + k, docs[k][1]) for k in range(10)] + [(600, ""), (601, None), (None, "nobody's text, with enough words to stand alone here")]
    shared = "a long line that many documents hold, word for word, as it is"
    docs += [(700 + k, shared + "\n" + " ".join(rng.choice(["red", "green", "blue"]) for _ in range(40))) for k in range(6)]
    rows = [(i, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at, results = first, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        results.append([tuple(r) for r in at.collect()])
        if name != "byte_bpe":
            assert at.dtypes == first.dtypes
    clean, cut, single, mix, ids = results

    model = toxicity.fit(first, spark.read.parquet(f"{tmp_path}/labels.parquet"), queries.remainder("key", 4) != 2)
    low = {r.id for r in toxicity.scores(first, model).collect() if r.score < 0.3}
    assert sorted(map(str, clean)) == sorted(str(r) for r in rows if r[0] in low)

    lines = brute.kept_lines([r[:2] for r in clean], 40)
    want = {clean[k][0]: "\n".join(x) for k, x in lines.items() if x}
    assert {r[0]: r[1] for r in cut if r[1] is not None} == want
    assert all(r[4] == len(r[1]) for r in cut if r[1] is not None)

    fps = [brute.fingerprint(r[1], 4) for r in cut]
    best = {}
    for k, c in enumerate(brute.components(fps, 4)):
        best[c] = min(best.get(c, (True, 0)), (cut[k][0] is None, cut[k][0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in single) == sorted(best.values())
    assert {r[0]: r for r in single}.items() <= {r[0]: r for r in cut}.items()

    drawn = mixing.drawn(spark.read.parquet(f"{tmp_path}/simhash_near_dedup")).collect()
    assert Counter(r[0] for r in mix) == Counter({r.id: len(r.copies) for r in drawn if r.copies})

    words = queries.vocabulary()
    enc = tiktoken.Encoding("plain", pat_str=words.pattern, mergeable_ranks=words.ranks(), special_tokens={})
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in ids) == \
        sorted((r[0] is None, r[0] or 0, len(enc.encode(r[1] or "")), enc.encode(r[1] or "")) for r in mix)

    whole = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, whole)) == sorted(map(str, ids))


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.count() == 0
