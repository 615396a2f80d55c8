"""Registered queries of the operators: each applies one operator, with its
production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import (ann, bpe, collocations, hard_negatives, html_text, line_dedup, mixing, secrets, simhash, suffix_dedup,
                          suffix_tree, topk, toxicity)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a 50-byte string of an earlier document covers are removed."""
    kept = suffix_dedup.repeated_removed(read(spark, sf_dir, "documents"), depth=50)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                       F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document, with its source's target, and the shards they go to."""
    drawn = mixing.drawn(read(spark, sf_dir, "documents"))
    return drawn.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.size("copies")).cast("long").alias("taken"), F.col("copies.shard").alias("shards"))


def remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo ``divisor`` (-1 for a null id)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(-1))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a suffix tree learned from those whose remainder is not 1."""
    docs = read(spark, sf_dir, "documents")
    found = suffix_tree.scored(docs, remainder("doc_id", 5) != 1)
    return found.select(F.col("id").alias("doc_id"), (remainder("id", 5) == 1).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of documents whose remainder is 2 are not learned from."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), remainder("key", 4) != 2)
    return toxicity.scores(docs, model).select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "score",
                                               (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows found for each query row."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    found = html_text.extracted(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows with the highest integer inner product with each query row."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256.0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines."""
    return line_dedup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of four-word shingles and component at four bits or fewer."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes they decode to."""
    words = vocabulary()
    found = bpe.decoded(bpe.encoded(read(spark, sf_dir, "documents"), words), words)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all kinds in every text."""
    found = secrets.scanned(read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(F.col("id").alias("doc_id"), *[of(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
                        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return collocations.collocations(read(spark, sf_dir, "documents"), words=3, least=10, share=50, first=2000)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors' positives; every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label, positives=5, negatives=5, share=80, scale=256.0)


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_mixing": op2_mixing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_toxicity": op4_toxicity,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_html_text": op6_html_text,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_secret_scan": op11_secret_scan,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}


def _secrets_sql() -> str:
    """Each rule's matches with all places, in the order of the rules."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = "\n  union all ".join(
        f"select doc_id, {n} as place, '{r.kind}' as kind, {r.least} as least, string_split_regex(body, {quoted(r.pattern)}) as pieces, "
        f"regexp_extract_all(body, {quoted(r.pattern)}) as matches, regexp_extract_all(body, {quoted(r.pattern)}, {r.group}) as asked "
        f"from texts where regexp_matches(body, {quoted(r.pattern)})" for n, r in enumerate(secrets.RULES))
    return f"""
with texts as (select doc_id, coalesce(text, '') as body from documents),
found as (
  {each}),
numbered as (select *, unnest(range(len(matches))) as i from found),
placed as (
  select doc_id, place, kind, length(matches[i + 1]) as size,
    list_sum(list_transform(pieces[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:i], lambda x: length(x))), 0) as start
  from numbered where length(asked[i + 1]) >= least),
spans as (select doc_id, place, kind, start, kind || ':' || start::bigint || ':' || (start + size)::bigint as span from placed),
by_text as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(span, ',' order by start, place) filter (place < 3) as base, string_agg(span, ',' order by start, place) as spans
  from spans group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join by_text using (doc_id)"""


#: SQL where it can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.w, v.w)::bigint as score
  from whole q join whole v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from scored qualify rank <= 5""",
    "op8_line_dedup": """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
sized as (select *, sum(length(line) + 1) over (partition by doc_id order by pos) as upto, length(line) + 1 as size from lines),
long as (
  select a.doc_id, a.pos as start, b.pos as stop from sized a
  join sized b on a.doc_id = b.doc_id and b.pos between a.pos and a.pos + 40 and b.upto - a.upto + a.size > 40),
runs as (select doc_id, start, min(stop) as stop from long group by all union select doc_id, max(start), stop from long group by all),
told as (
  select r.doc_id, r.start, r.stop, string_agg(line, chr(10) order by pos) as run
  from runs r join lines l on l.doc_id = r.doc_id and l.pos between r.start and r.stop group by all),
later as (select * from told qualify row_number() over (partition by run order by doc_id, start) > 1),
cut as (select distinct doc_id, unnest(range(start, stop + 1)) as pos from later),
marked as (select lines.*, cut.pos is not null as gone from lines left join cut using (doc_id, pos)),
started as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as starts from marked),
whole as (
  select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text, count(*) as n_lines,
    count(*) filter (gone) as n_removed, count(*) filter (starts) as n_runs
  from started group by doc_id)
select doc_id, whole.text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs
from documents left join whole using (doc_id)""",
    "op11_secret_scan": _secrets_sql(),
    "op12_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
cut as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces),
places as (select lang, words, unnest(range(len(words))) as i from cut),
phrases as (
  select lang, m, array_to_string(words[i + 1:i + m], ' ') as phrase, count(*)::hugeint as f
  from places, (values (1), (2), (3)) span(m) where i + m <= len(words) group by all),
totals as (select lang, sum(f)::bigint as n from phrases where m = 1 group by lang),
candidates as (select lang, m, phrase, f as a, string_split(phrase, ' ') as words from phrases where m > 1 and f >= 10),
inside as (
  select lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) as phrase, a from candidates where m = 3),
longest as (select lang, phrase, max(a) as longer from inside group by all),
kept as (select c.* from candidates c left join longest using (lang, phrase) where longer is null or 100 * longer < 50 * a),
cuts as (
  select lang, phrase, a, k, array_to_string(words[1:k], ' ') as head, array_to_string(words[k + 1:], ' ') as tail
  from kept, (values (1), (2)) split(k) where k < m),
scored as (
  select cuts.lang, cuts.phrase, a, k, h.f as l, t.f as r, 1000000 * a * a // (h.f * t.f) as score
  from cuts join phrases h on h.lang = cuts.lang and h.phrase = head join phrases t on t.lang = cuts.lang and t.phrase = tail),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a::bigint as a, l::bigint as l,
  r::bigint as r, n, score::bigint as score
from lowest join totals using (lang) qualify rank <= 2000""",
    "op13_hard_negatives": """
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as w
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label = v.label as same, v.vec_id, list_inner_product(a.w, v.w)::bigint as score
  from whole a join whole v on a.vec_id % 100 = 0 and v.vec_id <> a.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
negatives as (
  select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score
  from positives join scored using (anchor_id)
  where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id))::integer as rank,
  negative_id, positive_score, negative_score
from negatives qualify rank <= 5""",
}
