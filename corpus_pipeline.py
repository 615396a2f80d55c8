"""Training-corpus pipeline: five stages over ``documents``, each one operator.

Each stage works on all rows that the one before kept; ``run`` writes its result as Parquet in
the shared folder and reads it again for the next. All stages but the last return the columns of ``documents``.

Defined cases beyond those of the operators: an empty table passes every stage as an empty table; rows
with null ids or texts pass like others (without labels nothing is rejected as toxic); extra columns are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import bpe, line_dedup, mixing, queries, simhash, toxicity
from opsframe.llm.chunks import table
from opsframe.session import pinned, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the threshold stay."""
    model = toxicity.fit(docs, queries.read(spark, sf_dir, "labels"), queries.remainder("key", 4) != 2)
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which nothing is left."""
    cut = line_dedup.deduplicated(docs)
    kept = cut.filter("n_removed < n_lines or n_lines = 0")
    counted = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return kept.withColumns(counted).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates stays."""
    return simhash.representatives(docs, words=4, distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in shuffled shards."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids of each row, and a digest of the bytes they decode to."""
    words = queries.vocabulary()
    # written between encoding and decoding: a task then needs one Python worker at a time
    found = bpe.decoded(table(bpe.encoded(docs, words), "encoded"), words, keep_ids=True)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The classifier, the fingerprints, the mix and the encoding cannot be written in SQL; tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = queries.read(spark, sf_dir, "documents"), pinned(spark)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
        # the stage's result is written: what it and the stage before have left behind goes
        release(spark, keep=[*before, pinned(spark)[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
