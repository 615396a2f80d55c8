"""Operator 7: exact top-k by inner product, accumulated term at a time.

A vector is a sparse row: its dimensions are terms, its components weights. Queries are
dealt into blocks, rows into sections, and each pair of a block and a section is a unit of work. A unit inverts
its section into postings (row, weight) for each term; then every term adds, for all
queries of the block, the weighted postings into a dense array of scores. A
partition selects the k best of each query, and the units' results merge.

Every query meets every row once. A unit's memory is bounded by block x section,
and neither side is collected or broadcast.

Defined cases: vectors null or holding null or non-finite components take no part, nor do rows with a
null id; of rows with one id the smallest vector stands for it; shorter vectors count as ending in
zeros, an empty one scores 0 with all; ties go to the smaller id; with fewer than k other
rows all come; extra columns are ignored; an empty table gives no rows. Weights and scores are
64-bit integers: if the largest weight, squared, times the longest vector's length may pass 2**63, ValueError is raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.chunks import parts, table
from opsframe.llm.vectors import clean, largest, matrix, merged

#: Queries of a block, and rows of a section at most.
BLOCK, SECTION = 1024, 8192


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of every row (first axis) for every query, by adding one term's postings after another."""
    scores = np.zeros((len(rows), len(queries)), np.int64)
    for term in range(min(queries.shape[1], rows.shape[1])):
        asked = queries[:, term]
        posting = np.flatnonzero(rows[:, term])
        if len(posting) and asked.any():
            scores[posting] += rows[posting, term][:, None] * asked
    return scores


def _unit(k: int):
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return kind.empty_table()
        r = r.sort_by("id")
        q_ids, r_ids = q.column("id").to_numpy(), r.column("id").to_numpy()
        rows, out = matrix(r.column("weights"), np.int64), []
        asked = matrix(q.column("weights"), np.int64)
        for low in range(0, len(q_ids), 128):
            scores = accumulate(asked[low:low + 128], rows)
            for i, own in enumerate(q_ids[low:low + 128]):
                one = scores[:, i]
                others = r_ids != own
                ids, one = (r_ids, one) if others.all() else (r_ids[others], one[others])
                at = largest(one, k)
                out.append((np.full(len(at), own), ids[at], one[at]))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=kind)

    return run


def top_k(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query. ``is_query`` is a condition on
    the column ``id``; weights are floor(scale * component)."""
    weights = F.transform("vector", lambda x: F.floor(x * scale).cast("long"))
    largest_part = F.array_max(F.transform("vector", F.abs))
    known = table(clean(rows, id_col, vector).select("id", weights.alias("weights"), largest_part.alias("top")), "weights")
    n, top, width = known.agg(F.count("id"), F.max("top"), F.max(F.size("weights"))).first()
    if top is not None and (top * abs(scale) + 1) ** 2 * width >= 2 ** 62:  # a factor of two for what doubles round off
        raise ValueError(f"a component of {top} times {scale} in {width} dimensions may pass 64-bit scores")
    known = known.drop("top")
    asked = known.filter(is_query)
    blocks = max(1, -(-asked.count() // BLOCK))
    sections = max(parts(rows.sparkSession), -(-n // SECTION))
    deal = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select("id", "weights", deal(blocks).alias("block"), every(sections).alias("section"))
    right = known.select("id", "weights", deal(sections).alias("section"), every(blocks).alias("block"))
    found = left.groupBy("block", "section").cogroup(right.groupBy("block", "section")).applyInArrow(
        _unit(k), "query_id long, vec_id long, score long")
    return merged(found, k)
