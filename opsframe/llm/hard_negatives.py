"""Operator 13: hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. Angles obey the triangle inequality, so for an anchor a, a
row v and any reference r

    |angle(a, r) - angle(v, r)|  <=  angle(a, v)  <=  min(angle(a, r) + angle(v, r), 2 pi - that)

which gives an interval of cosines; times both norms it bounds the score, widened for rounding. Only rows whose
interval overlaps the scores that are asked for get their integer inner product.

Two searches run over the same stored angles. The first finds each anchor's positives: rows of its label whose upper
bound reaches the k-th best lower bound. The second takes the positives' scores as windows and scores rows of other labels
whose interval meets a window. Rows lie in sections (same nearest reference, ``SECTION`` rows on average, dealt by a
hash of the id) in order of their angle to that reference, so that a window first cuts out one stretch of a section.
A unit is a block of anchors and a section; its memory is bounded by both, and the partial results merge.

The references are fitted on a bounded sample (``SAMPLE`` rows, those with the smallest hash of the id); they decide what
is skipped, never what is found. Every row is indexed.

Defined cases: rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no part;
of rows with one id the smallest vector (then label) stands for it; shorter vectors count as ending in zeros, an empty
or zero vector scores 0 with all; ties go to the smaller id; with fewer than k rows all come; extra columns are ignored; an
empty table gives no rows. Scores are 64-bit integers: components too large for that raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.chunks import table
from opsframe.llm.vectors import finite, matrix

#: Anchors of a block, and rows of a section on average.
BLOCK, SECTION = 8192, 8192
#: Reference directions, and the rows that they are chosen from.
REFERENCES, SAMPLE = 16, 2000
#: Radians by which every angle may be off: arccos near 1 keeps half of a double's digits.
SLACK = 1e-7

_FOUND = "anchor_id long, positive_id long, vec_id long, score long"
_FOUND_SCHEMA = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def indexed_rows(rows: DataFrame, id_col: str, vector: str, label: Column, scale: float) -> DataFrame:
    """(id, label, weights array<long>): rows that take part, one for each id, written once."""
    found = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                        finite(F.col(vector).cast("array<double>")).alias("vector"))
    found = found.filter("id is not null and label is not null and vector is not null")
    one = found.groupBy("id").agg(F.min(F.struct("vector", "label")).alias("row"))
    known = table(one.select("id", "row.label", "row.vector"), "clean")
    width, top = known.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if top is not None and (top * abs(scale) + 1) ** 2 * width >= 2 ** 62:  # a factor of two for what doubles round off
        raise ValueError(f"a component of {top} times {scale} in {width} dimensions may pass 64-bit scores")
    return known.select("id", "label", F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("weights"))


def references(known: DataFrame) -> np.ndarray:
    """Unit vectors of sampled rows, each the one farthest from those before it."""
    hashed = F.xxhash64("id")
    sample = known.filter(F.exists("weights", lambda x: x != 0)).orderBy(hashed, "id").limit(SAMPLE).select("weights").toArrow()
    if not sample.num_rows:
        return np.zeros((1, 0))
    points = matrix(sample.column("weights"), np.float64)
    points /= np.linalg.norm(points, axis=1)[:, None]
    chosen, nearest = [0], points @ points[0]
    while len(chosen) < min(REFERENCES, len(points)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return points[chosen]


def with_angles(known: DataFrame, directions: np.ndarray) -> DataFrame:
    """Adds ``norm``, ``angles`` (to each reference) and ``near`` (the reference with the smallest angle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(pa.chunked_array([batch.column("weights")]), np.float64)
            shared = min(rows.shape[1], directions.shape[1])
            norm = np.sqrt((rows * rows).sum(axis=1))
            cosine = rows[:, :shared] @ directions[:, :shared].T / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(directions)), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm), lists, pa.array(angles.argmin(axis=1).astype(np.int32))],
                                             names=[*batch.schema.names, "norm", "angles", "near"])

    return known.mapInArrow(run, "id long, label long, weights array<bigint>, norm double, angles array<double>, near int")


def score_bounds(norm: float, angles: np.ndarray, norms: np.ndarray, row_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of rows with one anchor, safe against rounding."""
    apart = np.abs(row_angles - angles).max(axis=1) - SLACK
    total = row_angles + angles
    joint = np.minimum(total, 2 * np.pi - total).min(axis=1) + SLACK
    size = norm * norms
    room = size * 1e-9 + 1
    return np.floor(size * np.cos(np.minimum(joint, np.pi)) - room), np.ceil(size * np.cos(np.maximum(apart, 0)) + room)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class _Section:
    """Rows of one section in order of their angle to the reference they share."""

    def __init__(self, rows: pa.Table) -> None:
        near = rows.column("near")[0].as_py()
        angles = matrix(rows.column("angles"), np.float64)
        order = np.argsort(angles[:, near], kind="stable")
        self.near, self.angles = near, angles[order]
        self.own = self.angles[:, near]
        self.ids = rows.column("id").to_numpy()[order]
        self.labels = rows.column("label").to_numpy()[order]
        self.norms = rows.column("norm").to_numpy()[order]
        self.top = float(self.norms.max())
        self.weights = matrix(rows.column("weights"), np.int64)[order]

    def scores(self, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        shared = min(len(weights), self.weights.shape[1])
        return self.weights[at, :shared] @ weights[:shared]

    def stretch(self, norm: float, angles: np.ndarray, least: float) -> slice:
        """Rows whose angle to the reference leaves room for a score of ``least``."""
        size = norm * self.top
        if least <= size * 1e-9 + 1 or not size:
            return slice(0, len(self.ids))
        reach = np.arccos(min(1.0, (least - size * 1e-9 - 1) / size)) + SLACK
        return slice(np.searchsorted(self.own, angles[self.near] - reach, "left"), np.searchsorted(self.own, angles[self.near] + reach, "right"))


def _units(search):
    """Runs ``search(section, anchor)`` for all anchors of a block; it gives (positive ids, row ids, scores)."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _FOUND_SCHEMA.empty_table()
        section, out = _Section(rows), []
        for row in anchors.drop_columns(["block", "section"]).to_pylist():
            anchor = {name.removeprefix("anchor_"): value for name, value in row.items()}
            anchor["weights"], anchor["angles"] = np.array(anchor["weights"], np.int64), np.array(anchor["angles"])
            for positive, ids, scores in search(section, anchor):
                out.append((np.full(len(ids), anchor["id"]), np.full(len(ids), positive), ids, scores))
        if not out:
            return _FOUND_SCHEMA.empty_table()
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=_FOUND_SCHEMA)

    return run


def _positives(k: int):
    def search(section: _Section, anchor: dict):
        at = np.flatnonzero((section.labels == anchor["label"]) & (section.ids != anchor["id"]))
        if len(at) > k:
            low, high = score_bounds(anchor["norm"], anchor["angles"], section.norms[at], section.angles[at])
            at = at[high >= np.partition(low, len(low) - k)[len(low) - k]]
        scores = section.scores(anchor["weights"], at)
        first = best(scores, section.ids[at], k)
        yield -1, section.ids[at][first], scores[first]

    return search


def _negatives(k: int):
    def search(section: _Section, anchor: dict):
        windows = [w for w in anchor["windows"] if w["least"] <= w["most"]]
        if not windows:
            return
        least, most = min(w["least"] for w in windows), max(w["most"] for w in windows)
        part = section.stretch(anchor["norm"], anchor["angles"], least)
        at = part.start + np.flatnonzero(section.labels[part] != anchor["label"])
        low, high = score_bounds(anchor["norm"], anchor["angles"], section.norms[at], section.angles[at])
        meets = np.zeros(len(at), bool)
        for w in windows:
            meets |= (high >= w["least"]) & (low <= w["most"])
        at = at[meets]
        scores, ids = section.scores(anchor["weights"], at), section.ids[at]
        if not len(scores) or scores.max() < least or scores.min() > most:
            return
        for w in windows:
            inside = np.flatnonzero((scores >= w["least"]) & (scores <= w["most"]))
            first = inside[best(scores[inside], ids[inside], k)]
            if len(first):
                yield w["positive_id"], ids[first], scores[first]

    return search


def _searched(anchors: DataFrame, rows: DataFrame, blocks: int, sections: int, search) -> DataFrame:
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # columns under new names: both sides come from one table, and a cogroup tells them apart by column
    left = anchors.select(*[F.col(c).alias(f"anchor_{c}") for c in anchors.columns], dealt.alias("block"), every(sections).alias("section"))
    right = rows.select("id", "label", "weights", "norm", "angles", "near", F.col("section").alias("part"), every(blocks).alias("place"))
    return left.groupBy("block", "section").cogroup(right.groupBy("place", "part")).applyInArrow(_units(search), _FOUND)


def mined(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, share: int = 80,
          id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    best ``positives`` rows of the same label, the best ``negatives`` rows of other labels that score at least ``share``
    percent of the positive and no more than it. ``is_anchor`` is a condition on ``id``, ``label`` a column of ``rows``."""
    known = indexed_rows(rows, id_col, vector, label, scale)
    directions = references(known)
    stored = table(with_angles(known, directions), "angles")
    counts = dict(stored.groupBy("near").count().collect())  # one row for each reference
    asked = stored.filter(is_anchor).select("id", "label", "weights", "norm", "angles")
    blocks = max(1, -(-asked.count() // BLOCK))
    pieces = [max(1, -(-counts.get(r, 0) // SECTION)) for r in range(len(directions))]
    firsts = [sum(pieces[:r]) for r in range(len(pieces))]
    of = lambda numbers: F.array(*[F.lit(n) for n in numbers])[F.col("near")]
    placed = stored.withColumn("section", (of(firsts) + F.pmod(F.xxhash64("id"), of(pieces))).cast("int"))

    first = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    found = _searched(asked, placed, blocks, sum(pieces), _positives(positives))
    best_of = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives)
    kept = table(best_of.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    exact = F.col("positive_score").cast("decimal(38,0)")
    least = F.ceil(exact * share / 100).cast("long")
    window = F.struct("positive_id", least.alias("least"), F.col("positive_score").alias("most"))
    windows = kept.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(window).alias("windows"))  # at most ``positives`` each
    found = _searched(asked.join(windows, "id"), placed, blocks, sum(pieces), _negatives(negatives))
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "vec_id")
    best_of = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return best_of.join(kept, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
