"""Operator 4: toxicity by compression distance with two zstandard dictionaries.

*Fitting* uses a bounded sample of labelled rows: ``MAX_TOXIC`` and ``MAX_ORDINARY``
documents, in order of a hash of the id, one row for each id. A text of more than ``MAX_CHARS`` characters is represented there by
``PIECES`` pieces of it, evenly spread from its start to its end. Nothing else here is bounded. One dictionary is trained on ordinary text. The other is trained on toxic
text: on those words of it that recur among toxic documents and are at least
``CONTRAST`` times as frequent there, set before the same ordinary content. Windows of ordinary text
then compress alike under both, and a window with toxic words is shorter under the toxic one.

*Scoring* cuts every whole text into windows of about ``WINDOW`` bytes at
spaces, compresses each with both dictionaries, and takes a few figures of the differences
(largest, mean of the largest, shares over thresholds). A logistic curve
turns them into a score; it is calibrated on documents whose differences come from
dictionaries that did not see them (two folds), and moved to the share of toxic rows among all usable labels.

Only the text is an input of a score. Defined cases: null and empty text have one empty window and get a score
like any other; rows with a null id are scored but never fitted on; labels without a document, null labels, and
repeated labels (the larger one counts) are harmless; without labels of both kinds the score is the share of toxic
labels (0 without labels); very long texts keep one number for each window; extra
columns are kept by ``without_toxic`` and ignored by ``scores``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.chunks import give_back, table

#: The bound of the sample that the classifier is fitted on.
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS, PIECES = 1500, 3000, 20_000, 10
WINDOW = 64
LEVEL = 5
SHARED_BYTES, TOXIC_BYTES = 15 << 10, 768
#: A toxic word recurs (after different words) in this share of toxic documents, and is so many times as frequent there as elsewhere.
RECUR, CONTRAST = 0.015, 8
THRESHOLD = 0.3


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Cut at the first space after ``size`` bytes; a run without one is cut at three times that."""
    data, out, at = text.lower().encode(), [], 0
    while at < len(data):
        end = data.find(b" ", at + size, at + 3 * size)
        if end < 0:
            end = min(len(data), at + 3 * size)
        out.append(data[at:end])
        at = end
    return out or [b""]


def _words(text: str) -> list[bytes]:
    return [w.strip(b".,;:!?") for w in text.lower().encode().split()]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The last ``size`` bytes (the most useful segments) of a dictionary trained on the samples, padded at the front."""
    import zstandard

    try:
        content = zstandard.train_dictionary(size + 512, samples, k=segment, d=6, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        content = b" ".join(samples)
    return content[-size:].rjust(size, b" ")


def train(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary dictionary, toxic dictionary), as raw content of one size."""
    in_toxic, in_ordinary = (Counter(w for text in texts for w in set(_words(text))) for texts in (toxic, ordinary))
    often = {w for w, n in in_toxic.items() if w and n >= max(3, RECUR * len(toxic))
             and n / len(toxic) >= CONTRAST * (in_ordinary.get(w, 0) + 1) / (len(ordinary) + 1)}
    # copies of one document make its words recur: a word counts once after each different word
    after: dict[bytes, set[bytes]] = {w: set() for w in often}
    for text in toxic:
        words = _words(text)
        for before, word in zip([b"", *words], words):
            if word in often:
                after[word].add(before)
    marked = {w for w, n in after.items() if len(n) >= max(3, RECUR * len(toxic))}
    samples = [b" ".join(w for w in _words(text) if w in marked) for text in toxic]
    pieces = [w for text in ordinary for w in windows(text, 256)]
    pieces = [pieces[i] for i in np.random.default_rng(1).permutation(len(pieces))]
    shared = _trained(pieces, SHARED_BYTES, 64)
    filler = b"".join(pieces[:64])[:TOXIC_BYTES].rjust(TOXIC_BYTES, b" ")
    return filler + shared, _trained([s for s in samples if s], TOXIC_BYTES, 16) + shared


def _compressor(content: bytes):
    import zstandard

    kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=4 * WINDOW, dict_size=len(content), write_content_size=False)
    kind.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=kind).compress


def differences(text: str, ordinary, toxic) -> list[float]:
    """Figures of how much shorter a text's windows are under the toxic dictionary."""
    each = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], float)
    top, n = np.sort(each)[::-1], len(each)
    return [top[0], top[:2].mean(), top[:4].mean(), each.mean(), (each >= 2).mean(), (each >= 4).mean(), (each >= 6).mean(),
            math.log(n), top[:max(1, n // 20)].mean(), top[:max(1, n // 8)].mean()]


@dataclass
class Model:
    """Two dictionaries and the logistic curve over the differences."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scorer(self):
        ordinary, toxic = _compressor(self.ordinary), _compressor(self.toxic)

        def score(text: str | None) -> float:
            x = (np.array(differences(text or "", ordinary, toxic)) - self.mean) / self.spread
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.weights[0] + x @ self.weights[1:]))))

        return score


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method with a small ridge."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a, ridge = np.c_[np.ones(len(x)), (x - mean) / spread], 1e-3 * len(x) * np.eye(x.shape[1] + 1)
    ridge[0, 0] = 1e-9
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
    return mean, spread, w


def _represented(body: Column) -> Column:
    """The text itself, or ``PIECES`` pieces of a text that is too long, from its start to its end."""
    size = MAX_CHARS // PIECES
    at = [F.floor((F.char_length(body) - size) * (i / (PIECES - 1))).cast("int") + 1 for i in range(PIECES)]
    return F.when(F.char_length(body) <= MAX_CHARS, body).otherwise(F.concat_ws(" ", *[F.substring(body, a, size) for a in at]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """``usable``: a condition on the column ``key`` (the id) for labels that may be learned from."""
    marks = labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("mark")).filter("key is not null and mark in (0, 1)")
    marks = (marks if usable is None else marks.filter(usable)).groupBy("key").agg(F.max("mark").alias("mark"))
    bodies = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    marks = table(marks.join(bodies.select("key").distinct(), "key", "left_semi"), "marks")  # labels that have a document
    order = [F.xxhash64("key"), F.col("key")]
    chosen = (marks.filter("mark = 1").orderBy(*order).limit(MAX_TOXIC)
              .union(marks.filter("mark = 0").orderBy(*order).limit(MAX_ORDINARY)))
    found = bodies.join(F.broadcast(chosen), "key").select("key", "mark", _represented(F.col("body")).alias("body"))
    # of rows with one id the one with the smallest hash: at most MAX_TOXIC + MAX_ORDINARY rows
    one = found.groupBy("key", "mark").agg(F.min(F.struct(F.xxhash64("body"), "body"))["body"].alias("body"))
    sample = table(one.select("body", "mark", F.xxhash64("key").bitwiseAND(F.lit(1 << 20)).cast("boolean").alias("fold")), "sample")
    rows = sample.orderBy(F.xxhash64("body"), "body").collect()
    pick = lambda mark, folds: [r.body for r in rows if r.mark == mark and r.fold in folds]
    both = [(len(pick(1, [f])), len(pick(0, [f]))) for f in (False, True)]
    if not all(n for counts in both for n in counts):
        share = sum(r.mark for r in rows) / max(1, len(rows))
        level = -500.0 if share == 0 else 500.0 if share == 1 else math.log(share / (1 - share))
        return Model(b" " * 1024, b" " * 1024, np.zeros(10), np.ones(10), np.array([level] + [0.0] * 10))
    halves = {f: train(pick(1, [not f]), pick(0, [not f])) for f in (False, True)}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {f: tuple(map(_compressor, pair)) for f, pair in halves.items()}
        for b in batches:
            x = [differences(t, *tools[f]) for t, f in zip(b.column("body").to_pylist(), b.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("mark")], names=["x", "mark"])

    found = sample.repartition(12).mapInArrow(measured, "x array<double>, mark int").collect()
    found = sorted((tuple(r.x), r.mark) for r in found)
    mean, spread, weights = _calibrated(np.array([x for x, _ in found]), np.array([m for _, m in found], float))
    # the sample holds more toxic rows than the labels do: move the curve to their share
    counts = {r.mark: r["count"] for r in marks.groupBy("mark").count().collect()}
    weights[0] += math.log(counts[1] / counts[0]) - math.log(len(pick(1, [False, True])) / len(pick(0, [False, True])))
    return Model(*train(pick(1, [False, True]), pick(0, [False, True])), mean, spread, weights)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([score(x.as_py()) for x in b.column("body")], pa.float64())], names=["id", "score"])
            del b
        give_back()

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
            .mapInArrow(run, "id long, score double"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(x.as_py()) < threshold for x in b.column(at)], pa.bool_()))
            del b
        give_back()

    return docs.mapInArrow(run, docs.schema)
