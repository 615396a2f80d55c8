"""Operator 9: SimHash near-duplicates found through a Gray-order hierarchical index.

1. A task turns each whole text into a 64-bit fingerprint of its word shingles.
   Equal fingerprints become one entry, so copies cost nothing further.
2. Of ``distance + k`` blocks of bits, two fingerprints within ``distance`` bits agree wholly on k (pigeonhole). Each entry is sent once
   for each choice of k blocks, to the section of the index that holds its values there. k grows with the number of
   entries, so that a section of evenly spread fingerprints stays at ``SECTION`` entries: for a distance of 4, five keys of 12 bits up to 4
   million entries, 15 of 21 bits up to 2 billion, 35 of 27 bits beyond. Sections that hold more all the same (likenesses) are cut by a hash, and each pair of pieces becomes a unit
   of its own, so a crowded section is spread over tasks without losing a pair.
3. In a unit, entries are sorted by Gray rank. A leaf stands for one entry, a node for a
   run of ``FAN`` children, and holds the bits that all below it share (mask
   and value) less those its parent has already. A query goes from the top nodes down,
   adding up the bits that differ, and leaves out every node whose sum exceeds the distance.
4. A unit returns only the links of a spanning forest of what it found; the components
   of all links come from distributed contraction.

Defined cases: null or blank text has fingerprint zero, which links like any other; fewer
words than the shingle length give one shingle of them all; a null id takes part
in linking, but is never a component's id unless all its rows' ids are null; every input row gives
one row, repeated rows and ids included; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.chunks import give_back, parts, ranges, table
from opsframe.llm.components import components

#: Entries of a section that one piece holds.
SECTION = 1024
#: Children of a node of the index.
FAN = 8
#: Queries that go down the index together.
TOGETHER = 512
#: Shingles hashed at once, for texts of any length.
SHINGLES = 1 << 18


def fingerprint(text: str | None, words: int) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: only A-Z fold, only ASCII space parts words
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends + 1 - sizes
    width = min(words, len(tokens))
    starts, ends = starts[:len(starts) - width + 1].tolist(), ends[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + SHINGLES], ends[at:at + SHINGLES])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """(id, fp) of every row; ``fp`` as a signed long. ``marked``: with ``mark``, a hash of the text."""
    more = ["mark"] if marked else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column("body")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64)), *[batch.column(c) for c in more]], names=["id", "fp", *more])
            del batch
        give_back()

    body = F.col(text).cast("string")
    return (docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"), *[F.xxhash64(body).alias(c) for c in more])
            .mapInArrow(run, ", ".join(["id long", "fp long", *[f"{c} long" for c in more]])))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Entries of many units, each under its own top nodes. Levels go from leaves up."""

    def __init__(self, unit: np.ndarray, codes: np.ndarray) -> None:
        self.order = np.lexsort((gray_rank(codes), unit))
        codes, unit = codes[self.order], unit[self.order]
        self.codes = codes
        level = {"unit": unit, "all": codes, "any": codes, "first": None, "count": None}
        levels = [level]
        while len(np.unique(level["unit"])) < len(level["unit"]):
            unit = level["unit"]
            head = np.concatenate(([True], unit[1:] != unit[:-1]))
            place = np.arange(len(unit)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            first = np.flatnonzero(place % FAN == 0)
            level = {"unit": unit[first], "all": np.bitwise_and.reduceat(level["all"], first),
                     "any": np.bitwise_or.reduceat(level["any"], first), "first": first,
                     "count": np.diff(np.append(first, len(unit)))}
            levels.append(level)
        above = np.zeros(len(levels[-1]["unit"]), np.uint64)
        for level in reversed(levels):
            shared = level["all"] | ~level["any"]
            level["mask"], level["value"] = shared & ~above, level["all"]
            if level["first"] is not None:
                above = np.repeat(shared, level["count"])
        self.levels = levels

    def within(self, unit: np.ndarray, codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, entry) of one unit at most ``distance`` bits apart, some queries at a time."""
        top = self.levels[-1]
        for low in range(0, len(codes), TOGETHER):
            query = np.arange(low, min(low + TOGETHER, len(codes)))
            # a unit has one top node at most
            node = np.searchsorted(top["unit"], unit[query])
            there = node < len(top["unit"])
            there[there] = top["unit"][node[there]] == unit[query][there]
            query, node = query[there], node[there]
            differ = np.zeros(len(query), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                differ = differ + np.bitwise_count((codes[query] ^ level["value"][node]) & level["mask"][node])
                near = differ <= distance
                query, node, differ = query[near], node[near], differ[near]
                if depth:
                    count = level["count"][node]
                    node = ranges(level["first"][node], count)
                    query, differ = np.repeat(query, count), np.repeat(differ, count)
            yield query, self.order[node]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n members the smallest member that the pairs connect it with."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _linked(distance: int):
    def run(t: pa.Table) -> pa.Table:
        codes = t.column("fp").to_numpy().view(np.uint64)
        side = t.column("side").to_numpy()
        keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("block", "value", "i", "j")], axis=1)
        _, unit = np.unique(keys, axis=0, return_inverse=True)
        entries, queries = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        index = GrayIndex(unit[entries], codes[entries])
        found = ((queries[q], entries[e]) for q, e in index.within(unit[queries], codes[queries], distance))
        root = _forest(len(codes), found)
        tied = np.flatnonzero(root != np.arange(len(codes)))
        fp = codes.view(np.int64)
        return pa.table({"a": fp[root[tied]], "b": fp[tied]})

    return run


def block_masks(distance: int, entries: int) -> list[int]:
    """Masks (signed 64-bit) of the choices of k out of ``distance + k`` blocks, for the smallest k that leaves ``SECTION`` entries to a value."""
    for k in range(1, 9):
        ends = [64 * (b + 1) // (distance + k) for b in range(distance + k)]
        blocks = [((1 << e) - 1) ^ ((1 << a) - 1) for a, e in zip([0, *ends], ends)]
        masks = [reduce(or_, choice) for choice in combinations(blocks, k)]
        if entries <= SECTION << min(m.bit_count() for m in masks):
            break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b) fingerprints whose components are those of all pairs within ``distance`` bits.
    ``fps``: one column ``fp`` of distinct values."""
    if not 0 <= distance < 16:
        raise ValueError("distance must be from 0 to 15 bits")
    entries = fps.count()
    masks = block_masks(distance, entries)
    bits = [F.struct(F.lit(b).alias("block"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for b, mask in enumerate(masks)]
    sent = fps.select("fp", F.inline(F.array(*bits)))
    crowded = (sent.groupBy("block", "value").count().filter(F.col("count") > SECTION)
               .select("block", "value", F.ceil(F.col("count") / SECTION).cast("int").alias("pieces")))
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    units = (sent.join(crowded, ["block", "value"], "left")
             .select("fp", "block", "value", F.coalesce("pieces", F.lit(1)).alias("pieces"))
             .withColumn("piece", piece)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
             .select("fp", "block", "value", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"),
                     F.when(F.col("piece") == F.col("other"), 2).otherwise((F.col("piece") > F.col("other")).cast("int")).alias("side")))
    n = max(parts(fps.sparkSession), entries * len(masks) // (16 * SECTION))
    dealt = F.pmod(F.xxhash64("block", "value", "i", "j"), F.lit(n)).cast("int")
    return units.withColumn("bin", dealt).groupBy("bin").applyInArrow(_linked(distance), "a long, b long")


def _components(distinct: DataFrame, distance: int) -> DataFrame:
    """With ``root``: the fingerprint that stands for the component of ``fp``."""
    roots = components(links(distinct.select("fp"), distance))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int, distance: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id of its component."""
    rows = table(fingerprints(docs, words, id_col, text), "fingerprints")
    known = _components(table(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct"), distance)
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    named = known.join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def representatives(docs: DataFrame, words: int, distance: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, unchanged: that with the smallest id (null last), of rows
    with one id that whose text has the smallest hash, and one of wholly equal texts."""
    place = F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"), F.col("mark"))
    mark = F.xxhash64(F.col(text).cast("string"))
    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    # one fingerprint for each (id, text); the shuffle carries hashes, not texts
    rows = table(fingerprints(marked, words, "id", "body", marked=True), "fingerprints")
    known = _components(table(rows.groupBy("fp").agg(F.min(place).alias("first")), "distinct"), distance)
    chosen = known.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).isNull().alias("unnamed"),
                         F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), mark.alias("mark"))
    kept = packed.join(chosen, ["unnamed", "id", "mark"], "left_semi")
    one = Window.partitionBy("unnamed", "id", "mark").orderBy(F.lit(0))
    return kept.withColumn("nth", F.row_number().over(one)).filter("nth = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
