"""Operator 12: phrase collocations, counted by a multikey three-way quicksort of suffix pointers.

A text is cut into pieces and words; every word of a piece starts a suffix of at most ``words`` words.

* Word counts come first: the words of each language with all their occurrences (``word_counts``). Words with more than
  ``OWNER_TOKENS`` occurrences are *hot*; there is at most one for so many tokens of the corpus, and only they are sent to all tasks.
* Chunks of text send each different suffix once, with its count (``merged``). A suffix is routed by its leading words, up to and
  including the first that is not hot. So no owner gets more than ``OWNER_TOKENS`` suffixes behind one route, whatever word or
  pair of words fills the corpus, and all suffixes that share these words meet.
* An owner sorts pointers to the suffixes it got by the quicksort (``partitioned``): a segment of suffixes that agree in d words is
  split at a pivot into the parts with a smaller, an equal and a greater next word. An equal part of depth d holds all suffixes that
  start with one phrase of d words, so its size, counts added, is the phrase's frequency. Parts below the threshold are abandoned. Where
  the route is longer than the phrase (hot words only), several owners hold parts of it: they report their sizes unabandoned and the sums decide.
* Candidates are joined with the counts of their parts and scored in DECIMAL(38, 0), which is exact up to frequencies of 10**16.

A (chunk, owner) fragment is one row of compressed arrays, so there are never more rows than different suffixes. Words are
compared as bytes throughout; no hash stands for a word, hashes only choose owners.

Defined cases: null text is empty and has no words; a null language is ``und``; ids take no part, so null ids and repeated rows
count as often as they are there; very long texts are worked off in slices that end where a piece ends (a piece without a break stays whole); a very long word is
a word; equal scores and frequencies go by the phrase's UTF-8 bytes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.chunks import binary_parts, pack_binary, parts, planes, table, unplaned

#: Bytes of text that a chunk gathers before it sends what it counted.
CHUNK_BYTES = 8 << 20
#: Suffixes that one owner holds on average, and that one route may hold at most.
OWNER_TOKENS = 1 << 20
#: Shares of a language's phrases that are ranked apart before they are ranked together.
SHARES = 64

_GAP = np.isin(np.arange(256), list(b"\x20\x09"))
_BREAK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_FRAGMENT = "owner int, langs string, letters binary, lengths binary, suffixes binary, counts binary"
_FRAGMENT_SCHEMA = pa.schema([("owner", pa.int32()), ("langs", pa.string()), ("letters", pa.binary()), ("lengths", pa.binary()),
                              ("suffixes", pa.binary()), ("counts", pa.binary())])
_COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])
_COUNT = "lang string, phrase string, size int, n long"


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in slices of about a chunk, each but the last ending with a break."""
    low = 0
    while len(data) - low > CHUNK_BYTES:
        breaks = np.flatnonzero(_BREAK[data[low:low + CHUNK_BYTES]])
        if not len(breaks):
            breaks = np.flatnonzero(_BREAK[data[low:]])[:1]
        if not len(breaks):
            break
        yield data[low:low + int(breaks[-1]) + 1]
        low += int(breaks[-1]) + 1
    yield data[low:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[str]]]:
    """About ``CHUNK_BYTES`` of texts at a time, with their languages."""
    texts, langs, size = [], [], 0
    for batch in batches:
        data, offsets = binary_parts(pa.chunked_array([batch.column("body")]))
        for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            for part in _slices(data[a:b]):
                texts.append(part)
                langs.append(lang)
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield texts, langs
                    texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


class _Coded:
    """The words of a chunk as codes, with the code of their language and the number of their piece."""

    def __init__(self, texts: list[np.ndarray], langs: list[str]) -> None:
        ends = np.cumsum([len(t) for t in texts])
        data = _LOWER[np.concatenate(texts)]
        cut = _BREAK[data]
        inside = ~(_GAP[data] | cut)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = np.unique(ends[:-1][ends[:-1] < len(data)])  # where a text starts, so do a word and a piece
        first[heads] = inside[heads]
        pieces = cut.astype(np.int32)
        pieces[heads] += 1
        starts = np.flatnonzero(first)
        self.piece = np.cumsum(pieces, dtype=np.int32)[starts]
        self.langs, numbers = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = numbers[np.searchsorted(ends, starts, "right")].astype(np.int32)
        word = np.cumsum(first, dtype=np.int32)[inside] - 1
        offsets = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(starts)))))
        found = pack_binary(data[inside], offsets).dictionary_encode()
        self.words, self.code = found.dictionary, found.indices.to_numpy().astype(np.int32)

    def suffixes(self, depth: int) -> np.ndarray:
        """A row for each word: its language, it and the words after it, -1 where the piece has ended."""
        rows = np.full((len(self.code), depth + 1), -1, np.int32)
        rows[:, 0] = self.lang
        for d in range(min(depth, len(self.code))):
            n = len(self.code) - d
            rows[:n, d + 1] = np.where(self.piece[:n] == self.piece[d:], self.code[d:], -1)
        return rows


def partitioned(keys: np.ndarray, weights: np.ndarray, least: int = 0,
                unsure: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the rows of ``keys``, the segments of one round together.

    Gives (depth, a row of each group, the group's weight, whether it ends there) for groups of rows that agree in their first
    ``depth`` columns; a group ends with the value -1. Groups that weigh less than ``least`` are abandoned unless
    ``unsure`` says, for their row and last column, that more of the group may lie elsewhere.
    """
    order = np.arange(len(keys), dtype=np.int32)
    starts = np.zeros(min(1, len(keys)), np.int64)
    depths = np.zeros(len(starts), np.int64)
    while len(order):
        sizes = np.diff(np.append(starts, len(order)))
        segment = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        word = keys[order, depths[segment]]
        pivot = word[starts + sizes // 2]
        split = pivot[segment]
        target = np.empty(len(order), np.int32)
        counts, base = [], starts
        for side in (word < split, word == split, word > split):
            rank = np.cumsum(side, dtype=np.int32)
            before = rank[starts] - side[starts]
            target[side] = (base - before)[segment[side]] + rank[side] - 1
            counts.append(np.append(rank[starts[1:] - 1], rank[-1]) - before)
            base = base + counts[-1]
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        below, equal, above = counts
        first = starts + below
        added = np.concatenate(([0], np.cumsum(weights[order], dtype=np.int64)))
        weight, row, ended = added[first + equal] - added[first], order[first], pivot < 0
        found = weight >= least
        if unsure is not None:
            found |= unsure[row, depths]
        for d in np.unique(depths[found]).tolist():
            at = found & (depths == d)
            yield d + 1, row[at], weight[at], ended[at]
        deeper = found & ~ended & (depths + 1 < keys.shape[1])
        nexts = ((starts, below, depths, below > 0), (first, equal, depths + 1, deeper), (first + equal, above, depths, above > 0))
        start, size, depths = (np.concatenate([part[i][part[3]] for part in nexts]) for i in range(3))
        starts = np.cumsum(size) - size
        order = order[np.repeat(start - starts, size) + np.arange(int(size.sum()))]


def merged(rows: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different rows (language, then word codes below ``words`` or -1) in order, and how often each is there."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    if (int(rows[:, 0].max()) + 1) * (words + 1) ** (rows.shape[1] - 1) < 1 << 63:
        key = rows[:, 0].astype(np.int64)
        for c in range(1, rows.shape[1]):
            key = key * (words + 1) + (rows[:, c] + 1)
        key.sort()
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        key, out = key[cuts], np.empty((len(cuts), rows.shape[1]), np.int32)
        for c in range(rows.shape[1] - 1, 0, -1):
            key, code = np.divmod(key, words + 1)
            out[:, c] = code - 1
        out[:, 0] = key
    else:  # codes too large for one number
        rows = rows[np.lexsort(rows.T[::-1])]
        cuts = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
        out = rows[cuts]
    return out, np.diff(np.append(cuts, len(rows)))


def _hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)


def _all_hot(rows: np.ndarray, hot: np.ndarray, size: int) -> np.ndarray:
    """For each column, whether the row's words up to it are all hot. ``hot``: sorted lang * size + word."""
    found = np.ones(rows.shape, bool)
    for c in range(1, rows.shape[1]):
        code = rows[:, 0].astype(np.int64) * size + rows[:, c]
        found[:, c] = found[:, c - 1] & (rows[:, c] >= 0) & np.isin(code, hot)
    return found


def _hot_codes(hot: set[tuple[str, str]], langs, words: pa.Array) -> np.ndarray:
    lang_code, wanted = {x: i for i, x in enumerate(langs)}, sorted({w for _, w in hot})
    places = dict(zip(wanted, pa.compute.index_in(pa.array([w.encode() for w in wanted], pa.binary()), value_set=words).to_pylist()))
    return np.array(sorted(lang_code[x] * len(words) + places[w] for x, w in hot if x in lang_code and places[w] is not None), np.int64)


def _fragments(owners: int, depth: int, hot: set[tuple[str, str]]):
    """Each chunk's different suffixes of two words and more, by owner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for texts, names in _chunks(batches):
            chunk = _Coded(texts, names)
            rows = chunk.suffixes(depth)
            rows, counts = merged(rows[rows[:, 2] >= 0], len(chunk.words))
            if not len(rows):
                continue
            # the route: leading words, the first one that is not hot included
            longer = _all_hot(rows, _hot_codes(hot, chunk.langs, chunk.words), len(chunk.words))
            mixed = _hashes(pa.array([x.encode() for x in chunk.langs], pa.binary()))[rows[:, 0]]
            words = np.append(_hashes(chunk.words), np.uint64(0))
            for c in range(1, depth + 1):
                step = (mixed ^ words[rows[:, c]]) * np.uint64(0x9E3779B97F4A7C15)
                mixed = np.where(longer[:, c - 1], step ^ (step >> np.uint64(29)), mixed)
            owner = ((mixed >> np.uint64(16)) % np.uint64(owners)).astype(np.int32)
            by = np.argsort(owner, kind="stable")
            rows, counts, owner = rows[by], counts[by], owner[by]
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(owner))):
                used, code = np.unique(rows[a:b, 1:], return_inverse=True)
                held, lang = np.unique(rows[a:b, 0], return_inverse=True)
                known = chunk.words.take(pa.array(used[used >= 0]))
                letters, ends = binary_parts(pa.chunked_array([known]))
                # codes start at 1 for words, 0 stands for an ended piece
                code = code.reshape(b - a, depth) + (0 if used[0] < 0 else 1)
                out.append((int(owner[a]), json.dumps(chunk.langs[held].tolist()), zstandard.compress(letters.tobytes(), 3), planes(np.diff(ends)),
                            planes(np.concatenate((lang[:, None], code), axis=1).T.ravel()), planes(counts[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FRAGMENT_SCHEMA)], schema=_FRAGMENT_SCHEMA)

    return run


def _owner(depth: int, least: int, hot: set[tuple[str, str]]):
    """Phrases of two words and more among an owner's suffixes, with their frequencies there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fragments = [b for b in batches if b.num_rows]
        if not fragments:
            return
        t = pa.Table.from_batches(fragments)
        letters = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in t.column("letters").to_pylist()]
        lengths = [unplaned(x).astype(np.int64) for x in t.column("lengths").to_pylist()]
        found = pack_binary(np.concatenate(letters), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))).dictionary_encode()
        code, langs, rows, at = found.indices.to_numpy(), {}, [], 0
        for names, size, packed in zip(t.column("langs").to_pylist(), lengths, t.column("suffixes").to_pylist()):
            own = np.concatenate(([-1], code[at:at + len(size)])).astype(np.int32)
            lang = np.array([langs.setdefault(x, len(langs)) for x in json.loads(names)], np.int32)
            columns = unplaned(packed).reshape(depth + 1, -1)
            rows.append(np.column_stack((lang[columns[0]], *[own[c] for c in columns[1:]])))
            at += len(size)
        rows = np.concatenate(rows)
        weights = np.concatenate([unplaned(x) for x in t.column("counts").to_pylist()]).astype(np.int64)
        words, names = found.dictionary.cast(pa.string()), np.array(list(langs), object)
        unsure = _all_hot(rows, _hot_codes(hot, names, found.dictionary), len(words))
        for d, row, weight, ended in partitioned(rows, weights, least, unsure):
            row, weight = row[~ended], weight[~ended]
            if d < 3 or not len(row):
                continue
            phrase = pa.compute.binary_join_element_wise(*[words.take(pa.array(rows[row, c])) for c in range(1, d)], " ")
            yield pa.RecordBatch.from_arrays([pa.array(names[rows[row, 0]], pa.string()), phrase, pa.array(np.full(len(row), d - 1), pa.int32()),
                                              pa.array(weight)], schema=_COUNT_SCHEMA)

    return run


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, names in _chunks(batches):
        chunk = _Coded(texts, names)
        pairs, counts = np.unique(chunk.lang.astype(np.int64) * len(chunk.words) + chunk.code, return_counts=True)
        if len(pairs):
            lang, word = np.divmod(pairs, len(chunk.words))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.langs[lang], pa.string()), chunk.words.take(pa.array(word)).cast(pa.string()),
                                              pa.array(np.ones(len(pairs)), pa.int32()), pa.array(counts, pa.int64())], schema=_COUNT_SCHEMA)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, size, n): every word of each language with all its occurrences. ``texts`` holds (lang, body)."""
    return _summed(texts.mapInArrow(_counted_words, _COUNT))


def phrase_counts(texts: DataFrame, singles: DataFrame, words: int, least: int) -> DataFrame:
    """(lang, phrase, size, n): phrases of 2 to ``words`` words that occur ``least`` times or more."""
    total = singles.agg(F.sum("n")).first()[0] or 0
    hot = {(r.lang, r.phrase) for r in singles.filter(F.col("n") > OWNER_TOKENS).toLocalIterator()}  # total / OWNER_TOKENS words at most
    owners = max(parts(texts.sparkSession), -(-total // OWNER_TOKENS))
    sent = texts.mapInArrow(_fragments(owners, words, hot), _FRAGMENT).repartitionById(owners, F.col("owner"))  # a partition for each owner
    return _summed(sent.mapInArrow(_owner(words, least, hot), _COUNT)).filter(F.col("n") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    exact = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", exact(a) * exact(a) * F.lit(1000000).cast("decimal(7,0)"), exact(left) * exact(right))


def collocations(docs: DataFrame, words: int = 3, least: int = 10, share: int = 50, first: int = 2000,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score, those left out that lie in a longer
    phrase with ``share`` percent of their frequency or more."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    singles = table(word_counts(texts), "words")
    phrases = table(phrase_counts(texts, singles, words, least), "phrases")
    known = singles.filter(F.col("n") >= least).unionByName(phrases).select("lang", "phrase", "n")

    each = phrases.withColumn("word", F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(max(2, words - 1))), lambda m: F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(words - 1)), lambda i: (m < F.col("size")) & (i + m - 1 <= F.col("size"))),
        lambda i: F.array_join(F.slice("word", i, m), " "))))
    around = each.select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = each.join(around, ["lang", "phrase"], "left").filter("longer is null or 100 * cast(longer as decimal(38,0)) < %d * cast(n as decimal(38,0))" % share)

    cuts = kept.select("lang", "phrase", "size", "word", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("word", F.lit(1), F.col("k")), " "),
                             "right": F.array_join(F.slice("word", F.col("k") + 1, F.col("size")), " ")})
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]))
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the best of each share of a language's phrases, then the best of those: no task gets more than SHARES * first rows
    shared = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for keys in (["lang", "share"], ["lang"]):
        shared = shared.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= first)
    best = shared
    totals = singles.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
