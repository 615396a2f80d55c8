"""Operator 3: language-model scores by a probabilistic suffix tree over words.

States are contexts of 0, 1 or 2 words, kept by a divergence test; a token is scored in the
longest kept suffix of what precedes it. The root is the smoothed unigram distribution. With c(s) the
training tokens that follow a context s, n(s, x) those that are x, counted if x recurs there (2 or more),
and rest(s) = c(s) - sum of the counted, a state's distribution is

    P(x | s) = (n(s, x) + (rest(s) + PSEUDO) P(x | parent)) / (c(s) + PSEUDO)

so what occurred once pays for what has not been seen, and each distribution sums to one. A context stays if its
divergence from its parent, summed over its occurrences, exceeds ``PENALTY`` nats for each counted x.

How it runs: texts become codes in a chunk's dictionary, written once to the shared folder, bucketed by chunk. Chunks
send each different word with its training count; its owner adds up, and answers with the global count and id. Chunks then
send each different (two words before, token) with its count to the owner of the
word before the token: all contexts that end in that word are grown, tested and
smoothed there. A word with more than ``HOT_TOKENS`` training tokens is *hot*: the counts of its pairs (it, token) are added up
by the owners of the pairs, its own state follows from sums over them, and its contexts of two words are dealt to
owners by both words, each entry with what the state of its last word makes of it. So no owner holds all that follows one word. The answer is a pair (a, b) with P = a + b P(root), from which the chunk scores its texts. Everything that is
gathered grows with the corpus; no table is broadcast. Totals reach the driver, and the figures of hot words: one for so many tokens at most.

Words and contexts are known by 64-bit hashes and ids. Defined cases: null text is empty and scores its end token alone;
null and repeated ids are kept, a row out for each row in; a condition that is null is no training; without training rows
every token has probability 1 (score 0) by the formula of the base; a word of a whole long text is a word like any other;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.chunks import bucketed, parts, planes, table, unplaned

#: Characters of text that one chunk gathers before it is written.
CHUNK_CHARS = 10 << 20
#: Training tokens of a word beyond which its contexts are split over owners, and triples of training tokens that an owner holds on average.
HOT_TOKENS, OWNER_TOKENS = 1 << 22, 1 << 21
#: Entries of contexts of two words that are tested together.
TOGETHER = 1 << 19
PSEUDO = 1.0
PENALTY = 3.0

_CODED_SCHEMA = pa.schema([("dest", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("trained", pa.binary()),
                           ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int64())),
                           ("codes", pa.binary()), ("places", pa.binary())])
_CODED = ("dest int, chunk long, hashes binary, trained binary, ids array<bigint>, train array<boolean>, counts array<bigint>, "
          "codes binary, places binary")
#: No word is empty, so the empty one is the end of a text.
END = b""


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def _coded(dests: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        known, codes, ids, train, counts, chars = {END: 0}, array("I"), [], [], [], 0

        def written() -> pa.RecordBatch:
            used = np.frombuffer(codes, np.uint32)
            by_use = np.argsort(-np.bincount(used, minlength=len(known)), kind="stable")
            code = np.empty(len(known), np.int64)
            code[by_use] = np.arange(len(known))
            used = code[used]
            trained = np.bincount(used[np.repeat(np.array(train, bool), counts)], minlength=len(known))
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)[by_use]
            dest = (hashes % np.uint64(dests)).astype(np.int64)
            places = np.argsort(dest, kind="stable")
            cuts = _runs(dest[places])
            rows = [(int(dest[places[a]]), number, hashes[places[a:b]].astype("<u8").tobytes(), planes(trained[places[a:b]]), None, None, None, None, None)
                    for a, b in zip(cuts, np.append(cuts[1:], len(places)))]
            rows.append((None, number, None, None, ids, train, counts, planes(used), planes(places)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CODED_SCHEMA)], schema=_CODED_SCHEMA)

        for batch in batches:
            for key, learn, text in zip(batch.column("id").to_pylist(), batch.column("train").to_pylist(), batch.column("body")):
                words = (text.as_py() or "").encode().lower().split()  # bytes: only A-Z fold, only ASCII space parts words
                codes.extend([known.setdefault(w, len(known)) for w in words])
                codes.append(0)
                ids.append(key)
                train.append(learn)
                counts.append(len(words) + 1)
                chars += len(text.as_py() or "")
                if chars >= CHUNK_CHARS:
                    yield written()
                    known, codes, ids, train, counts, chars, number = {END: 0}, array("I"), [], [], [], 0, number + 1
        if ids:
            yield written()

    return run


_WORDS = "chunk long, dest int, first binary, second binary, tokens long, known long, top long"
_WORDS_SCHEMA = pa.schema([("chunk", pa.int64()), ("dest", pa.int32()), ("first", pa.binary()), ("second", pa.binary()),
                           ("tokens", pa.int64()), ("known", pa.int64()), ("top", pa.int64())])


def _counted_words(t: pa.Table) -> pa.Table:
    """For each chunk, its words' ids here (frequent first) and training counts."""
    hashes = [np.frombuffer(x, "<u8") for x in t.column("hashes").to_pylist()]
    trained = [unplaned(x) for x in t.column("trained").to_pylist()]
    found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(trained), len(found)).astype(np.int64)
    number = np.empty(len(found), np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(found))
    ends = np.cumsum([len(x) for x in hashes])
    own = [inverse[e - len(x):e] for x, e in zip(hashes, ends)]
    n = len(own)
    return pa.table([t.column("chunk").combine_chunks(), pa.array([t.column("dest")[0].as_py()] * n, pa.int32()),
                     pa.array([planes(number[i]) for i in own], pa.binary()), pa.array([planes(total[i], "<u8") for i in own], pa.binary()),
                     pa.array([int(total.sum())] * n, pa.int64()), pa.array([int((total > 0).sum())] * n, pa.int64()),
                     pa.array([int(total.max())] * n, pa.int64())], schema=_WORDS_SCHEMA)


class _Chunk:
    """A chunk's tokens with the ids and training counts of their words, and its
    different (before last, last, token) triples in the order of their owners."""

    def __init__(self, coded: pa.Table, dests: int, owners: int, hot: int) -> None:
        words = sorted(coded.column("words")[0].as_py(), key=lambda w: w["dest"])
        codes = unplaned(coded.column("codes")[0].as_py()).astype(np.int32)
        places = unplaned(coded.column("places")[0].as_py())
        self.number, self.total = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
        self.number[places] = np.concatenate([unplaned(w["first"]).astype(np.int64) * dests + w["dest"] for w in words])
        self.total[places] = np.concatenate([unplaned(w["second"], "<u8") for w in words]).astype(np.int64)
        self.ids = coded.column("ids").combine_chunks().flatten()
        self.counts = np.array(coded.column("counts")[0].as_py(), np.int64)
        self.codes = codes
        train = np.repeat(np.array(coded.column("train")[0].as_py(), bool), self.counts)
        starts = np.cumsum(self.counts) - self.counts
        n, size = len(codes), len(places) + 1
        last, before = np.zeros(n, np.int32), np.zeros(n, np.int32)  # code + 1; 0: nothing there
        last[1:] = codes[:-1] + 1
        before[2:] = codes[:-2] + 1
        last[starts] = 0
        before[starts] = 0
        before[(starts + 1)[self.counts > 1]] = 0
        self.inner = np.flatnonzero(last > 0).astype(np.int32)  # a text's first token has no context
        pair, of_pair = np.unique(last[self.inner].astype(np.int64) * size + codes[self.inner], return_inverse=True)
        triple, of_triple = np.unique(of_pair * size + before[self.inner], return_inverse=True)
        del of_pair, last, before
        pair, self.before = pair[triple // size], triple % size
        self.last, self.token = pair // size, pair % size
        count = np.bincount(of_triple, train[self.inner], len(triple)).astype(np.int64)
        last, token = self.number[self.last - 1], self.number[self.token]
        owner = (last * 2654435761 >> 7) % owners
        self.hot = self.total[self.last - 1] > hot
        if self.hot.any():  # by both words; where there is no second one, by the token
            second = np.where(self.before > 0, self.number[self.before - 1] + 1, -1 - token)
            owner = np.where(self.hot, _dealt(last, second, owners), owner)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of_triple, self.owner, self.count = place[of_triple], owner[order], count[order]
        self.before, self.last, self.token, self.hot = self.before[order], self.last[order], self.token[order], self.hot[order]

    def hot_pairs(self, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different (last, token) with a hot last word, in the order of their owners: words' codes, training count, owner, and for
        each hot triple which of them it has."""
        size = len(self.number) + 1
        pair, of = np.unique(self.last[self.hot] * size + self.token[self.hot], return_inverse=True)
        last, token = pair // size, pair % size
        owner = _dealt(self.number[last - 1], self.number[token], owners)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return last[order], token[order], np.bincount(of, self.count[self.hot], len(pair)).astype(np.int64)[order], owner[order], place[of]


def _dealt(a: np.ndarray, b: np.ndarray, owners: int) -> np.ndarray:
    """Owners of pairs of numbers."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % owners


_PAIRS = "dest int, chunk long, last binary, token binary, total binary, count binary"
_PAIRS_SCHEMA = pa.schema([("dest", pa.int32()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in ("last", "token", "total", "count")])


def _sent_pairs(dests: int, owners: int, hot: int):
    """Each chunk's pairs of a hot word and the token after it, with their training counts."""
    def run(coded: pa.Table) -> pa.Table:
        c = _Chunk(coded, dests, owners, hot)
        last, token, count, owner, _ = c.hot_pairs(owners)
        cuts = _runs(owner)
        rows = [(int(owner[a]), planes(c.number[last[a:b] - 1], "<u8"), planes(c.number[token[a:b]], "<u8"), planes(c.total[token[a:b]], "<u8"),
                 planes(count[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(owner)))]
        columns = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(columns[0], pa.int32()), pa.array([coded.column("chunk")[0].as_py()] * len(rows), pa.int64())]
                        + [pa.array(x, pa.binary()) for x in columns[1:]], schema=_PAIRS_SCHEMA)

    return run


def _added_pairs(t: pa.Table) -> pa.Table:
    """To each chunk the training counts of its pairs in all (rows with a chunk), and the different pairs (without one)."""
    parts_of = {name: [unplaned(x, kind) for x in t.column(name).to_pylist()] for name, kind in (("last", "<u8"), ("token", "<u8"), ("total", "<u8"), ("count", "<u4"))}
    ends = np.cumsum([len(x) for x in parts_of["last"]])
    last, token, total, count = (np.concatenate(parts_of[c]).astype(np.int64) for c in ("last", "token", "total", "count"))
    order = np.lexsort((token, last))
    fresh = np.concatenate(([True], (last[order][1:] != last[order][:-1]) | (token[order][1:] != token[order][:-1])))
    summed = np.add.reduceat(count[order], np.flatnonzero(fresh))
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    head, dest, none = order[fresh], t.column("dest")[0].as_py(), b""
    rows = [(dest, chunk, none, none, none, planes(summed[inverse[e - len(x):e]])) for chunk, x, e in zip(t.column("chunk").to_pylist(), parts_of["last"], ends)]
    rows.append((dest, None, planes(last[head], "<u8"), none, planes(total[head], "<u8"), planes(summed)))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAIRS_SCHEMA)], schema=_PAIRS_SCHEMA)


_SUMS = "last long, whole double, seen double, gain double"


def _summed_pairs(tokens: int, known: int, sums: dict[int, tuple[float, float]]):
    """Of each hot word among the different pairs: their counts, those that recur, and with ``sums`` (both over all pairs) the
    gain of the recurring ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for last, total, count in zip(*(batch.column(c).to_pylist() for c in ("last", "total", "count"))):
                last, total, n = unplaned(last, "<u8").astype(np.int64), unplaned(total, "<u8").astype(float), unplaned(count).astype(float)
                words, of = np.unique(last, return_inverse=True)
                counted, gain = np.where(n >= 2, n, 0.0), np.zeros(len(n))
                if sums:
                    whole, seen = (np.array([sums[w][k] for w in words.tolist()])[of] for k in (0, 1))
                    root = (total + 0.5) / (tokens + 0.5 * (known + 1))
                    p = (counted + (whole - seen + PSEUDO) * root) / (whole + PSEUDO)
                    gain = np.where(counted > 0, counted * np.log(p / root) - PENALTY, 0.0)
                each = [np.bincount(of, x, len(words)) for x in (n, counted, gain)]
                yield pa.RecordBatch.from_arrays([pa.array(words), *map(pa.array, each)], names=["last", "whole", "seen", "gain"])

    return run


def hot_states(pairs: DataFrame, tokens: int, known: int) -> dict[int, tuple[float, float, bool]]:
    """Of each hot word (one for ``HOT_TOKENS`` tokens at most): the tokens that follow it, those that recur there, and whether its state stays."""
    different = pairs.filter("chunk is null")

    def added(sums: dict) -> list:
        return different.mapInArrow(_summed_pairs(tokens, known, sums), _SUMS).groupBy("last").agg(F.sum("whole"), F.sum("seen"), F.sum("gain")).collect()

    sums = {r[0]: (r[1], r[2]) for r in added({})}
    out = {}
    for word, whole, seen, gain in added(sums):
        alone = whole - seen
        out[word] = (whole, seen, bool(seen > 0 and gain + alone * np.log((alone + PSEUDO) / (whole + PSEUDO)) > 0))
    return out


_TRIPLES = "dest int, chunk long, last binary, token binary, total binary, before binary, count binary, first binary, second binary"
_TRIPLES_SCHEMA = pa.schema([("dest", pa.int32()), ("chunk", pa.int64())]
                            + [(c, pa.binary()) for c in ("last", "token", "total", "before", "count", "first", "second")])


def _sent_triples(dests: int, owners: int, hot: int, states: dict[int, tuple[float, float, bool]]):
    """Each chunk's triples; those of a hot last word with (a, b) of its state."""
    def run(coded: pa.Table, added: pa.Table | None = None) -> pa.Table:
        if not coded.num_rows:
            return _TRIPLES_SCHEMA.empty_table()
        c = _Chunk(coded, dests, owners, hot)
        before = np.where(c.before > 0, c.number[c.before - 1] + 1, 0)
        a = b = np.full(len(c.last), np.nan)
        if c.hot.any():
            last, _, _, _, of = c.hot_pairs(owners)
            n = np.concatenate([unplaned(x) for x in added.sort_by("dest").column("count").to_pylist()]).astype(float)
            whole, seen, kept = (np.array([states[w][k] for w in c.number[last - 1].tolist()]) for k in range(3))
            a[c.hot] = np.where(kept, np.where(n >= 2, n, 0.0) / (whole + PSEUDO), 0.0)[of]
            b = a.copy()
            b[c.hot] = np.where(kept, (whole - seen + PSEUDO) / (whole + PSEUDO), 1.0)[of]
        cuts = _runs(c.owner)
        rows = []
        for x, y in zip(cuts, np.append(cuts[1:], len(c.owner))):
            s = slice(x, y)
            given = [planes(v[s].astype("<f4").view("<u4")) for v in (a, b)] if c.hot[s].any() else [b"", b""]
            rows.append((int(c.owner[x]), planes(c.number[c.last[s] - 1], "<u8"), planes(c.number[c.token[s]], "<u8"),
                         planes(c.total[c.token[s]], "<u8"), planes(before[s], "<u8"), planes(c.count[s]), *given))
        columns = list(zip(*rows)) or [()] * 8
        return pa.table([pa.array(columns[0], pa.int32()), pa.array([coded.column("chunk")[0].as_py()] * len(rows), pa.int64())]
                        + [pa.array(x, pa.binary()) for x in columns[1:]], schema=_TRIPLES_SCHEMA)

    # Spark looks at the number of arguments
    return run if states else lambda coded: run(coded)


def grown(last, token, before, count, root, given=None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each different (before, last, token) with its training count: P = a + b * root.

    ``root``: the root's probability of the token; ``before`` 0: no second word. The triples are in
    order of (last, token, before), and all with one ``last`` are here, or all with one (before, last) where ``given`` has (a, b) of
    the last word's state (not a number elsewhere)."""

    def states(context: np.ndarray, n: np.ndarray, parent: np.ndarray, some: np.ndarray):
        """(kept, numerator, share of the parent) for entries (context number, count)."""
        size = int(context.max()) + 1 if len(context) else 0
        counted = np.where(n >= 2, n, 0.0)
        all_, seen = np.bincount(context, n, size), np.bincount(context, counted, size)
        rest, whole = (all_ - seen)[context], all_[context] + PSEUDO
        p = (counted + (rest + PSEUDO) * parent) / whole
        gain = np.where(counted > 0, counted * np.log(p / parent) - PENALTY, 0.0)
        singles = all_ - seen
        gain = np.bincount(context, gain, size) + singles * np.log((singles + PSEUDO) / (all_ + PSEUDO))
        kept = (gain > 0) & (seen > 0) & some
        return kept[context], counted / whole, (rest + PSEUDO) / whole

    new_last = np.concatenate(([True], last[1:] != last[:-1]))
    new_pair = new_last | np.concatenate(([True], token[1:] != token[:-1]))
    head, pair = np.flatnonzero(new_pair), np.cumsum(new_pair) - 1
    one = (np.cumsum(new_last) - 1)[head]
    kept, a, b = states(one, np.add.reduceat(count, head).astype(float), root[head], np.ones(int(one[-1]) + 1, bool))
    a, b = np.where(kept, a, 0.0)[pair], np.where(kept, b, 1.0)[pair]
    if given is not None:
        a, b = (np.where(np.isnan(g), x, g) for g, x in zip(given, (a, b)))
    # contexts of two words, each beside the state (or the root) of its last word; some contexts at a time
    by = np.lexsort((before, last))
    fresh = np.flatnonzero(np.concatenate(([True], (last[by][1:] != last[by][:-1]) | (before[by][1:] != before[by][:-1]))))
    at = 0
    while at < len(fresh):
        until = max(at + 1, int(np.searchsorted(fresh, fresh[at] + TOGETHER, "right")))
        end = int(fresh[until]) if until < len(fresh) else len(by)
        some, starts = by[fresh[at]:end], fresh[at:until] - fresh[at]
        two = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(some))))
        kept, own, share = states(two, count[some].astype(float), a[some] + b[some] * root[some], before[some[starts]] > 0)
        a[some], b[some] = np.where(kept, own + share * a[some], a[some]), np.where(kept, share * b[some], b[some])
        at = until
    return a, b


_ANSWERS = "chunk long, dest int, first binary, second binary"
_ANSWERS_SCHEMA = pa.schema([("chunk", pa.int64()), ("dest", pa.int32()), ("first", pa.binary()), ("second", pa.binary())])


def _grown_contexts(tokens: int, known: int):
    def run(t: pa.Table) -> pa.Table:
        def column(name: str, kind: str) -> np.ndarray:
            each = [unplaned(x, kind) for x in t.column(name).to_pylist()]
            small = max(int(x.max()) for x in each) < 1 << 32
            return np.concatenate([x.astype(np.uint32) for x in each] if small else each)

        sizes = [len(unplaned(x)) for x in t.column("count").to_pylist()]
        last, token, before = (column(c, "<u8") for c in ("last", "token", "before"))
        order = np.lexsort((before, token, last))
        fresh = np.ones(len(order), bool)
        fresh[1:] = False
        for x in (last, token, before):
            fresh[1:] |= x[order][1:] != x[order][:-1]
        head = order[fresh]
        summed = np.add.reduceat(column("count", "<u4")[order].astype(np.int64), np.flatnonzero(fresh))
        inverse = np.empty(len(order), np.uint32)
        inverse[order] = np.cumsum(fresh) - 1
        del order, fresh
        last, token, before = last[head], token[head], before[head]
        root = (column("total", "<u8")[head] + 0.5) / (tokens + 0.5 * (known + 1))
        given = None
        if any(t.column("first").to_pylist()):
            given = [np.concatenate([unplaned(x).view("<f4") if x else np.full(n, np.nan, "<f4") for x, n in zip(t.column(c).to_pylist(), sizes)])[head].astype(float)
                     for c in ("first", "second")]
        a, b = grown(last, token, before, summed, root, given)
        own = [slice(e - n, e) for n, e in zip(sizes, np.cumsum(sizes))]
        return pa.table([t.column("chunk").combine_chunks(), pa.array([t.column("dest")[0].as_py()] * len(own), pa.int32()),
                         *[pa.array([planes(x[inverse[s]].view("<u4")) for s in own], pa.binary()) for x in (a.astype("<f4"), b.astype("<f4"))]],
                        schema=_ANSWERS_SCHEMA)

    return run


_SCORED = "id long, n_tokens long, n_known long, base_score double, score double"


def _scored(dests: int, owners: int, hot: int, tokens: int, known: int):
    kind = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        if not coded.num_rows:
            return kind.empty_table()
        c = _Chunk(coded, dests, owners, hot)
        states = answers.sort_by("dest")
        a, b = (np.concatenate([unplaned(x).view("<f4") for x in states.column(s).to_pylist()] or [np.zeros(0, "<f4")]).astype(float) for s in ("first", "second"))
        root = ((c.total + 0.5) / (tokens + 0.5 * (known + 1)))[c.codes]
        p = root.copy()
        p[c.inner] = a[c.of_triple] + b[c.of_triple] * root[c.inner]
        starts = np.cumsum(c.counts) - c.counts
        return pa.table([c.ids, pa.array(c.counts), pa.array(np.add.reduceat((c.total > 0)[c.codes].astype(np.int64), starts)),
                         pa.array(np.add.reduceat(np.log10(root), starts)), pa.array(np.add.reduceat(np.log10(p), starts))], schema=kind)

    return run


def scored(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row. ``is_training``: a condition on the columns of ``docs``."""
    dests, hot = parts(docs.sparkSession), HOT_TOKENS
    bodies = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_training, F.lit(False)).alias("train"), F.col(text).cast("string").alias("body"))
    coded = bucketed(bodies.mapInArrow(_coded(dests), _CODED), "chunk", "tokens")
    words = bucketed(coded.filter("dest is not null").select("dest", "chunk", "hashes", "trained").groupBy("dest")
                     .applyInArrow(_counted_words, _WORDS), "chunk", "words")
    totals = words.groupBy("dest").agg(*[F.first(c).alias(c) for c in ("tokens", "known", "top")]).agg(F.sum("tokens"), F.sum("known"), F.max("top")).first()
    tokens, known, top = (int(x or 0) for x in totals)
    owners = max(4 * dests, -(-tokens // OWNER_TOKENS))
    own = words.groupBy("chunk").agg(F.collect_list(F.struct("dest", "first", "second")).alias("words"))  # a row per owner
    # both tables are bucketed by chunk: neither moves for the join, nor when the answers come
    chunks = coded.filter("dest is null").select("chunk", "ids", "train", "counts", "codes", "places").join(own, "chunk")
    if top > hot:
        pairs = table(chunks.groupBy("chunk").applyInArrow(_sent_pairs(dests, owners, hot), _PAIRS).groupBy("dest").applyInArrow(_added_pairs, _PAIRS), "pairs")
        states = hot_states(pairs, tokens, known)
        added = pairs.filter("chunk is not null").select(F.col("chunk").alias("of"), "dest", "count")
        sent = chunks.groupBy("chunk").cogroup(added.groupBy("of")).applyInArrow(_sent_triples(dests, owners, hot, states), _TRIPLES)
    else:  # no word is hot
        sent = chunks.groupBy("chunk").applyInArrow(_sent_triples(dests, owners, hot, {}), _TRIPLES)
    answers = sent.groupBy("dest").applyInArrow(_grown_contexts(tokens, known), _ANSWERS)
    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(dests, owners, hot, tokens, known), _SCORED)
    return found.withColumn("train_tokens", F.lit(tokens).cast("long"))
