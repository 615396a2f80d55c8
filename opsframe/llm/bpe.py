"""Operator 10: byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. *Pre-tokens with positions.* Each task splits whole texts by the vocabulary's
   pattern and replaces every pre-token by its code in the chunk's dictionary (most
   frequent first). The codes keep the positions; the dictionary holds each word
   of the chunk once. Both are written to the shared folder, bucketed by chunk.
2. *Each distinct word once.* Dictionaries are dealt by a hash of the word. The
   task that owns a word encodes it once, however many chunks, documents or
   places it has, and answers each chunk.
3. *Reassembly.* Answers go to the buckets of the codes, which do not move; a document's ids are those of
   its pre-tokens in order of position.

A frequent word costs one entry for each chunk, not one for each use. Decoding
joins ids with the token-byte table, whose size the vocabulary fixes.

Defined cases: null text is encoded as empty (no ids); null and repeated document ids are
kept, one row out for each row in; a very long text is split at places where no
pre-token can cross (before a space or newline that follows a non-space), so memory follows
the chunk size; other columns are ignored; an empty table gives no rows; decoding
drops nothing: a null list of ids decodes to empty bytes, and an id that the
vocabulary lacks raises an error.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.chunks import bucketed, give_back, pack_binary, parts, planes, ranges, unplaned

#: Characters of text that one chunk gathers before it is written.
CHUNK_CHARS = 6 << 20
#: Ids decoded at once.
SLICE_IDS = 1 << 20
#: Characters split at once.
PIECE_CHARS = 1 << 20
#: A vocabulary file travels with the tasks, so its size is checked.
MAX_VOCABULARY_BYTES = 64 << 20


class Vocabulary:
    """Ranks of byte strings (lines of base64 and rank) and the pattern that splits text before them."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.lines = f.read(MAX_VOCABULARY_BYTES + 1)
        if len(self.lines) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
        self.pattern = pattern

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, self.lines.splitlines())}

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("words", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes end to end, each id's start, and its length (-1: no such id)."""
        ranks = self.ranks()
        starts = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths = np.full(len(starts), -1, np.int64)
        data, at = [], 0
        for word, rank in ranks.items():
            starts[rank], lengths[rank] = at, len(word)
            data.append(word)
            at += len(word)
        return np.frombuffer(b"".join(data), np.uint8), starts, lengths


_CUT = re.compile("[ \n]")


def _pieces(text: str) -> Iterator[str]:
    """The text in parts that split alike: each cut is before a space or newline that follows a non-space."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = _CUT.search(text, at + PIECE_CHARS)
        while cut and text[cut.start() - 1].isspace():
            cut = _CUT.search(text, cut.end())
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_CODED = "dest int, chunk long, words binary, n_words int, ids array<bigint>, counts array<bigint>, codes binary, places binary"
_CODED_SCHEMA = pa.schema([("dest", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("n_words", pa.int32()),
                           ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()),
                           ("places", pa.binary())])


def _coded(pattern: str, dests: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash
        import zstandard
        from pyspark import TaskContext

        split, number = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        known: dict[str, int] = {}
        codes, ids, counts, chars = array("I"), [], [], 0

        def written() -> pa.RecordBatch:
            used = np.frombuffer(codes, np.uint32)
            words = list(known)
            by_use = np.argsort(-np.bincount(used, minlength=len(words)), kind="stable")
            code = np.empty(len(words), np.int64)
            code[by_use] = np.arange(len(words))
            keys = [w.encode() for w in words]
            dest = np.array([xxhash.xxh64_intdigest(k) % dests for k in keys], np.int64)
            order = np.argsort(dest, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(dest[order]) != 0))) if len(order) else order
            rows = []
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                order[a:b] = sorted(order[a:b].tolist(), key=keys.__getitem__)
                own = [keys[i] for i in order[a:b]]
                sizes = np.array([len(k) for k in own], "<u4").tobytes()
                rows.append((int(dest[order[a]]), number, zstandard.compress(sizes + b"".join(own), 3), int(b - a), None, None, None, None))
            # places: the code of each word in the order in which its answer will come
            rows.append((None, number, None, None, ids, counts, planes(code[used] if len(used) else used), planes(code[order])))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CODED_SCHEMA)], schema=_CODED_SCHEMA)

        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("body")):
                text, before = text.as_py() or "", len(codes)
                for piece in _pieces(text):
                    codes.extend([known.setdefault(w, len(known)) for w in split(piece)])
                ids.append(key)
                counts.append(len(codes) - before)
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield written()
                    known, codes, ids, counts, chars, number = {}, array("I"), [], [], 0, number + 1
            del batch
        if ids:
            yield written()
        del known, codes, ids, counts
        give_back()

    return run


_ANSWERED = "chunk long, dest int, sizes binary, tokens binary"


def _encoded_words(vocabulary: Vocabulary):
    made = []

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        if not made:
            made.append(vocabulary.encoding())
        encode, once, out = made[0].encode_ordinary, {}, []
        for chunk, n, packed in zip(t.column("chunk").to_pylist(), t.column("n_words").to_pylist(), t.column("words").to_pylist()):
            data = zstandard.decompress(packed)
            ends = np.cumsum(np.frombuffer(data, "<u4", n)) + 4 * n
            own = [data[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]
            for word in own:
                if word not in once:
                    once[word] = array("I", encode(word.decode()))
            tokens = [once[word] for word in own]
            out.append((chunk, planes(np.array([len(x) for x in tokens], np.uint32)),
                        planes(np.frombuffer(b"".join(x.tobytes() for x in tokens), np.uint32))))
        dest = t.column("dest")[0].as_py()
        del once, own, tokens, data
        give_back()
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "dest": pa.array([dest] * len(out), pa.int32()),
                         "sizes": pa.array([x[1] for x in out], pa.binary()), "tokens": pa.array([x[2] for x in out], pa.binary())})

    return run


_ENCODED_SCHEMA = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _reassembled(coded: pa.Table, answers: pa.Table) -> pa.Table:
    if not coded.num_rows:
        return _ENCODED_SCHEMA.empty_table()
    answers = answers.sort_by("dest")
    codes, places = unplaned(coded.column("codes")[0].as_py()), unplaned(coded.column("places")[0].as_py())
    sizes = [unplaned(x) for x in answers.column("sizes").to_pylist()]
    tokens = [unplaned(x) for x in answers.column("tokens").to_pylist()]
    sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
    start, length = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    start[places], length[places] = np.cumsum(sizes) - sizes, sizes
    counts = np.array(coded.column("counts")[0].as_py(), np.int64)
    per_word = length[codes]
    ends = np.concatenate(([0], np.cumsum(per_word)))[np.concatenate(([0], np.cumsum(counts)))]
    ids = tokens[ranges(start[codes], per_word)].astype(np.int32)
    del codes, places, sizes, tokens, start, length, per_word
    give_back()
    return pa.table([coded.column("ids").combine_chunks().flatten(),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], schema=_ENCODED_SCHEMA)


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    dests = parts(docs.sparkSession)
    bodies = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    # in buckets of whole chunks, so that the codes stay where they are when the answers come
    coded = bucketed(bodies.mapInArrow(_coded(vocabulary.pattern, dests), _CODED), "chunk", "coded")
    answers = (coded.filter("dest is not null").select("dest", "chunk", "words", "n_words")
               .groupBy("dest").applyInArrow(_encoded_words(vocabulary), _ANSWERED))
    codes = coded.filter("dest is null").select("chunk", "ids", "counts", "codes", "places")
    return codes.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_reassembled, "id long, ids array<int>")


def decoded(encodings: DataFrame, vocabulary: Vocabulary, keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_bytes, decoded): the ids as little-endian unsigned 32-bit integers, and
    the bytes they stand for. With ``keep_ids`` the list is the column ``ids`` instead of bytes."""
    shown = ("ids", pa.list_(pa.int32())) if keep_ids else ("ids_bytes", pa.binary())
    kind = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), shown, ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, lengths = vocabulary.token_bytes()
        for batch in batches:
            edges = np.concatenate(([0], np.cumsum([n or 0 for n in batch.column("ids").value_lengths().to_pylist()])))
            row = 0
            while row < len(batch):  # some rows at a time, at least one
                until = max(row + 1, int(np.searchsorted(edges, edges[row] + SLICE_IDS, "right")) - 1)
                yield piece(batch.slice(row, until - row), data, starts, lengths)
                row = until
            del batch
            give_back()

    def piece(batch: pa.RecordBatch, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        lists = batch.column("ids")
        counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths) or lengths[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        size = lengths[ids] if len(ids) else np.zeros(0, np.int64)
        edges = np.concatenate(([0], np.cumsum(counts)))
        ends = np.concatenate(([0], np.cumsum(size)))[edges]
        bodies = data[ranges(starts[ids], size)] if len(ids) else np.zeros(0, np.uint8)
        same = (pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())) if keep_ids
                else pack_binary(ids.astype("<u4").view(np.uint8), edges * 4))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), same, pack_binary(bodies, ends)], schema=kind)

    return encodings.select("id", "ids").mapInArrow(run, f"id long, n_tokens long, {'ids array<int>' if keep_ids else 'ids_bytes binary'}, decoded binary")
