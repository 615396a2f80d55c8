"""Operator 1: exact removal of repeated byte strings by a depth-limited radix sort.

A byte goes when a ``depth``-byte window that covers it also starts in a
document with a smaller id. Windows are the suffixes, compared only through
``depth`` bytes, and ordered from their most significant digit on:

1. *First digit, by shuffle.* Every window has an anchor: its smallest
   ``GRAM``-byte string by a fixed hash (the leftmost of equals). Equal windows have
   equal anchors at equal offsets, so (anchor, offset) is a digit of the key
   that never parts equal windows. Neighbouring windows share an anchor, so one
   fragment of text carries about 15 windows.
2. *Singletons leave.* Chunks send only 32 bits for each different anchor, and the number of its different fragments there;
   anchors seen in one document of one chunk drop out before any text moves.
   An anchor with more than ``HOT_FRAGMENTS`` different fragments in all (a short string between ever new surroundings) is hot: its
   windows are dealt one by one, by a hash of all their bytes, so that only equal windows must meet.
3. *Further digits, in the task.* The fragments of what is left are dealt by
   anchor. Each pass splits the groups of equal (anchor, offset) by the next eight
   bytes in big-endian order; groups of one leave at each pass. After
   ``depth`` bytes the groups are exactly the repeated windows, and the
   smallest id of each group decides.

Equal fragments of a chunk are sent once, with their smallest id, so a passage
that a third of all documents share costs one row for each chunk. Hashes only
route; equality is decided on bytes. The three steps that need the texts share one shuffle of them,
and fragments travel compressed.

Defined cases: null text counts as empty; a text shorter than ``depth`` keeps
all bytes; a null id counts as larger than every id; rows with one id are
one document to each other (no id is smaller than itself), so they keep what only
they share; repeated rows each give a row; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from opsframe.llm.chunks import binary_parts, chunk_count, dealt, pack_binary, planes, ranges, unplaned

DEPTH = 50
#: Bytes of an anchor.
GRAM = 20
#: Windows handled at once in a task: bounds memory for texts of any length.
SLICE = 1 << 20
#: Different fragments around one anchor that may meet in a task.
HOT_FRAGMENTS = 1 << 17
NO_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    return h ^ (h >> np.uint64(29))


class _Hasher:
    """Rolling 64-bit hashes of byte strings (prefix sums modulo 2**64)."""

    def __init__(self) -> None:
        self.letters = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
        self.up = _powers(_BASE, SLICE + 4096)
        self.down = _powers(_INVERSE, SLICE + 4096)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n >= len(self.up):
            self.up, self.down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[:n], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        return (sums[size:] - sums[:n]) * self.down[:n]


def _anchored(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int, hasher: _Hasher):
    """Fragments of consecutive windows with one anchor, slice by slice:
    row, start of the first window, number of windows, anchor's offset in the
    first window, anchor's routing hash, and a hash of the fragment's bytes."""
    total, inside = len(data), depth - gram + 1
    fragments = []
    for low in range(0, max(0, total - depth + 1), SLICE):
        high = min(low + SLICE, total - depth + 1)
        part = data[low:high + depth - 1]
        sums = hasher.prefixes(part)
        raw = hasher.grams(sums, gram)
        key = (_mixed(raw, 0xBF58476D1CE4E5B9) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(raw), dtype=np.uint64)
        width = 1
        while 2 * width <= inside:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if inside > width:
            key = np.minimum(key[:len(key) - (inside - width)], key[inside - width:])
        anchor = (key[:high - low] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that cross the end of a text are none
        valid = np.ones(high - low, bool)
        first, last = np.searchsorted(offsets, [low, high + depth], "left")
        for cut in offsets[first:last]:
            valid[max(0, cut - depth + 1 - low):max(0, min(high, cut) - low)] = False
        anchor[~valid] = -1
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        edge_end = np.append(edge[1:], high - low)
        at = anchor[edge]
        real = at >= 0
        edge, edge_end, at = edge[real], edge_end[real], at[real]
        whole = hasher.spans(sums, edge, edge_end + depth - 1)
        fragments.append((np.searchsorted(offsets, edge + low, "right") - 1, edge + low, edge_end - edge,
                          at - edge, _mixed(raw[at], 0x94D049BB133111EB), whole))
    if not fragments:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*fragments))


def _chunk(t: pa.Table):
    """Ids (null: largest), bytes and offsets, in an order that depends only on the rows."""
    ids = t.column("id").to_numpy(zero_copy_only=False) if not t.column("id").null_count else \
        np.array([NO_ID if x is None else x for x in t.column("id").to_pylist()], np.int64)
    data, offsets = binary_parts(t.column("body"))
    order = np.argsort(ids, kind="stable")
    tied = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    if len(tied):  # one id in several rows: order by text as well
        body = t.column("body").combine_chunks()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], body[i].as_py())), np.int64)
    lengths = np.diff(offsets)[order]
    data = data[ranges(offsets[:-1][order], lengths)]
    return ids[order].astype(np.int64), data, np.concatenate(([0], np.cumsum(lengths))), order


def _routes(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an anchor is sent, and the 31 bits that stand for it there."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64) % n, (hashes >> np.uint64(33)).astype(np.int64)


def _by(dest: np.ndarray):
    """(value, slice) of each run of a sorted array."""
    cuts = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1]))) if len(dest) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(dest))):
        yield int(dest[a]), slice(int(a), int(b))


_MARKS = "dest int, chunk int, marks binary, counts binary"
_REPEATED = "dest int, chunk int, marks binary"


def _sent_anchors(n: int, depth: int, gram: int):
    """For each different anchor 31 bits, whether documents of the chunk share it, and its different fragments there."""
    def run(t: pa.Table) -> pa.Table:
        ids, data, offsets, _ = _chunk(t)
        row, _, _, _, hashes, whole = _anchored(data, offsets, depth, gram, _Hasher())
        dest, bits = _routes(hashes, n)
        key = (dest << 31) | bits
        order = np.lexsort((whole, key))
        key, own, whole = key[order], ids[row][order], whole[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        shared, counts = np.zeros(0, bool), np.zeros(0, np.int64)
        if len(head):
            shared = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head)
            counts = np.add.reduceat(np.concatenate(([True], (whole[1:] != whole[:-1]) | (key[1:] != key[:-1]))).astype(np.int64), head)
        key = key[head]
        marks = (((key & 0x7FFFFFFF) << 1) | shared).astype("<u4")
        out = [(d, marks[s].tobytes(), planes(counts[s])) for d, s in _by(key >> 31)]
        chunk = t.column("chunk")[0].as_py()
        return pa.table({"dest": pa.array([d for d, _, _ in out], pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int32()),
                         "marks": pa.array([m for _, m, _ in out], pa.binary()), "counts": pa.array([c for _, _, c in out], pa.binary())})

    return run


def _repeated_anchors(hot: int):
    """To each chunk its anchors that others share, with a bit for those of more than ``hot`` different fragments."""
    def run(t: pa.Table) -> pa.Table:
        dest, chunks = t.column("dest")[0].as_py(), t.column("chunk").to_pylist()
        marks = [np.frombuffer(m, "<u4") for m in t.column("marks").to_pylist()]
        values = np.concatenate(marks)
        bits, shared = values >> np.uint32(1), (values & np.uint32(1)).astype(bool)
        found, inverse, counts = np.unique(bits, return_inverse=True, return_counts=True)
        keep = counts > 1
        keep[inverse[shared]] = True
        total = np.bincount(inverse, np.concatenate([unplaned(c) for c in t.column("counts").to_pylist()]), len(found))
        keep, values = keep[inverse], ((bits << np.uint32(1)) | (total > hot)[inverse]).astype("<u4")
        ends = np.cumsum([len(m) for m in marks])
        out = [(c, values[e - len(m):e][keep[e - len(m):e]].tobytes()) for c, m, e in zip(chunks, marks, ends)]
        out = [x for x in out if x[1]]
        return pa.table({"dest": pa.array([dest] * len(out), pa.int32()), "chunk": pa.array([c for c, _ in out], pa.int32()),
                         "marks": pa.array([m for _, m in out], pa.binary())})

    return run


_FRAGMENTS = ("dest int, chunk int, anchors binary, ids binary, offset binary, windows binary, places binary, "
              "rows binary, starts binary, body binary")
_FRAGMENT_SCHEMA = pa.schema([("dest", pa.int32()), ("chunk", pa.int32())] + [
    (c, pa.binary()) for c in ("anchors", "ids", "offset", "windows", "places", "rows", "starts", "body")])


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i, whether ``size[i]`` bytes from ``a[i]`` and ``b[i]`` are equal."""
    same = np.ones(len(a), bool)
    for k in range(0, int(size.max()) if len(size) else 0):
        live = same & (size > k)
        same[live] = data[a[live] + k] == data[b[live] + k]
    return same


def _merged(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Unions of overlapping or touching spans of each row."""
    if not len(rows):
        return rows, starts, ends
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    top = int(ends.max()) + 1
    reach = np.maximum.accumulate(rows * top + ends)
    new = np.concatenate(([True], rows[1:] * top + starts[1:] > reach[:-1]))
    head = np.flatnonzero(new)
    return rows[head], starts[head], np.append(reach[head[1:] - 1], reach[-1]) - rows[head] * top


def _one_by_one(fragments: tuple, hot: np.ndarray, data: np.ndarray, n: int, depth: int, hasher: _Hasher) -> tuple:
    """Fragments (row, start, count, offset, hash of the bytes, route) with the hot ones as single windows, routed by all their bytes."""
    row, start, count, offset, whole, mine = (x[hot] for x in fragments)
    at = ranges(start, count)
    hashes = np.empty(len(at), np.uint64)
    # rolling hashes slice by slice of the data; fragments come in the order of their starts
    by = np.argsort(at, kind="stable")
    for low in range(0, len(data), SLICE):
        part = by[np.searchsorted(at[by], low):np.searchsorted(at[by], low + SLICE)]
        if len(part):
            sums = hasher.prefixes(data[low:low + SLICE + depth])
            hashes[part] = hasher.spans(sums, at[part] - low, at[part] - low + depth)
    dest, bits = _routes(_mixed(hashes, 0xD6E8FEB86659FD93), n)
    single = (np.repeat(row, count), at, np.ones(len(at), np.int64), np.zeros(len(at), np.int64), hashes, (dest << 31) | bits)
    return tuple(np.concatenate((x[~hot], y)) for x, y in zip(fragments, single))


def _sent_fragments(n: int, depth: int, gram: int):
    """Two kinds of rows: fragments for an anchor's task, and spans that a smaller id of
    the same chunk already shows to be repeated (no anchors; passed through)."""

    def run(t: pa.Table, marks: pa.Table) -> pa.Table:
        import zstandard

        if not t.num_rows or not marks.num_rows:
            return _FRAGMENT_SCHEMA.empty_table()
        ids, data, offsets, _ = _chunk(t)
        hasher = _Hasher()
        row, start, count, offset, hashes, whole = _anchored(data, offsets, depth, gram, hasher)
        dest, bits = _routes(hashes, n)
        known = np.concatenate([(np.int64(d) << 32) | np.frombuffer(m, "<u4").astype(np.int64)
                                for d, m in zip(marks.column("dest").to_pylist(), marks.column("marks").to_pylist())])
        known.sort()
        mine = (dest << 31) | bits
        at = np.minimum(np.searchsorted(known, mine << 1), len(known) - 1)
        live = known[at] >> 1 == mine
        hot = (known[at] & 1).astype(bool)[live]
        row, start, count, offset, whole, mine = fragments = tuple(x[live] for x in (row, start, count, offset, whole, mine))
        if hot.any():
            row, start, count, offset, whole, mine = _one_by_one(fragments, hot, data, n, depth, hasher)
        # equal fragments next to each other, the smallest id first
        order = np.lexsort((start, ids[row], whole, mine))
        row, start, count, offset, whole, mine = (x[order] for x in (row, start, count, offset, whole, mine))
        if not len(row):
            return _FRAGMENT_SCHEMA.empty_table()
        chunk = t.column("chunk")[0].as_py()
        same = (mine[1:] == mine[:-1]) & (whole[1:] == whole[:-1]) & (count[1:] == count[:-1]) & (offset[1:] == offset[:-1])
        near = np.flatnonzero(same)
        same[near] = _same_bytes(data, start[near], start[near + 1], count[near] + depth - 1)
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        group = np.cumsum(np.concatenate(([True], ~same))) - 1
        own = ids[row] == ids[row][head][group]
        # a larger id of this chunk: its windows are repeated whatever other chunks hold
        r, a, b = _merged(row[~own], start[~own], start[~own] + count[~own] + depth - 1)
        out = [(chunk % n, b"", b"", b"", b"", b"", r.astype("<i4").tobytes(), (a - offsets[r]).astype("<i8").tobytes(),
                (b - a).astype("<i8").tobytes())] if len(r) else []
        places = np.add.reduceat(own.astype(np.int64), head)
        row_o, start_o = row[own], (start - offsets[row])[own]
        place_end = np.cumsum(places)
        sent, f_id, f_off, f_count, f_start = mine[head], ids[row[head]], offset[head], count[head], start[head]
        for d, s in _by(sent >> 31):
            p = slice(int(place_end[s.start] - places[s.start]), int(place_end[s.stop - 1]))
            out.append((d, (sent[s] & 0x7FFFFFFF).astype("<u4").tobytes(), f_id[s].astype("<i8").tobytes(),
                        f_off[s].astype("u1").tobytes(), f_count[s].astype("u1").tobytes(), places[s].astype("<i4").tobytes(),
                        row_o[p].astype("<i4").tobytes(), start_o[p].astype("<i8").tobytes(),
                        zstandard.compress(data[ranges(f_start[s], f_count[s] + depth - 1)].tobytes(), 1)))
        if not out:
            return _FRAGMENT_SCHEMA.empty_table()
        columns = list(zip(*out))
        return pa.table([pa.array(columns[0], pa.int32()), pa.array([chunk] * len(out), pa.int32())]
                        + [pa.array(c, pa.binary()) for c in columns[1:]], schema=_FRAGMENT_SCHEMA)

    return run


def radix_groups(data: np.ndarray, starts: np.ndarray, first_digit: np.ndarray, depth: int):
    """Order windows by (first_digit, bytes) in passes of eight bytes, dropping
    groups of one after each. Returns the surviving windows' indices in order and
    a group number for each; a group is exactly one repeated window."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray(shape=(len(data) + 1,), dtype=">u8", buffer=padded.data, strides=(1,))
    order = np.argsort(first_digit, kind="stable")
    digit = first_digit[order]
    fresh = np.concatenate(([True], digit[1:] != digit[:-1])) if len(digit) else np.zeros(0, bool)

    def without_singletons(order, fresh):
        alone = fresh & np.append(fresh[1:], True)
        return order[~alone], fresh[~alone]

    order, fresh = without_singletons(order, fresh)
    at = 0
    while at < depth and len(order):
        width = min(8, depth - at)
        digit = words[starts[order] + at].astype(np.uint64) >> np.uint64(8 * (8 - width))
        change = np.concatenate(([True], digit[1:] != digit[:-1]))
        group = np.cumsum(fresh) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[change & ~fresh]] = True
        again = np.flatnonzero(mixed[group])  # only groups with more than one digit need ordering
        if len(again):
            place = again[np.lexsort((digit[again], group[again]))]
            order[again], digit[again] = order[place], digit[place]
            change = np.concatenate(([True], digit[1:] != digit[:-1]))
        order, fresh = without_singletons(order, fresh | change)
        at += width
    return order, np.cumsum(fresh) - 1 if len(fresh) else np.zeros(0, np.int64)


_SPANS = "chunk int, rows binary, starts binary, lengths binary"


def _repeated_windows(depth: int):
    def run(t: pa.Table) -> pa.Table:
        import zstandard

        local = pc.equal(pc.binary_length(t.column("anchors")), 0)
        passed, t = t.filter(local), t.filter(pc.invert(local))
        out = list(zip(*(passed.column(c).to_pylist() for c in ("chunk", "rows", "starts", "body"))))
        if t.num_rows:
            out += found(t, b"".join(map(zstandard.decompress, t.column("body").to_pylist())))
        columns = list(zip(*out)) or [()] * 4
        return pa.table({"chunk": pa.array(columns[0], pa.int32()), "rows": pa.array(columns[1], pa.binary()),
                         "starts": pa.array(columns[2], pa.binary()), "lengths": pa.array(columns[3], pa.binary())})

    def found(t: pa.Table, body: bytes) -> list[tuple]:
        def column(name: str, kind: str):
            each = [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
            return np.concatenate(each).astype(np.int64), np.array([len(x) for x in each], np.int64)

        chunks = np.array(t.column("chunk").to_pylist(), np.int64)
        (anchors, per), (ids, _), (offset, _), (count, _), (places, _) = (
            column(*x) for x in (("anchors", "<u4"), ("ids", "<i8"), ("offset", "u1"), ("windows", "u1"), ("places", "<i4")))
        (rows, _), (starts, _) = column("rows", "<i4"), column("starts", "<i8")
        data = np.frombuffer(body, np.uint8)
        size = count + depth - 1
        base = np.cumsum(size) - size
        # windows of each fragment, in order; the anchor's offset falls by one from window to window
        fragment = np.repeat(np.arange(len(count)), count)
        place = ranges(np.zeros(len(count)), count)
        window = base[fragment] + place
        _, anchor = np.unique(anchors, return_inverse=True)
        order, group = radix_groups(data, window, anchor[fragment] * 256 + offset[fragment] - place, depth)
        del window
        repeated = np.zeros(len(fragment), bool)
        if len(order):
            head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            least = np.minimum.reduceat(ids[fragment[order]], head)
            repeated[order] = least[group] < ids[fragment[order]]
        # runs of repeated windows in each fragment, at each of its places in its document
        first = repeated & np.concatenate(([True], ~repeated[:-1] | (fragment[1:] != fragment[:-1])))
        last = repeated & np.concatenate((~repeated[1:] | (fragment[1:] != fragment[:-1]), [True]))
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        owner = fragment[first]
        copies = places[owner]
        spot = ranges((np.cumsum(places) - places)[owner], copies)
        begin = starts[spot] + np.repeat(place[first], copies)
        length = np.repeat(place[last] - place[first] + depth, copies)
        chunk = np.repeat(np.repeat(chunks, per)[owner], copies)
        order = np.argsort(chunk, kind="stable")
        out = []
        for c, s in _by(chunk[order]):
            o = order[s]
            r, a, b = _merged(rows[spot][o], begin[o], begin[o] + length[o])
            out.append((c, r.astype("<i4").tobytes(), a.astype("<i8").tobytes(), (b - a).astype("<i8").tobytes()))
        return out

    return run


_KEPT = "id long, n_bytes long, starts array<bigint>, ends array<bigint>, kept binary"


def _applied(t: pa.Table, spans: pa.Table) -> pa.Table:
    kind = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())),
                      ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
    if not t.num_rows:
        return kind.empty_table()
    ids, data, offsets, order = _chunk(t)
    rows, starts, lengths = (np.concatenate([np.frombuffer(x, k) for x in spans.column(c).to_pylist()] or [np.zeros(0, k)]).astype(np.int64)
                             for c, k in (("rows", "<i4"), ("starts", "<i8"), ("lengths", "<i8")))
    rows, starts, ends = _merged(rows, starts, starts + lengths)
    keep = np.ones(len(data), bool)
    keep[ranges(offsets[rows] + starts, ends - starts)] = False
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    per = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(ids)))))
    lists = [pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(x, pa.int64())) for x in (starts, ends)]
    return pa.table([t.column("id").combine_chunks().take(pa.array(order)), pa.array(np.diff(offsets)), *lists,
                     pack_binary(data[keep], kept)], schema=kind)


def repeated_removed(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, starts, ends, kept): per document its length, the maximal
    removed byte spans in order, and the bytes that stay."""
    gram = max(1, min(GRAM, depth - 1))
    if not gram < depth <= 200:
        raise ValueError("depth must be from 2 to 200 bytes")
    n = chunk_count(docs, text)
    texts = dealt(docs, n, id_col, text)
    dests = 2 * n
    marks = (texts.groupBy("chunk").applyInArrow(_sent_anchors(dests, depth, gram), _MARKS)
             .groupBy("dest").applyInArrow(_repeated_anchors(HOT_FRAGMENTS), _REPEATED))
    spans = (texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_sent_fragments(dests, depth, gram), _FRAGMENTS)
             .groupBy("dest").applyInArrow(_repeated_windows(depth), _SPANS))
    # one plan: the three uses of the chunks share one shuffle of the texts
    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_applied, _KEPT)
