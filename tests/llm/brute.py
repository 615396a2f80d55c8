"""Plain versions of the operators, one document or row at a time."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def repeated_spans(docs: list[tuple[int | None, str | None]], depth: int) -> list[tuple[list[list[int]], bytes]]:
    last = float("inf")
    rows = [(last if i is None else i, (t or "").encode()) for i, t in docs]
    first: dict[bytes, float] = {}
    for i, b in sorted(rows, key=lambda r: r[0]):
        for p in range(len(b) - depth + 1):
            first.setdefault(b[p:p + depth], i)
    out = []
    for i, b in rows:
        spans: list[list[int]] = []
        for p in range(len(b) - depth + 1):
            if first[b[p:p + depth]] < i:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + depth
                else:
                    spans.append([p, p + depth])
        kept, at = b"", 0
        for a, e in spans:
            kept, at = kept + b[at:a], e
        out.append((spans, kept + b[at:]))
    return out


def fingerprint(text: str | None, words: int) -> int:
    import xxhash

    tokens = WORD.findall(lower(text or ""))
    if not tokens:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[k:k + words]).encode(), 42) for k in range(max(1, len(tokens) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], distance: int) -> list[int]:
    """Smallest index of each fingerprint's component."""
    root = list(range(len(fps)))

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(fps))]


def kept_lines(docs: list[tuple[int | None, str | None]], long: int) -> dict[int, list[str]]:
    """Lines that stay, by position in ``docs``; ids must be different. Every run of lines that is long enough is looked at, of any length."""
    order = sorted((k for k, d in enumerate(docs) if d[1] is not None), key=lambda k: float("inf") if docs[k][0] is None else docs[k][0])
    lines = {k: docs[k][1].split("\n") for k in order}
    runs = [(k, p, e) for k in order for p in range(len(lines[k])) for e in range(p + 1, len(lines[k]) + 1) if len("\n".join(lines[k][p:e])) >= long]
    first: dict[tuple, tuple[int, int]] = {}
    for k, p, e in runs:
        first.setdefault(tuple(lines[k][p:e]), (k, p))
    gone = {(k, x) for k, p, e in runs if first[tuple(lines[k][p:e])] != (k, p) for x in range(p, e)}
    return {k: [x for p, x in enumerate(lines[k]) if (k, p) not in gone] for k in order}


def targets(sizes: dict[str | None, int], share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, found = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not full:
            return found | {s: level * weight[s] for s in free}
        for s in full:
            found[s] = most * sizes[s]
            left -= found[s]
        free -= full
    return found


def tree_scores(docs: list[tuple[str | None, bool]], pseudo: float, penalty: float) -> list[tuple[int, int, float, float]]:
    """(tokens, known tokens, base, score) of each (text, learn)."""
    rows = [[*WORD.findall(lower(t or "")), None] for t, _ in docs]
    train = [w for w, (_, learn) in zip(rows, docs) if learn]
    count = Counter(x for w in train for x in w)
    total, kinds = sum(count.values()), len(count)
    follow: dict[tuple, Counter] = defaultdict(Counter)
    for w in train:
        for k in range(1, len(w)):
            follow[(w[k - 1],)][w[k]] += 1
            if k > 1:
                follow[(w[k - 2], w[k - 1])][w[k]] += 1

    def root(x):
        return (count[x] + 0.5) / (total + 0.5 * (kinds + 1))

    states: dict[tuple, object] = {}

    def state(context):
        while context and context not in states:
            context = context[1:]
        return states[context] if context else root

    for context in sorted(follow, key=len):
        own, parent = follow[context], state(context[1:])
        whole = sum(own.values())
        rest = sum(n for n in own.values() if n < 2)

        def p(x, own=own, parent=parent, whole=whole, rest=rest):
            n = own.get(x, 0)
            return ((n if n > 1 else 0) + (rest + pseudo) * parent(x)) / (whole + pseudo)

        gain = sum(n * math.log(p(x) / parent(x)) - penalty for x, n in own.items() if n > 1)
        if rest < whole and gain + rest * math.log((rest + pseudo) / (whole + pseudo)) > 0:
            states[context] = p
    return [(len(w), sum(count[x] > 0 for x in w), sum(math.log10(root(x)) for x in w),
             sum(math.log10(state(tuple(w[max(0, k - 2):k]))(x)) for k, x in enumerate(w))) for w in rows]


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the base kinds: all matches of the stated expressions, those that are too short dropped."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    keys = assign[1:assign.index(")")]
    assign = assign.replace(keys, "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in keys))
    found = []
    for kind, (pattern, group, least) in enumerate([(assign, 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32)]):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(found)


def collocations(docs: list[tuple[str | None, str | None]], words: int, least: int, share: int, first: int) -> list[tuple]:
    freq: dict[str, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, words + 1):
                freq[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in freq.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer: Counter = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        rows = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return out


def hard_negatives(rows: dict[int, tuple[list[int], int]], anchors: list[int], positives: int, negatives: int, share: int) -> set[tuple]:
    """``rows``: id to integer vector and label."""
    out = set()
    for a in anchors:
        vector, label = rows[a]
        score = {i: sum(x * y for x, y in zip(vector, v)) for i, (v, _) in rows.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if rows[i][1] == label][:positives]:
            inside = [i for i in ranked if rows[i][1] != label and share * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(inside[:negatives], 1)}
    return out
