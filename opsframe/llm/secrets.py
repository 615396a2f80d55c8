"""Operator 11: secret scans through a trigram inverted index (DataFrame functions only).

A rule is a regular expression. ``trigram_query`` reads its syntax tree and derives a Boolean query over lower-case
trigrams that every match must contain: alternatives (any of them), each a set of trigrams (all of them). ``indexed`` writes
the inverted index, one posting (gram, key) for each trigram that some rule asks for and each text that holds it.
``candidates`` meets postings with the queries' terms and keeps the (text, rule) pairs for which all
postings of an alternative are there. Only those are verified: the expression runs over the whole text, and its pieces
between matches and its matches give the places. Rules without a mandatory trigram scan every text.

``key`` is a 64-bit hash of id and text and only routes: equal rows share one, and two texts that share one by chance are both
verified for the rules of either. Postings are counted before they are shuffled, by key, so a trigram that a third
of all texts hold is no group of its own. The texts are shuffled once, to meet their candidate rules; very many wholly equal rows
meet on one key, which adaptive execution splits. Nothing is collected; the terms come from the rules, not from the data.

Matches of one rule are leftmost and do not overlap; a match whose group ``group`` is shorter than ``least`` is dropped after
it has taken its place. Places are code points, ends exclusive. Rules are written in the syntax that Java and Python share,
and their matches are never empty.

Defined cases: null text is empty; null and repeated ids are kept, a row out for each row in; texts of any length are
searched whole; spans of several rules that start at one place come in the rules' order; extra columns are ignored; an empty
table gives no rows; without rules every list is empty.
"""

from __future__ import annotations

import re._constants as syntax
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.chunks import chunk_count, table

#: Strings that a part of a rule may stand for before it counts as unknown, and alternatives of a query.
MOST = 64
#: Spans that are gathered in one array before they move on to the list of arrays.
TOGETHER = 512


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# What a secret of each kind looks like. The first three are the base kinds.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # runs of 32 and more are whole runs: the class stops where a run does
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,200}:[^\x20\x09-\x0D/@]{1,200}@"),
)
BASE_KINDS = ("assign", "access", "hex")

Query = frozenset  # of alternatives, each a frozenset of trigrams; the empty alternative is always true
ALWAYS: Query = frozenset([frozenset()])


def _least(query: Query) -> Query:
    """Without alternatives that ask for all that another asks for, and more."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    """Both queries hold. One that would grow beyond bounds gives way: a query may ask for less, never for more."""
    if len(a) * len(b) > MOST:
        return a if a != ALWAYS else b
    return _least(frozenset(x | y for x in a for y in b))


def _grams(strings: set[str]) -> Query:
    """One of the strings is there."""
    return _least(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """What one part of an expression matches: its only strings (None: unknown), and the query of its matches."""
    if op is syntax.LITERAL:
        return ({chr(arg).lower()}, ALWAYS) if arg < 128 else (None, ALWAYS)
    if op is syntax.IN:
        letters = set()
        for kind, value in arg:
            if kind is syntax.LITERAL and value < 128:
                letters.add(chr(value).lower())
            else:
                return None, ALWAYS
        return letters, ALWAYS
    if op is syntax.SUBPATTERN:
        return _sequence(arg[3])
    if op is syntax.BRANCH:
        found = [_sequence(part) for part in arg[1]]
        if all(strings is not None for strings, _ in found):
            return set().union(*(strings for strings, _ in found)), ALWAYS
        each = [_grams(strings) if strings is not None else query for strings, query in found]
        return None, _least(frozenset().union(*each))
    if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT, syntax.POSSESSIVE_REPEAT):
        low, high, part = arg
        strings, query = _sequence(part)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALWAYS
        if (low, high) == (1, 1):
            return strings, query
        if not low:
            return None, ALWAYS
        strings, query = _sequence([*part] * min(low, 3))
        return None, query if strings is None else _grams(strings)
    if op in (syntax.AT, syntax.ASSERT, syntax.ASSERT_NOT):
        return {""}, ALWAYS  # takes no text
    return None, ALWAYS


def _sequence(parts) -> tuple[set[str] | None, Query]:
    whole, tails, query = True, {""}, ALWAYS
    for op, arg in parts:
        strings, inner = _node(op, arg)
        if strings is not None and len(tails) * len(strings) <= MOST:
            tails = {a + b for a in tails for b in strings}
            continue
        query = _both(_both(query, _grams(tails)), inner if strings is None else _grams(strings))
        whole, tails = False, {""}
    return (tails, ALWAYS) if whole else (None, _both(query, _grams(tails)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, one of which every text with a match holds in full."""
    strings, query = _sequence(parser.parse(pattern))
    return _grams(strings) if strings is not None else query


def _terms(rules: Sequence[Rule]) -> list[tuple[str, int, int, int]]:
    """(gram, rule, alternative, trigrams of the alternative) of all rules that ask for trigrams."""
    rows = []
    for number, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if frozenset() in query:
            continue
        for place, grams in enumerate(sorted(query, key=sorted)):
            rows += [(g, number, place, len(grams)) for g in sorted(grams)]
    return rows


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    key, body = F.col(id_col).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(key.alias("id"), body.alias("body"), F.xxhash64(key, body).alias("key"))


def indexed(docs: DataFrame, grams: Sequence[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index (gram, key) over the lower-case texts, in the order of the grams within each file."""
    low = _keyed(docs, id_col, text).select("key", F.lower("body").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return table(low.select("key", F.explode(held).alias("gram")).sortWithinPartitions("gram", "key"), "postings")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, rules): the numbers of the rules for which a text holds all trigrams of an alternative."""
    rows = F.array(*[F.struct(F.lit(g).alias("gram"), F.lit(r).alias("rule"), F.lit(a).alias("place"), F.lit(n).alias("need"))
                     for g, r, a, n in _terms(rules)])
    terms = index.sparkSession.range(1).select(F.inline(rows))  # as many rows as the rules have trigrams
    met = index.join(F.broadcast(terms), "gram").groupBy("key", "rule", "place").agg(F.collect_set("gram").alias("grams"), F.first("need").alias("need"))
    return met.filter(F.size("grams") == F.col("need")).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, order: int, body: Column) -> Column:
    """(start, rule, stop) of the matches in ``body``, in order."""
    kind = "array<struct<start:int,rule:int,stop:int>>"
    matches = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))
    asked = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group))
    sizes = F.zip_with(F.split(body, rule.pattern, -1), F.arrays_zip(matches.alias("match"), asked.alias("asked")), lambda piece, m: F.struct(
        F.char_length(piece).alias("skip"), F.char_length(m["match"]).alias("size"), F.char_length(m["asked"]).alias("asked")))

    def step(state: Column, one: Column) -> Column:
        start = state["at"] + one["skip"]
        stop = start + F.coalesce(one["size"], F.lit(0))
        span = F.when(one["asked"] >= rule.least, F.array(F.struct(start.alias("start"), F.lit(order).alias("rule"), stop.alias("stop"))))
        found = F.coalesce(span, F.array().cast(kind))
        full = F.size(state["open"]) >= TOGETHER
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
                        F.when(full, found).otherwise(F.concat(state["open"], found)).alias("open"), stop.alias("at"))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("open"), F.lit(0).alias("at"))
    return F.aggregate(sizes, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["open"]))))


def scanned(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans): for each row the spans (start, rule, stop, kind) of all rules, by start, then rule."""
    grams = sorted({g for g, *_ in _terms(rules)})
    asking = {r for _, r, *_ in _terms(rules)}
    rows = _keyed(docs, id_col, text)
    if grams:
        # as many partitions as the texts need, so that a task sorts one chunk of text
        rows = rows.repartition(chunk_count(docs, text), "key").join(candidates(indexed(docs, grams, id_col, text), rules), "key", "left")
    none = F.array().cast("array<struct<start:int,rule:int,stop:int>>")
    found = []
    for number, rule in enumerate(rules):
        body = F.col("body")
        there = body.rlike(rule.pattern)
        if number in asking:
            there = F.coalesce(F.array_contains("rules", F.lit(number)), F.lit(False)) & there
        found.append(F.when(there, _spans(rule, number, body)).otherwise(none))
    kinds = F.array(*[F.lit(r.kind) for r in rules], F.lit(None).cast("string"))
    spans = F.transform(F.array_sort(F.concat(none, *found)), lambda s: F.struct(
        s["start"].alias("start"), s["rule"].alias("rule"), s["stop"].alias("stop"), kinds[s["rule"]].alias("kind")))
    return rows.select("id", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
