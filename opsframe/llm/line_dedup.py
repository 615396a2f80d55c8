"""Operator 8: repeated runs of lines, by a suffix array over line ids.

Documents become sequences of line ids. Prefix doubling gives every suffix (a
place in a document) its rank among all suffixes by the first 1, 2, 4, ... lines:
the rank at 2h is the order of the pairs (rank at h here, rank at h
h lines on). A suffix whose rank is shared by no other leaves, since
no longer prefix of it can be shared. Suffixes of one rank are the intervals of the suffix array whose longest
common prefix is at least h lines.

A run of lines counts as repeated from ``LONG`` characters on, whether it is one long line or several short ones: short lines may
well repeat by chance, and so may two of them. Every line asks for the shortest run from it on, and the shortest one that ends with
it, that is long enough (``LONG`` + 1 lines at most, since a line's end counts as a character). Two runs of L lines are equal if
their ranks at the largest h <= L agree here and L - h lines on, so doubling goes on to the longest run that is asked for. Together
the repeated ones of these runs cover exactly the maximal repeated runs of ``LONG`` characters and more. The first copy of a run (by
id, then place) stays, and lines that only later copies cover are deleted.

Only DataFrame operations are used. A line that a third of all documents hold is reduced to a
count and a first place by partial aggregates; joins are of many rows to one.

Defined cases: null text stays null and has no lines; an empty text has one empty line;
lines are parted by a newline alone, and empty lines count like others; a null id comes after
every id; rows equal in id and text are one document (all are cut alike); rows with one id and other texts are
ordered by a hash of the text; other columns are kept as they are, but for those named like the three counts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.chunks import parts, table

#: Characters of a line, or of a run of lines with the line ends between them.
LONG = 40
_LAST = (1 << 63) - 1
_KEY = ["_id", "_text"]


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """With the document's place in the order: its id (null last), then a hash of its text."""
    return docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), "_text": F.xxhash64(F.col(text))})


def _lines_of(sizes: Column, long: int) -> Column:
    """How many of the first lines together have ``long`` + 1 characters, line ends counted; 0: all of them have fewer."""
    def add(state: Column, size: Column) -> Column:
        reached = state["sum"] + size
        more = F.struct(reached.alias("sum"), (state["n"] + 1).alias("n"), (reached > long).alias("done"))
        return F.when(state["done"], state).otherwise(more)

    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(sizes, start, add, lambda s: F.when(s["done"], s["n"]).otherwise(0))


def line_ids(docs: DataFrame, id_col: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """(_id, _text, pos, line, ahead, back): one row per line; ``line`` is a 128-bit digest of it, ``ahead`` and ``back`` the
    lines of the shortest long run that starts, and that ends, with it (0: none)."""
    rows = _keyed(docs.select(F.col(id_col), F.col(text)), id_col, text).select(*_KEY, F.split(F.col(text), "\n", -1).alias("lines"))
    rows = rows.withColumn("sizes", F.transform("lines", lambda x: F.char_length(x) + 1))
    ahead = F.transform("sizes", lambda x, i: F.when(x > long, 1).otherwise(_lines_of(F.slice("sizes", i + 1, long + 1), long)))
    first = lambda i: F.greatest(i - long, F.lit(0))
    back = F.transform("sizes", lambda x, i: F.when(x > long, 1).otherwise(
        _lines_of(F.reverse(F.slice("sizes", first(i) + 1, i - first(i) + 1)), long)))
    each = rows.select(*_KEY, F.posexplode(F.arrays_zip(F.col("lines").alias("line"), ahead.alias("ahead"), back.alias("back"))).alias("pos", "one"))
    return each.select(*_KEY, "pos", F.unhex(F.md5("one.line")).alias("line"), "one.ahead", "one.back")


def _first_copy(pos: str) -> Column:
    return F.min(F.struct(*_KEY, F.col(pos).alias("pos")))


def _ranked(suffixes: DataFrame, keys: list[str], name: str, once: bool = False) -> DataFrame:
    """Suffixes that share their ``keys`` with another, with the keys' rank in
    order and the first of the suffixes that share them."""
    shared = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _first_copy("pos").alias("first")).filter("n > 1")
    # ranks: numbered inside ranges of the keys, then moved on by the sizes of earlier ranges
    sent = table(shared.repartitionByRange(parts(suffixes.sparkSession), *keys).withColumn("part", F.spark_partition_id()), name)
    sizes = sent.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = sent.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*keys)))
    ranks = inside.join(F.broadcast(offsets), "part").select(*keys, "first", (F.col("place") + F.col("offset")).alias("place"))
    ranked = suffixes.join(ranks, keys).drop(*keys).withColumnRenamed("place", "rank")
    # rows equal in id and text are one document; only what is shared is looked through for them
    return table(ranked.dropDuplicates([*_KEY, "pos"]) if once else ranked, name)


def doubled(ranks: DataFrame, at: int) -> DataFrame:
    """The suffixes that share twice ``at`` lines with another, from those that share ``at``."""
    ahead = ranks.select(*_KEY, (F.col("pos") - at).alias("pos"), F.col("rank").alias("next"))
    return _ranked(ranks.select(*_KEY, "pos", "rank").join(ahead, [*_KEY, "pos"]), ["rank", "next"], "ranks")


def _later_windows(windows: DataFrame, ranks: DataFrame, at: int) -> DataFrame:
    """Windows of ``at`` to 2 ``at`` - 1 lines that have an earlier copy."""
    here = ranks.select(*_KEY, F.col("pos").alias("start"), F.col("rank").alias("here"))
    there = ranks.select(*_KEY, F.col("pos").alias("last"), F.col("rank").alias("there"))
    known = (windows.filter(F.col("size").between(at, 2 * at - 1)).join(here, [*_KEY, "start"])
             .withColumn("last", F.col("start") + F.col("size") - at).join(there, [*_KEY, "last"]))
    same = ["size", "here", "there"]
    firsts = known.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), _first_copy("start").alias("first")).filter("n > 1").drop("n")
    later = F.col("first") != F.struct(*_KEY, F.col("start").alias("pos"))
    return known.join(firsts, same).filter(later).select(*_KEY, "start", "size")


def later_copies(docs: DataFrame, long: int = LONG, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _text, cut): per document with any, the sorted places of the lines that later copies cover."""
    if long < 1:
        raise ValueError("long must be at least 1")
    ranks = _ranked(table(line_ids(docs, id_col, text, long), "lines"), ["line"], "ranks", once=True)
    later = F.col("first") != F.struct(*_KEY, "pos")
    found = ranks.filter((F.col("ahead") == 1) & later).select(*_KEY, F.col("pos").alias("start"), F.lit(1).alias("size"))
    windows = (ranks.filter("ahead > 1").select(*_KEY, F.col("pos").alias("start"), F.col("ahead").alias("size"))
               .union(ranks.filter("back > 1").select(*_KEY, (F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("size"))).distinct())
    longest, at = ranks.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0, 1
    while 2 * at <= longest:  # long + 1 at most, so some six rounds
        ranks = doubled(ranks, at)
        at *= 2
        found = found.union(_later_windows(windows, ranks, at))
    cut = found.select(*_KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
    return cut.groupBy(*_KEY).agg(F.array_sort(F.collect_set("pos")).alias("cut"))


def _spans(cut: Column, n: Column) -> Column:
    """Runs of lines between the cut places, as (from, length)."""
    left, right = F.concat(F.array(F.lit(-1)), cut), F.concat(cut, F.array(n))
    spans = F.zip_with(left, right, lambda a, b: F.struct((a + 1).alias("at"), (b - a - 1).alias("size")))
    return F.filter(spans, lambda s: s["size"] > 0)


def deduplicated(docs: DataFrame, long: int = LONG, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text cut, and ``n_lines``, ``n_removed``, ``n_runs`` (maximal runs removed)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(id_col).alias("key"), F.col(text).cast("string").alias("body"))
    cut = later_copies(packed, long, "key", "body")
    lines, none = F.split("body", "\n", -1), F.array().cast("array<int>")
    joined = (_keyed(packed, "key", "body").join(cut, _KEY, "left")
              .withColumns({"gone": F.coalesce("cut", none), "lines": lines}))
    kept = F.flatten(F.transform(_spans(F.col("gone"), F.array_size("lines")),
                                 lambda s: F.slice(F.col("lines"), s["at"] + 1, s["size"])))
    starts = F.filter(F.zip_with(F.concat(F.array(F.lit(-2)), F.col("gone")), F.col("gone"), lambda a, b: b - a), lambda d: d > 1)
    made = {"n_lines": F.coalesce(F.array_size("lines"), F.lit(0)).cast("long"),
            "n_removed": F.array_size("gone").cast("long"), "n_runs": F.array_size(starts).cast("long")}
    body = F.when(F.size("gone") == 0, F.col("body")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[body.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in made],
                         *[v.alias(c) for c, v in made.items()])
