"""Operator 2: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are counts of words. Targets share a multiple of all words by weight; a source stops at
``max_repeats`` times its own size and the excess goes to the others by weight.

* *Blocks.* A source's documents fall into blocks by a seeded hash; the blocks of
  an epoch are permuted by another. Whole epochs take every block; the last, partial
  epoch takes blocks in permuted order up to the target and goes on document by document, through the block on the edge and
  those after it, until no unused document fits the gap. So every source has an exact quota of blocks.
* *Splitting tree.* A node holds the quotas of all sources. It gives its left child half of its blocks;
  how many of each source is a multivariate-hypergeometric draw, made source by
  source by inverting the conditional distribution at a seeded uniform number. The right child has the
  rest. Leaves are output shards, whose sizes differ by one block at most.
* *Shards.* A shard takes the next disjoint stretch of each source's permuted blocks, as
  long as its quota, and orders its documents by a seeded hash (a local shuffle). ``mixed`` cuts that order
  into stretches of about ``PIECE_BYTES`` of text, one partition each.

Only DataFrame operations are used. The number of blocks is bounded (``MAX_BLOCKS`` plus one
for each source and epoch), so blocks grow with the input and windows over them do not. A source that holds a
third of all rows is only ever added up by partial aggregates. Seeds are the only randomness, so reruns agree.

Defined cases: null or blank text has size 0; a document of size 0 is never needed for a target and is taken 0 times
outside whole epochs (it adds no words in them); null is a source like any other, last in order;
rows with one id are told apart by source and text, and wholly equal rows are taken alike; extra columns are kept
by ``mixed``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.chunks import table

#: Blocks of all sources together are this many at most, and hold BLOCK_WORDS words at least.
MAX_BLOCKS = 1 << 16
BLOCK_WORDS = 1 << 15
SHARDS = 16
#: Text bytes that a partition of the mixed rows holds on average. The number of partitions of a shard grows with the input.
PIECE_BYTES = 16 << 20
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
_LAST = (1 << 63) - 1


def _hash(*cols) -> Column:
    return F.xxhash64(F.lit(SEED), *cols)


def _uniform(*cols) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(_hash(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *more: str) -> DataFrame:
    """(id, mark, source, size) and ``more`` columns: ``mark`` tells rows with one id apart."""
    body = F.col(text).cast("string")
    return docs.select(*more, F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("mark"), F.col(source).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(totals: DataFrame, share: float = 1.5, max_repeats: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size), one row per source.

    Sources are ordered by code point (Spark compares strings byte by byte, which is the same), null
    last. Filling up to the caps: with sources in order of cap per weight, all before the first one
    below its cap are full, and the rest share what is left.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    rows = totals.select("source", "source_size", F.row_number().over(ordered).alias("place"), weight.alias("weight"), cap.alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * share
    left = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    levelled = rows.withColumn("level", left).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level at the first source that is not full holds for all after it
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)["level"]
    return (levelled.withColumn("final", level)
            .select("source", "source_size", "place", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target")))


def _hypergeometric(all_: Column, own: Column, drawn: Column, u: Column) -> Column:
    """How many of ``own`` are among ``drawn`` of ``all_``: the distribution function inverted at ``u``.

    Chances follow from one another by their ratio, from the smallest value on, and are divided by their
    sum. Values over 12 standard deviations from the mean (likelihood below 1e-30) are left out."""
    total, good, size = (x.cast("double") for x in (all_, own, drawn))
    mean = F.when(all_ > 0, size * good / total).otherwise(0.0)
    spread = F.when(all_ > 1, F.sqrt(mean * (1 - good / total) * (total - size) / (total - 1))).otherwise(0.0)
    low = F.greatest(F.lit(0).cast("long"), drawn + own - all_, F.floor(mean - 12 * spread - 2))
    high = F.greatest(low, F.least(own, drawn, F.ceil(mean + 12 * spread + 2)))

    def ratio(k: Column) -> Column:
        return F.when(k < high, (good - k) * (size - k) / ((k + 1) * (total - good - size + k + 1))).otherwise(0.0)

    def add(state: Column, k: Column) -> Column:
        return F.struct((state["sum"] + state["chance"]).alias("sum"), (state["chance"] * ratio(k)).alias("chance"))

    def pick(state: Column, k: Column) -> Column:
        return F.struct((state["left"] - state["chance"]).alias("left"), (state["chance"] * ratio(k)).alias("chance"),
                        F.when(state["left"] > 0, k).otherwise(state["value"]).alias("value"))

    values, one = F.sequence(low, high), F.lit(1.0).alias("chance")
    whole = F.aggregate(values, F.struct(F.lit(0.0).alias("sum"), one), add)["sum"]
    return F.aggregate(values, F.struct((u * whole).alias("left"), one, low.alias("value")), pick)["value"]


def split_tree(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, place, first, quota): which stretch of each source's permuted
    blocks each shard takes, from (place, quota) for each source.

    The root is one row with an array over the sources; each level draws the left children of all
    its nodes and so doubles the rows."""
    item = F.struct(F.col("place").cast("long").alias("place"), F.col("quota").cast("long").alias("quota"))
    nodes = quotas.agg(F.array_sort(F.collect_list(item)).alias("quotas")).select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), "quotas")
    zero = F.lit(0).cast("long")
    for _ in range(max(1, shards - 1).bit_length() if shards > 1 else 0):
        blocks = F.aggregate("quotas", zero, lambda s, q: s + q["quota"])
        half = F.ceil((F.col("high") - F.col("low")) / 2).cast("int")
        # blocks go to the shards of each side in proportion, so that shards end up equal to within one
        here = nodes.withColumns({"n": blocks, "half": half, "wide": F.col("high") - F.col("low")})
        here = here.withColumn("want", F.when(F.col("wide") <= 1, F.col("n")).otherwise(
            F.expr("n div wide * half + least(n % wide, half)")))
        empty = F.struct(F.col("n").alias("rest"), F.col("want").alias("want"), F.array().cast("array<bigint>").alias("drawn"))

        def draw(state: Column, q: Column) -> Column:
            taken = _hypergeometric(state["rest"], q["quota"], state["want"], _uniform(F.col("low"), F.col("high"), q["place"]))
            return F.transform(F.array(taken), lambda x: F.struct(
                (state["rest"] - q["quota"]).alias("rest"), (state["want"] - x).alias("want"),
                F.concat(state["drawn"], F.array(x)).alias("drawn")))[0]

        drawn = here.withColumn("left", F.aggregate("quotas", empty, draw)["drawn"])
        pick = lambda sign: F.zip_with("quotas", "left", lambda q, x: F.struct(
            q["place"].alias("place"), (x if sign else q["quota"] - x).alias("quota")))
        middle = F.col("low") + F.col("half")
        children = F.when(F.col("wide") <= 1, F.array(F.struct("low", "high", "quotas"))).otherwise(F.array(
            F.struct(F.col("low"), middle.alias("high"), pick(True).alias("quotas")),
            F.struct(middle.alias("low"), F.col("high"), pick(False).alias("quotas"))))
        nodes = drawn.select(F.inline(children))
    flat = nodes.select(F.col("low").alias("shard"), F.inline("quotas"))
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("quota").over(earlier), F.lit(0)))


def plan(sized: DataFrame, shards: int, share: float = 1.5, max_repeats: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Two small tables: (source, source_size, place, target, n_blocks) per source, and
    (place, block, whole, edge, cutoff, skipped) per block that is used: its copies in whole, and the
    copy of the documents that ``cutoff`` admits by hash and size and ``skipped`` does not name."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = table(targets(totals, share, max_repeats).join(totals.select("source", "rows").withColumnRenamed("source", "_s"),
                                                             F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "sources")
    # words and rows both count, so that many empty documents still make many blocks
    load = F.col("source_size") + F.col("rows")
    per_block = F.greatest(F.lit(BLOCK_WORDS), F.ceil(F.sum(load).over(Window.partitionBy()) / MAX_BLOCKS))
    sources = table(sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(load / per_block)).cast("long")).drop("rows"), "sources")
    placed = _placed(sized, sources)
    blocks = table(placed.groupBy("place", "block").agg(F.sum("size").alias("words")), "blocks")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    needed = sources.select("place", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))
    rows = blocks.join(needed, "place").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    permuted = Window.partitionBy("place").orderBy("epoch", _hash(F.lit("block"), "place", "epoch", "block"), "block")
    partial = F.when(F.col("epoch") == F.col("epochs"), F.col("words")).otherwise(0)
    rows = rows.withColumns({"slot": F.row_number().over(permuted) - 1, "end": F.sum(partial).over(permuted)})
    whole = (F.col("epoch") < F.col("epochs")) | (F.col("end") <= F.col("rest"))
    rows = table(rows.withColumn("is_whole", whole), "slots")
    edges = table(_edges(placed, rows.filter("not is_whole and rest > 0")), "edges")
    used = rows.join(edges.select("place", "slot", F.lit(True).alias("is_edge")), ["place", "slot"], "left").filter("is_whole or is_edge")
    # a block of the rest of the epoch of which nothing is taken has no place in the shards
    kept = Window.partitionBy("place").orderBy("slot")
    used = table(used.withColumn("slot", F.row_number().over(kept) - 1), "used")
    quotas = used.groupBy("place").agg(F.count(F.lit(1)).alias("quota"))
    shard = table(split_tree(quotas, shards).filter("quota > 0").select("place", "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("slot")), "shards")
    copy = F.struct("epoch", "shard")
    taken = (used.join(shard, ["place", "slot"]).groupBy("place", "block")
             .agg(F.sort_array(F.collect_list(F.when(F.col("is_whole"), copy))).alias("whole"), F.max(F.when(F.col("is_edge"), copy)).alias("edge")))
    return sources, table(taken.join(edges.drop("slot"), ["place", "block"], "left"), "taken")


def _edges(placed: DataFrame, later: DataFrame) -> DataFrame:
    """(place, slot, block, cutoff, skipped) per block of the rest of the partial epoch of which documents are taken.

    The order is that of the permuted blocks, and of the hash in a block. A pass takes, of the documents that fit the gap, as
    many as reach up to it; the next begins after them with the gap that is left, until no document after them fits. Documents
    passed over are larger than the gap was then, so at the end no unused one fits. ``cutoff`` has a block's
    passes and ``skipped`` the hashes of equal rows that fit one by one and not together."""
    later = table(later.select("place", "block", "slot", "rest", "end", "words"), "later")
    units = table(_small(placed, later.select("place", "block", "slot"), ["place", "block"], "inner").filter("size > 0")
                  .groupBy("place", "block", "slot", "hash").agg(F.sum("size").alias("size"), F.max("size").alias("row")), "units")
    # the edge block's gap; no block before it is open
    gaps = later.groupBy("place").agg(F.min(F.struct("slot", (F.col("rest") - F.col("end") + F.col("words")).alias("gap")))["gap"].alias("gap"))
    gaps = table(gaps.select("place", "gap", F.lit(-1).alias("low_slot"), F.lit(_LAST).alias("low_hash")), "gaps")
    state, passes = gaps.columns, []
    while not gaps.isEmpty():
        after = (F.col("slot") > F.col("low_slot")) | ((F.col("slot") == F.col("low_slot")) & (F.col("hash") > F.col("low_hash")))
        fits = _small(units, gaps, ["place"], "inner").filter((F.col("size") <= F.col("gap")) & after)
        up_to = F.sum("words").over(Window.partitionBy("place").orderBy("slot"))
        by_block = fits.groupBy(*state, "slot").agg(F.sum("size").alias("words")).withColumn("up_to", up_to)
        full = F.col("up_to") <= F.col("gap")
        found = table(by_block.groupBy(*state).agg(F.max(F.when(full, F.col("slot"))).alias("last"), F.min(F.when(~full, F.col("slot"))).alias("open"),
                                                   F.coalesce(F.max(F.when(full, F.col("up_to"))), F.lit(0)).alias("got")), "found")
        # the block that crosses the target, by document
        opened = fits.join(F.broadcast(found.select("place", F.col("open").alias("slot"), "got")), ["place", "slot"])
        reach = F.col("got") + F.sum("size").over(Window.partitionBy("place").orderBy("hash"))
        inside = opened.withColumn("reach", reach).filter("reach <= gap").groupBy("place").agg(F.max("hash").alias("hash"), F.max("reach").alias("reach"))
        step = found.join(inside, "place", "left")
        step = table(step.select(*state, "open", F.when(F.col("hash").isNull(), F.col("last")).otherwise(F.col("open")).alias("high_slot"),
                                 F.coalesce("hash", F.lit(_LAST)).alias("high_hash"),
                                 (F.col("gap") - F.coalesce("reach", "got")).alias("left")), "passes")
        passes.append(step.select(*state, "high_slot", "high_hash"))
        gaps = step.filter("open is not null and left >= 1").select("place", F.col("left").alias("gap"), F.col("high_slot").alias("low_slot"),
                                                                    F.col("high_hash").alias("low_hash"))
    every = gaps.withColumns({"high_slot": F.col("low_slot"), "high_hash": F.col("low_hash")})
    for one in passes:
        every = every.union(one)
    after = (F.col("slot") > F.col("low_slot")) | ((F.col("slot") == F.col("low_slot")) & (F.col("hash") > F.col("low_hash")))
    until = (F.col("slot") < F.col("high_slot")) | ((F.col("slot") == F.col("high_slot")) & (F.col("hash") <= F.col("high_hash")))
    met = _small(units, table(every, "every"), ["place"], "inner").filter(after & until & (F.col("row") <= F.col("gap")))
    bounds = F.struct(F.when(F.col("slot") == F.col("low_slot"), F.col("low_hash")).alias("low"),
                      F.when(F.col("slot") == F.col("high_slot"), F.col("high_hash")).otherwise(_LAST).alias("high"), "gap")
    fit = F.col("size") <= F.col("gap")
    return (met.groupBy("place", "slot", "block").agg(F.collect_set(F.when(fit, bounds)).alias("cutoff"),
                                                      F.collect_list(F.when(~fit, F.col("hash"))).alias("skipped")).filter(F.size("cutoff") > 0))


def _small(df: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with ``other``, which is broadcast only if it has no more rows than the bound on blocks."""
    return df.join(F.broadcast(other) if other.count() <= 2 * MAX_BLOCKS else other, on, how)


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """With the source's row, the document's block and its hash."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias("_key")
    known = sources.select(key("source"), "source_size", "place", "target", "n_blocks")
    return (_small(sized.withColumn("_key", key("source")), known, ["_key"], "inner").drop("_key")
            .withColumns({"block": F.pmod(_hash(F.lit("of"), "id", "mark"), "n_blocks"), "hash": _hash(F.lit("edge"), "id", "mark")}))


def _copies(sized: DataFrame, sources: DataFrame, taken: DataFrame) -> DataFrame:
    """With ``copies``: (epoch, shard) of each time the mix takes the document."""
    joined = _small(_placed(sized, sources), taken, ["place", "block"], "left")
    fits = (F.col("size") > 0) & ~F.array_contains("skipped", F.col("hash")) & F.exists(
        "cutoff", lambda p: (F.col("size") <= p["gap"]) & (F.col("hash") <= p["high"]) & (p["low"].isNull() | (F.col("hash") > p["low"])))
    edge = F.when(fits, F.array("edge")).otherwise(F.array().cast("array<struct<epoch:int,shard:int>>"))
    return joined.withColumn("copies", F.when(F.col("whole").isNull(), F.array().cast("array<struct<epoch:int,shard:int>>"))
                             .otherwise(F.concat("whole", edge)))


def drawn(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies): what the mix takes of every row."""
    sized = table(sizes(docs, id_col, text, source), "sizes")
    return _copies(sized, *plan(sized, shards)).select("id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, dealt to their shards and shuffled in each.

    A shard is one or more partitions, each a stretch of its order, in sequence: their number grows with the bytes of the mix."""
    bytes_of = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("bytes")
    sized = table(sizes(docs.select(id_col, text, source, bytes_of), id_col, text, source, "bytes"), "sizes")
    sources, taken = plan(sized, shards)
    total = _copies(sized, sources, taken).agg(F.sum(F.col("bytes") * F.size("copies"))).first()[0] or 0
    pieces = max(1, -(-total // (shards * PIECE_BYTES)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = sizes(docs.select(row.alias("row")), f"row.{id_col}", f"row.{text}", f"row.{source}", "row")
    copies = _copies(packed, sources, taken).select("row", "id", "mark", F.inline("copies"))
    copies = copies.select("row", "shard", _hash(F.lit("order"), "epoch", "shard", "id", "mark").alias("order"))
    # hashes are spread evenly, so stretches of equal width hold equal shares of a shard
    stretch = F.least(F.lit(pieces - 1), F.floor((F.col("order") / float(1 << 64) + 0.5) * pieces))
    return (copies.withColumn("piece", (F.col("shard") * pieces + stretch).cast("int"))
            .repartitionById(shards * pieces, "piece").sortWithinPartitions("shard", "order")
            .select(*[F.col("row")[c].alias(c) for c in docs.columns]))
