"""Joins with the reference's semantics, written to scale.

Conventions: every function takes and returns DataFrames; join keys are
given as ``[(left_col, right_col), ...]`` or a list of shared names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.dates import calendar_units
from opsframe.session import pin

Keys = Sequence[str] | Sequence[tuple[str, str]]


def _pairs(on: Keys) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in on]


def _cond(left: DataFrame, right: DataFrame, on: Keys) -> Column:
    return reduce(and_, [left[a] == right[b] for a, b in _pairs(on)])


def left_outer(left: DataFrame, right: DataFrame, on: Keys, extra: Column | None = None,
               first_right: Column | None = None, matches_first=None) -> DataFrame:
    """LEFT OUTER JOIN that survives a hot key on either side.

    Adaptive execution may split only the left side of a left outer join, so a key holding a third of the right rows would
    land in one task. An inner join it splits on both sides. So the matches come from an inner join, and the
    left rows without one from an anti-join against one row per right key (a partial aggregate). Both take the left side in the same
    partitioning, which is shuffled once. With ``extra`` (a condition beyond the keys) that row holds ``first_right``, an
    aggregate over the key's right rows such as ``min(t)``, and ``matches_first(left, agg)`` says whether a left row matches given it.

    Column names of the two sides must be distinct.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"left_outer needs distinct column names, both sides have {sorted(clash)}")
    pairs = _pairs(on)
    found = left.join(right, _cond(left, right, on) if extra is None else _cond(left, right, on) & extra, "inner")
    keys = right.select(*[b for _, b in pairs]).distinct() if extra is None else right.groupBy(*[b for _, b in pairs]).agg(first_right.alias("_lo_first"))
    keys = keys.select(*[F.col(b).alias(f"_lo_k{i}") for i, (_, b) in enumerate(pairs)], *([] if extra is None else ["_lo_first"]))
    same = reduce(and_, [left[a] == keys[f"_lo_k{i}"] for i, (a, _) in enumerate(pairs)])
    alone = left.join(keys, same if extra is None else same & matches_first(left, keys["_lo_first"]), "left_anti")
    return found.unionByName(alone.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]))


def star_left(spine: DataFrame, lookups: Sequence[tuple[DataFrame, Keys | Column]]) -> DataFrame:
    """Chain of left look-up joins on one spine.

    Each look-up is ``(frame, keys)``; keys may be a Column condition. No
    broadcast hint: AQE converts each to a broadcast join at run time when
    the measured side is small, and keeps a shuffle join otherwise.
    """
    out = spine
    for right, on in lookups:
        cond = on if isinstance(on, Column) else _cond(out, right, on)
        out = out.join(right, cond, "left")
    return out


def left_join_where(left: DataFrame, right: DataFrame, on: Keys, right_predicate: Column,
                    right_unique: bool = False) -> DataFrame:
    """``left join r on k and <predicate on r>`` -- the predicate filters
    the right side *before* the join, so unmatched left rows are kept.
    ``right_unique`` says the right side has at most one row per key (a
    keyed look-up): then a plain left join, with no hot right key to split."""
    r = right.filter(right_predicate)
    if right_unique:
        return left.join(r, _cond(left, r, on), "left")
    return left_outer(left, r, on)


def join_earlier(left: DataFrame, right: DataFrame, on: Keys, right_time: str, left_time: str,
                 strict: bool = False, how: str = "left") -> DataFrame:
    """Equality plus ``right.t <= left.t`` (``<`` when strict).

    Every earlier right row matches (this is not an as-of join); the
    fan-out is kept. Spark plans an equi-join on the keys with the
    inequality as a join filter. Written as ``left_outer``: the inner part
    lets AQE split a hot key on either side; left rows with no earlier
    right row are found by an anti-join against the earliest right time per key.
    """
    lt, rt = left[left_time], right[right_time]
    extra = (rt < lt) if strict else (rt <= lt)
    if how == "inner":
        return left.join(right, _cond(left, right, on) & extra, "inner")
    if how != "left":
        raise ValueError("join_earlier supports how='left' or 'inner'")
    return left_outer(left, right, on, extra, first_right=F.min(right_time),
                      matches_first=lambda j, first: (first < j[left_time]) if strict else (first <= j[left_time]))


def unmatched(left: DataFrame, right: DataFrame, on: Keys) -> DataFrame:
    """``left join r ... where r.k is null`` written as ``left_anti``.

    Catalyst does not rewrite the LEFT/IS NULL form into an anti-join; the
    anti-join never materialises the joined rows. The right keys are made
    distinct first (a partial aggregate, whose hash partitioning the join
    reuses), so a hot right key is one row per map task, not a buffered run.
    """
    keys = right.select(*[b for _, b in _pairs(on)]).distinct()
    return left.join(keys, _cond(left, keys, on), "left_anti")


def semi(left: DataFrame, right: DataFrame, on: Keys) -> DataFrame:
    """``k in (select ...)`` (right keys made distinct first, as in ``unmatched``)."""
    keys = right.select(*[b for _, b in _pairs(on)]).distinct()
    return left.join(keys, _cond(left, keys, on), "left_semi")


def not_in(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """SQL ``left_col NOT IN (select right_col from right)``, null-aware.

    SQL rules: one null in the subquery empties the result; an empty
    subquery keeps every left row (null keys too); otherwise null left keys
    are dropped and the rest anti-joined.

    Spark's own null-aware anti-join needs the whole subquery broadcast,
    which does not hold at scale. Here the two facts that decide the case
    (row count, null count) come from one distributed aggregation that
    returns a single row, then a plain shuffle ``left_anti`` runs on the
    non-null keys.
    """
    keys = right.select(F.col(right_col).alias("_nin_k"))
    stats = keys.agg(F.count(F.lit(1)).alias("n"),
                     F.count(F.when(F.col("_nin_k").isNull(), 1)).alias("nulls")).first()
    if stats["n"] == 0:
        return left
    if stats["nulls"] > 0:
        return left.filter(F.lit(False))
    nonnull = keys.filter(F.col("_nin_k").isNotNull()).distinct()
    kept = left.filter(F.col(left_col).isNotNull())
    return kept.join(nonnull, kept[left_col] == nonnull["_nin_k"], "left_anti")


def distinct_lookup(left: DataFrame, right: DataFrame, on: Keys, cols: Sequence[str]) -> DataFrame:
    """Left join to ``select distinct <cols>`` of a look-up.

    The distinct is a partial (map-side) aggregation; a key that keeps
    several distinct rows fans the left row out, as in the source.
    """
    names = list(dict.fromkeys([b for _, b in _pairs(on)] + list(cols)))
    d = right.select(*names).distinct()
    return left_outer(left, d, on)


def member_join(left: DataFrame, left_col: str, right: DataFrame, array_col: str,
                how: str = "inner") -> DataFrame:
    """``left.x = ANY(right.arr)`` as explode + equi-join.

    ``array_distinct`` first, so a repeated member does not repeat the row.
    Scales as a normal shuffle join (no nested loop over arrays).
    """
    ex = right.withColumn("_member", F.explode(F.array_distinct(F.col(array_col))))
    out = left.join(ex, left[left_col] == ex["_member"], how)
    return out.drop("_member")


GRAM = 3
#: Sizes of the substrings under which texts and names meet; a run of literals takes the largest that fits.
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Kinds of keys: the empty one, substrings of these sizes, and (below 0) those of ``GRAM`` with one character skipped after the first.
KINDS = (0, *SIZES, *(-k for k in range(1, GRAM)))


def _key(kind: Column, a: Column, b: Column) -> Column:
    """A key's hash: two that share it only meet in vain."""
    return F.xxhash64(kind, a, b)


def _text_keys(text: Column, kinds: Sequence[int] = KINDS) -> Column:
    """Keys under which a text can be found, those of the given kinds."""
    n, none = F.char_length(text), F.lit("")

    def at(kind: int):
        if kind > 0:
            return lambda i: _key(F.lit(kind), text.substr(i, F.lit(kind)), none)
        return lambda i: _key(F.lit(kind), text.substr(i, F.lit(-kind)), text.substr(i - kind + 1, F.lit(GRAM + kind)))

    found = [F.array(_key(F.lit(0), none, none))] if 0 in kinds else []
    for kind in (k for k in kinds if k):
        width = kind if kind > 0 else GRAM + 1
        starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(starts, at(kind)))
    return F.array_distinct(F.concat(*found))


def _pattern_keys(pattern: Column) -> Column:
    """Keys that every text matching the pattern has, with their kinds. Each run of literals brings the substrings of the largest of
    ``SIZES`` that fits, end to end; each "_" the ``GRAM`` characters around it. Shorter runs count only if there is nothing longer.
    The empty key is the only one of a pattern without literals, and of one with an escape."""
    none = F.lit("")

    def of_run(run: Column) -> Column:
        n = F.char_length(run)
        size = F.coalesce(*[F.when(n >= s, F.lit(s)) for s in reversed(SIZES)])
        last = n - size + 1
        starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, size), F.array(last)))
        return F.transform(starts, lambda i: F.struct(size.alias("size"), size.alias("kind"), _key(size, run.substr(i, size), none).alias("g")))

    def around(k: int):
        def at(i: Column) -> Column:
            a, b = pattern.substr(i, F.lit(k)), pattern.substr(i + k + 1, F.lit(GRAM - k))
            fits = (pattern.substr(i + k, F.lit(1)) == "_") & ~F.concat(a, b).rlike("[%_]")
            return F.when(fits, F.struct(F.lit(GRAM).alias("size"), F.lit(-k).alias("kind"), _key(F.lit(-k), a, b).alias("g")))
        return at

    runs = F.filter(F.split(pattern, "[%_]"), lambda r: F.char_length(r) > 0)
    n = F.char_length(pattern)
    starts = F.when(n > GRAM, F.sequence(F.lit(1), n - GRAM)).otherwise(F.array().cast("array<int>"))
    parted = [F.filter(F.transform(starts, around(k)), lambda key: key.isNotNull()) for k in range(1, GRAM)]
    keys = F.concat(F.flatten(F.transform(runs, of_run)), *parted)
    least = F.least(F.lit(GRAM), F.array_max(F.transform(keys, lambda key: key["size"])))
    empty = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("kind"), _key(F.lit(0), none, none).alias("g")))
    return (F.when(pattern.contains("\\") | (F.size(keys) == 0), empty)
            .otherwise(F.array_distinct(F.filter(keys, lambda key: key["size"] >= least))))


#: Hash values of the mask below: so many rows it has at most, whatever the number of names.
MASK = 1 << 20


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _masked(of_text: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text keys whose hash a wanted key has. The mask holds one long for each hash value, ``MASK`` at most, and is
    broadcast on that proof; a key that slips through by its hash meets nothing later."""
    bit = lambda: F.pmod("_g", F.lit(MASK))
    return of_text.join(F.broadcast(wanted.select(bit().alias("_bit")).distinct()), bit() == F.col("_bit"), "left_semi")


def contains_keys(L: DataFrame, text_col: str, R: DataFrame, name_col: str, lid: str, rid: str) -> tuple[DataFrame, DataFrame]:
    """((lid, key) of the texts, (rid, key) of the names): the names' side first. Every name brings keys that all its
    matches have; texts count those alone; every name keeps its rarest; and texts send the keys kept."""
    of_name = (R.filter(F.col(name_col).isNotNull()).select(rid, F.explode(_pattern_keys(F.col(name_col))).alias("_k"))
               .select(rid, F.col("_k.kind").alias("_kind"), F.col("_k.g").alias("_g")))
    of_name = pin(of_name, "contains_names")
    kinds = sorted(r[0] for r in of_name.select("_kind").distinct().collect())  # of KINDS
    # cut out of the texts once: counted here, sent below; few bytes of text are much work, so they are dealt out first
    dealt = L.select(lid, text_col).repartition(_partitions(L), lid)
    of_text = pin(_masked(dealt.select(lid, F.explode(_text_keys(F.col(text_col), kinds or KINDS)).alias("_g")), of_name), "contains_keys")
    often = of_text.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    choice = (of_name.select(rid, "_g").distinct().join(often, "_g", "left")
              .groupBy(rid).agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_g").alias("g"))).alias("_c"))
              .filter("_c.f > 0").select(rid, F.col("_c.g").alias("_g")))
    choice = pin(choice, "contains_choice")
    return _masked(of_text, choice), choice


#: Rows that a task of ``contains_join`` makes, about.
MADE = 1 << 20


def contains_join(left: DataFrame, text_col: str, right: DataFrame, name_col: str) -> DataFrame:
    """``left.text LIKE '%' || right.name || '%'`` without a cartesian product.

    Different texts and names meet first, each once. Every name picks, of the substrings that all texts matching it must
    have, the one that the fewest texts have: as long as its runs of literals allow (``SIZES``), so that names which differ
    are found under different keys however many they are. ``_`` wildcards are stepped over, so names like ``NATION_7`` are
    found under what differs (``ON_7``), not under what all share. Texts send only the substrings that some name has picked
    (``contains_keys``), so the rows that move are bounded by what the names can match. Texts and names meet
    in an equi-join on that key and the LIKE decides. A name without any
    literal meets every text, as its result does. Crowded keys are split by adaptive
    execution (an inner join).

    Then rows with the same text or name take part in what these have found. The rows to come are counted, so there
    are partitions for them; a text with many is dealt over several, its rows sent to each.
    """
    lid, rid, text, name = "_cj_lid", "_cj_rid", "_cj_text", "_cj_name"
    # pin the ids: both sides are read more than once below
    L, R = pin(left, "contains_left"), pin(right.withColumn(rid, F.monotonically_increasing_id()), "contains_right")

    def different(rows: DataFrame, col: str, as_: str, id_: str, n: str) -> DataFrame:
        d = rows.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias(as_)).agg(F.count(F.lit(1)).alias(n))
        return pin(d.withColumn(id_, F.monotonically_increasing_id()), f"contains{as_}")

    texts, names = different(L, text_col, text, lid, "_cj_nl"), different(R, name_col, name, "_cj_nid", "_cj_nr")
    of_text, choice = contains_keys(texts, text, names, name, lid, "_cj_nid")
    met = of_text.join(choice, "_g").select(lid, "_cj_nid")
    pairs = pin(met.join(texts, lid).join(names, "_cj_nid")
                .filter(F.like(F.col(text), F.concat(F.lit("%"), F.col(name), F.lit("%"))))
                .select(text, name, (F.col("_cj_nl") * F.col("_cj_nr")).alias("_cj_n")), "contains_pairs")

    made = pairs.groupBy(F.col(text).alias("_cj_t")).agg(F.sum("_cj_n").alias("_cj_n"))
    parts = max(_partitions(left), 1 + int((made.agg(F.sum("_cj_n")).first()[0] or 0) // MADE))
    crowded = made.filter(F.col("_cj_n") > MADE).select("_cj_t", F.ceil(F.col("_cj_n") / MADE).cast("int").alias("_cj_s"))

    def shares(rows: DataFrame, col: str) -> DataFrame:
        return rows.join(crowded, rows[col] == crowded["_cj_t"], "left").withColumn("_cj_s", F.coalesce("_cj_s", F.lit(1))).drop("_cj_t")

    # under names of their own: the sides may share some
    l_cols, r_cols = [f"_cj_l{i}" for i in range(len(left.columns))], [f"_cj_r{i}" for i in range(len(right.columns))]
    lt, rn = l_cols[left.columns.index(text_col)], r_cols[right.columns.index(name_col)]
    found = pairs.select(text, name).join(R.toDF(*r_cols, rid), F.col(name) == F.col(rn))
    found = shares(found, text).withColumn("_cj_p", F.pmod(F.xxhash64(rid), F.col("_cj_s")).cast("int"))
    held = shares(L.toDF(*l_cols), lt).withColumn("_cj_q", F.explode(F.sequence(F.lit(0), F.col("_cj_s") - 1)))
    found, held = found.repartition(parts, text, "_cj_p"), held.repartition(parts, lt, "_cj_q")
    out = held.join(found, (F.col(lt) == F.col(text)) & (F.col("_cj_q") == F.col("_cj_p")))
    return out.select(*l_cols, *r_cols).toDF(*left.columns, *right.columns)


def _minute_bucket(ts: Column, bucket_minutes: int) -> Column:
    """Monotone bucket number of a timestamp, on its calendar fields (no
    time zone involved, so no daylight-saving jump)."""
    return F.floor(calendar_units("MINUTE", ts) / F.lit(bucket_minutes)).cast("long")


def within_after(left: DataFrame, right: DataFrame, on: Keys, left_time: str, right_time: str,
                 max_minutes: int, bucket_minutes: int | None = None) -> DataFrame:
    """Range join: ``right.t`` in ``[left.t, left.t + max_minutes]`` on equal keys.

    A plain equi-join on the keys would pair every left row with every right
    row of the key and then filter on time -- all pairs of a busy key. Here
    both sides also carry a time bucket: each right row its own, each left
    row the few buckets its window touches. The equi-join on (keys, bucket)
    only meets rows that are close in time; the exact predicate then
    decides. Every qualifying pair meets in exactly one bucket. Inner join
    only: a left row sits in several buckets, so an outer form would
    null-extend it once per empty bucket.
    """
    b = bucket_minutes or max_minutes
    lt, rt = left[left_time], right[right_time]
    lb = left.withColumn("_rjb", F.explode(F.sequence(
        _minute_bucket(lt, b), _minute_bucket(F.timestamp_add("MINUTE", F.lit(max_minutes), lt), b))))
    rb = right.withColumn("_rjb2", _minute_bucket(rt, b))
    cond = _cond(lb, rb, on) & (lb["_rjb"] == rb["_rjb2"])
    cond = cond & (rb[right_time] >= lb[left_time]) & (rb[right_time] <= F.timestamp_add("MINUTE", F.lit(max_minutes), lb[left_time]))
    return lb.join(rb, cond, "inner").drop("_rjb", "_rjb2")


def ratio_to_days_before(daily: DataFrame, date_col: str, value_col: str, days: int = 7,
                         prev_date: str = "prev_date", prev_value: str = "prev_count",
                         ratio_col: str = "ratio") -> DataFrame:
    """Each day's value against the value ``days`` earlier (left
    self-join on the shifted date; the ratio is null when there is no
    earlier day or it is zero). ``daily`` holds one row per date, so both
    sides are as small as the calendar; AQE broadcasts one of them."""
    a = daily.withColumn(prev_date, F.date_add(F.col(date_col).cast("date"), -int(days)))
    b = daily.select(F.col(date_col).alias("_rdb_date"), F.col(value_col).alias(prev_value))
    j = a.join(b, F.col("_rdb_date") == F.col(prev_date), "left").drop("_rdb_date")
    return j.withColumn(ratio_col, F.try_divide(F.col(value_col).cast("double"), F.col(prev_value).cast("double")))
