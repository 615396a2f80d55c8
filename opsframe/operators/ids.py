"""W4 across runs: surrogate ids that stay the same.

``row_number() over ()`` gives a model new ids whenever it is run on more rows. ``stable_ids`` keeps a registry, a stored table of
(keys, id): keys that it knows keep their id; new keys, found by an anti-join, are numbered from its last id on in the order
of the keys (range partitions with offsets, no single-task sort) and added in one version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.windows import surrogate_number
from opsframe.sources.stored import Conflict, StoredTable


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    found = F.lit(True)
    for i, k in enumerate(keys):
        found = found & left[k].eqNullSafe(right[f"_s{i}"])
    return found


def _named(registry: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    return registry.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], *more)


def register(rows: DataFrame, keys: Sequence[str], registry: StoredTable, batch: str, name: str = "id") -> int:
    """Give every new key of ``rows`` an id; returns the registry's version. The same batch again changes nothing. If another
    run registers keys meanwhile, this one starts again from that run's version, so no id is given twice."""
    while True:
        last = registry.manifest()
        if batch in last["batches"]:
            return last["version"]
        found, top = rows.select(*keys).distinct(), 0
        if last["version"]:
            known = registry.scan(last["files"], last["schema"])
            top = known.agg(F.max(name)).first()[0] or 0
            named = _named(known, keys)
            found = found.join(named, _same(found, named, keys), "left_anti")
        numbered = surrogate_number(found, [F.col(k).asc_nulls_last() for k in keys], name=name)
        numbered = numbered.select(*keys, (F.col(name) + F.lit(top)).cast("long").alias(name))
        try:
            return registry.append(numbered, batch, base=last)
        except Conflict:
            continue


def stable_ids(rows: DataFrame, keys: Sequence[str], registry: StoredTable, batch: str, name: str = "id") -> DataFrame:
    """``rows`` with the id of their keys, new keys registered first. Null keys are one key."""
    known = _named(registry.read(register(rows, keys, registry, batch, name)), keys, name)
    return rows.join(known, _same(rows, known, keys)).drop(*[f"_s{i}" for i in range(len(keys))])
