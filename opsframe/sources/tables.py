"""Scanning named tables.

The reference reads tables by bare, schema-qualified and quoted three-part
names, and (in templated models) by role. All of these reduce to one
resolver from a name to a parquet scan, so Catalyst sees a plain
``Relation`` and can push filters and prune columns into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession

# The tables present in a data folder.
BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def bare_name(name: str) -> str:
    """``"dev"."schema"."tbl"`` / ``schema.tbl`` / ``tbl`` -> ``tbl``."""
    last = name.strip().split(".")[-1]
    return last.strip().strip('"').strip("`").lower()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet scan (``Tables`` keeps one per table)."""
    return spark.read.parquet(path)


class Tables(Mapping):
    """Lazy name -> DataFrame resolver over one folder of parquet tables.

    ``aliases`` maps a role or foreign name (S3, e.g. ``"role:expenses"``)
    onto a table name or onto a DataFrame that stands in for it.
    """

    def __init__(self, spark: SparkSession, folder: str,
                 aliases: Mapping[str, str | DataFrame] | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.aliases = dict(aliases or {})
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{bare_name(name)}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        target = self.aliases.get(name, self.aliases.get(bare_name(name), name))
        if isinstance(target, DataFrame):
            return target
        key = bare_name(target)
        if key not in self._cache:
            self._cache[key] = read_parquet(self.spark, self.path(key))
        return self._cache[key]

    def __iter__(self):
        return iter(BASE_TABLES)

    def __len__(self) -> int:
        return len(BASE_TABLES)

    def register_views(self, names: Iterable[str] = BASE_TABLES) -> None:
        """Expose the tables to ``spark.sql`` under their bare names."""
        for n in names:
            self[n].createOrReplaceTempView(bare_name(n))


def resolve(spark: SparkSession, folder: str, names: Iterable[str] = BASE_TABLES) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` for the requested names."""
    t = Tables(spark, folder)
    return {bare_name(n): t[n] for n in names}


def lookup(df: DataFrame, predicate: Column) -> DataFrame:
    """Whole-row look-up by a predicate (pushed to the parquet scan)."""
    return df.filter(predicate)
