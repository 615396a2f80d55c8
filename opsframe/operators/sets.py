"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL ``UNION`` (by column name, duplicates removed by a partial aggregate)."""
    return a.unionByName(b).distinct()


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """``SELECT DISTINCT cols``."""
    return df.select(*cols).distinct()
