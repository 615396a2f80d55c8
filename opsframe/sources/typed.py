"""Declared column types that hold at write -- CHAR(n), VARCHAR(n), NUMERIC(p, s), integers, NOT NULL.

``checked`` casts every column to its declared type and lists each row's faults in the same pass; ``store`` writes good rows
and rejected rows in one job and counts the faults of each rule on the way. One bad row does not stop a load, and no
row is read twice.

Rules, as in the warehouse: lengths count bytes; a text that is too long by blanks at its end only is cut; CHAR is padded with blanks
to its length; NUMERIC rounds half up to its scale and must fit its precision; integers must fit their range (fractions
are rounded first); what cannot be read as a number is a fault of its own kind; NULL is a fault unless allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The declared integer types and what they are in Spark.
INTEGERS = {"int2": "smallint", "int4": "int", "int8": "bigint"}


@dataclass(frozen=True)
class Declared:
    name: str
    kind: str  # char, varchar, numeric, int2, int4, int8
    size: int = 0
    scale: int = 0
    nullable: bool = False

    def typed(self, value: Column) -> Column:
        """The value as stored; null where it does not fit."""
        if self.kind in ("char", "varchar"):
            text = value.cast("string")
            bare = F.rtrim(text)
            padded = F.concat(bare, F.repeat(F.lit(" "), F.lit(self.size) - F.octet_length(bare)))
            whole = padded if self.kind == "char" else F.when(F.octet_length(text) <= self.size, text).otherwise(padded)
            return F.when(F.octet_length(bare) <= self.size, whole)
        if self.kind == "numeric":
            return value.try_cast(f"decimal({self.size},{self.scale})")
        return F.round(value.try_cast("decimal(38,10)"), 0).try_cast(INTEGERS[self.kind])

    def fault(self, value: Column) -> Column:
        """Why the value cannot be stored, or null."""
        wrong = F.when(value.isNull(), F.lit(None if self.nullable else "is null"))
        if self.kind in ("char", "varchar"):
            return wrong.when(self.typed(value).isNull(), F.lit(f"longer than {self.size} bytes"))
        readable = value.cast("string").try_cast("double")
        return wrong.when(readable.isNull(), F.lit("not a number")).when(self.typed(value).isNull(), F.lit(f"beyond {self.label()}"))

    def rules(self) -> list[str]:
        kind = [f"longer than {self.size} bytes"] if self.kind in ("char", "varchar") else ["not a number", f"beyond {self.label()}"]
        return [*([] if self.nullable else ["is null"]), *kind]

    def label(self) -> str:
        return f"numeric({self.size},{self.scale})" if self.kind == "numeric" else self.kind


def checked(df: DataFrame, declared: Sequence[Declared]) -> DataFrame:
    """(columns as declared, ``faults``): each fault as (column, rule, value), in the order of the columns."""
    clash = {"faults", "given", "good"} & {d.name for d in declared}
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    found = [F.when(d.fault(F.col(d.name)).isNotNull(), F.struct(
        F.lit(d.name).alias("column"), d.fault(F.col(d.name)).alias("rule"), F.col(d.name).cast("string").alias("value"))) for d in declared]
    return df.select(*[d.typed(F.col(d.name)).alias(d.name) for d in declared], F.array_compact(F.array(*found)).alias("faults"),
                     F.struct(*[F.col(d.name).cast("string").alias(d.name) for d in declared]).alias("given"))


def _share(column: str, rule: str) -> Column:
    """Number of rows with one fault."""
    return F.sum(F.exists("faults", lambda fault: (fault["column"] == column) & (fault["rule"] == rule)).cast("long"))


def store(df: DataFrame, declared: Sequence[Declared], path: str) -> dict[str, int]:
    """Write good rows and the others under ``path`` in one job (``stored`` and ``rejected`` read them); returns the number of
    faults by "column: rule". The counts come with the job and may count a retried task twice; the written rows do not."""
    each = [(d.name, rule) for d in declared for rule in d.rules()]
    rows = checked(df, declared).withColumn("good", F.size("faults") == 0)
    rows = rows.withColumn("given", F.when(~F.col("good"), F.col("given")))
    counts = Observation()
    rows.observe(counts, *[_share(*f).alias(f"fault_{i}") for i, f in enumerate(each)]).write.partitionBy("good").parquet(path)
    return {f"{c}: {rule}": int(counts.get[f"fault_{i}"] or 0) for i, (c, rule) in enumerate(each)}


def stored(df: DataFrame, declared: Sequence[Declared]) -> DataFrame:
    """The good rows of what ``store`` wrote (``df``: its path read as Parquet)."""
    return df.filter(F.col("good").cast("boolean")).select(*[d.name for d in declared])


def rejected(df: DataFrame) -> DataFrame:
    """One row for each fault: the row as it was given, the column, the rule and the value."""
    return df.filter(~F.col("good").cast("boolean")).select("given", F.explode("faults").alias("fault")).select("given.*", "fault.column", "fault.rule", "fault.value")
