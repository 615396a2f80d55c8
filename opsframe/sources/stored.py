"""Stored tables with versions: appends that count once (S7), updates that rewrite only the files
they touch (S10) and aggregates that refresh from what changed (S9).

A stored table is a folder of Parquet files and, for every version, a manifest: a small JSON file that names the data files, the
batches counted so far and the schema. A version is there once its manifest has been renamed into place, which fails when another
writer was faster; until then nothing of it is read. So a reader sees one whole version, before, during and after a
write; a job that dies half-way leaves files that no manifest names; and a batch that is sent again finds its id in the manifest.
Data files are never changed. ``vacuum`` deletes those that no kept version names.

The manifest grows with the number of files (some 100 bytes each), which the driver holds as it does for any scan. The folder
must be on a file system with an atomic rename (HDFS, a local disk).
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsframe.sources.sinks import rewrite_where


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Folder:
    """The few file operations that a manifest needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, inside: str) -> list[str]:
        where = self._at(inside)
        return [s.getPath().getName() for s in self._files.listStatus(where)] if self._files.exists(where) else []

    def exists(self, name: str) -> bool:
        return self._files.exists(self._at(name))

    def text(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The whole text under ``name``, or ``Conflict`` if that is there already."""
        head, _, last = name.rpartition("/")
        draft = f"{head}/.{last}-{uuid.uuid4().hex[:12]}"
        stream = self._files.create(self._at(draft))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = getattr(self._fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # never over an existing file
        target = self._fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        try:
            target.rename(self._at(draft), self._at(name), options)
        except Py4JJavaError as error:
            self._files.delete(self._at(draft), False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"{self.path}/{name} is there already") from None
            raise

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)

    def take(self, other: Folder, name: str, new: str) -> None:
        """Move a file of another folder here; one that has been moved already is there."""
        if not other.exists(name):
            if self.exists(new):
                return
            raise FileNotFoundError(f"{other.path}/{name}")
        self._files.mkdirs(self._at(new.rpartition("/")[0]))
        if not self._files.rename(other._at(name), self._at(new)):
            raise OSError(f"cannot move {other.path}/{name} to {self.path}/{new}")


EMPTY = {"version": 0, "schema": None, "files": [], "batches": {}, "more": {}}


class StoredTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def version(self) -> int:
        found = [re.fullmatch(r"(\d+)\.json", n) for n in self.folder.names("_versions")]
        return max((int(m[1]) for m in found if m), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.folder.text(f"_versions/{version}.json")) if version else EMPTY

    def scan(self, files: Sequence[str], schema: str | None) -> DataFrame:
        """Some data files; without any, no rows."""
        if schema is None:
            raise ValueError(f"{self.folder.path} has no version yet")
        kind = StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.folder.path}/data/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """One version, the last by default."""
        found = self.manifest(version)
        return self.scan(found["files"], found["schema"])

    def write_files(self, df: DataFrame, label: str, by: Sequence[str] = (), ranges: int | None = None) -> list[str]:
        """Data files that no version names yet. ``by``: ranges of these columns to a file, sorted, so that
        the files' column statistics tell them apart; ``ranges`` files, or as many as adaptive execution finds right."""
        if by:
            df = (df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)).sortWithinPartitions(*by)
        inside = f"{re.sub('[^A-Za-z0-9_-]', '-', label)[:80]}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.folder.path}/data/{inside}")
        return sorted(f"{inside}/{n}" for n in self.folder.names(f"data/{inside}") if n.endswith(".parquet"))

    def commit(self, base: dict, schema: str, files: Sequence[str], batches: Mapping[str, int] | None = None, more: Mapping | None = None) -> int:
        """Publish the version after ``base``; ``Conflict`` if there is one already."""
        version = base["version"] + 1
        new = {"version": version, "schema": schema, "files": list(files), "batches": dict(base["batches"] if batches is None else batches),
               "more": dict(base["more"] if more is None else more)}
        self.folder.publish(f"_versions/{version}.json", json.dumps(new))
        return version

    def _schema(self, df: DataFrame, base: dict) -> str:
        if base["schema"] is None:
            return df.schema.json()
        kind = StructType.fromJson(json.loads(base["schema"]))
        if [(f.name, f.dataType) for f in kind] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"columns {df.schema.simpleString()} do not fit {kind.simpleString()}")
        return base["schema"]

    def create_like(self, other: StoredTable) -> int:
        """An empty table with the columns of another; an existing one must have them."""
        last, schema = self.manifest(), other.manifest()["schema"]
        if last["schema"] is None:
            return self.commit(last, schema, [])
        self._schema(other.read(), last)
        return last["version"]

    def append_from(self, other: StoredTable) -> int:
        """``ALTER TABLE .. APPEND FROM``: every row of ``other`` moves here, which leaves it empty. Files are renamed, not
        rewritten. The move counts once: called again after it broke off anywhere, it goes on where it stopped. Readers of
        ``other`` must have finished, as for the warehouse's statement; both tables must lie on one file system."""
        from_, last = other.manifest(), self.manifest()
        batch = f"append from {other.folder.path} version {from_['version']}"
        if from_["files"]:
            if batch not in last["batches"]:
                schema = self._schema(other.scan([], from_["schema"]), last)
                inside = "moved-" + hashlib.sha256(batch.encode()).hexdigest()[:16]
                moved = {f: f"{inside}/{f.replace('/', '-')}" for f in from_["files"]}
                for old, new in moved.items():
                    self.folder.take(other.folder, f"data/{old}", f"data/{new}")
                while batch not in last["batches"]:
                    try:
                        self.commit(last, schema, [*last["files"], *moved.values()], {**last["batches"], batch: last["version"] + 1})
                    except Conflict:  # another batch came in between
                        pass
                    last = self.manifest()
            other.commit(from_, from_["schema"], [])
        return self.version()

    def append(self, df: DataFrame, batch: str, by: Sequence[str] = (), ranges: int | None = None, base: dict | None = None) -> int:
        """The rows of a batch, once. Sent again, it changes nothing and costs one look at the manifest. Rows that other
        writers add meanwhile stay; with ``base``, the append holds for that version only and raises ``Conflict`` otherwise."""
        files = None
        while True:
            last = base or self.manifest()
            if batch in last["batches"]:
                return last["version"]
            schema = self._schema(df, last)
            files = self.write_files(df, batch, by, ranges) if files is None else files
            try:
                return self.commit(last, schema, [*last["files"], *files], {**last["batches"], batch: last["version"] + 1})
            except Conflict:
                if base is not None:
                    raise

    def touched(self, predicate: Column, last: dict) -> list[str]:
        """Data files that hold a row for which ``predicate`` is true. The predicate is pushed into the scan, so files whose
        column statistics rule it out are not read; one name a file comes back."""
        where = self.scan(last["files"], last["schema"]).filter(predicate).select(F.col("_metadata.file_path").alias("path")).distinct()
        return sorted("/".join(r.path.rsplit("/", 2)[1:]) for r in where.toLocalIterator())

    def update(self, set_values: Mapping[str, object], predicate: Column, by: Sequence[str] = ()) -> int:
        """``UPDATE ... SET ... WHERE predicate``; only files with a matching row are written anew, the others are taken over as
        they are. An update that loses against another writer starts again from that writer's version."""
        while True:
            last = self.manifest()
            files = self.touched(predicate, last)
            if not files:
                return last["version"]
            changed = self.write_files(rewrite_where(self.scan(files, last["schema"]), set_values, predicate), "update", by)
            try:
                return self.commit(last, last["schema"], [f for f in last["files"] if f not in set(files)] + changed)
            except Conflict:
                continue

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the last ``keep``, and data files that none of those names. Call it when no older
        reader and no writer is at work; returns the number of files deleted."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        named = {f for v in kept for f in self.manifest(v)["files"]}
        gone = 0
        for inside in self.folder.names("data"):
            names = [n for n in self.folder.names(f"data/{inside}") if n.endswith(".parquet")]
            if not any(f"{inside}/{n}" in named for n in names):
                self.folder.delete(f"data/{inside}")
                gone += len(names)
                continue
            for n in names:
                if f"{inside}/{n}" not in named:
                    self.folder.delete(f"data/{inside}/{n}")
                    gone += 1
        for n in self.folder.names("_versions"):
            if n.startswith(".") or n not in {f"{v}.json" for v in kept}:
                self.folder.delete(f"_versions/{n}")
        return gone


class StoredAggregate:
    """``SELECT keys, SUM(..) .. GROUP BY keys`` over a stored table, kept as partial sums.

    A refresh reads only data files that came or went since the last one: sums over the new files are added, sums over files that
    an update has replaced are taken off. The partial sums of a refresh, one row for each key they touch, become one
    more set of files of the aggregate, published with the source version they stand for; after ``merge_after`` refreshes they are
    merged. ``read`` adds them up. Sums are DECIMAL, so that what is taken off is exactly what was added; a group
    whose rows have all gone disappears, and a sum over nulls only is null, as in SQL.

    ``prepare`` turns rows of the source into rows with the keys and measures. Stored tables that it joins are named in
    ``lookups``: a refresh after a change of one of them is a rebuild, as every sum may lie under another key then. Source files must
    not be vacuumed before the refresh that takes them off; if they were, the refresh is a rebuild too. Two refreshes at once
    publish one version after the other; the slower one starts again from the faster one's.
    """

    def __init__(self, source: StoredTable, path: str, keys: Sequence[str], sums: Mapping[str, Column],
                 prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, lookups: Sequence[StoredTable] = (), scale: int = 6,
                 merge_after: int = 8) -> None:
        self.source, self.table = source, StoredTable(source.spark, path)
        self.keys, self.sums, self.prepare, self.merge_after = list(keys), dict(sums), prepare, merge_after
        self.lookups = list(lookups)
        self.kind = f"decimal(38,{scale})"

    def _partial(self, files: Sequence[str], schema: str, sign: int) -> DataFrame:
        rows = self.prepare(self.source.scan(files, schema))
        measures = [(name, value.cast(self.kind)) for name, value in self.sums.items()]
        return rows.groupBy(*self.keys).agg(
            *[(F.sum(v) * F.lit(sign)).cast(self.kind).alias(f"_sum_{n}") for n, v in measures],
            *[(F.count(v) * F.lit(sign)).alias(f"_n_{n}") for n, v in measures], (F.count(F.lit(1)) * F.lit(sign)).alias("_rows"))

    def _added(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(
            *[F.sum(f"_sum_{n}").cast(self.kind).alias(f"_sum_{n}") for n in self.sums],
            *[F.sum(f"_n_{n}").alias(f"_n_{n}") for n in self.sums], F.sum("_rows").alias("_rows"))

    def refresh(self) -> int:
        """Bring the aggregate to the source's last version; a reader meanwhile sees the version before, whole."""
        while True:
            try:
                return self._refreshed(self.table.manifest(), self.source.manifest(), [t.version() for t in self.lookups])
            except Conflict:
                continue

    def rebuild(self) -> int:
        """Everything from the source's last version, published in one step."""
        return self._rebuilt(self.table.manifest(), self.source.manifest(), [t.version() for t in self.lookups])

    def _refreshed(self, last: dict, now: dict, lookups: list[int]) -> int:
        then = set(last["more"].get("source_files", []))
        came, went = [f for f in now["files"] if f not in then], sorted(then - set(now["files"]))
        known = last["version"] and last["more"]["lookups"] == lookups
        if known and not came and not went:
            return last["version"]
        if not known or any(not self.source.folder.exists(f"data/{f}") for f in went):
            return self._rebuilt(last, now, lookups)
        found = self._partial(came, now["schema"], 1)
        if went:
            found = self._added(found.unionByName(self._partial(went, now["schema"], -1)))
        files, refreshes = self.table.write_files(found, "partial"), last["more"]["refreshes"] + 1
        if refreshes >= self.merge_after:
            merged = self._added(self.table.scan([*last["files"], *files], last["schema"])).filter("_rows > 0")
            return self._publish(last, now, lookups, last["schema"], self.table.write_files(merged, "merged"), 0)
        return self._publish(last, now, lookups, last["schema"], [*last["files"], *files], refreshes)

    def _rebuilt(self, last: dict, now: dict, lookups: list[int]) -> int:
        whole = self._partial(now["files"], now["schema"], 1)
        return self._publish(last, now, lookups, whole.schema.json(), self.table.write_files(whole, "whole"), 0)

    def _publish(self, last: dict, now: dict, lookups: list[int], schema: str, files: Sequence[str], refreshes: int) -> int:
        return self.table.commit(last, schema, files, more={
            "source_version": now["version"], "source_files": now["files"], "lookups": lookups, "refreshes": refreshes})

    def read(self, version: int | None = None) -> DataFrame:
        """(keys, sums) of one version, the last by default."""
        found = self._added(self.table.read(version)).filter("_rows > 0")
        return found.select(*self.keys, *[F.when(F.col(f"_n_{n}") > 0, F.col(f"_sum_{n}")).alias(n) for n in self.sums])
