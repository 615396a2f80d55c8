"""Session helpers: build a local session for tests/bench, and resolve the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Collection

from pyspark.sql import SparkSession

# Settings every job in the library assumes. On a cluster these come from the
# cluster's defaults; ``build_session`` applies them for local runs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "opsframe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("OPSFRAME_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where that is harmless.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object-store)
    folder and is used as is; without it this is an error, as every executor would
    write to its own disk. Only a local master (tests, the bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="opsframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


#: Paths of written intermediate tables that are not released yet, by application and thread, oldest first.
_PINNED: dict[tuple[str, int], list[str]] = {}


def _mine(spark: SparkSession) -> tuple[str, int]:
    return spark.sparkContext.applicationId, threading.get_ident()


def pinned_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, which ``release`` deletes."""
    path = scratch_path(spark, name)
    _PINNED.setdefault(_mine(spark), []).append(path)
    return path


def pinned(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables that this thread has written and not released yet, oldest first."""
    return list(_PINNED.get(_mine(spark), []))


def release(spark: SparkSession, keep: Collection[str] = ()) -> int:
    """Delete the intermediate tables that this thread has written, but those to ``keep``, once the frames
    read from them are no longer needed; returns how many."""
    kept = set(keep)
    paths = pinned(spark)
    _PINNED[_mine(spark)] = [p for p in paths if p in kept]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in paths if p not in kept]
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    return len(gone)


def pin(df, name: str):
    """Cut lineage: write ``df`` as a parquet table in the shared checkpoint
    folder and read it back. Values computed with non-deterministic
    expressions (row ids, partition ids) stay fixed for every later read,
    including recomputation after a lost executor."""
    spark = df.sparkSession
    path = pinned_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
