import types

import pytest
from pyspark.sql import functions as F

from opsframe.session import checkpoint_dir, pin, pinned, release


def test_checkpoint_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getCheckpointDir()
    assert configured and checkpoint_dir(spark) == configured


def test_pin_keeps_values_of_nondeterministic_columns(spark):
    df = spark.range(100).withColumn("r", F.rand(7))
    pinned = pin(df, "pin_test")
    first = sorted(pinned.collect())
    assert first == sorted(pinned.collect())
    assert pinned.count() == 100


def test_release_leaves_no_pinned_table(spark):
    release(spark)
    pinned = pin(spark.range(5), "short_lived")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pinned.inputFiles()[0]).getParent()
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path) and release(spark) == 1 and not files.exists(path)
    assert release(spark) == 0


def test_release_keeps_what_it_is_told_to(spark):
    release(spark)
    first = pin(spark.range(5), "first")
    kept = pinned(spark)[-1]
    pin(spark.range(6), "second")
    assert release(spark, keep=[kept]) == 1 and pinned(spark) == [kept] and first.count() == 5
    assert release(spark) == 1


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(types.SimpleNamespace(sparkContext=context, conf=conf))
