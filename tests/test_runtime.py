import types

import pytest

from sparrowdex.runtime import _TABLES, scratch, shared_dir, spread, written


def test_scratch(spark):
    with scratch():
        df = written(spark.range(5), "some")
        path = df._written_to
        assert path in _TABLES and df.count() == 5
    assert path not in _TABLES


def test_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda *a: None)
    sc = types.SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(types.SimpleNamespace(sparkContext=sc, conf=conf))


def test_spread(spark):
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=9)).rdd.getNumPartitions() == 9
    assert spread(types.SimpleNamespace(sparkSession=None)) is not None
