"""Tables of the shared folder: scopes drop what was written inside them."""

import pytest

from framewright import scratch
from framewright.plans.registry import QUERIES


def exists(spark, path):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_scopes(spark):
    df = spark.range(5)
    _, before = scratch.write_table(df, "outside")
    with scratch.scope(spark):
        inner, path = scratch.write_table(df, "inside")
        with scratch.scope(spark):
            _, deeper = scratch.write_table(df, "deeper")
        assert inner.count() == 5 and exists(spark, path) and not exists(spark, deeper)
    assert exists(spark, before) and not exists(spark, path)
    with pytest.raises(RuntimeError), scratch.scope(spark):
        _, path = scratch.write_table(df, "failed")
        raise RuntimeError
    assert not exists(spark, path)


def test_a_query_leaves_nothing(spark, sf_dir):
    where = scratch.shared_dir(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {x.getPath().getName() for x in store.listStatus(folder)} if store.exists(folder) else set()
    before = names()
    with scratch.scope(spark):
        assert QUERIES["wav_roundtrip"](spark, sf_dir).count() > 0
    assert names() == before
