"""Tables written between steps of one job, in the folder that the whole cluster shares.

The folder is the one named by ``spark.checkpoint.dir``. A folder of our own is
made only where that setting is absent and the master is local, as in tests; on a
cluster its absence is an error, as executors do not share local folders. A table
written here cuts the lineage: a lost executor only costs the tasks that read it.

``Tables`` writes the steps of one job and drops them once they are no longer read;
a lazy result keeps the tables that it reads itself. A caller that has written such a
result drops them too by working inside ``scope``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI that Spark's readers and writers take."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="framewright-")
            spark.sparkContext.setCheckpointDir(_own[app])
        where = _own[app]
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Everything that is written to the shared folder inside is dropped at the end; results are to be written elsewhere, or collected, by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_path(spark, path)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder; the table as read again, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """The tables of one job; those not released by keep are dropped by close."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again."""
        out, path = write_table(df, name)
        self.paths.append(path)
        return out

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again; close leaves it."""
        return write_table(df, name)[0]

    def close(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths = []
