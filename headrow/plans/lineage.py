"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_collectors: ContextVar[tuple[list[str], ...]] = ContextVar("collectors", default=())  # each thread has its own


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode, as in tests; an error on a cluster."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{_SETTING} has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-headrow-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    The table survives lost executors, has true sizes for the planner and lets later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/headrow-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    for paths in _collectors.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Note the paths of the tables that cut() writes inside the block."""
    before = _collectors.set((*_collectors.get(), paths))
    try:
        yield
    finally:
        _collectors.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that cut() wrote, once nothing lazy reads them any more; paths is emptied."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
