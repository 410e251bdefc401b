"""Folders that all executors share, for files and tables that a query writes and reads again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders given out in this process that still stand.
_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under the warehouse, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    path = f"{base.rstrip('/')}/timegrid/{uuid.uuid4().hex}/{name}"
    _made.append(path.rpartition("/")[0])
    return path


def remove_all(spark: SparkSession, since: int = 0) -> None:
    """Removes the folders given out in this process (from the number `since` on); results that read them end with them."""
    jvm = spark.sparkContext._jvm
    for made in _made[since:]:
        path = jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:]


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all folders that were given out inside it."""
    since = len(_made)
    try:
        yield
    finally:
        remove_all(spark, since)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in such a folder, read again: what several branches need is worked out once, and the lineage ends there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
