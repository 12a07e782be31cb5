"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    It is read from ``spark.checkpoint.dir``. Only where that is unset (tests
    in one JVM) is a folder below the warehouse set instead.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessera_shared"
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as that system has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    store, place = _store(spark, path)
    store.deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there."""
    path = path or fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While actions run within, Arrow batches have at most ``rows`` rows (documents may be long)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
