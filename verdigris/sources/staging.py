"""Tables written to the folder that driver and executors share: a lineage ends there, and lost executors cost nothing."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from verdigris import shared_dir

_held: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends, or by `release` before."""
    path = f"{shared_dir(spark)}/verdigris/{name}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(lambda: [_remove(*x) for x in list(_held)])
    _held.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    _held[:] = [x for x in _held if x[1] != path]
    if spark.sparkContext._jsc is not None:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared(df: DataFrame, name: str) -> DataFrame:
    """df written and read again; the write leaves no shuffle files, which would stay until the driver collects its garbage."""
    spark = df.sparkSession
    path = folder(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.staged_at)
