"""Spark's own tables behind statements with parameters, and conditional claims by one writer.

`sql`, `execute` and `insert` are the calls of a small relational store on the session's catalog: parameters are bound, never
pasted, rows come back as a DataFrame, many rows go in as one.

A claim takes a key that nobody holds.  Requests are a stream and one stream decides them: each micro-batch keeps, of the
keys that no earlier batch gave away, the first request, and writes its winners as the batch's own folder.  A batch that
dies is run again and writes the same folder; nothing is locked, so a writer that is gone blocks no one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import latest
from verdigris.sources.files import exists


def create(name: str, rows: DataFrame, path: str) -> None:
    """A table of these rows, kept as Parquet at the path."""
    rows.write.mode("errorifexists").option("path", path).saveAsTable(name)


def sql(spark: SparkSession, statement: str, **parameters) -> DataFrame:
    """The rows of a query; :name stands for a parameter."""
    return spark.sql(statement, args=parameters or None)


def execute(spark: SparkSession, statement: str, **parameters) -> None:
    """A statement that changes a table."""
    spark.sql(statement, args=parameters or None).collect()


def insert(name: str, rows: DataFrame) -> None:
    """All rows at once; columns are matched by name."""
    spark = rows.sparkSession
    rows.select(*(F.col(f"`{c}`") for c in spark.table(name).columns)).write.mode("append").insertInto(name)


CLAIMS = "key string, owner string, asked_at long"


def decide(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over requests (key, owner, asked_at): the earliest request of a free key wins, ties by owner."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        free = batch.where("key is not null")
        if exists(spark, path):
            taken = spark.read.schema(f"{CLAIMS}, epoch long").parquet(path).where(F.col("epoch") < epoch)
            free = free.join(taken.select("key"), "key", "left_anti")
        won = latest.first_by(free, ["key"], [F.col("asked_at"), F.col("owner")])
        won.select("key", "owner", "asked_at").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def claims(spark: SparkSession, path: str) -> DataFrame:
    """key, owner, asked_at, epoch of what was claimed so far."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{CLAIMS}, epoch long")
    return spark.read.schema(f"{CLAIMS}, epoch long").parquet(path)


def claim(requests: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Decides all requests that are available (a stream of key, owner, asked_at) and returns the claims."""
    requests.writeStream.foreachBatch(decide(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return claims(requests.sparkSession, path)
