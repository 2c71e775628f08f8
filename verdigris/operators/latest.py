"""Latest-wins, first-wins and upsert semantics as windows over keyed rows: one shuffle on the key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order; ties beyond the order are the caller's to break."""
    names = df.columns
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").select(*names)


def latest_verdict(verdicts: DataFrame, role: str) -> DataFrame:
    """The latest verdict of a role: newest prompt version, then newest time, then newest row."""
    return first_by(verdicts.where(F.col("role") == role), ["dedup_key"], [F.desc("prompt_version"), F.desc("judged_at"), F.desc("id")])


def latest_at_version(verdicts: DataFrame, role: str, version: str) -> DataFrame:
    rows = verdicts.where((F.col("role") == role) & (F.col("prompt_version") == version))
    return first_by(rows, ["dedup_key"], [F.desc("judged_at"), F.desc("id")])


def latest_generation(rows: DataFrame, keys: list[str], generation: list[str]) -> DataFrame:
    """All rows of each key's newest generation, a generation being the combination of some columns."""
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*generation)).alias("__g"))
    same = [F.col(f"__g.{g}").eqNullSafe(F.col(g)) for g in generation]
    joined = rows.join(newest, keys)
    for s in same:
        joined = joined.where(s)
    return joined.select(*rows.columns)


def insert_or_ignore(stored: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """stored plus the rows of batch whose key is new; within the batch the first by seq wins."""
    tagged = stored.withColumn("__b", F.lit(0)).unionByName(batch.withColumn("__b", F.lit(1)))
    return first_by(tagged, keys, [F.col("__b"), F.col(seq)]).drop("__b")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """stored with each key's row replaced by the batch's last one."""
    tagged = stored.withColumn("__b", F.lit(0)).unionByName(batch.withColumn("__b", F.lit(1)))
    return first_by(tagged, keys, [F.desc("__b"), F.desc(seq)]).drop("__b")


def guarded_upsert(rows: DataFrame, keys: list[str], guard: Column, seq: str) -> DataFrame:
    """The last row of each key, but rows for which guard holds beat all others."""
    return first_by(rows, keys, [guard.desc(), F.desc(seq)])


def classify_batch(existing: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """batch with status new (the first of its key, which isn't stored) or duplicate."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(seq))
    known = existing.select(*keys).distinct().withColumn("__known", F.lit(True))
    joined = batch.withColumn("__n", n).join(known, keys, "left")
    return joined.withColumn("status", F.when(F.col("__known").isNull() & (F.col("__n") == 1), "new").otherwise("duplicate")).drop("__n", "__known")


def reconcile(expected: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and action: insert, delete, update or keep."""
    e = expected.select(*keys, F.col(value).alias("__e"), F.lit(True).alias("__in_e"))
    s = stored.select(*keys, F.col(value).alias("__s"), F.lit(True).alias("__in_s"))
    action = F.when(F.col("__in_s").isNull(), "insert").when(F.col("__in_e").isNull(), "delete").when(~F.col("__e").eqNullSafe(F.col("__s")), "update").otherwise("keep")
    return e.join(s, keys, "full").select(*keys, action.alias("action"))
