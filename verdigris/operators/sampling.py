"""Seeded sampling by hash order: deterministic in the seed and the id, exact in its counts, independent of partitions.

A draw's order is sha256(seed ':' id), which any engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def draw(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def ranked(df: DataFrame, strata: list[str], key: str, seed: int, name: str = "place") -> DataFrame:
    w = Window.partitionBy(*strata).orderBy(draw(seed, F.col(key)), key)
    return df.withColumn(name, F.row_number().over(w))


def carve(df: DataFrame, strata: list[str], key: str, share: float, seed: int) -> DataFrame:
    """df with split: of each stratum max(1, round half even of n · share) rows are val, the rest train."""
    n = df.groupBy(*strata).agg(F.greatest(F.bround(F.count("*") * F.lit(share)), F.lit(1)).cast("int").alias("__quota"))
    return ranked(df, strata, key, seed, "__place").join(n, strata).withColumn("split", F.when(F.col("__place") <= F.col("__quota"), "val").otherwise("train")).drop("__place", "__quota")


def repeat_to(df: DataFrame, extra: DataFrame, key: str, seed: int, group: list[str]) -> DataFrame:
    """Each row once and `extra` rows of its group more: whole cycles, then the first of the hash order.

    extra: group columns and n_extra.  Adds copy (0 is the original)."""
    n = df.groupBy(*group).agg(F.count("*").alias("__n"))
    rows = ranked(df, group, key, seed, "__place").join(n, group).join(extra, group, "left")
    more = F.coalesce("n_extra", F.lit(0))
    copies = F.floor(more / F.col("__n")) + (F.col("__place") <= more % F.col("__n")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int")))).drop("__place", "__n", "n_extra")


def quota_sample(df: DataFrame, stratum: str, quotas: dict[str, int], remainder: int, key: str, seed: int) -> DataFrame:
    """quotas[stratum] rows of each named stratum; `remainder` rows of the others together."""
    named = F.col(stratum).isin(list(quotas))
    group = F.when(named, F.col(stratum)).otherwise("__rest")
    rows = ranked(df.withColumn("__g", group), ["__g"], key, seed, "__place")
    quota = F.create_map(*[x for k, v in [*quotas.items(), ("__rest", remainder)] for x in (F.lit(k), F.lit(v))])
    return rows.where(F.col("__place") <= F.element_at(quota, F.col("__g"))).drop("__g", "__place")


def greedy(df: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Walk a group's rows in order, keep each that still fits the budget.  A group's walk is one fold over two numbers a
    row; its rows stay where they are."""
    import pyarrow as pa

    schema = df.select(group, *order, size).schema

    def run(batches):
        now, used = object(), 0
        for b in batches:
            keep = []
            for g, n in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if g != now:
                    now, used = g, 0
                keep.append(used + n <= budget)
                used += n if keep[-1] else 0
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.select(group, *order, size).repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def batches(df: DataFrame, group: str, order: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Consecutive rows of a group in batches of bounded rows and size; a larger row is a batch of its own."""
    import pyarrow as pa

    schema = df.select(group, *order, size).schema.add("batch", T.IntegerType())

    def run(parts):
        now, n, used, batch = object(), 0, 0, 0
        for b in parts:
            out = []
            for g, s in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if g != now:
                    now, n, used, batch = g, 0, 0, 0
                elif n and (n >= most_rows or used + s > most_size):
                    n, used, batch = 0, 0, batch + 1
                n, used = n + 1, used + s
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=schema.fieldNames())

    return df.select(group, *order, size).repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def bootstrap_auc(rows: DataFrame, label: str, score: str, iterations: int, seed: int) -> DataFrame:
    """One row: low and high of the AUC's 95 % interval over Poisson resamples by hash; resamples of one class are left out.

    Rows are pre-aggregated by score before anything is sorted."""
    it = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it")
    u = (F.xxhash64(F.lit(seed), "it", "__id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52))
    weight = F.lit(0)
    total, term = 0.0, 0.36787944117144233
    for k in range(1, 8):  # inverse of the Poisson distribution with mean one
        total += term
        weight = weight + (u >= total).cast("int")
        term /= k
    r = rows.withColumn("__id", F.monotonically_increasing_id() if "__id" not in rows.columns else F.col("__id")).select("__id", label, score, it).withColumn("w", weight).where("w > 0")
    n = r.groupBy("it", F.col(score).alias("s")).agg(F.sum(F.when(F.col(label), F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(~F.col(label), F.col("w")).otherwise(0)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("it").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = n.withColumn("below", below).groupBy("it").agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc")).where("auc is not null")
    ordered = auc.agg(F.array_sort(F.collect_list("auc")).alias("a"))  # `iterations` numbers
    at = lambda q: F.get("a", F.least(F.floor(F.size("a") * q), F.size("a") - 1).cast("int"))
    return ordered.select(at(0.025).alias("low"), at(0.975).alias("high"))
