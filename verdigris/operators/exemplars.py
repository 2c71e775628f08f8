"""An embedding index that is kept from run to run: only new and changed texts reach the encoder.

Two tables below one path.  `vectors` is appended to and holds every (key, digest, embedding) that was ever made; `live-n` is
run n's list of (key, digest), what the index holds now, named by the small file `current`.  A run computes the digests,
encodes the pairs that `vectors` lacks, and writes the next list.  So a text that changes back isn't encoded again, a row
that is gone is gone from the list at once, and a run that dies leaves the old list in force.  `compact` drops the vectors
that no list needs.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import extend
from verdigris.sources.files import exists, read_text, write_text
from verdigris.sources.staging import delete, shared

#: A text's digest is that of its last so many characters; encoders see no more.
TAIL = 16_000


def tail(text: Column, most: int = TAIL) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, -most, most))


@dataclass
class Report:
    run: int
    encoded: int
    kept: int
    removed: int


class EmbeddingIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _run(self) -> int:
        return json.loads(read_text(self.spark, f"{self.path}/current") or '{"run": 0}')["run"]

    def _vectors(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/vectors") if exists(self.spark, f"{self.path}/vectors") else None

    def pending(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """key, digest, text (its tail) of the rows that the index has no vector for; no vector is read.

        Keys and digests alone are held against the index; the texts move only to meet what that leaves, if it is much."""
        rows = docs.select(F.col(key), tail(F.col(text)).alias("text")).select(key, F.sha2("text", 256).alias("digest"), "text")
        held = self._vectors()
        if held is None:
            return rows
        left = shared(rows.select(key, "digest").join(held.select(F.col("key").alias(key), "digest"), [key, "digest"], "left_anti").distinct(), "pending").toDF("__key", "__digest")
        return rows.join(left, rows[key].eqNullSafe(left["__key"]) & (rows["digest"] == left["__digest"]), "left_semi")

    def refresh(self, docs: DataFrame, key: str, text: str, encoder: extend.Encoder) -> Report:
        """Brings the index up to docs (a row a key); keys that docs lack go."""
        run = self._run()
        todo = self.pending(docs, key, text).withColumnRenamed(key, "key")
        pair = F.struct("key", "digest")
        made = extend.encoded(todo.select(pair.alias("pair"), "text"), "pair", "text", encoder).select("pair.key", "pair.digest", "embedding", F.lit(run + 1).alias("run"))
        made.write.mode("append").parquet(f"{self.path}/vectors")
        live, at = docs.select(F.col(key).alias("key"), F.sha2(tail(F.col(text)), 256).alias("digest")), f"{self.path}/live-{run + 1}"
        live.write.mode("overwrite").parquet(at)
        live = self.spark.read.parquet(at)
        before = self.spark.read.parquet(f"{self.path}/live-{run}") if run else live.where("false")
        fresh = self._vectors().where(F.col("run") == run + 1).select("key", "digest")
        report = Report(run + 1, fresh.count(), live.join(fresh, ["key", "digest"], "left_anti").count(), before.join(live, "key", "left_anti").count())
        write_text(self.spark, f"{self.path}/current", json.dumps(asdict(report)))
        if run > 1:  # the list before the last; whoever reads the last goes on
            delete(self.spark, f"{self.path}/live-{run - 1}")
        return report

    def table(self) -> DataFrame:
        """key, embedding of the rows that the index holds."""
        run = self._run()
        if not run:
            raise ValueError(f"no index at {self.path}")
        vectors = self._vectors().dropDuplicates(["key", "digest"])  # a run that died after its append was run again
        return self.spark.read.parquet(f"{self.path}/live-{run}").join(vectors, ["key", "digest"]).select("key", "embedding")

    def compact(self) -> int:
        """Drops the vectors that the present list doesn't need; their number.  Not beside a refresh."""
        run = self._run()
        live, held = self.spark.read.parquet(f"{self.path}/live-{run}"), self._vectors()
        needed = held.join(live, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])
        needed.write.mode("overwrite").parquet(f"{self.path}/compacted")
        gone = held.count() - self.spark.read.parquet(f"{self.path}/compacted").count()
        delete(self.spark, f"{self.path}/vectors")
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        p(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(p(f"{self.path}/compacted"), p(f"{self.path}/vectors"))
        self.spark.catalog.refreshByPath(f"{self.path}/vectors")
        return gone
