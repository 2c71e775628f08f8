"""BM25 search over a stored inverted index, which is rebuilt only when its key moves.

The postings of a set of documents are one table, a folder for each bucket of terms, sorted by term and block.  A row is a
term's postings within one block of documents: (document, frequency, length) in an array, and before them the block's
maxima: postings, the highest frequency, the shortest document.  Blocks hold documents of similar length, about
`block_docs` at most, so the postings of a word that stands in every document are many rows of bounded size, dealt over
many files.  The term '' stands for the documents themselves: its postings hold their lengths.

A search reads the folders of its terms' buckets, of these the terms' row groups, and at first only the blocks' maxima.
They bound the score that a document of the block can have.  The blocks of the highest bounds are scored, which gives a
score that the last hit must reach; the postings of all blocks that can reach it are read then, the others are not.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.sources.files import read_text, write_text
from verdigris.sources.staging import delete

WORD = r"[\p{L}\p{N}_]+"
ALL = ""


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def staleness(pairs: DataFrame, at: str, ledger: DataFrame, ledger_at: str) -> DataFrame:
    """The index's key: it is built again when this text changes."""
    a = pairs.agg(F.concat_ws(":", F.count("*"), F.max(at)).alias("a"))
    b = ledger.agg(F.concat_ws(":", F.count("*"), F.max(ledger_at)).alias("b"))
    return a.join(b, F.lit(True)).select(F.concat_ws(":", "a", "b").alias("key"))


def postings(docs: DataFrame, key: str, columns: list[str], buckets: int, blocks: int) -> DataFrame:
    """bucket, term, block, n, most, shortest, posts [(id, f, n)].  Rows without a word or an id have no postings.

    A document is counted where it is read and then moves once, as a row, to its block; a block's postings are made there,
    at once, so no posting is shuffled or sorted as a row of its own."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def counted(batches):
        for b in batches:
            for i, found in enumerate(b.column(2)):
                seen = pc.value_counts(found.values)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), seen.field(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *lists], names=["id", "n", "terms", "fs"])

    cut = docs.select(F.col(f"`{key}`").alias("id"), words(F.concat_ws(" ", *columns)).alias("words"))
    cut = cut.where("id is not null and size(words) > 0").select("id", F.size("words").cast("long").alias("n"), F.concat("words", F.transform("words", lambda _: F.lit(ALL))).alias("words"))
    kind = cut.schema["id"].dataType.simpleString()
    rows = cut.mapInArrow(counted, f"id {kind}, n long, terms array<string>, fs array<long>")
    of_length = F.floor(F.log2(F.col("n").cast("double"))).cast("long") * blocks
    rows = rows.withColumn("block", of_length + F.pmod(F.xxhash64("id"), F.lit(blocks)))

    def gathered(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["id"])).combine_chunks()
        terms, fs, ids, n = (group[c].chunk(0) for c in ("terms", "fs", "id", "n"))
        sizes = np.diff(terms.offsets.to_numpy())
        coded = pc.dictionary_encode(terms.flatten())
        codes, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(codes, kind="stable")  # within a term documents stay in the order of their ids
        doc, f = doc[order], fs.flatten().to_numpy()[order]
        first = np.flatnonzero(np.diff(codes[order], prepend=-1))
        cuts = np.append(first, len(order))
        length = n.to_numpy()[doc]
        posts = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(f), pa.array(length)], names=["id", "f", "n"])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), posts)
        block = pa.repeat(group["block"][0], len(first))
        return pa.table({"term": coded.dictionary, "block": block, "n": np.diff(cuts), "most": np.maximum.reduceat(f, first), "shortest": np.minimum.reduceat(length, first), "posts": lists})

    made = rows.groupBy("block").applyInArrow(gathered, f"term string, block long, n long, most long, shortest long, posts array<struct<id: {kind}, f: long, n: long>>")
    return made.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "*")


@dataclass
class State:
    key: str
    at: str
    docs: int
    mean: float
    buckets: int
    build: int
    schema: str


class Index:
    """A stored index below `path`.  A build writes a new table and then names it in one small file, so that searches see
    the old index or the new one; the table before the last stays for those who still read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def state(self) -> State | None:
        held = read_text(self.spark, f"{self.path}/current")
        return State(**json.loads(held)) if held else None

    def ensure(self, docs: DataFrame, key: str, columns: list[str], stale: str, *, buckets: int = 64, block_docs: int = 1024) -> bool:
        """Builds the index unless the stored one has this key; whether it did.  `docs` is only read then.

        docs: a row a document; `key` names it, null ones are left out."""
        old = self.state()
        if old and old.key == stale:
            return False
        blocks = max(1, docs.count() // block_docs)
        at = f"{self.path}/postings-{uuid.uuid4().hex}"
        made = postings(docs, key, columns, buckets, blocks)
        made.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(at)
        new = State(stale, at, 0, 0.0, buckets, old.build + 1 if old else 1, made.schema.json())
        total = self._of(new, [ALL]).select(F.explode("posts").alias("p")).agg(F.count("*").alias("docs"), F.avg("p.n").alias("mean")).first()
        new.docs, new.mean = total.docs, total.mean or 0.0
        write_text(self.spark, f"{self.path}/current", json.dumps(asdict(new)))
        self._sweep({at, old.at if old else at})
        return True

    def _sweep(self, keep: set[str]) -> None:
        """Removes the tables of builds before the last."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p):
            name = s.getPath().getName()
            if name.startswith("postings-") and f"{self.path}/{name}" not in keep:
                delete(self.spark, f"{self.path}/{name}")

    def _of(self, state: State, terms: list[str]) -> DataFrame:
        """The stored rows of these terms: bucket folders and row groups of others are not read."""
        ask = self.spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(state.buckets)).cast("int").alias(f"b{i}") for i, t in enumerate(terms)))
        stored = self.spark.read.schema(T.StructType.fromJson(json.loads(state.schema))).parquet(state.at)
        return stored.where(F.col("bucket").isin(list(set(ask.first()))) & F.col("term").isin(terms))

    def terms(self, query: str) -> list[str]:
        """The query's distinct words."""
        return [t for t in self.spark.range(1).select(F.array_distinct(words(F.lit(query))).alias("t")).first().t]

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each of the terms stands."""
        return {r.term: r.d for r in self._of(self._known(), terms).groupBy("term").agg(F.sum("n").alias("d")).collect()}

    def _known(self) -> State:
        state = self.state()
        if state is None:
            raise ValueError(f"no index at {self.path}")
        return state

    def search(self, query: str, limit: int, k1: float = 1.2, b: float = 0.75, first: int = 8) -> DataFrame:
        """id, score of the documents that have all words of the query, the best first, `limit` at most; ties by id.

        `first` blocks are scored to find what the others must reach."""
        state, terms = self._known(), self.terms(query)
        stored = self._of(state, terms or [ALL])
        nothing = stored.where("false").select(F.explode("posts").alias("p")).select("p.id", F.lit(0.0).alias("score"))
        df = self.frequencies(terms) if terms else {}
        if not terms or len(df) < len(terms):
            return nothing
        parts = F.create_map(*(x for t in terms for x in (F.lit(t), F.log(F.lit(1 + (state.docs - df[t] + 0.5) / (df[t] + 0.5))))))
        idf = F.element_at(parts, F.col("term"))
        worth = lambda f, n: idf * f * (k1 + 1) / (f + k1 * (1 - b + b * n / F.lit(state.mean)))
        heads = stored.groupBy("block").agg(F.sum(worth(F.col("most"), F.col("shortest"))).alias("bound"), F.count("*").alias("has")).where(F.col("has") == len(terms)).select("block", "bound")

        def scored(among: DataFrame) -> DataFrame:
            rows = stored.join(among, "block", "left_semi").select("block", "term", F.explode("posts").alias("p"))
            rows = rows.select("block", "p.id", worth(F.col("p.f"), F.col("p.n")).alias("part"))
            hits = rows.groupBy("block", "id").agg(F.sum("part").alias("score"), F.count("*").alias("has"))
            return hits.where(F.col("has") == len(terms)).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)

        low = scored(F.broadcast(heads.orderBy(F.desc("bound")).limit(first))).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
        reach = low.least * (1 - 1e-9) if low.n >= limit else float("-inf")
        return scored(heads.where(F.col("bound") >= reach))
