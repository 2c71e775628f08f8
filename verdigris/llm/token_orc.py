"""Operator 1: token ids in ORC, with integer run-length encoding, row indexes and Bloom filters on document ids.

`write_tokens` encodes whole texts and writes one row a document, in ascending document id over all files: files follow
each other in ranges of ids (`shard`), rows within a file ascend.  ORC's own writer packs the id lists by run-length
encoding, keeps statistics for each `row_index_stride` rows and a Bloom filter on the document id, and cuts stripes at
`stripe_mb`, so a reader can take stripes in parallel and skip those that can't hold an id.  `read_tokens` reads only the
columns asked for, `positions` adds each document's place in the whole id sequence, and `lookup` fetches documents by id.

Defined cases: a null or empty text has the end id alone; rows of equal ids are all kept, in the order of their texts'
hashes (texts of one hash in any order); null ids come first; texts of any length are taken whole; an empty table gives an empty table with the schema; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.common import slices
from verdigris.llm.encoding import encoder, with_end

COLUMNS = "shard int, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str = "byte_bpe_50k.json", kind: str = "byte", end_id: int = 2, stripe_mb: int = 64, row_index_stride: int = 1000, bloom_fpp: float = 0.01, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ORC files at `path`, which must not exist."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, at, shard = encoder(tokenizer, kind), 0, TaskContext.get().partitionId()
        for b in slices(batches):
            ids, cuts = with_end(*enc.encode(b.column(1)), end_id)
            n, ends = np.diff(cuts), cuts[1:]
            values = pa.array(ids.view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), shard), pa.int32()), pa.array(at + ends - n), pa.array(n), lists], names=["doc_id", "shard", "local_start", "n_tokens", "ids"])
            at += int(ends[-1])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    tokens = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")
    tokens.write.format("orc").options(**{"compression": "zstd", "orc.stripe.size": stripe_mb << 20, "orc.row.index.stride": row_index_stride, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": bloom_fpp}).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; columns that a query doesn't name are not read."""
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """Documents by id; ORC skips files, stripes and row groups by statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(list(doc_ids)))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): ids before the shard's first document; from the small columns alone, a row for each file."""
    sums = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the ids that are read back."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            cuts, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4", copy=False))
            sums = [zlib.crc32(values[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

    read = read_tokens(spark, path).select("doc_id", "shard", "local_start", "ids")
    read = read.mapInArrow(crc, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, shard int, local_start long, n_tokens long, ids_crc32 long")
    # one row a file: its size is bounded by the number of files
    return read.join(F.broadcast(positions(spark, path)), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
