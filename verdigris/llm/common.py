"""Pieces that several operators share: the staging folder, Arrow helpers, word hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris import reachable, shared_dir

#: Most bytes of text that a Python worker handles at once (a single longer text still comes whole).
SLICE_BYTES = 4 << 20
#: Most entries of a per-worker word cache; a full cache is emptied, which costs time and no results.
CACHE_WORDS = 400_000
#: Bytes, as `row_bytes` counts them, up to which a table is broadcast.
MOST_BROADCAST = 24 << 20
#: Rows of a few numbers up to which Spark may choose to broadcast a side of a join.
MOST_ROWS = 100_000

_staged: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/verdigris/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(lambda: [discard(spark, p) for p in list(_staged)])
    _staged.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing reads any more."""
    if path in _staged:
        _staged.remove(path)
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in tables:
        discard(df.sparkSession, df.staged_at)


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in a broadcast table."""

    def of(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.StructType):
            return reduce(add, (of(f.dataType, c[f.name]) for f in kind.fields), F.lit(16))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * 24 + 16
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        return F.lit(8)

    return reduce(add, (of(f.dataType, F.col(f"`{f.name}`")) for f in schema.fields), F.lit(32)).cast("long")


def shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df, which grows with these many rows, for a join that must not broadcast it once they are more than MOST_ROWS.

    Spark broadcasts what takes less than 10 MB on disk, and staged tables are so well compressed that this may be many
    millions of rows, more than the driver can hold."""
    return df.hint("merge") if rows > MOST_ROWS else df


def small(df: DataFrame) -> DataFrame:
    """df (a stored table: it is read here), to be broadcast if its bytes (counted) are few; else joins shuffle it."""
    return F.broadcast(df) if (df.select(row_bytes(df.schema).alias("b")).agg(F.sum("b")).first()[0] or 0) <= MOST_BROADCAST else df.hint("merge")


def spread_join(rows: DataFrame, side: DataFrame, key: str, often: int = 100_000) -> DataFrame:
    """rows ⋈ side on key.  side (a stored table) has a row for each key and its number of rows, `times`, which the
    result leaves out.  Keys of more than `often` rows, and of a 2,000th of all, are few and are broadcast, so none
    meets in one task."""
    most, total, keys = side.agg(F.max("times"), F.sum("times"), F.count("*")).first()
    often = max(often, (total or 0) // 2000)
    if (most or 0) <= often:
        return rows.join(shuffled(side.drop("times"), keys), key)
    hot = F.broadcast(side.where(F.col("times") > often).drop("times"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(shuffled(side.where(F.col("times") <= often).drop("times"), keys), key))


def numbered(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """These columns of df as c0, c1 …: a map over Arrow batches can't take names with dots."""
    return df.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text at most."""
    at_least = 1
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.fromiter((x or 0 for x in pa.compute.binary_length(col).to_pylist()), np.int64, batch.num_rows))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + at_least, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
        pa.default_memory_pool().release_unused()


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_held: dict[str, Callable[[], object]] = {}


def holds(name: str, clear: Callable[[], object] | None = None) -> None:
    """Says that this worker now needs the cache `name`: all others, left by earlier operators, are emptied."""
    others = [n for n in _held if n != name]
    for n in others:
        _held.pop(n)()
    if clear:
        _held[name] = clear
    if others:
        trim()


def trim() -> None:
    """Gives freed memory back to the machine: idle workers stay for a while, beside those of the next stage."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """The same map over batches; what it freed goes back when a task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


class WordHash(dict):
    """bytes → 64-bit hash, cached up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if "words" not in _held:
            holds("words", self.clear)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHash()
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; empty where there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _MIX[0]
        out += words[i : i + n]
    return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles; the whole sequence is the one shingle of a shorter text; none without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    # the length is mixed in so that a short text's one shingle can't equal a prefix of another kind
    return np.unique(rolling(words, k) if len(words) >= k else rolling(words, len(words)) ^ np.uint64(len(words)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends."""
    cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]], cuts - cuts[0]


def word_spans(letter: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of letters; texts, which begin at the cuts, follow each other without a break."""
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inner = cuts[1:-1]
    inner = inner[(inner > 0) & (inner < len(letter))]
    first[inner] |= letter[inner]
    last[inner - 1] |= letter[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of running sums of bytes times powers of an odd number."""
    n = len(data) + 1
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    sums = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * _powers[1][begin])


class HashIndex:
    """Places of 64-bit hashes in an array of distinct ones, by open addressing; −1 for others."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(4 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), (keys >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        at, slot = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(at):
            got = self.slots[slot]
            same = (got >= 0) & (self.keys[got] == h[at])
            out[at[same]] = got[same]
            on = (got >= 0) & ~same
            at, slot = at[on], (slot[on] + 1) & self.mask
        return out


def components(links: DataFrame, src: str, dst: str, name: str = "components", most: int = 100) -> DataFrame:
    """Connected components of links (src, dst) as rows (node, component = its smallest node); nodes without links don't occur.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round is a group and a join on node keys, a
    written table ends the lineage, and rounds stop when the set of links stays the same.  Rounds grow as log² of a
    component's size at most.  Self-links and nulls are ignored.  The result is a stored table.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    paths = [new_path(spark, name)]
    edges = staged(edges, name, paths[0])
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    now = sign(edges)
    for _ in range(most):
        # large star: every neighbour above u gets u's smallest neighbour (or u)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(shuffled(least, now[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(least, now[0]), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        paths.append(new_path(spark, name))
        after = staged(small, name, paths[-1])
        same = now == (now := sign(after))
        discard(spark, paths.pop(0))
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle within {most} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out.staged_at = paths[0]
    return out


def narrow_batches(spark: SparkSession, most: int = 2000) -> None:
    """Rows of whole texts are wide: fewer of them in an Arrow batch bound what a worker and its JVM hold at once."""
    reachable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= most:
        spark.conf.set(key, most)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

