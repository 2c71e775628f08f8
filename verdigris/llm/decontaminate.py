"""Operator 7: benchmark decontamination by winnowing.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.  Texts are reduced to hashes of `k` words in
a row; of each `window - k + 1` neighbouring hashes the smallest is kept, on both sides, so a shared span of `window`
words has a kept hash in common, wherever it lies: the kept one depends on the span alone.  Equal fingerprints are joined
and each meeting is extended to both sides word by word; a match of `window` words or more counts.  Items shorter than
the window have no span of that length: they are looked for as a whole, by the hash of all their words, then compared.

The benchmark is the stated query set.  It is taken in blocks of about `block_bytes` of text, so the driver holds one block
at a time; each block's index is broadcast and meets every slice of texts in one pass.  A worker holds all indexes while
they take `held_bytes` or less, and else one at a time.  Documents are never shuffled or grouped.

Defined cases: null and wordless texts have no words and no hits; null and wordless items, and items without an id, occur
nowhere; items of equal text all count, of equal ids too; item ids may be of any type that sorts; texts of any length are
taken whole; repeated documents are rows of their own; an empty benchmark hits nothing; other columns stay, but for those
named n_words, hit_spans and hit_items, which are replaced.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdigris.llm.common import SLICE_BYTES, as_bytes, holds, mix, numbered, rolling, slices

#: Bytes that belong to words stay, with A-Z lowered; all others become a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_NONE = np.uint64(2**64 - 1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Vocabulary(dict):
    """word → number from 1; 0 for words that no item has, which are not stored."""

    def __missing__(self, word: bytes) -> int:
        return 0


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row; the largest value where a word is unknown, so it is never kept before a known one."""
    h = rolling(mix(ids.astype(np.uint64)), k)
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    h[unknown[k:] != unknown[:-k]] = _NONE
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Where h is the smallest of some w neighbours; ties all count."""
    keep = np.zeros(len(h), bool)
    n = len(h) - w + 1
    if n > 0:
        least = np.minimum.reduce([h[i : i + n] for i in range(w)])
        for i in range(w):
            keep[i : i + n] |= h[i : i + n] == least
    return keep & (h != _NONE)


class Index:
    """Fingerprints of a block of items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], k: int, window: int):
        self.k, self.window, self.vocabulary = k, window, Vocabulary()
        self.ids, self.items = [], []
        for item, words in items:
            self.items.append(item)
            self.ids.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.prints: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, own in enumerate(self.ids):
            array = np.array(own, np.int64)
            if len(own) >= window:
                h = grams(array, k)
                for p in np.flatnonzero(winnow(h, window - k + 1)):
                    self.prints[int(h[p])].append((i, int(p)))
            elif own:
                self.short[len(own)][int(grams(array, len(own))[0])].append(i)
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.prints = dict(self.prints)
        self.sorted = np.sort(np.fromiter(self.prints, np.uint64, len(self.prints)))
        self.sorted_short = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in self.short.items()}

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans [start, end) that some item's windows cover, and the items."""
        own = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        spans, items = [], set()
        if len(own) >= self.window and len(self.sorted):
            h = grams(own, self.k)
            keep = np.flatnonzero(winnow(h, self.window - self.k + 1))
            keep = keep[_among(h[keep], self.sorted)]
            if len(keep):
                seq, done = own.tolist(), {}
                for p in keep.tolist():
                    for i, q in self.prints[int(h[p])]:
                        if done.get((i, p - q), -1) >= p:
                            continue
                        a, b, other = p, p, self.ids[i]
                        d = q - p
                        while a > 0 and a + d > 0 and seq[a - 1] == other[a + d - 1]:
                            a -= 1
                        while b < len(seq) and b + d < len(other) and seq[b] == other[b + d]:
                            b += 1
                        done[i, p - q] = b
                        if b - a >= self.window:
                            spans.append((a, b))
                            items.add(self.items[i])
        for n, table in self.short.items():
            if len(own) >= n:
                h = grams(own, n)
                for p in np.flatnonzero(_among(h, self.sorted_short[n])).tolist():
                    for i in table[int(h[p])]:
                        if own[p : p + n].tolist() == self.ids[i]:
                            spans.append((p, p + n))
                            items.add(self.items[i])
        return spans, items


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, block_bytes: int, id_column: str, text_column: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with words, a bounded block at a time; the driver never holds more than one."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).toLocalIterator():
        words = words_of((text or "").encode())
        if words and item is not None:
            held.append((item, words))
            size += len(text)
            if size >= block_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = 5, block_bytes: int = 8 << 20, held_bytes: int = 256 << 20, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hit_spans (array of disjoint word spans) and hit_items (sorted item ids)."""
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    own = [f for f in docs.schema.fields if f.name not in ("n_words", "hit_spans", "hit_items")]
    spans_type, item_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), benchmark.schema[item_id].dataType
    schema = T.StructType([*own, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("hit_items", T.ArrayType(item_type))])
    items_type, names = pa.list_(to_arrow_type(item_type)), schema.fieldNames()
    broadcast = docs.sparkSession.sparkContext.broadcast
    size, indexes = 0, []
    for block in blocks(benchmark, block_bytes, item_id, item_text):
        made = pickle.dumps(Index(block, k, window))
        size += 4 * len(made)  # about what it takes in memory
        indexes.append(broadcast(made))
    at, keep = [f.name for f in own].index(text_column), size <= held_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("index")
        tables = [pickle.loads(x.value) for x in indexes] if keep else ()
        for b in slices(batches, f"c{at}", SLICE_BYTES if keep else 8 * SLICE_BYTES):
            texts = as_bytes(b.column(at))
            spans, items = [[] for _ in texts], [set() for _ in texts]
            counts = [0] * len(texts) if indexes else [len(words_of(x)) for x in texts]
            for table in tables or (pickle.loads(x.value) for x in indexes):
                for j, text in enumerate(texts):
                    words = words_of(text)
                    counts[j] = len(words)
                    more, which = table.match(words)
                    spans[j] += more
                    items[j] |= which
            hit = [[{"start": x, "end": y} for x, y in merged(s)] for s in spans]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(hit, spans_type), pa.array([sorted(i) for i in items], items_type)], names=names)

    return numbered(docs, own).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    names = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
