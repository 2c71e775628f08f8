"""Operator 12: vectors compressed to product codes, with codebooks kept by delta-maintained Lloyd rounds.

A vector's components become integers, floor(scale·x), and it is cut into equal consecutive parts.  Each part position has a
codebook; a code is the number of the nearest entry for each part.  The codebooks begin as the parts of the vectors of the
smallest ids and are refined by Lloyd rounds: assign all parts, then replace each entry by the mean of its parts.

The vectors never move.  A round is a map that stores, beside each vector, its assignment of this round and of the round
before.  Sums and counts of all entries run on from round to round: only parts whose assignment changed contribute, the part
itself added to the new entry and taken from the old one.  Tasks add their contributions up before they leave, so a task
shuffles parts × entries sums at most, whatever it has read, and a settled corpus shuffles nothing.  All is integer
arithmetic, so the running sums are those of a fresh count.  The driver holds codebooks and sums only.

Defined cases: a vector that is null, empty, or holds a null or non-finite component is dropped; vectors of different
lengths, a length that `parts` doesn't divide, and components whose integers reach 2**26 raise; repeated rows count each; the
first entries are the smallest by (id, vector), null ids last; ties go to the lower entry; an entry that has no part stays;
fewer rows than entries make smaller codebooks; an empty table gives an empty result; ids and labels may be of any type,
null labels are one group; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import narrow_batches, release, spread_join, staged, trimmed

#: Components, once integers, stay below this, so that sums of squared distances fit 64 bits.
MOST = 1 << 26
#: Vectors whose distances to one codebook are held at once.
BLOCK = 2048


@dataclass
class Codebooks:
    entries: np.ndarray  # parts × entries × width
    sums: np.ndarray  # the same: running sums of the parts assigned to each entry
    counts: np.ndarray  # parts × entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def refined(self) -> np.ndarray:
        """Each entry's mean, rounded down; an entry without parts as it is."""
        n = self.counts[:, :, None]
        return np.where(n > 0, self.sums // np.maximum(n, 1), self.entries)


def integers(vectors: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """id, label, q (components as 32-bit integers in a binary) of the vectors that are kept."""
    x = F.col(f"`{vector}`")
    number = lambda c: c.cast("double")
    sound = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")))
    too_far = F.exists(x, lambda c: F.abs(number(c)) * scale >= MOST)
    whole = F.when(too_far, F.raise_error("a component is too large to be coded exactly")).otherwise(F.transform(x, lambda c: F.floor(number(c) * scale).cast("int")))
    held = (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label")
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(f"`{key}`").alias("id"), held, whole.alias("q"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column(2)
            flat, cuts = q.flatten().to_numpy(zero_copy_only=False).astype("<i4"), q.offsets.to_numpy() - q.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["id", "label", "q"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(packed, f"id {kinds['id']}, label {kinds['label']}, q binary")


def entries_kind(many: int) -> str:
    return "<u1" if many <= 256 else "<u2"


def matrix(column: pa.Array) -> np.ndarray:
    """The column's vectors as rows of 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x (vectors × parts × width) the nearest entry of each part, the lower one of equals, and its distance."""
    codes, far = np.empty(x.shape[:2], entries_kind(entries.shape[1])), np.empty(x.shape[:2], np.int64)
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    exact = 4 * entries.shape[2] * largest**2 < 1 << 53  # then doubles, which multiply faster, hold every sum exactly
    for i in range(0, len(x), BLOCK):
        for p, book in enumerate(entries):
            part = x[i : i + BLOCK, p]
            if exact:
                gap = (book**2).sum(1)[None, :].astype(float) - 2 * (part.astype(float) @ book.T.astype(float))
            else:
                gap = (book**2).sum(1)[None, :] - 2 * (part @ book.T)
            best = gap.argmin(1)
            codes[i : i + BLOCK, p] = best
            far[i : i + BLOCK, p] = ((x[i : i + BLOCK, p] - book[best]) ** 2).sum(1)
    return codes, far


def assigned(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """rows with `before`, the codes they had (null at first), and `codes`, those of these entries."""
    parts, _, width = entries.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, _ = nearest(matrix(b.column(2)).reshape(-1, parts, width), entries)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(3), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "label", "q", "before", "codes"])

    before = F.col("codes") if "codes" in rows.columns else F.lit(None).cast("binary")
    return rows.select("id", "label", "q", before.alias("before")).mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, q binary, before binary, codes binary")


def changes(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """place (part, entry and component as one number; the last component is the count), delta: what parts that changed add
    to their new entries and take from their old ones, added up by task."""
    parts, many, width = entries.shape
    kind = entries_kind(many)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * many, width + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0)).reshape(-1, parts, width)
            now = np.frombuffer(b"".join(b.column(2).to_pylist()), kind).reshape(-1, parts).astype(np.int64)
            fresh = np.array([v is None for v in b.column(1).to_pylist()])
            old = np.frombuffer(b"".join(v if v is not None else bytes(parts * np.dtype(kind).itemsize) for v in b.column(1).to_pylist()), kind).reshape(-1, parts).astype(np.int64)
            moved = fresh[:, None] | (now != old)
            for at, sign in ((moved, 1), (moved & ~fresh[:, None], -1)):
                row, part = np.nonzero(at)
                place = part * many + (now if sign > 0 else old)[row, part]
                np.add.at(total, (place[:, None], np.arange(width)[None, :]), sign * x[row, part])
                np.add.at(total, (place, width), sign)
        flat = total.reshape(-1)
        full = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(flat[full], pa.int64())], names=["place", "delta"])

    return rows.where("before is null or before <> codes").select("q", "before", "codes").mapInArrow(run, "place long, delta long").groupBy("place").agg(F.sum("delta").alias("delta"))


def learn(rows: DataFrame, parts: int = 16, many: int = 64, rounds: int = 2) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks after `rounds` rounds over rows (a stored table from `integers`), and the rows with the last round's codes
    (stored); None where there is no row."""
    size = rows.agg(F.min(F.octet_length("q")).alias("least"), F.max(F.octet_length("q")).alias("most")).first()
    if size.most is None:
        return None, rows
    width, over = divmod(size.most // 4, parts)
    if size.least != size.most or over:
        raise ValueError(f"vectors have {size.least // 4} to {size.most // 4} components, which {parts} parts can't cut alike")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(many).select("q").collect()
    entries = np.stack([np.frombuffer(r.q, "<i4").astype(np.int64).reshape(parts, width) for r in first], axis=1)
    books = Codebooks(entries, np.zeros_like(entries), np.zeros(entries.shape[:2], np.int64))
    for r in range(rounds):
        after = staged(assigned(rows, books.entries), "vector-codes")
        if r:
            release(rows)
        rows = after
        for place, delta in changes(rows, books.entries).collect():  # parts × entries × (width + 1) numbers at most
            cell, at = divmod(place, width + 1)
            part, entry = divmod(cell, entries.shape[1])
            if at < width:
                books.sums[part, entry, at] += delta
            else:
                books.counts[part, entry] += delta
        books.entries = books.refined()
    return books, rows


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, codes (a binary with a number for each part), error: the squared distances of all parts, summed."""
    parts, _, width = books.entries.shape
    entries, kinds = books.entries, {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, far = nearest(matrix(b.column(2)).reshape(-1, parts, width), entries)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far.sum(1))], names=["id", "label", "codes", "error"])

    return rows.select("id", "label", "q").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, codes binary, error long")


def decoded(codes: bytes, books: Codebooks, scale: int = 256) -> np.ndarray:
    """The vector that codes stand for, at the middle of each integer's step."""
    at = np.frombuffer(codes, entries_kind(books.entries.shape[1]))
    return (np.concatenate([book[c] for book, c in zip(books.entries, at, strict=True)]) + 0.5) / scale


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, many: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """key, code (hex), error, label_error (summed over rows of the same label), codebooks_sha256."""
    narrow_batches(vectors.sparkSession, 10_000)
    rows = staged(integers(vectors, key, vector, label, scale), "vector-integers")
    books, last = learn(rows, parts, many, rounds)
    name = F.col("id").alias(key)
    if books is None:
        return rows.select(name, F.hex("q").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    done = staged(encoded(last, books).withColumn("label", F.struct("label")), "vector-encoded")
    release(rows)
    if last is not rows:
        release(last)
    by_label = staged(done.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("times")), "vector-labels")
    return spread_join(done, by_label, "label").select(name, F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
