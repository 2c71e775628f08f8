"""Operator 2: few-document patterns fitted to the length histogram by non-negative least squares.

`token_pieces` encodes whole texts and cuts only documents longer than a sequence; `plan` decides, from the histogram of
piece lengths alone, how often each pattern of lengths is used; `assign` gives each piece its sequence and offset.

The plan: pieces of full length stand alone.  All patterns of two or three lengths (those of the histogram) that sum to
the sequence length are enumerated, and repeat counts x >= 0 that minimise |A x - h|² (A: pieces of each length in each
pattern, h: the histogram) are found by accelerated projected gradient.  Counts are rounded down with the remainders
carried from pattern to pattern, and no length is used more often than it occurs.  The residual histogram is packed
best-fit decreasing, all pieces of a length at a time.  The histogram has at most `size` entries whatever the input, so
this runs on the driver in bounded time and memory.

Ranks within a length come from each shard's own running counts plus the counts of earlier shards, so that no length,
however common, meets in one task.

Defined cases: a null or empty text is its end token alone; texts of any length are taken whole, in pieces; repeated rows and ids are documents of their own; an empty table
gives an empty result; other columns are left out; equal histograms give equal plans.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import slices, staged, trimmed
from verdigris.llm.encoding import encoder, with_end

#: Most bytes of text that a worker encodes at once: units and ids of a slice take many times its bytes.
SLICE = 512 << 10
PIECES = "piece int, start long, length long, ids_crc32 long, shard int, local_rank long"


def token_pieces(docs: DataFrame, *, size: int = 2048, tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 0, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece, with its ids if asked for; `local_rank` counts the shard's earlier pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer, kind, 300_000), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in slices(batches, limit=SLICE):
            ids, cuts = with_end(*enc.encode(b.column(1)), end_id)
            total = np.diff(cuts)
            n = -(-total // size)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(total[row] - start, size)
            order = np.argsort(length, kind="stable")
            run = length[order]
            first = np.searchsorted(run, run)
            rank = np.empty(len(row), np.int64)
            rank[order] = seen[run] + np.arange(len(run)) - first
            seen += np.bincount(length, minlength=size + 1)
            at = cuts[:-1][row] + start
            crcs = [zlib.crc32(ids[i : i + k]) for i, k in zip(at, length, strict=True)]
            out = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(row), shard), pa.int32()), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "local_rank"]
            if keep_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(trimmed(cut), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + PIECES + ", ids array<int>" * keep_ids)


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All multisets of two or three of the lengths that sum to size, as rows of three (0: none), longest first."""
    here = np.zeros(size + 1, bool)
    here[lengths] = True
    found = []
    for a in lengths[::-1]:
        rest = size - a
        b = lengths[(lengths <= min(a, rest)) & (2 * lengths >= rest)]
        c = rest - b
        fit = (c == 0) | here[c]
        found.append(np.stack([np.full(fit.sum(), a), b[fit], c[fit]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(pats: np.ndarray, h: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with small |A x - h|², by projected gradient with Nesterov's momentum."""
    n = len(h)
    used = pats.ravel()

    def times(x: np.ndarray) -> np.ndarray:
        out = np.bincount(used, np.repeat(x, 3), n)
        out[0] = 0
        return out

    # steps scaled by the row sums of AᵀA, which bound its eigenvalues
    count = np.bincount(used, minlength=n).astype(float)
    count[0] = 0
    scale = 1 / np.maximum(count[pats].sum(1), 1)
    x = y = scale * h[pats].sum(1)
    t = 1.0
    for _ in range(steps):
        r = times(y) - h
        r[0] = 0
        z = np.maximum(y - scale * r[pats].sum(1), 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = z + (before - 1) / t * (z - x)
        x = z
    return x


def plan(h: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) whose lengths, repeated so, are just the histogram h (h[k]: pieces of length k)."""
    left = h.astype(np.int64).copy()
    out = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    lengths = np.flatnonzero(left)
    pats = patterns(lengths, size)
    if len(pats):
        x = fit(pats, left.astype(float))
        whole = np.diff(np.floor(np.cumsum(x) + 1e-9), prepend=0).astype(np.int64)
        for i in np.argsort(-whole, kind="stable"):
            if not whole[i]:
                break
            parts = [int(k) for k in pats[i] if k]
            times = min(int(whole[i]), *(int(left[k]) // parts.count(k) for k in parts))
            if times:
                out.append((tuple(parts), times))
                for k in parts:
                    left[k] -= times
    return out + best_fit(left, size)


def best_fit(h: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal bins are filled together."""
    space: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for k in range(size, 0, -1):
        n, room = int(h[k]), k
        while n:
            while room <= size and not space[room]:
                room += 1
            if room > size:
                each = min(size // k, n)
                bins = n // each
                space[size - each * k].append(((k,) * each, bins))
                n -= bins * each
                room = k
            else:
                parts, bins = space[room].pop()
                each = min(room // k, n)
                take = min(bins, n // each)
                space[room - each * k].append((parts + (k,) * each, take))
                if bins > take:
                    space[room].append((parts, bins - take))
                n -= take * each
                room = k
    return [x for s in space for x in s]


def assign(pieces: DataFrame, *, size: int = 2048) -> DataFrame:
    """pieces (which must be a stored table: it is read twice) with sequence_id and offset."""
    counts = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    before = counts.select("shard", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    h = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        h[r.length] = r.n
    slots: list[tuple[int, int, int, int]] = []
    next_rank, sequence = np.zeros(size + 1, np.int64), 0
    for parts, times in plan(h, size):
        offset = 0
        for k in parts:
            slots.append((k, int(next_rank[k]), sequence, offset))
            next_rank[k] += times
            offset += k
        sequence += times
    if (next_rank != h).any():
        raise AssertionError("the plan doesn't hold every piece once")
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)  # bounded by the number of patterns
    keys = (table[:, 0] << 44) + table[:, 1]
    names = [c for c in pieces.columns if c not in ("shard", "local_rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            rank = col["local_rank"].to_numpy() + col["before"].to_numpy()
            key = (col["length"].to_numpy() << 44) + rank
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*(col[n] for n in names), pa.array(table[at, 2] + key - keys[at]), pa.array(table[at, 3])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return pieces.join(before, ["shard", "length"]).select(*names, "local_rank", "before").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, *, size: int = 2048, **options) -> DataFrame:
    """The pieces of all documents with their places."""
    return assign(staged(token_pieces(docs, size=size, **options), "pieces"), size=size)
