"""Vectors, shingles and MinHash over texts."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = (1 << 31) - 1
#: Angles, or components of vectors, that a Python worker holds at once in `cosine_cells`.
ANGLES = 1 << 20
#: Vectors of a cell that a task holds while the cell's others pass by, and products that it makes at once.
PART, PRODUCTS = 1 << 14, 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def unit_rows(vectors: list) -> np.ndarray:
    """The vectors as rows of length 1; a zero vector stays."""
    v = np.array(vectors, float).reshape(len(vectors), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def pivots(df: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """Up to `most` of the vectors, as drawn by hash, of 16 MB at most."""
    drawn = df.where(F.exists(vector, lambda x: x != 0)).select(vector).orderBy(F.xxhash64(key), key)
    one = drawn.first()
    if one is None:
        return np.zeros((1, 1))
    return unit_rows([r[0] for r in drawn.limit(max(1, min(most, (16 << 20) // (8 * len(one[0]))))).collect()])


def cosine_cells(df: DataFrame, key: str, vector: str, threshold: float, block: int, coarse: int = 0) -> DataFrame:
    """cell, guest, core, id, v: each vector in the cell of its nearest pivot, and as a guest wherever a vector of that cell
    can have the cosine with it.

    Let x live with pivot p, y with q, and their angle be t at most.  Then angle(y, p) is at most angle(x, p) + t, so at most
    the cell's radius + t; and as x is nearer to p than to q, it is at most angle(y, q) + 2t.  A guest is only sent to cells
    before its own, so two vectors meet once.  `core`: within t/2 of the pivot, so that all of a core are alike.  Where
    vectors would be guests in over a quarter of the cells before theirs, a pivot has `coarse` vectors instead of `block`."""
    import pyarrow as pa

    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-7
    centres = pivots(df, key, vector, -(-df.count() // block))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def angles(batches):
        """ids, vectors and their angles with all pivots, `ANGLES` at once."""
        step = max(1, ANGLES // len(centres))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                v = unit_rows(b.column(1).to_pylist())
                if v.shape[1] != centres.shape[1]:
                    yield b.column(0), v, np.zeros((len(v), len(centres)))
                else:
                    yield b.column(0), v, np.arccos(np.clip(v @ centres.T, -1, 1))

    def radius(batches):
        far = np.zeros(len(centres))
        for _, _, at in angles(batches):
            np.maximum.at(far, at.argmin(1), at.min(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(far)), pa.int32()), pa.array(far)], names=["cell", "far"])

    radii = np.zeros(len(centres))
    for cell, far in rows.mapInArrow(radius, "cell int, far double").groupBy("cell").agg(F.max("far")).collect():  # a row a pivot
        radii[cell] = far

    def guests(at):
        home, near = at.argmin(1), at.min(1)
        return home, near, (at <= radii[None, :] + reach) & (at <= near[:, None] + 2 * reach) & (np.arange(len(centres))[None, :] < home[:, None])

    def visits(batches):
        held = [(int(may.sum()), int(home.sum())) for _, _, at in angles(batches) for home, _, may in [guests(at)]]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x) for x in zip(*held)] if held else [0, 0], pa.int64()), pa.array([0, 1], pa.int32())], names=["n", "of"])

    if coarse > block and len(centres) > 1:
        n = {r["of"]: r["n"] for r in rows.mapInArrow(visits, "n long, of int").groupBy("of").agg(F.sum("n").alias("n")).collect()}
        if 4 * n[0] > n[1]:
            return cosine_cells(df, key, vector, threshold, coarse)

    def dealt(batches):
        for ids, v, at in angles(batches):
            home, near, may = guests(at)
            row, cell = np.nonzero(may)
            every, cells = np.concatenate([np.arange(len(v)), row]), np.concatenate([home, cell])
            of_core = (near <= reach / 2 - 1e-6) & (np.abs(v).sum(1) > 0)
            step = max(1, ANGLES // max(1, v.shape[1]))  # a vector may visit all cells, so its visits leave in parts
            for i in range(0, len(every), step):
                take = every[i : i + step]
                guest = np.arange(i, i + len(take)) >= len(v)
                cut = np.arange(len(take) + 1) * v.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(cells[i : i + step], pa.int32()), pa.array(guest), pa.array(~guest & of_core[take]), ids.take(pa.array(take)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v[take].ravel()))], names=["cell", "guest", "core", "id", "v"])

    return rows.mapInArrow(dealt, "cell int, guest boolean, core boolean, id long, v array<double>")


def cosine_pairs(df: DataFrame, key: str, vector: str, threshold: float, block: int = 512, forest: bool = False) -> DataFrame:
    """(a, b), a < b, of all pairs with that cosine or more, exactly: vectors meet in the cells of `cosine_cells`.  A cell's own
    vectors are dealt into parts of about `PART`; a task holds a part, and the other parts and the guests pass by it, so a
    vector is shuffled once for each part that it meets, not for each block.

    forest: pairs with the same components only, fewer than the vectors that meet; a cell's core is a star."""
    import pyarrow as pa

    from verdigris.sources.staging import shared

    cells = shared(cosine_cells(df.where(F.size(vector) > 0), key, vector, threshold, block, max(block, PART)), "cells")
    kind = F.when(F.col("guest"), 2).when(F.col("core") & F.lit(forest), 0).otherwise(1)
    cells = cells.select("cell", "id", "v", kind.alias("kind"))
    size = cells.where("kind < 2").groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("n"))
    rows = cells.join(F.broadcast(size), "cell")  # a row a pivot, and these are bounded
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    role = lambda i: F.when(F.col("kind") == 2, 2).when(i == own, 0).otherwise(1)
    # the core meets the rim where the core lives; the rim and guests go to all parts
    parts = F.transform(F.when(F.col("kind") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("n") - 1)), lambda i: F.struct(i.alias("part"), role(i).alias("role")))
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # of work, not of bytes
    visits = rows.select("cell", F.explode(parts).alias("p"), "kind", "id", "v").select("cell", "p.part", "p.role", "kind", "id", "v")

    def alike(a: tuple, b: tuple, once: str):
        """once: `rows` (b comes after a's rows), `ids` (the pair meets twice) or neither."""
        (left, x), (right, y) = a, b
        step = max(1, PRODUCTS // max(1, len(x)))
        for at in range(0, len(y), step):
            i, j = np.nonzero(x @ y[at : at + step].T >= threshold)
            j += at
            if once:
                keep = i < j + len(x) - len(y) if once == "rows" else left[i] < right[j]
                i, j = i[keep], j[keep]
            if forest:
                i, j = spanning(i, j + len(x), len(x) + len(y)) if once != "rows" else spanning(i, j + len(x) - len(y), len(x))
                j = j - len(x) if once != "rows" else j - len(x) + len(y)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left[i], right[j])), pa.array(np.maximum(left[i], right[j]))], names=["a", "b"])

    def run(batches):
        join = lambda of: tuple(np.concatenate(z) for z in zip(*of, strict=True))
        now, core, rim = None, [], []
        for b in batches:
            cell, part, roles, kinds, ids = (b.column(i).to_numpy() for i in range(5))
            code = np.stack([cell, part, roles, kinds])
            cuts = [0, *(np.flatnonzero((code[:, 1:] != code[:, :-1]).any(0)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if now != (now := (cell[lo], part[lo])):
                    core, rim = [], []
                some = ids[lo:hi], b.column(5).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                if roles[lo] > 0:
                    core, rim = ([join(x)] if x else [] for x in (core, rim))
                    for x in core + rim:
                        # a part's core is met by the rim of others there alone
                        yield from alike(x, some, "ids" if roles[lo] == 1 and x is not (core or [None])[0] else "")
                elif kinds[lo] == 0:
                    if rim:
                        yield from alike(join(rim), some, "")
                    core.append(some)
                else:
                    if core:
                        yield from alike(join(core), some, "")
                    rim = [join([*rim, some])]
                    yield from alike(rim[0], some, "rows")

    found = visits.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "role", "kind").mapInArrow(run, "a long, b long")
    if forest:
        least = cells.where("kind = 0").groupBy("cell").agg(F.min("id").alias("a"))
        found = found.union(cells.where("kind = 0").join(F.broadcast(least), "cell").select("a", F.col("id").alias("b")))
    return found.where("a <> b")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a–b of n places as many as connect the same places."""
    root, keep = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            keep.append(k)
    return a[keep], b[keep]


def shingle_hashes(text: Column, width: int = 5, base: int = 257) -> Column:
    """Distinct rolling hashes of all `width` bytes; empty for a shorter text."""
    raw = F.hex(F.encode(text, "UTF-8"))
    n = F.length(raw) / 2
    byte = lambda i: F.conv(F.substring(raw, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    def one(i: Column) -> Column:
        out = byte(i)
        for k in range(1, width):
            out = out * base + byte(i + k)
        return out

    return F.when(n >= width, F.array_distinct(F.transform(F.sequence(F.lit(0), (n - width).cast("int")), one))).otherwise(F.array().cast("array<long>"))


def shingle_jaccard(a: Column, b: Column) -> Column:
    """Both empty: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coefficients(perms: int, seed: int) -> tuple[list[int], list[int]]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, P, perms).tolist(), rng.integers(0, P, perms).tolist()


def byte_shingles(text: str | None) -> np.ndarray:
    """Sorted distinct base-257 hashes of all 5 bytes."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.int64)
    if len(raw) < 5:
        return np.empty(0, np.int64)
    h = raw[: len(raw) - 4].copy()
    for k in range(1, 5):
        h = h * 257 + raw[k : len(raw) - 4 + k]
    return np.unique(h)


def shingle_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, s: the distinct byte shingles of whole texts, in time linear in their length."""
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            sets = [byte_shingles(t) for t in b.column(1).to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], names=[key, "s"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, s array<long>")


def shingle_similarity(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, similarity: the Jaccard similarity of the byte shingles of two texts of each row, taken where the row is read;
    of no more than one row's sets are held.  Both empty: 0."""
    import pyarrow as pa

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def alike(x: str | None, y: str | None) -> float:
        x, y = byte_shingles(x), byte_shingles(y)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0

    def run(batches):
        for batch in batches:
            one, two = batch.column(len(keys)), batch.column(len(keys) + 1)
            found = (alike(x.as_py(), y.as_py()) for x, y in zip(one, two, strict=True))
            made = pa.array(np.fromiter(found, float, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], made], names=[*keys, "similarity"])

    return df.select(*keys, a, b).mapInArrow(run, f"{kinds}, similarity double")


def alike_texts(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the rows (a, b, x, y) whose texts x and y have that Jaccard similarity of their byte shingles.

    Sets are made where a row is read, for they take eight times the bytes of their texts; neighbouring rows with the
    same y share its set."""
    import pyarrow as pa

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("a", "b"))

    def run(batches):
        last, held = None, byte_shingles(None)
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = byte_shingles(one.as_py()), two.as_py()
                if y != last:
                    last, held = y, byte_shingles(y)
                small, large = sorted((len(x), len(held)))
                both = len(np.intersect1d(x, held, assume_unique=True)) if small >= threshold * large else 0
                union = len(x) + len(held) - both
                keep.append(union > 0 and both / union >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "x", "y").mapInArrow(run, kinds)


def minhash(df: DataFrame, key: str, text: str, perms: int = 128, seed: int = 17) -> DataFrame:
    """key, signature: min over byte 5-grams of (a·h + b) mod 2³¹ − 1, in an Arrow map (no shuffle); none below 5 bytes."""
    import pyarrow as pa

    a, b = coefficients(perms, seed)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        for batch in batches:
            made = []
            for t in batch.column(1).to_pylist():
                h = byte_shingles(t).astype(np.uint64) % np.uint64(P)
                if not len(h):
                    made.append(None)
                    continue
                made.append(np.concatenate([((x[i : i + 16, None] * h + y[i : i + 16, None]) % np.uint64(P)).min(1) for i in range(0, perms, 16)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=[key, "signature"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, signature array<long>")


def banded(signed: DataFrame, key: str, bands: int = 32) -> DataFrame:
    """key, band, hash: a row for each band of a signature."""
    rows = (F.size("signature") / bands).cast("int")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("signature", i * rows + 1, rows)).alias("hash")))
    return signed.where("signature is not null").select(key, F.explode(keys).alias("k")).select(key, "k.band", "k.hash")


#: Minima of a sketch, four bits of each.
SKETCH = 192


def minima(h: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The minima over h of times·h + plus (mod 2³²), one for each pair of coefficients."""
    out = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 1 << 13):
        part = h[at : at + (1 << 13)]
        for i in range(0, len(times), 16):
            rows = times[i : i + 16, None] * part
            rows += plus[i : i + 16, None]
            np.minimum(out[i : i + 16], rows.min(1), out=out[i : i + 16])
    return out


def profiles(df: DataFrame, key: str, text: str, perms: int = 128, bands: int = 32, seed: int = 17) -> DataFrame:
    """key, size (of the set of byte 5-grams), same (equal for equal sets), bands (a hash for each band of the first `perms`
    minima), sketch (four bits of each of 192 minima, 16 to an integer).  Texts below 5 bytes have no row."""
    import hashlib

    import pyarrow as pa

    rng = np.random.default_rng(seed)
    times, plus = (rng.integers(0, 1 << 32, max(perms, SKETCH), np.uint32) for _ in range(2))
    times |= np.uint32(1)
    kind = df.schema[key].dataType.simpleString()

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)

    def run(batches):
        for batch in batches:
            at, size, same, held, sketch = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                s = byte_shingles(t)
                if not len(s):
                    continue
                low = minima((mixed(s.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32), times, plus)
                band = np.arange(bands, dtype=np.uint64)
                for c in low[:perms].reshape(bands, -1).T:
                    band = mixed(band * np.uint64(31) + c)
                at.append(i)
                size.append(len(s))
                same.append(hashlib.md5(s.tobytes()).digest())
                held.append(band.view(np.int64))
                # middle bits: the high ones of a minimum are 0, the low ones of a product are not mixed
                four = (low[:SKETCH] >> np.uint32(7)).astype(np.uint8) & 15
                sketch.append((four[::2] << 4 | four[1::2]).view(np.int64))
            lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(size, pa.int64()), pa.array(same, pa.binary()), lists(held), lists(sketch)], names=[key, "size", "same", "bands", "sketch"])

    rows, cores = df.select(key, text), df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # less than a split for each core, so little
        rows = rows.repartition(cores)
    return rows.mapInArrow(run, f"{key} {kind}, size long, same binary, bands array<long>, sketch array<long>")


def most_unlike(threshold: float) -> int:
    off = (1 - threshold) * 15 / 16  # two unlike minima have the same four bits once in 16
    return math.ceil(SKETCH * off + 6 * math.sqrt(SKETCH * off * (1 - off)))


def may_be_alike(a: str, b: str, threshold: float) -> Column:
    """Whether two profiles (column prefixes) leave it possible that their sets have that Jaccard similarity: by their sizes
    for certain, by their sketches up to six standard deviations (1 in 10⁹ of the pairs at the threshold is lost)."""
    most = most_unlike(threshold)
    x, y = F.col(f"{a}size"), F.col(f"{b}size")

    def unlike(i: int) -> Column:
        d = F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    apart = reduce(add, (unlike(i) for i in range(SKETCH // 16)))
    return (F.least(x, y) >= threshold * F.greatest(x, y)) & (apart <= most)


def cells(nodes: DataFrame, key: str) -> DataFrame:
    """key, band, hash: a row for each band of a profile."""
    return nodes.select(key, F.posexplode("bands").alias("band", "hash"))


#: Rows of a group up to which its pairs are listed with those of other groups instead of meeting in a matrix.
FEW = 32
_FOUR = np.uint64(0x1111111111111111)


def unlike_parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of their minima's four bits the sketches differ, an integer of 16 after the other (first axis)."""
    out = 0
    for a, b in zip(x, y, strict=True):
        d = a ^ b
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        d &= _FOUR
        out = out + np.bitwise_count(d)
    return out


def alike_places(group: np.ndarray, role: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float):
    """Places x, y of rows that `may_be_alike` and are of one group (a number that doesn't fall from row to row), x of role 0;
    of two rows of role 0 once.  sketch: a column a row.  They come in parts of bounded size."""
    most = most_unlike(threshold)
    order = np.lexsort((size, role > 0, group))
    group, late, size, sketch = group[order], role[order] > 0, size[order], np.ascontiguousarray(sketch[:, order])
    cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    n = np.diff(cuts)

    def sized(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
        return x[near], y[near]

    def square(i: int, j: int, k: int, m: int):
        """Rows i to j against k to m, which are in order of their sizes."""
        low, high = np.searchsorted(size[k:m], [size[i] * threshold * (1 - 1e-12), size[j - 1] / threshold * (1 + 1e-12)])
        for at in range(k + low, k + high, 1024):
            x, y = np.nonzero(unlike_parts(sketch[:, i:j, None], sketch[:, None, at : min(at + 1024, k + high)]) <= most)
            x, y = x + i, y + at
            once = late[y] | (x < y)
            yield sized(x[once], y[once])

    def found():
        few = np.flatnonzero((n > 1) & (n <= FEW))
        for part in np.array_split(few, int((n[few] ** 2).sum() >> 18) + 1):  # each with each that comes after it
            rows = np.flatnonzero(np.isin(group, group[cuts[part]])) if len(part) else part
            after = np.repeat(cuts[part + 1], n[part]) - rows - 1
            x = np.repeat(rows, after)
            y = np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after) + x + 1
            x, y = sized(x[~late[x]], y[~late[x]])
            near = unlike_parts(sketch[:, x], sketch[:, y]) <= most
            yield x[near], y[near]
        for g in np.flatnonzero(n > FEW):
            begin, end = cuts[g], cuts[g + 1]
            first = begin + int((~late[begin:end]).sum())  # the others come after those of role 0
            for i in range(begin, first, 32):
                yield from square(i, min(i + 32, first), i, first)
                yield from square(i, min(i + 32, first), first, end)

    held, many = [], 0
    for x, y in found():
        held.append((order[x], order[y]))
        many += len(x)
        if many > 1 << 18:
            yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
            held, many = [], 0
    if many:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def met(rows: DataFrame, key: str, threshold: float, portion: int = 1024) -> DataFrame:
    """(a, b), a < b, of rows (key, band, hash, comp, size, sketch; a stored table) that share a bucket, are of different
    components and may be alike.  With their `bands` two rows meet in the first bucket they share and nowhere else.

    A bucket of more than `portion` rows is cut into classes of size, so wide that only rows of the same or of neighbouring
    classes may be alike.  A class is dealt into portions, and each portion meets the whole class and the one below: so no
    task holds more than a portion against them, whatever the bucket.  A sketch's comparison takes numpy some 50 ns, and
    what the profiles rule out never leaves the group."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from verdigris.sources.staging import shared

    cell = ["band", "hash"]
    often = rows.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > portion).select(*cell)
    of_size = F.floor(F.log("size") / (max(-math.log(threshold), 1e-6) * (1 + 1e-9))).cast("int")
    counts = rows.join(often, cell, "left_semi").groupBy(*cell, of_size.alias("c")).agg(F.ceil(F.count("*") / portion).cast("int").alias("n"))
    # a row a crowded bucket, stored, so that Spark broadcasts it while it is small
    crowded = shared(counts.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("parts")), "crowded")
    dealt = rows.join(crowded, cell, "left").withColumn("of_size", F.when(F.col("parts").isNotNull(), of_size).otherwise(-2))
    dealt = dealt.withColumns({"own": F.try_element_at("parts", "of_size"), "above": F.try_element_at("parts", F.col("of_size") + 1)})
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64(key), F.coalesce("own", F.lit(1))).cast("int"))
    place = lambda up, part, role: F.struct((F.col("of_size") + up).alias("of_size"), part.alias("part"), role.cast("int").alias("role"))
    parts = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    home = F.transform(parts(F.col("own")), lambda i: place(0, i, F.when(i == F.col("at"), 0).otherwise(1)))
    guest = F.when(F.col("above").isNotNull(), F.transform(parts(F.col("above")), lambda i: place(1, i, F.lit(2)))).otherwise(F.array().cast("array<struct<of_size:int,part:int,role:int>>"))
    once = "bands" in rows.columns
    kept = ["size", "key", "comp", "sketch", *["bands"] * once]
    visits = dealt.withColumnRenamed(key, "key").select(*cell, *kept, F.explode(F.concat(home, guest)).alias("p"))
    visits = visits.select(*cell, "p.of_size", "p.part", "p.role", *kept)
    where = [*cell, "of_size", "part"]
    kind = rows.schema[key].dataType.simpleString()

    def lists(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def pairs(batches: list[pa.RecordBatch]):
        """Of whole groups."""
        table = pa.concat_batches(batches) if len(batches) > 1 else batches[0]
        col = dict(zip(table.schema.names, table.columns, strict=True))
        moved = np.zeros(table.num_rows, bool)
        for c in where:
            v = col[c].to_numpy(zero_copy_only=False)
            moved[1:] |= v[1:] != v[:-1]
        role, code = (x.to_numpy(zero_copy_only=False) for x in (col["role"], col["comp"].dictionary_encode().indices))
        for x, y in alike_places(np.cumsum(moved), role, col["size"].to_numpy(zero_copy_only=False), lists(col["sketch"]).view(np.uint64).T, threshold):
            ok = code[x] != code[y]
            x, y = x[ok], y[ok]
            if once:
                band, held = col["band"].to_numpy(zero_copy_only=False), lists(col["bands"])
                ok = np.concatenate([np.empty(0, bool), *((held[x[i : i + 16384]] == held[y[i : i + 16384]]).argmax(1) == band[x[i : i + 16384]] for i in range(0, len(x), 16384))])
                x, y = x[ok], y[ok]
            a, b = col["key"].take(pa.array(x)), col["key"].take(pa.array(y))
            ahead = pc.less(a, b)
            low, high = pc.if_else(ahead, a, b), pc.if_else(ahead, b, a)
            ok = pa.array((role[y] != 1) | ahead.to_numpy(zero_copy_only=False))  # two portions meet twice
            yield pa.RecordBatch.from_arrays([low.filter(ok), high.filter(ok)], names=["a", "b"])

    def run(batches):
        held = []

        def same(x: pa.RecordBatch, i: int, y: pa.RecordBatch, j: int) -> bool:
            return all(x.column(c)[i].as_py() == y.column(c)[j].as_py() for c in where)

        for b in batches:
            if not b.num_rows:
                continue
            if not same(b, 0, b, b.num_rows - 1) or (held and not same(held[0], 0, b, 0)):
                last, low, high = b.num_rows - 1, 0, b.num_rows - 1
                while low < high:  # rows are in order, so the last group's first place is found by halves
                    mid = (low + high) // 2
                    low, high = (low, mid) if same(b, mid, b, last) else (mid + 1, high)
                yield from pairs([*held, b.slice(0, low)])
                held = []
                b = b.slice(low)
            held.append(b)
        if held:
            yield from pairs(held)

    found = visits.repartition(*where).sortWithinPartitions(*where).mapInArrow(run, f"a {kind}, b {kind}")
    return found if once else found.distinct()


def lsh_pairs(profiled: DataFrame, key: str, threshold: float = 0.8) -> DataFrame:
    """(a, b), a < b, of rows that share a band and may be alike at the threshold.  Rows of equal sets are one row here, held
    against their smallest only: copies don't become pairs of each other.  profiled: a stored table of `profiles`."""
    from verdigris.sources.staging import shared

    nodes, copies = distinct_sets(profiled, key)
    each = cells(nodes, key)
    several = each.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").select("band", "hash")
    rows = shared(each.join(several, ["band", "hash"]).join(nodes.select(key, F.col(key).alias("comp"), "size", "sketch", "bands"), key), "lsh-rows")
    return met(rows, key, threshold).union(copies)


def distinct_sets(profiled: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The profile of the smallest row of each set (stored), and (a, b) of that row and each other of the set."""
    from verdigris.sources.staging import shared

    nodes = shared(profiled.groupBy("same").agg(F.min(F.struct(key, "size", "bands", "sketch")).alias("x")).select("same", "x.*"), "nodes")
    copies = profiled.select("same", F.col(key).alias("b")).join(nodes.select("same", F.col(key).alias("a")), "same").where("a < b").select("a", "b")
    return nodes, copies
