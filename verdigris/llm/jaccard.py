"""Operator 4: n-gram Jaccard join, heavy-light by set size, as connected components.

A document's set holds its distinct k-word shingles (as 64-bit hashes); documents of equal sets are one node.  A set of n
shingles has `least(n)` shingles in common with any set that is similar to it, so two similar sets share c shingles of
their first n − least(n) + c, in any order that all sets agree on.  The order here puts common shingles last (counted in a
first pass over all texts), so that long inverted lists are rare.

* Light sets (n up to the boundary): all 2-subsets of the first n − least(n) + 2 shingles are the keys.
* Heavy sets: the first n − least(n) + 1 shingles are the keys, the inverted lists.  Light sets of a size that can still
  meet a heavy one are in those lists too.

The boundary is the one of least cost: subsets to write against list entries to write and scan, from the histogram of
sizes and the measured repetition of shingles.

Candidates never become all pairs of a list.  Each list has a hub, its member with the most common shingles.  First each
member is held against its nearest hubs; the components of these links contract the lists.  Then, only where a hub's members
still are in several components, members of different components are compared by size and by 256 counts of their shingles,
large sets by 2,048 more (half the sum of differences bounds the overlap), and what passes is verified on the sets.  Both steps verify by exact
intersection.  Pairs within a component are never made, and no link between components is lost.

Defined cases: null and wordless texts have an empty set and stay alone; a text of fewer than k words is one shingle; texts
of any length are taken whole; repeated ids are rows of one document id, which links only by text; ids may be of any type
that sorts, and a null id is no component's smallest but where all are null; an empty table gives an empty result; other
columns are left out (`representatives` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import WORDS, as_bytes, components, mix, release, shingles, slices, small, staged, trimmed

#: Entries of the table of common shingles: 9 bytes each.  Others count as rare, which costs time and no results.
MOST_COMMON = 1 << 21
#: Finer counts of large sets, which 256 counts tell apart badly.
WIDE, WIDE_SET = 2048, 1500
#: Nodes of a hub that meet another block of its nodes in one task.
BLOCK = 2048
#: Nodes of a list, of the 1 in 64 that are counted beforehand, from which on it may be dealt over many tasks.
OFTEN = 200
#: Hubs that a node is held against in the first step, which only spares work in the second, whole one.
FIRST_HUBS = 2


def least_overlap(n: int, similarity: float) -> int:
    """Shingles that a set of n shares with any similar set, at least."""
    return max(1, math.ceil(similarity * n - 1e-9))


def text_set(text: bytes, k: int) -> np.ndarray:
    return shingles(WORDS.of(text.lower().split()), k)


def census(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, float, dict[int, int]]:
    """Shingles that several documents of a slice have, sorted, with the levels of their counts (eighths of a power of two;
    the most frequent ones, at most MOST_COMMON of them), the sum of these counts, and the number of sets of each size;
    sizes over 128 count as 128."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.zeros(129, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)

        def batch(sort: int, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), sort), pa.int32()), pa.array(keys.view(np.int64)), pa.array(times)], names=["sort", "key", "n"])

        for b in slices(batches, limit=8 << 20):
            sets = [text_set(x, k) for x in as_bytes(b.column(0))]
            sizes += np.bincount([min(len(x), 128) for x in sets], minlength=129)
            every = np.sort(np.concatenate(sets))
            if len(every):
                first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                times = np.diff(np.append(first, len(every)))
                many = times > 1
                held.append((every[first[many]], times[many].astype(np.int64)))
                if sum(len(x) for x, _ in held) > 2 * MOST_COMMON:
                    held = [merged()]
                    if len(held[0][0]) > MOST_COMMON:
                        yield batch(0, *held.pop())
        if held:
            yield batch(0, *merged())
        yield batch(1, np.arange(129), sizes)

    counts = staged(texts.select("text").mapInArrow(trimmed(count), "sort int, key long, n long").groupBy("sort", "key").agg(F.sum("n").alias("n")), "census")
    level = F.floor(F.log2("n") * 8)
    least, held, scanned = 1 << 30, 0, 0.0
    for r in counts.where("sort = 0").groupBy(level.cast("int").alias("level")).agg(F.count("*").alias("n"), F.sum("n").alias("total")).orderBy(F.desc("level")).collect():  # some hundred levels
        if held + r.n > MOST_COMMON:
            break
        least, held, scanned = r.level, held + r.n, scanned + r.total
    found = counts.where((F.col("sort") == 0) & (level >= least)).select("key", F.least(level, F.lit(255)).cast("short").alias("level")).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    sizes = {r.key: r.n for r in counts.where("sort = 1 and key > 0 and n > 0").collect()}
    release(counts)
    return keys[order], found["level"].to_numpy(np.uint8)[order], scanned, sizes


def boundary(sizes: dict[int, int], scanned: float, similarity: float) -> int:
    """The largest light size, by least cost.  scanned: repetitions among the common shingles, which a list entry shares."""
    total = sum(n * f for n, f in sizes.items()) or 1
    meets = 1 + scanned / total
    best, cost = 1, math.inf
    for b in range(1, 65):
        c = 0.0
        for n, f in sizes.items():
            p = n - least_overlap(n, similarity) + 1
            if n <= b:
                c += f * p * (p + 1) / 2
            if n > b or n >= similarity * b:
                c += f * p * meets
        if c < cost:
            best, cost = b, c
    return best


def profile(s: np.ndarray) -> bytes:
    """256 counts of a set's shingles by their top bits; sets from WIDE_SET shingles on add WIDE finer ones."""
    count = lambda bits: np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()
    return count(8) + (count(WIDE.bit_length() - 1) if len(s) >= WIDE_SET else b"")


def narrow(profiles: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:256] for x in profiles), np.uint8).reshape(-1, 256)


def finer(a: bytes, b: bytes, n: int, m: int, similarity: float) -> bool:
    """False where the finer counts of two large sets rule similarity out."""
    if len(a) == 256 or len(b) == 256:
        return True
    x, y = (np.frombuffer(c, np.uint8, offset=256) for c in (a, b))
    return bool(may_be_similar(np.int64(n), np.int64(m), x, y, similarity))


def node_rows(docs: DataFrame, k: int, similarity: float, light: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, hash (of the text), n, node (a hash of the set), rank (smaller: more of its shingles are common), keys and
    counts (empty and null where the task has met the node before)."""
    table = docs.sparkSession.sparkContext.broadcast(common)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times = table.value

        def keys_of(s: np.ndarray) -> tuple[np.ndarray, float]:
            n = len(s)
            at = np.minimum(np.searchsorted(words, s), len(words) - 1) if len(words) else np.zeros(n, np.int64)
            known = words[at] == s if len(words) else np.zeros(n, bool)
            p = n - least_overlap(n, similarity) + 1
            rare = s[~known]
            if len(rare) <= p:
                often = s[known]
                rare = np.concatenate([rare, often[np.argsort(times[at[known]], kind="stable")]])
            made = []
            if 1 < n <= light:
                first = rare[: p + 1]
                i, j = np.triu_indices(len(first), 1)
                a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                made.append(mix(mix(a) + b + np.uint64(1)))
            if n > light or 1 < n and n >= similarity * light:
                made.append(mix(rare[:p] ^ np.uint64(0x5851F42D4C957F2D)))
            return np.concatenate(made) if made else np.empty(0, np.uint64), known.mean()

        met: set[int] = set()
        for b in slices(batches):
            sets = [text_set(x, k) for x in as_bytes(b.column(1))]
            node = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
            made = []
            for x, s in zip(node, sets, strict=True):
                made.append((s[:0], 0.0) if x is None or x in met else keys_of(s))
                met.add(x)
            if len(met) > 1_000_000:
                met.clear()
            cuts = np.concatenate([[0], np.cumsum([len(x) for x, _ in made])])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([x for x, _ in made]).view(np.int64)))
            counts = [profile(s) if len(x) else None for s, (x, _) in zip(sets, made, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array([int(32 * (1 - c)) for _, c in made], pa.int32()), lists, pa.array(counts, pa.binary())], names=["doc_id", "hash", "n", "node", "rank", "keys", "counts"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(trimmed(run), f"doc_id {kind}, hash long, n long, node long, rank int, keys array<long>, counts binary")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, similarity: float, name: str) -> DataFrame:
    """Those of the pairs (a, b; a stored table, which goes) whose sets are similar: a's set meets b's sets one after the
    other, b's in portions of about 256.  Each set is made from its text and goes straight to the places where it is needed."""
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("portions"))
    dealt = staged(pairs.join(portions, "a").select("a", F.pmod(F.xxhash64("b"), "portions").alias("portion"), "b"), f"{name}-dealt")
    mine = dealt.select(F.col("a").alias("node"), "a", "portion", F.lit(None).cast("long").alias("b")).distinct()
    places = staged(mine.union(dealt.select(F.col("b").alias("node"), "a", "portion", "b")), f"{name}-places")
    needed = staged(places.select("node").distinct().join(nodes, "node").select("node", F.col("doc_id").alias("id"), "hash"), f"{name}-needed")
    rows = docs.join(small(needed), F.xxhash64("text").eqNullSafe(F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_set(x, k).tobytes() for x in as_bytes(b.column(1))], pa.binary())], names=["node", "own"])

    made = rows.mapInArrow(trimmed(sets_of), "node long, own binary").join(small(places), "node").select("a", "portion", "b", "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, y, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                if y is None:
                    own = s
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= round(100 * similarity) * (len(own) + len(s) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = made.repartition("a", "portion").sortWithinPartitions("a", "portion", F.col("b").asc_nulls_first())
    out = staged(met.mapInArrow(trimmed(compare), "a long, b long"), f"{name}-links")
    release(pairs, dealt, places, needed)
    return out


def may_be_similar(n: np.ndarray, m: np.ndarray, counts: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """False where sizes or counts rule similarity out: the symmetric difference is as large as the counts' at least."""
    differ = np.abs(counts.astype(np.int16) - others.astype(np.int16)).sum(-1)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (differ * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-9)


def hub_members(rows: DataFrame) -> DataFrame:
    """(hub, node, lists: how many they share), the hub itself too, for every list of several nodes.

    A list's rows are sorted in one task, but for lists that hold many of the nodes (counted on one node in 64): of these,
    2,000 at most, the hubs come from counts that tasks combine first, and go to all tasks."""
    entries = rows.where("size(keys) > 0").select("node", "rank", F.explode("keys").alias("key"))
    seen = entries.where(F.pmod("node", F.lit(64)) == 0).groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") >= OFTEN)
    seen = staged(seen, "hot-lists")
    total = rows.where("size(keys) > 0").agg(F.sum(F.size("keys"))).first()[0] or 0
    hot = F.broadcast(seen.where(F.col("times") >= total // 64 // 2000).select("key"))
    lists = Window.partitionBy("key")
    least, low, high = F.min(F.struct("rank", "node")).over(lists), F.min("node").over(lists), F.max("node").over(lists)
    cold = entries.join(hot, "key", "left_anti").select("node", least["node"].alias("hub"), (low != high).alias("several")).where("several").select("hub", "node")
    warm = entries.join(hot, "key")
    first = F.min_by("node", F.shiftleft(F.col("rank").cast("long"), 57).bitwiseOR(F.shiftrightunsigned("node", 7)))
    hubs = staged(warm.groupBy("key").agg(first.alias("hub")), "hot-hubs")  # 2,000 rows at most
    return cold.union(warm.join(F.broadcast(hubs), "key").select("hub", "node")).groupBy("hub", "node").agg(F.count("*").alias("lists"))


def plausible(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) without those that sizes or counts rule out; rows have a, b, n, counts, m, others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (b.column(i).to_pylist() for i in (3, 5))
                n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
                keep = may_be_similar(n, m, narrow(x), narrow(y), similarity)
                for i in np.flatnonzero(keep & (np.minimum(n, m) >= WIDE_SET)).tolist():
                    keep[i] = finer(x[i], y[i], n[i], m[i], similarity)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "n", "counts", "m", "others").mapInArrow(trimmed(run), "a long, b long")


def across(members: DataFrame, info: DataFrame, similarity: float) -> DataFrame:
    """Plausible pairs (a, b) of nodes that share a hub and lie in different components.

    members: hub, node, component.  A hub's members are dealt into blocks of about BLOCK, and every two blocks meet in a
    group of their own, so groups are bounded; only plausible pairs leave them, each node of a smaller component as a.
    """
    open_hubs = members.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low <> high").select("hub", "blocks")
    rows = members.join(open_hubs, "hub").join(info, "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("hub", "node", "component", "n", "counts", "block", other.alias("other"))
    rows = rows.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "counts")

    def pairs(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("n")
        n, component, block = (group[c].to_numpy() for c in ("n", "component", "block"))
        node = group["node"].to_numpy()
        profiles = group["counts"].to_pylist()
        counts = narrow(profiles)
        same_block = group["i"][0].as_py() == group["j"][0].as_py()
        kinds, at = np.unique(component, return_inverse=True)
        weight = np.bincount(at)[at]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in range(len(n)):
            end = np.searchsorted(n, n[x] / similarity + 1e-9, "right")
            if end <= x + 1:
                continue
            y = np.arange(x + 1, end)
            y = y[(component[y] != component[x]) & (same_block | (block[y] != block[x]))]
            y = y[may_be_similar(n[y], n[x], counts[y], counts[x], similarity)] if len(y) else y
            if n[x] >= WIDE_SET:
                y = np.array([i for i in y.tolist() if finer(profiles[x], profiles[i], n[x], n[i], similarity)], np.int64)
            lighter = (weight[y] < weight[x]) | ((weight[y] == weight[x]) & (node[y] < node[x]))
            a.append(np.where(lighter, node[y], node[x]))
            b.append(np.where(lighter, node[x], node[y]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("hub", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def grouped(docs: DataFrame, *, k: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, hash (of the text), n, component of every row (a stored table); rows of one component are linked.  Null without
    words.  What it stores on the way goes as soon as nothing reads it."""
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    keys, times, scanned, sizes = census(texts, k)
    light = boundary(sizes, scanned, similarity)
    rows = staged(node_rows(texts, k, similarity, light, (keys, times)), "nodes")
    hubs = staged(hub_members(rows), "hubs")
    info = rows.where("counts is not null").join(hubs.select("node").distinct(), "node", "left_semi")
    info = staged(info.groupBy("node").agg(F.first("n").alias("n"), F.first("counts").alias("counts")), "info")
    nodes = staged(rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("x")).select("node", "x.doc_id", "x.hash"), "ids")

    hub_pairs = hubs.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"), "lists")
    # by size first, so that fewer rows carry the wide counts
    sized = hub_pairs.join(info.select(F.col("node").alias("a"), "n"), "a").join(info.select(F.col("node").alias("b"), F.col("n").alias("m")), "b")
    sized = sized.where(F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9)
    # a node meets the hubs that it shares most lists with; the second step settles what these leave open
    nearest = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("lists"), "a"))
    sized = sized.withColumn("place", nearest).where(F.col("place") <= FIRST_HUBS)
    pairs = sized.join(info.select(F.col("node").alias("a"), "counts"), "a").join(info.select(F.col("node").alias("b"), F.col("counts").alias("others")), "b")
    first = verified(texts, nodes, staged(plausible(pairs, similarity), "pairs"), k, similarity, "sets")
    groups = components(first, "a", "b", "contracted")
    members = staged(hubs.join(groups, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component")), "members")
    release(groups, hubs)
    second = staged(across(members, info, similarity), "pairs")
    release(members, info)
    second = verified(texts, nodes, second, k, similarity, "sets")
    groups = components(first.union(second), "a", "b", "groups")
    release(first, second, nodes)

    # most nodes are in no link: only the others are looked up
    found = staged(groups.where("node <> component"), "components")
    rows_of = rows.select("doc_id", "hash", "n", "node").join(small(found), "node", "left").select("doc_id", "hash", "n", F.coalesce("component", "node").alias("component"))
    out = staged(rows_of, "grouped")
    release(groups, found, rows)
    return out


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the component's smallest id) of every row; similarity is a whole number of hundredths, over one half."""
    rows = grouped(docs, **options)
    # rows that share their component with others; the rest are their own
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("times")).where("times > 1")
    least = small(staged(least, "component-ids").select("component", "component_id"))
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (nulls last), then text hash; of rows that are
    equal in both, one.  Rows without words all stay."""
    every = grouped(docs, id_column=id_column, text_column=text_column, **options)
    rows = every.where("component is not null")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    best = rows.groupBy("component").agg(F.min(place).alias("best"), F.count("*").alias("times")).where("times > 1")
    best = staged(best.select("component", "best"), "best")
    met = rows.join(small(best), "component").select("doc_id", "hash", (place == F.col("best")).alias("stays"))
    met = staged(met.groupBy("doc_id", "hash").agg(F.max("stays").alias("stays"), F.count("*").alias("times")), "met")
    release(every, best)
    own, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    same = own.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    of = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    kept = docs.join(small(of(met.where("not stays or times > 1"))), same & text.isNotNull(), "left_anti")
    again = small(of(met.where("stays and times > 1")))
    first = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))))
    one = docs.join(again, same & text.isNotNull()).withColumn("__first", first).where("__first = 1")
    return kept.union(one.select(*(F.col(f"`{c}`") for c in docs.columns)))
