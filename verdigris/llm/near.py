"""Operator 11: SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 64 bits: bit i is 1 if more than half the hashes (XXH64, seed 42) of its 3-word shingles,
repeats included, have it.  Fingerprints that differ in `radius` bits at most are linked; components of links are the groups.

Equal fingerprints are one node.  A fingerprint is cut into segments; two that differ in r bits differ in at most
r // segments in one of them.  So a table holds each fingerprint under its value in every segment, each fingerprint
enumerates the Hamming ball of that radius around its own value and fetches what the table holds there, and the distance of
the whole fingerprints decides.  A pair whose values differ is met once only: values are enumerated by their 0 bits, and of
two values that differ by one bit just one has a 0 there.  With two segments of 32 bits a fingerprint asks for about 34
values out of 2**32, so tables of billions of fingerprints answer with few candidates.

Large groups of near copies hold thousands of fingerprints that share a segment's value, and all pairs of them would be
candidates, mostly true ones.  Values that more than `dense` fingerprints share are contracted first: fingerprints that
hold one centre in their balls of radius 1 (on all 64 bits) differ by 2 at most, so all that name a centre are linked to
the smallest of them, 65 rows for each and at most 65 for a centre.  After that a value only matters to fingerprints of
different components, and the component that most of a value's fingerprints belong to meets the others, never itself.  The
links that this leaves out join fingerprints that are in one component anyway.

Defined cases: null, empty and wordless texts have fingerprint 0 and are linked like any other; texts of fewer words are
one shingle; texts of any length are taken whole; repeated rows all come back; ids may be of any type that sorts, and a
null id is a group's smallest only where all are null; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import as_bytes, components, numbered, release, shuffled, slices, spread_join, staged, trimmed

SEED = 42
#: Hashes whose bits are added up at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, k: int = 3) -> np.ndarray:
    """XXH64 of every k words, joined by a space; of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    cuts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends = cuts[min(k, len(words)) - 1 :] - 1
    begins = np.concatenate([[0], cuts])[: len(ends)]
    pieces = map(joined.__getitem__, map(slice, begins.tolist(), ends.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(ends))


def fingerprint(text: bytes, k: int = 3) -> int:
    h = shingle_hashes(text, k)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        counts += np.unpackbits(h[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """key, fp: the 64 bits as a signed integer."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "c1"):
            made = [np.uint64(fingerprint(t, k)) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["c0", "fp"])

    fields = [docs.schema[key], docs.schema[text]]
    out = T.StructType([T.StructField("c0", fields[0].dataType), T.StructField("fp", T.LongType())])
    return numbered(docs, fields).mapInArrow(run, out).select(F.col("c0").alias(key), "fp")


def _value(segment: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", segment * width).bitwiseAND(F.lit((1 << width) - 1))


def _ball(value: Column, width: int, radius: int) -> Column:
    """The values that have up to `radius` more 1 bits than this one: of two values the pair's smaller set asks.  Only
    radius 0 and 1 are met, for more segments than half the radius are taken."""
    own = F.array(value)
    if not radius:
        return own
    free = F.filter(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: value.bitwiseAND(b) == 0)
    return F.concat(own, F.transform(free, lambda b: value.bitwiseOR(b)))


def table(nodes: DataFrame, segments: int) -> DataFrame:
    """nodes with a row for each segment: slot (segment), value."""
    width = 64 // segments
    cells = F.array(*(F.struct(F.lit(s).cast("byte").alias("slot"), _value(s, width).alias("value")) for s in range(segments)))
    return nodes.select("*", F.explode(cells).alias("cell")).select(*nodes.columns, "cell.slot", "cell.value")


def probes(nodes: DataFrame, segments: int, radius: int) -> DataFrame:
    """nodes with a row for each value that they ask for."""
    width = 64 // segments
    each = table(nodes, segments)
    return each.withColumn("value", F.explode(_ball(F.col("value"), width, radius // segments)))


def dense_links(nodes: DataFrame, segments: int, dense: int) -> DataFrame | None:
    """(a, b) that connect what centres connect among the fingerprints of dense values; None where no value is dense."""
    cells = table(nodes.select("fp"), segments)
    often = cells.groupBy("slot", "value").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("slot", "value")
    near = staged(cells.join(shuffled(often, nodes.count()), ["slot", "value"]).select("fp").distinct(), "simhash-dense")
    if near.isEmpty():
        release(near)
        return None
    bits = F.sequence(F.lit(0), F.lit(63))
    flipped = F.transform(bits, lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    named = near.select("fp", F.explode(F.concat(F.array("fp"), flipped)).alias("centre"))
    hubs = named.groupBy("centre").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    out = staged(hubs.select("a", F.explode("all").alias("b")).where("a <> b").distinct(), "simhash-dense-links")
    release(near)
    return out


def links(nodes: DataFrame, segments: int, radius: int) -> DataFrame:
    """(a, b) of fingerprints in other components, at `radius` bits or fewer; nodes: fp, comp."""
    held, n = staged(table(nodes, segments), "simhash-table"), nodes.count()
    cells = ["slot", "value"]
    most = held.groupBy(*cells, "comp").agg(F.count("*").alias("n")).groupBy(*cells).agg(F.max(F.struct("n", "comp")).alias("most"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    most = most.select(*cells, F.col("most.comp").alias("top"), "low", "high")
    asked = probes(nodes, segments, radius).withColumnsRenamed({"fp": "a", "comp": "from"}).join(shuffled(most, 34 * n), cells).where("not (low = high and low = from)")
    asked = staged(asked.select(*cells, "a", "from", "top"), "simhash-asked")
    n = max(n, asked.count())
    answers = held.withColumnsRenamed({"fp": "b", "comp": "to"}).join(shuffled(most.select(*cells, F.col("top").alias("mine")), n), cells)
    few, many = answers.where("to <> mine").drop("mine"), answers.where("to = mine").drop("mine")
    near = (F.col("from") != F.col("to")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    # whoever asks meets the value's few; its most meet only those who are not of them
    found = asked.join(shuffled(few, n), cells).where(near).select("a", "b").union(asked.where("from <> top").join(shuffled(many, n), cells).where(near).select("a", "b"))
    out = staged(found.distinct(), "simhash-links")
    release(held, asked)
    return out


def grouped(rows: DataFrame, key: str = "doc_id", radius: int = 3, segments: int = 2, dense: int = 32) -> DataFrame:
    """key, fp, component_id of rows (key, fp; a stored table).  `segments` is chosen so that radius // segments is 0 or 1."""
    if segments < 2 or 64 % segments or radius // segments > 1:
        raise ValueError("segments must be at least 2, divide 64 and be more than half the radius")
    nodes = staged(rows.groupBy("fp").agg(F.min(F.col(f"`{key}`")).alias("id"), F.count("*").alias("times")), "simhash-nodes")
    plain, n = nodes.select("fp", F.col("fp").alias("comp")), nodes.count()
    first = dense_links(nodes, segments, dense) if radius >= 2 else None
    if first is None:
        found = links(plain, segments, radius)
        made = [found]
    else:
        roots = components(first, "a", "b", "simhash-dense-components")
        known = staged(nodes.select("fp").join(shuffled(roots, n), nodes.fp == roots.node, "left").select("fp", F.coalesce("component", "fp").alias("comp")), "simhash-known")
        more = links(known, segments, radius)
        found, made = first.union(more), [first, more, known]
    whole = components(found, "a", "b", "simhash-components")
    comp = staged(nodes.join(shuffled(whole, n), nodes.fp == whole.node, "left").select("fp", "id", "times", F.coalesce("component", "fp").alias("comp")), "simhash-comp")
    least = comp.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("times"))
    least = staged(least, "simhash-least")
    by_fp = staged(spread_join(comp.withColumnRenamed("times", "rows_of"), least, "comp").select("fp", F.col("rows_of").alias("times"), "component_id"), "simhash-by-fp")
    release(nodes, comp, least, *made)
    return spread_join(rows, by_fp, "fp").select(F.col(f"`{key}`"), "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, segments: int = 2) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (the smallest key reachable by links, its own included)."""
    rows = staged(fingerprints(docs, key, text), "simhash-fingerprints")
    return grouped(rows, key, radius, segments).select(F.col(f"`{key}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
