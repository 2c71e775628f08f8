"""Near-duplicates by MinHash candidates, exact verification and connected components; containment of stated texts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import similarity
from verdigris.sources.staging import release, shared


def labelled(nodes: DataFrame, links: DataFrame, key: str, most: int = 60) -> DataFrame:
    """nodes with component, the smallest key reachable by links (a, b); a row without links is its own.

    Each round every linked row takes the smallest label among its own and its neighbours', then that label's own label, so
    rounds grow with the logarithm of a component's length; a written table ends each round's lineage and replaces the last."""
    both = shared(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = shared(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    for _ in range(most):
        heard = both.join(now, both.b == now.id).groupBy("a").agg(F.min("c").alias("m"))
        new = now.join(heard, now.id == heard.a).select("id", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        jump = now.select(F.col("id").alias("c"), F.col("c").alias("j"))
        new = shared(new.join(jump, "c").select("id", F.least("c", "j").alias("c"), "was"), "labels")
        release(now)
        now = new
        if now.where("c <> was").isEmpty():
            release(both)
            return nodes.join(now.select(F.col("id").alias(key), F.col("c").alias("component")), key, "left").withColumn("component", F.coalesce("component", key))
    raise RuntimeError("components did not settle")


def similar_sets(docs: DataFrame, pairs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Those of the pairs (a, b; a stored table) whose byte 5-grams have that Jaccard similarity, stored."""
    needed = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
    texts = shared(docs.select(key, text).join(needed, key, "left_semi"), "texts")
    side = lambda of, name: texts.select(F.col(key).alias(of), F.col(text).alias(name)).hint("merge")  # noqa: E731  # broadcast, they leave the pairs to a few tasks
    rows = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    out = shared(similarity.alike_texts(rows, threshold), "links")
    release(texts, pairs)
    return out


def lexical_links(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Links (stored) whose components are those of all pairs that share a MinHash band and have the similarity.

    Rows of equal sets are one node.  First each node is held against the smallest node of its buckets.  Then only buckets
    whose nodes this leaves in different components matter: their nodes meet within the bucket, and of these pairs only
    those whose sizes and sketches allow the similarity become candidates, so a bucket of thousands of unlike rows gives few.
    Candidates of both steps are verified on whole sets."""
    profiled = shared(similarity.profiles(docs, key, text), "profiles")
    nodes, copies = similarity.distinct_sets(profiled, key)
    cells = shared(similarity.cells(nodes, key), "cells")
    hubs = cells.groupBy("band", "hash").agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "hash", "a")
    stars = cells.join(hubs, ["band", "hash"]).where(F.col("a") < F.col(key)).select("a", F.col(key).alias("b")).distinct()
    side = lambda p: nodes.select(F.col(key).alias(p), F.col("size").alias(f"{p}_size"), F.col("sketch").alias(f"{p}_sketch"))
    stars = shared(stars.join(side("a"), "a").join(side("b"), "b").where(similarity.may_be_alike("a_", "b_", threshold)).select("a", "b"), "stars")
    first = similar_sets(docs, stars, key, text, threshold)
    found = labelled(nodes.select(key, "size", "sketch"), first, key).withColumnRenamed("component", "comp")
    found = shared(found, "first-components")
    of_cell = cells.join(found.select(key, "comp"), key)
    still = of_cell.groupBy("band", "hash").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("band", "hash")
    rows = shared(cells.join(still, ["band", "hash"]).join(found, key), "open-rows")
    across = similar_sets(docs, shared(similarity.met(rows, key, threshold), "across"), key, text, threshold)
    out = shared(copies.union(first).union(across), "lexical-links")
    release(profiled, nodes, cells, found, rows, first, across)
    return out


def collapse(docs: DataFrame, key: str, text: str, threshold: float = 0.8, *, embedder=None, vectors: DataFrame | None = None, cosine: float = 0.92) -> DataFrame:
    """key, component, representative (the row of a component with the smallest hash), marginal.

    Candidates share a MinHash band; the exact Jaccard of their byte 5-grams decides.  With vectors (key, embedding), or
    an embedder (texts → matrix) that makes them, rows of that cosine or more are linked too; `marginal` says that a row
    is removed by these links alone."""
    from verdigris.operators import extend

    lexical = lexical_links(docs, key, text, threshold)
    best = F.min(F.struct(F.xxhash64(key), F.col(key).alias("k")))["k"]

    def kept(links: DataFrame) -> DataFrame:
        out = labelled(docs.select(key), links, key)
        return out.join(out.groupBy("component").agg(best.alias("representative")), "component").select(key, "component", "representative")

    if vectors is None and embedder is None:
        return kept(lexical).withColumn("marginal", F.lit(False))
    vectors = shared(extend.encoded(docs, key, text, embedder), "vectors") if vectors is None else vectors
    links = similarity.cosine_pairs(vectors.select(F.col(key), F.col(vectors.columns[1]).alias("v")), key, "v", cosine, forest=True)
    alone = kept(lexical).select(key, (F.col(key) == F.col("representative")).alias("before"))
    return kept(lexical.union(links)).join(alone, key).select(key, "component", "representative", (F.col("before") & (F.col(key) != F.col("representative"))).alias("marginal"))


def write_collapsed(rows: DataFrame, key: str, text: str, path: str, **options) -> dict[str, int]:
    """Writes one row of each group to path/rows and, beside it, statistics of the same pass: rows seen and kept, and those
    removed by kind (`lexical`, or `marginal`: by vectors alone).  rows: key is unique."""
    from pyspark.sql import Observation

    from verdigris.sources.files import write_text

    found = collapse(rows.select(key, text), key, text, **options).select(key, (F.col(key) == F.col("representative")).alias("__kept"), F.col("marginal").alias("__marginal"))
    seen = Observation("collapse")
    gone = ~F.col("__kept")
    counts = {"rows": F.count("*"), "kept": F.count_if("__kept"), "lexical": F.count_if(gone & ~F.col("__marginal")), "marginal": F.count_if(gone & F.col("__marginal"))}
    rows.join(found, key).observe(seen, *(c.alias(n) for n, c in counts.items())).where("__kept").drop("__kept", "__marginal").write.mode("overwrite").parquet(f"{path}/rows")
    stats = {n: int(seen.get[n]) for n in counts}
    write_text(rows.sparkSession, f"{path}/stats.json", json.dumps(stats, sort_keys=True))
    return stats


#: (bytes of a gram, grams of a window) by the least length of an item that they serve.
WINNOW = {64: (32, 33), 16: (8, 9)}


def winnowed(df: DataFrame, key: str, text: str, k: int, w: int, first: bool = False) -> DataFrame:
    """key, fp: the smallest hash of each w consecutive k-byte grams, so that two texts with w + k − 1 bytes in common share
    one; `first`: that of the first window alone.  Shorter texts have none."""
    import numpy as np
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()
    odd = np.uint64(0x9E3779B97F4A7C15)

    def of(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
        if first:
            raw = raw[: w + k - 1]
        n = len(raw) - k + 1
        if n < w:
            return np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * odd + raw[i : i + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        step, low = 1, h  # the minimum over w places from minima over powers of two
        while step * 2 <= w:
            low, step = np.minimum(low[:-step], low[step:]), step * 2
        rest = w - step
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        return np.unique(low).view(np.int64)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a text at a time bounds what is held
                fps = of(b.column(1)[i].as_py() or "")
                if len(fps):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(fps), i))), pa.array(fps)], names=[key, "fp"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, fp long")


def contained(items: DataFrame, item: str, item_text: str, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Items whose whole text stands in some document; empty and null items don't.

    An item has one fingerprint, that of its first window; a document has that of each window, so it has the item's wherever
    it holds the item's text.  Fingerprints join, and `contains` decides on the texts of the pairs that this leaves; of
    documents of equal text one is asked."""
    length, out = F.octet_length(item_text), None
    texts = docs.where(F.col(text).isNotNull()).groupBy(F.xxhash64(text).alias("h"), F.octet_length(text).alias("n")).agg(F.min(doc).alias(doc)).select(doc)
    once = shared(docs.select(doc, text).join(texts, doc), "distinct-texts")
    short = [r.n for r in items.select(length.alias("n")).where(f"n > 0 and n < {min(WINNOW)}").distinct().collect()]
    for least, (k, w) in {**WINNOW, **{n: (n, 1) for n in short}}.items():  # shorter items ask for all grams of their length
        most = least + 1 if w == 1 else min((x for x in WINNOW if x > least), default=1 << 40)
        asked = items.where((length >= least) & (length < most)).select(item, item_text)
        fps = shared(winnowed(asked, item, item_text, k, w, first=True), "item-fingerprints")
        if fps.isEmpty():
            continue
        pairs = winnowed(once, doc, text, k, w).join(fps, "fp").select(item, doc).distinct()
        met = pairs.join(asked.select(item, F.col(item_text).alias("__asked")), item).join(once.select(doc, F.col(text).alias("__held")), doc)
        found = met.where(F.contains("__held", "__asked")).select(item).distinct()
        out = found if out is None else out.union(found)
    return shared(out if out is not None else items.select(item).where("false"), "contained")
