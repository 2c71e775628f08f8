"""Operator 5: LM scoring with Brown's class-based n-grams.

log10 P(text) = Σ log10 P(class | class before) + log10 P(member | class) [+ log10 P(word | signature)], from the end token
before the text to the end token after it.

Classes come from exchange clustering in two levels.  The `head` most frequent words, and all other words by signature (a
hash of the last three bytes into 512), are units; on the table of unit bigrams each unit in turn moves to the class that
raises the likelihood of the corpus's class bigrams most, until none moves.  Then every other word of the vocabulary, by
the units before and after each of its occurrences, is held against the table of class bigrams and moves to its best class,
in a distributed pass; the table is counted again from the whole corpus, and so on for `sweeps` passes.  The vocabulary
grows with the input: all words that occur twice, up to `vocabulary` words, the most frequent first.  The others (words that
occur once, and those that were never seen) are the members of their signature's class together; within a signature an
absolute discount (from the counts of counts) leaves its share to words that were never seen.

What is gathered: counts of all words, of all bigrams of units and of classes, and the contexts of all vocabulary words,
from every training text; tasks count first, the sums are shuffled.  The driver gets the vocabulary's hashes, counts and
classes (11 bytes a word), which go to all tasks, and tables of units and classes; counts of all other words are joined by a
shuffle.  Words are told apart by 64-bit hashes.

Defined cases: a null or wordless text is the end token alone; texts of any length are taken whole; null ids are never held
out; repeated rows count again; words of one frequency follow each other by their hashes, a move needs a gain; nothing to
learn from: every token is unknown; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import HashIndex, holds, mix, slices, span_hashes, staged, text_bytes, trim, trimmed, word_spans

#: Stands for the end token among the words' hashes.
END = 0
SIGNATURES = 512
#: Distinct words that a task counts, and contexts that it holds, before it hands them on.
HELD_WORDS, HELD_CONTEXTS = 1_000_000, 4_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its text's number, its hash and its signature, in order; without the ends."""
    data, cuts = text_bytes(pc.fill_null(texts, ""))
    low = _LOWER[data]
    begin, end = word_spans(~_SPACE[data], cuts)
    h = span_hashes(low, begin, end)
    h[h == END] = 1
    last = [np.where(end - begin > k, low[np.maximum(end - 1 - k, 0)], 0).astype(np.uint64) for k in range(3)]
    signature = mix(last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)) % np.uint64(SIGNATURES)
    return np.searchsorted(cuts, begin, "right") - 1, h, signature.astype(np.int16)


def with_ends(rows: np.ndarray, own: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """`own` of the words of n texts in a row, with `end` after each text; and the text of each."""
    out = np.full(len(rows) + n, end, np.int64)
    out[np.arange(len(rows)) + rows] = own
    return out, np.repeat(np.arange(n), np.bincount(rows, minlength=n) + 1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, at, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    return h, np.concatenate([p[1] for p in parts])[at], np.bincount(inverse, np.concatenate([p[2] for p in parts])).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """h, sig, n over all rows of texts (text); the end token counts once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("lm")
        held, size, ends = [], 0, 0

        def batch(h: np.ndarray, sig: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sig, pa.int16()), pa.array(n, pa.int64())], names=["h", "sig", "n"])

        for b in slices(batches):
            _, h, sig = tokens(b.column(0))
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((h, sig[at], n))
            size, ends = size + len(h), ends + b.num_rows
            if size > 2 * HELD_WORDS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD_WORDS:
                    yield batch(*held.pop())
                    size = 0
        if held:
            yield batch(*_summed(held))
        if ends:
            yield batch(np.array([END], np.uint64), np.zeros(1, np.int16), np.array([ends]))

    return texts.select("text").mapInArrow(trimmed(count), "h long, sig short, n long").groupBy("h").agg(F.max("sig").alias("sig"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Words by hash: counts, units (head words first, then signatures, then the end) and classes."""

    keys: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    heads: int
    own: np.ndarray | None = None  # by word
    classes: np.ndarray | None = None  # by unit

    @property
    def end(self) -> int:
        return self.heads + SIGNATURES

    @property
    def units(self) -> int:
        return self.end + 1

    def class_of(self, place: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Classes of words by their place (−1: not among the vocabulary's) and signature."""
        return np.where(place >= 0, self.own[place] if len(self.own) else 0, self.classes[self.heads + sig])


def unit_bigrams(texts: DataFrame, vocabulary: Vocabulary, parts: int) -> tuple[np.ndarray, DataFrame]:
    """How often a unit follows another in all texts, an end standing before each; and the contexts of the vocabulary's words
    that are no head words: rows of (words, cuts, before, after), binary arrays, with all of a word in one row."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)
    size = vocabulary.units

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = held.value, np.zeros(size * size, np.int32)
        index, contexts, many = HashIndex(v.keys), [], 0
        names = ["part", "unit", "data"]

        def handed() -> Iterator[pa.RecordBatch]:
            word, before, after = (np.concatenate(x) for x in zip(*contexts, strict=True))
            order = np.argsort(word, kind="stable")
            word, before, after = word[order], before[order], after[order]
            cuts = np.searchsorted(word, np.arange(parts + 1) * (len(v.keys) / parts))
            cuts[-1] = len(word)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[i], cuts[i + 1]
                data = word[a:b].astype(np.int32).tobytes() + before[a:b].astype(np.uint16).tobytes() + after[a:b].astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([-1], pa.int32()), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary()), pa.array([len(data)], pa.int64())], names=[*names, "size"])

        for b in slices(batches):
            rows, h, sig = tokens(b.column(0))
            place = index.of(h)
            unit = np.where(place >= 0, v.unit[place] if len(v.unit) else 0, v.heads + sig)
            seq, _ = with_ends(rows, unit, b.num_rows, v.end)
            before = np.concatenate([[v.end], seq[:-1]])
            keys, n = np.unique(before * size + seq, return_counts=True)
            table[keys] += n.astype(np.int32)
            at = np.flatnonzero((place >= 0) & (unit >= v.heads))
            spot = at + rows[at]
            contexts.append((place[at], before[spot].astype(np.uint16), seq[spot + 1].astype(np.uint16)))
            many += len(at)
            if many > HELD_CONTEXTS:
                yield from handed()
                contexts, many = [], 0
        if many:
            yield from handed()
        table = table.reshape(size, size)
        some = np.flatnonzero(table.any(1))
        rows = [zlib.compress(table[i].astype(np.int64).tobytes(), 1) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), -1), pa.int32()), pa.array(some, pa.int32()), pa.array(rows, pa.binary()), pa.array(np.zeros(len(some), np.int64))], names=[*names, "size"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of equal units follow each other; only a sum is held."""
        unit, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["unit", "row"])

        for b in batches:
            for u, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if u != unit:
                    if total is not None:
                        yield done()
                    unit, total = u, np.zeros(size, np.int64)
                total += np.frombuffer(zlib.decompress(row), np.int64)
        if total is not None:
            yield done()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of equal parts follow each other; a part, which is bounded by the number of parts, is held."""
        part, blocks = None, []

        def done() -> pa.RecordBatch:
            word, before, after = (np.concatenate(x) for x in zip(*blocks, strict=True))
            order = np.argsort(word, kind="stable")
            word = word[order]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            cols = [word[first], np.append(first, len(word)).astype(np.int32), before[order], after[order]]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["words", "cuts", "before", "after"])

        for b in batches:
            for p, data, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part and blocks:
                    yield done()
                    blocks = []
                part, k = p, n // 8
                raw = np.frombuffer(pa.decompress(data, n, "zstd", asbytes=True), np.uint8)
                blocks.append((raw[: 4 * k].view(np.int32), raw[4 * k : 6 * k].view(np.uint16), raw[6 * k :].view(np.uint16)))
        if blocks:
            yield done()

    made = staged(texts.select("text").mapInArrow(trimmed(count), "part int, unit int, data binary, size long"), "contexts")
    rows = made.where("unit >= 0").select("unit", F.col("data").alias("row"))
    out = np.zeros((size, size))
    for r in rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(trimmed(add), "unit int, row binary").collect():  # a row for each unit
        out[r.unit] = np.frombuffer(zlib.decompress(r.row), np.int64)
    blocks = made.where("part >= 0").select("part", "data", "size").repartition("part").sortWithinPartitions("part")
    return out, staged(blocks.mapInArrow(trimmed(merge), "words binary, cuts binary, before binary, after binary"), "word-contexts")


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """A class for each unit; the last unit (the end) keeps the last class to itself.  Every move raises the likelihood, so
    the sweeps end."""
    n, b = len(bigrams), bigrams.astype(float, copy=False)
    weight = b.sum(0) + b.sum(1)
    own = np.zeros(n, np.int64)
    order = [int(i) for i in np.argsort(-weight, kind="stable") if i != n - 1 and weight[i]]
    own[order] = np.arange(len(order)) % (classes - 1)
    own[n - 1] = classes - 1
    z = np.zeros((n, classes))
    z[np.arange(n), own] = 1
    after, before = b @ z, b.T @ z  # by unit: the classes that follow it, and that come before it
    table = z.T @ after
    diagonal = np.arange(classes)
    moved = 1
    while moved:
        moved = 0
        for w in order:
            k, twice = own[w], b[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[k] -= twice
            left[k] -= twice
            table[k] -= right
            table[:, k] -= left
            table[k, k] -= twice
            rows, cols = table.sum(1), table.sum(0)
            gain = (_phi(table + right) - _phi(table)).sum(1) + (_phi(table.T + left) - _phi(table.T)).sum(1)
            cell = table[diagonal, diagonal]
            gain += _phi(cell + right + left + twice) - _phi(cell + right) - _phi(cell + left) + _phi(cell)
            gain -= _phi(rows + right.sum() + twice) - _phi(rows) + _phi(cols + left.sum() + twice) - _phi(cols)
            gain[classes - 1] = -np.inf
            to = int(gain.argmax())
            if gain[to] <= gain[k] + 1e-6:
                to = int(k)
            table[to] += right
            table[:, to] += left
            table[to, to] += twice
            if to != k:
                moved += 1
                own[w] = to
                after[:, k] -= b[:, w]
                after[:, to] += b[:, w]
                before[:, k] -= b[w]
                before[:, to] += b[w]
    return own


def best_classes(contexts: DataFrame, vocabulary: Vocabulary, table: np.ndarray) -> np.ndarray:
    """The vocabulary's classes after every word that is no head word moved to the class of the largest likelihood."""
    k = len(table)
    log = np.log(table + 0.5)
    share = np.log(table.sum(1) + 0.5 * k) + np.log(table.sum(0) + 0.5 * k)
    held = contexts.sparkSession.sparkContext.broadcast((vocabulary.classes, log, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, log, share = held.value
        for b in batches:
            for words, cuts, before, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, cuts = np.frombuffer(words, np.int32), np.frombuffer(cuts, np.int32)
                at = np.repeat(np.arange(len(words)), np.diff(cuts)) * k
                count = lambda units: np.bincount(at + classes[np.frombuffer(units, np.uint16)], minlength=len(words) * k).reshape(-1, k)
                gain = count(after) @ log.T + count(before) @ log - np.diff(cuts)[:, None] * share
                gain[:, k - 1] = -np.inf  # the end's own
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(gain.argmax(1), pa.int16())], names=["word", "class"])

    found = contexts.mapInArrow(trimmed(run), "word int, class short").toArrow()  # a row for each word of the vocabulary
    own = vocabulary.own.copy()
    own[found["word"].to_numpy()] = found["class"].to_numpy()
    return own


def class_bigrams(texts: DataFrame, vocabulary: Vocabulary, classes: int) -> np.ndarray:
    """How often a class follows another in all texts, an end standing before each."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = held.value, np.zeros(classes * classes, np.int64)
        index = HashIndex(v.keys)
        for b in slices(batches):
            rows, h, sig = tokens(b.column(0))
            seq, _ = with_ends(rows, v.class_of(index.of(h), sig), b.num_rows, classes - 1)
            table += np.bincount(np.concatenate([[classes - 1], seq[:-1]]) * classes + seq, minlength=classes * classes)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(table[some])], names=["cell", "n"])

    out = np.zeros(classes * classes, np.int64)
    for r in texts.select("text").mapInArrow(trimmed(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # classes squared
        out[r.cell] = r.n
    return out.reshape(classes, classes)


@dataclass
class Model:
    vocabulary: Vocabulary
    ends: int
    tokens: int
    distinct: int
    discount: float
    transition: np.ndarray  # log10 P(class | class before)
    mass: np.ndarray  # by class: log10 of what its members' counts, each with one half added, add up to
    rare: np.ndarray  # by signature: tokens of counted words beyond the vocabulary
    kinds: np.ndarray  # by signature: distinct ones
    counts: DataFrame | None = None  # of these words

    def unit_emission(self) -> np.ndarray:
        """log10 P(signature | class), by signature."""
        c = self.vocabulary.classes[self.vocabulary.heads : self.vocabulary.end]
        return np.log10(self.rare + 0.5) - self.mass[c]

    def seen(self) -> np.ndarray:
        """log10 of a signature's tokens, 0 for none."""
        return np.log10(np.maximum(self.rare, 1))

    def unseen(self) -> np.ndarray:
        """log10 of what a signature's discounts add up to; all of it where there is nothing to discount."""
        return np.log10(np.where(self.rare > 0, self.discount * self.kinds, 1))


def learn(texts: DataFrame, *, head: int = 2000, classes: int = 64, vocabulary: int = 1_000_000, sweeps: int = 2) -> Model:
    """From all rows of texts (text)."""
    counts = staged(word_counts(texts), "word-counts")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(((F.col("n") == 1) & (F.col("h") != END)).cast("long")), F.lit(0)).alias("once"), F.coalesce(F.sum(((F.col("n") == 2) & (F.col("h") != END)).cast("long")), F.lit(0)).alias("twice"), F.coalesce(F.sum(F.when(F.col("h") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    level = F.floor(F.log2("n") * 16).cast("int")
    words = counts.where(F.col("h") != END)
    least, held = 1 << 30, 0
    for r in words.where("n > 1").groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # some hundred levels
        if held + r.n > vocabulary:
            break
        least, held = r.level, held + r.n
    inside = (F.col("n") > 1) & (level >= least)
    found = words.where(inside).select("h", "sig", "n").toArrow()  # `vocabulary` words at most
    keys, sig, n = found["h"].to_numpy().view(np.uint64), found["sig"].to_numpy().astype(np.int64), found["n"].to_numpy()
    order = np.argsort(keys)
    keys, sig, n = keys[order], sig[order], n[order]
    del found, order
    first = np.lexsort((keys, -n))[:head]
    unit = len(first) + sig
    unit[first] = np.arange(len(first))
    v = Vocabulary(keys, n, unit.astype(np.int32), len(first))

    rare, kinds = np.zeros(SIGNATURES), np.zeros(SIGNATURES)
    for r in words.where(~inside).groupBy("sig").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # a row for each signature
        rare[r.sig], kinds[r.sig] = r.n, r.k
    bigrams, contexts = unit_bigrams(texts, v, max(8, int(total.n) // 1_000_000))
    v.classes = exchange(bigrams, classes)
    v.own = v.classes[v.unit].astype(np.uint8)
    z = np.zeros((v.units, classes))
    z[np.arange(v.units), v.classes] = 1
    table = z.T @ (bigrams @ z)
    del bigrams
    trim()
    for _ in range(sweeps if len(keys) > len(first) else 0):
        v.own = best_classes(contexts, v, table)
        table = class_bigrams(texts, v, classes)

    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * classes)
    transition = np.log10((table + 5 * share) / (table.sum(1, keepdims=True) + 5))
    mass = np.bincount(v.own, n + 0.5, classes) + np.bincount(v.classes[v.heads : v.end], rare + 0.5, classes)
    mass[classes - 1] = 1  # the end is its class's one member
    discount = (total.once + 0.5) / (total.once + 2 * total.twice + 1)  # between 0 and 1
    return Model(v, int(total.ends), int(total.n), int(total.v), float(discount), transition, np.log10(np.maximum(mass, 1e-300)), rare, kinds, words.where(~inside).select("h", "n"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, held_out) → doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    counts, model.counts = model.counts, None
    held = docs.sparkSession.sparkContext.broadcast(model)
    model.counts = counts
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        holds("lm")
        m, row = held.value, TaskContext.get().partitionId() << 33
        v, floor = m.vocabulary, np.log10(m.tokens + m.distinct + 1)
        index, last = HashIndex(v.keys), len(m.transition) - 1
        word = np.log10(v.n + 0.5) - m.mass[v.own]
        group = m.unit_emission() - m.seen()
        unseen = m.unseen()
        base_of = np.log10(v.n + 1)
        for b in slices(batches):
            k = b.num_rows
            rows, h, sig = tokens(b.column(1))
            place = index.of(h)
            inside = place >= 0
            emission = np.where(inside, word[place] if len(word) else 0, group[sig])
            seq, text = with_ends(rows, v.class_of(place, sig), k, last)
            step = m.transition[np.concatenate([[last], seq[:-1]]), seq]
            total = np.bincount(text, step, k) + np.bincount(rows, emission, k)
            size = np.bincount(text, minlength=k)
            base = np.bincount(rows, np.where(inside, base_of[place] if len(word) else 0, 0), k) + np.log10(m.ends + 1) - size * floor
            known = np.bincount(rows[inside], minlength=k).astype(np.int64) + (m.ends > 0)
            # the other words' counts are joined: each once for a text
            out = np.flatnonzero(~inside)
            order = out[np.lexsort((h[out], rows[out]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]])
            at = np.flatnonzero(fresh)
            one = order[at]
            cuts = pa.array(np.searchsorted(rows[one], np.arange(k + 1)), pa.int32())
            lists = [pa.array(h[one].view(np.int64)), pa.array(np.diff(np.append(at, len(order)))), pa.array(unseen[sig[one]])]
            rare = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(lists, names=["h", "times", "unseen"]))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(k)), b.column(0), b.column(2), pa.array(size), pa.array(known), pa.array(base), pa.array(total), rare], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "total", "rare"])
            row += k

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, total double, rare array<struct<h: long, times: long, unseen: double>>"
    part = staged(docs.select("doc_id", "text", "held_out").mapInArrow(trimmed(run), schema), "text-scores")
    rare = part.where("size(rare) > 0").select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.times", "r.unseen")
    met = rare.join(counts, "h", "left")
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known_more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times") * F.log10(F.col("n") + 1)).otherwise(0)).alias("base_more"),
        F.sum(F.col("times") * F.when(F.col("n").isNotNull(), F.log10(F.col("n") - model.discount)).otherwise(F.col("unseen"))).alias("total_more"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = part.drop("rare").join(more, "row", "left")
    total = F.col("total") + zero("total_more")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("known_more")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("base_more")).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))
