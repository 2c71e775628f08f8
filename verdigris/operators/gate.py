"""The lexical gate: TF-IDF over a vocabulary of words and character grams with a balanced logistic regression; temperature
scaling.

Two blocks of features: words of two letters or more with their pairs, and character grams of 3 to 5 within words (a space
stands for either border).  A gram needs `min_df` texts; of character grams the most frequent are kept.  A text's weight for
a gram is (1 + ln tf)·idf with idf = ln((1 + n) / (1 + df)) + 1, and each block is scaled to length 1.  The vocabulary, with
document frequencies and places, is a stored table of bounded size; it is counted by a shuffle of grams that tasks have
already summed up over their texts, and is broadcast to where texts are read, so that a text's grams stay in its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from verdigris.sources.staging import release, shared

WORD, CHAR = 0, 1


#: Grams that a task counts before it passes them on, and entries of texts that it holds before it sums them up.
TALLY, HELD = 1 << 19, 1 << 20
#: Letters that have a number; grams with others, and only these, are looked up as strings.
LETTERS = 4095
ONE, TWO, SHIFT = 1 << 60, 1 << 61, 30


class Numbered(dict):
    """Numbers keys from 0 as they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Keys:
    """Grams as integers: three to five letters of 12 bits each; ONE and a word's number; TWO and the numbers of a pair of
    words; negative ones for character grams with a letter beyond the first `LETTERS`.  A frozen one has no new grams."""

    def __init__(self, words: dict[str, int], rare: dict[str, int], letters: str = "", frozen: bool = False):
        self.words, self.rare, self.letters, self.frozen = words, rare, letters, frozen
        self.number = np.zeros(0x110000, np.uint16)  # of each code point, from 1; 0 has none
        self.number[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)

    def learn(self, codes: np.ndarray) -> None:
        for x in np.unique(codes)[: LETTERS - len(self.letters)].tolist():
            self.letters += chr(x)
            self.number[x] = len(self.letters)

    def packed(self, gram: str) -> int | None:
        """None: a letter has no number."""
        out = 0
        for x in gram:
            if not (n := int(self.number[ord(x)])):
                return None
            out = out << 12 | n
        return out

    def of(self, text: str | None) -> np.ndarray:
        """With repeats.  A character gram begins and ends where its word does, a blank before and after, or within it."""
        text = (text or "").lower()
        words, rest = re.findall(r"\b\w\w+\b", text), text.split()
        a = np.fromiter((self.words.get(w, -1) for w in words) if self.frozen else map(self.words.__getitem__, words), np.int64, len(words))
        out = [ONE | a[a >= 0], (TWO | a[:-1] << SHIFT | a[1:])[(a[:-1] >= 0) & (a[1:] >= 0)]]
        codes = np.frombuffer(f" {' '.join(rest)} ".encode("utf-32-le"), np.uint32)
        c = self.number[codes].astype(np.int64)
        if not c.all() and not self.frozen and len(self.letters) < LETTERS:
            self.learn(codes[c == 0])
            c = self.number[codes].astype(np.int64)
        within, known, key = codes != 32, c > 0, c[:-1] << 12 | c[1:]
        inner, every = np.ones(len(key), bool), known[:-1] & known[1:]
        for n in (3, 4, 5):
            key, inner, every = key[:-1] << 12 | c[n - 1 :], inner[:-1] & within[n - 2 : -1], every[:-1] & known[n - 1 :]
            out.append(key[inner & every])
        if not c.all() and not (self.frozen and not self.rare):
            grams = (g for w in rest for p in [f" {w} "] for n in (3, 4, 5) for i in range(len(p) - n + 1) if self.packed(g := p[i : i + n]) is None)
            found = (self.rare.get(g, -1) if self.frozen else self.rare[g] for g in grams)
            out.append(np.array([-1 - n for n in found if n >= 0], np.int64))
        return np.concatenate(out)

    def grams(self, keys: np.ndarray) -> list[str]:
        """Of ascending keys of character grams, the rare ones first."""
        rare, by_number = list(self.rare), "\0" + self.letters
        out = [rare[-1 - k] for k in keys[keys < 0].tolist()]
        codes = np.array([ord(x) for x in by_number], np.uint32)
        packed = keys[keys >= 0]
        for n in (3, 4, 5):
            part = packed[(packed >= 1 << 12 * (n - 1)) & (packed < 1 << 12 * n)]
            text = codes[np.stack([part >> 12 * (n - 1 - i) & 4095 for i in range(n)], 1)].tobytes().decode("utf-32-le")
            out += [text[i : i + n] for i in range(0, len(text), n)]
        return out


class Tally:
    """In how many texts grams stand and how often."""

    def __init__(self):
        self.keys, self.parts, self.held, self.distinct = Keys(Numbered(), Numbered()), [], 0, 0

    def add(self, text: str | None) -> None:
        keys, total = np.unique(self.keys.of(text), return_counts=True)
        self.parts.append((keys, np.ones(len(keys), np.int64), total))
        self.held += len(keys)
        if self.held >= HELD:
            self.sum_up()

    def sum_up(self) -> None:
        keys, at = np.unique(np.concatenate([k for k, _, _ in self.parts]), return_inverse=True)
        df, total = (np.bincount(at, np.concatenate([x[i] for x in self.parts]), len(keys)).astype(np.int64) for i in (1, 2))
        self.parts, self.held, self.distinct = [(keys, df, total)], 0, len(keys)

    def batch(self) -> pa.RecordBatch:
        self.sum_up()
        keys, df, total = self.parts[0]
        words = pa.array(list(self.keys.words), pa.string())
        chars, single = np.searchsorted(keys, [ONE, TWO]).tolist()
        two = keys[single:] - TWO
        two = pc.binary_join_element_wise(words.take(pa.array(two >> SHIFT)), words.take(pa.array(two & (1 << SHIFT) - 1)), " ")
        gram = pa.concat_arrays([pa.array(self.keys.grams(keys[:chars]), pa.string()), words.take(pa.array(keys[chars:single] - ONE)), two])
        return pa.RecordBatch.from_arrays([pa.array(np.where(keys < ONE, CHAR, WORD), pa.int32()), gram, pa.array(df), pa.array(total)], names=["block", "gram", "df", "total"])


def tallied(rows: DataFrame, text: str) -> DataFrame:
    """block, gram, df, total: in how many texts a gram stands and how often, summed up in parts where the texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for b in batches:
            for x in b.column(0):
                held.add(x.as_py())
                if held.distinct >= TALLY:
                    yield held.batch()
                    held = Tally()
        if held.parts:
            yield held.batch()

    return rows.select(text).mapInArrow(run, "block int, gram string, df long, total long")


def vocabulary(tallies: DataFrame, texts: int, word_min_df: int, char_min_df: int, most: tuple[int, int]) -> DataFrame:
    """block, gram, place, idf (stored): of each block the `most` frequent grams of enough texts, ties by gram, in the order of
    block and gram."""
    enough = F.when(F.col("block") == WORD, word_min_df).otherwise(char_min_df)
    found = shared(tallies.groupBy("block", "gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= enough), "grams")
    kept = [found.where(F.col("block") == k).orderBy(F.desc("total"), "gram").limit(most[k]) for k in (WORD, CHAR)]
    idf = F.log((1.0 + texts) / (1.0 + F.col("df"))) + 1
    place = F.row_number().over(Window.orderBy("block", "gram")) - 1  # of the bounded vocabulary
    out = shared(kept[WORD].union(kept[CHAR]).select("block", "gram", place.alias("place"), idf.alias("idf")), "vocabulary")
    release(found)
    return out


class Places:
    """The places of a vocabulary's grams in a text."""

    def __init__(self, table: pa.Table):
        def of(kept: pa.Array) -> tuple[pa.Array, np.ndarray]:
            part = table.filter(kept)
            return pa.concat_arrays([pa.array([], pa.string()), *part["gram"].cast(pa.string()).chunks]), part["place"].to_numpy().astype(np.int64)

        word = pc.equal(table["block"], WORD)
        pair = pc.and_(word, pc.greater_equal(pc.find_substring(table["gram"], " "), 0))
        (chars, at), (one, at_one), (two, at_two) = of(pc.invert(word)), of(pc.and_not(word, pair)), of(pair)
        chars = chars.to_pylist()
        words = pa.concat_arrays([one, pc.list_flatten(pc.split_pattern(two, " "))]).dictionary_encode()
        rare = Numbered()
        self.keys = Keys({w: i for i, w in enumerate(words.dictionary.to_pylist())}, rare, "".join(sorted({x for g in chars for x in g})[:LETTERS]), frozen=True)
        made = np.array([-1 - rare[g] if (k := self.keys.packed(g)) is None else k for g in chars], np.int64)
        number = words.indices.to_numpy().astype(np.int64)
        rest = number[len(one) :]
        made = np.concatenate([made, ONE | number[: len(one)], TWO | rest[::2] << SHIFT | rest[1::2]])
        order = np.argsort(made)
        self.known, self.at = made[order], np.concatenate([at, at_one, at_two])[order]

    def find(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places, ascending, and how often their grams stand in the text."""
        keys, tf = np.unique(self.keys.of(text), return_counts=True)
        at = np.searchsorted(self.known, keys)
        hit = np.flatnonzero(at < len(self.known))
        hit = hit[self.known[at[hit]] == keys[hit]]
        places = self.at[at[hit]]
        order = np.argsort(places)
        return places[order].astype(np.int32), tf[hit][order].astype(np.int32)

    def parts(self, batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of the batch, where each one's places begin and end, the places and how often; about `HELD` places at once."""
        found, start, held = [], 0, 0
        for i in range(batch.num_rows):
            found.append(self.find(batch.column(text)[i].as_py()))
            held += len(found[-1][0])
            if held >= HELD or i + 1 == batch.num_rows:
                at, tf = (np.concatenate(x) for x in zip(*found, strict=True))
                yield batch.slice(start, len(found)), np.cumsum([0, *(len(x) for x, _ in found)]), at, tf
                found, start, held = [], i + 1, 0


def placed(rows: DataFrame, key: str, text: str, held: DataFrame, *more: str) -> DataFrame:
    """key, `more`, at, tf: the places of the vocabulary's grams in each text, ascending, and how often they stand there.
    The vocabulary, which is bounded, is broadcast, so no gram is shuffled."""
    columns, sent = [key, *more], rows.sparkSession.sparkContext.broadcast(held.select("block", "gram", "place").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(sent.value)
        for b in batches:
            for part, cut, at, tf in places.parts(b, len(columns)):
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (at, tf)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *lists], names=[*columns, "at", "tf"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, text).mapInArrow(run, f"{kinds}, at array<int>, tf array<int>")


def weighed(cut: np.ndarray, at: np.ndarray, tf: np.ndarray, idf: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each place and its weight there; places from `words` on are of character grams."""
    row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    x = (1 + np.log(tf)) * idf[at]
    block = 2 * row + (at >= words)
    return row, x / np.sqrt(np.bincount(block, x * x))[block]


@dataclass
class Gate:
    vocabulary: DataFrame
    size: int
    model: object  # a fitted logistic regression

    def weights(self) -> DataFrame:
        """block, gram, weight."""
        held = [(i, float(w)) for i, w in enumerate(self.model.coefficients)]
        return self.vocabulary.join(self.vocabulary.sparkSession.createDataFrame(held, "place int, weight double"), "place").select("block", "gram", "weight")


def frequencies(held: DataFrame) -> tuple[np.ndarray, int]:
    """idf by place, and how many grams are of words; their places come first."""
    table = held.select("block", "place", "idf").toArrow()
    idf = np.zeros(table.num_rows)
    idf[table["place"].to_numpy()] = table["idf"].to_numpy()
    return idf, pc.sum(pc.equal(table["block"], WORD)).as_py() or 0


def vectors(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows (of `placed`) with features in place of at and tf: a sparse vector, empty without a gram."""
    from pyspark.ml.linalg import VectorUDT

    sent, names = rows.sparkSession.sparkContext.broadcast(frequencies(held)), [c for c in rows.columns if c not in ("at", "tf")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, words = sent.value
        for b in batches:
            at, tf = b.column(len(names)), b.column(len(names) + 1)
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy())])
            _, x = weighed(cut, at.flatten().to_numpy(), tf.flatten().to_numpy(), idf, words)
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), v) for v in (at.flatten(), pa.array(x))]
            vector = pa.StructArray.from_arrays([pa.array(np.zeros(b.num_rows), pa.int8()), pa.array(np.full(b.num_rows, len(idf)), pa.int32()), *lists], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], vector], names=[*names, "features"])

    schema = StructType([*(rows.schema[c] for c in names), StructField("features", VectorUDT())])
    return rows.select(*names, "at", "tf").mapInArrow(run, schema)


def train(rows: DataFrame, key: str, text: str, label: str, *, word_min_df: int = 2, char_min_df: int = 5, most: tuple[int, int] = (1 << 20, 200_000), c: float = 4.0, steps: int = 100, tol: float = 1e-6) -> Gate:
    """key: unique; label: 0 or 1.  Both classes weigh the same: a row's weight is n / (2·rows of its class).  The loss is
    c·Σ weight·log loss + |w|²/2, which is Spark's with the mean loss and regParam 1 / (c·n)."""
    from pyspark.ml.classification import LogisticRegression

    n = {bool(r["y"]): r["n"] for r in rows.groupBy(F.col(label).cast("boolean").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    held = vocabulary(tallied(rows, text), total, word_min_df, char_min_df, most)
    size = held.count()
    weight = F.when(F.col("y") == 1, total / (2.0 * n.get(True, 1))).otherwise(total / (2.0 * n.get(False, 1)))
    data = rows.select(key, text, F.col(label).cast("double").alias("y")).withColumn("weight", weight)
    data = shared(placed(data, key, text, held, "y", "weight").drop(key), "gate-rows")
    fit = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1.0 / (c * total), standardization=False, maxIter=steps, tol=tol)
    # a task passes on a gradient of all grams in each step, so no more tasks than run at once
    model = fit.fit(vectors(data.coalesce(rows.sparkSession.sparkContext.defaultParallelism), held))
    release(data)
    return Gate(held, size, model)


def score(gate: Gate, rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, p of every row, taken where its text is read; a text without a known gram has the p of the intercept."""
    model = gate.model.coefficients.toArray(), float(gate.model.intercept)
    sent = rows.sparkSession.sparkContext.broadcast((gate.vocabulary.select("block", "gram", "place").toArrow(), *frequencies(gate.vocabulary), *model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, idf, words, w, intercept = sent.value
        places = Places(table)
        for b in batches:
            for part, cut, at, tf in places.parts(b, 1):
                row, x = weighed(cut, at, tf, idf, words)
                z = np.bincount(row, x * w[at], part.num_rows) + intercept
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-z)))], names=[key, "p"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, p double")


def temperature(rows: DataFrame, logit: str, label: str, low: float = 0.05, high: float = 20.0, steps: int = 40) -> float:
    """The T in [low, high] with the least logistic loss of logit / T.

    Losses at a grid of T are sums of one pass; the grid then closes in on the best, three times."""
    for _ in range(3):
        ts = np.geomspace(low, high, steps)
        z = lambda t: F.col(logit) / float(t)
        loss = lambda t: F.sum(F.log1p(F.exp(-F.abs(z(t)))) + F.greatest(z(t), F.lit(0.0)) - F.when(F.col(label), z(t)).otherwise(0.0))
        found = rows.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(ts))).first()
        best = int(np.argmin([np.inf if x is None else x for x in found]))
        low, high = float(ts[max(0, best - 1)]), float(ts[min(steps - 1, best + 1)])
    return (low * high) ** 0.5
