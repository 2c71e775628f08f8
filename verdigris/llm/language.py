"""Operator 8: language identification with error-correcting output codes.

Each language has a codeword of ±1.  For every bit a binary classifier over hashed 2-grams and 3-grams of the text's bytes
(a naive Bayes log ratio between the languages with +1 and those with −1) gives a margin.  Decoding takes the codeword
with the smallest sum of logistic losses, each bit weighted by how well its classifier keeps the languages apart; `score`
is the softmax of the negated losses, and a text whose two best are closer than `gap` is flagged ambiguous.

Learning counts the n-grams of all training texts: tasks count their rows by language, the counts are summed by
(language, slot), and languages × 2**bits numbers reach the driver whatever the input.  Prediction is a map.

Up to 7 languages get the exhaustive code; more get words of 15 or 10·log2(languages) bits, chosen among seeded draws for
the largest least distance.

Defined cases: rows with a null language or text teach nothing; a null text, one without a letter, and any text if nothing
was learned are `und` with score 0; texts of any length are taken whole; ties go to the language that comes first by name;
repeated rows count again; other columns stay, but for those named lang_pred, score and ambiguous, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import as_bytes, numbered, slices

BITS = 14
UNKNOWN = "und"
#: ASCII letters lowered, other ASCII to a space, all else as it is.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)


def slots(text: bytes) -> np.ndarray:
    """A slot for each 2-gram and 3-gram of the folded text between two spaces; runs of spaces are one."""
    x = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    spread = lambda g: (g * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return np.concatenate([spread(two + np.uint32(1 << 24)), spread(three)])


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """n words of ±1, a row each."""
    if n <= 7:
        k = max(1, 2 ** (n - 1) - 1)
        first = np.ones((1, k), int)
        rest = [[1 if (j >> (n - 2 - i)) & 1 else -1 for j in range(k)] for i in range(n - 1)]
        return np.concatenate([first, np.array(rest, int).reshape(n - 1, k)])
    k = max(15, int(10 * np.log2(n)))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        draw = rng.choice([-1, 1], (n, k))
        near = int(((k - draw @ draw.T) // 2 + k * np.eye(n, dtype=int)).min())
        if near > far:
            best, far = draw, near
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages × bits of the code
    weights: np.ndarray  # 2**BITS × bits of the code
    trust: np.ndarray  # bits of the code

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of margins: the best language's number, its score, and the second best's score."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.codes[None]) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best].copy()
        p[np.arange(len(p)), best] = 0
        return best, score, p.max(1)


def train(docs: DataFrame, *, text_column: str = "text", language_column: str = "lang", most_languages: int = 4096) -> Model | None:
    """From all rows of docs with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if lang not in seen:
                    seen[lang] = np.zeros(1 << BITS, np.int64)
                seen[lang] += np.bincount(slots(text), minlength=1 << BITS)
            if len(seen) > most_languages:
                raise ValueError(f"more than {most_languages} languages")
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "slot", "n"])

    rows = docs.select(F.col(language_column).cast("string").alias("lang"), F.col(text_column).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # languages × 2**BITS rows at most
    if not len(found):
        return None
    languages = sorted(found["lang"].unique())
    n = np.zeros((len(languages), 1 << BITS))
    n[np.searchsorted(languages, found["lang"]), found["slot"]] = found["n"]
    p = (n + 0.5) / (n + 0.5).sum(1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.zeros((1 << BITS, codes.shape[1]), np.float32)
    for j, code in enumerate(codes.T):
        if len(set(code)) == 2:
            weights[:, j] = np.log(p[code > 0].mean(0)) - np.log(p[code < 0].mean(0))
    # a bit is trusted as far as its weakest language's own profile lands on the right side
    reach = np.maximum((p @ weights * codes).min(0), 0)
    trust = reach / reach.sum() * len(reach) if reach.sum() else np.ones(len(reach))
    return Model(languages, codes, weights, trust)


def predict(docs: DataFrame, model: Model | None, *, gap: float = 0.2, scale: float = 40.0, text_column: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous.  scale: n-grams after which a longer text makes no surer."""
    added = ("lang_pred", "score", "ambiguous")
    own = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    held, at = docs.sparkSession.sparkContext.broadcast(model), [f.name for f in own].index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in slices(batches, f"c{at}"):
            langs, scores, unsure = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows, [False] * b.num_rows
            texts = b.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
            for start in range(0, len(known), 128):
                part = known[start : start + 128]
                grams = [slots(texts[i].encode()) for i in part]
                counts = np.stack([np.bincount(g, minlength=1 << BITS) for g in grams]).astype(np.float32)
                size = np.array([len(g) for g in grams])
                margins = (counts @ model.weights) * (np.minimum(size, scale) / size)[:, None]
                for i, k, s, second in zip(part, *model.decode(margins), strict=True):
                    langs[i], scores[i], unsure[i] = model.languages[k], float(s), bool(s - second < gap)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=schema.fieldNames())

    return numbered(docs, own).mapInArrow(run, schema)


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds
