"""Operator 9: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the whole text and ordered thresholds: P(grade <= k) = σ(θ_k − w·x).  From it
come the expected grade and the probability of the best grade, by which documents are selected.

Features: words without case and outer punctuation, that punctuation, and shares of capitalised, bare-punctuation and
distinct words, all hashed into the same 2**bits weights; a word that takes a share s of the text counts √s.

Fitting is bounded: `most_rows` rated documents, those with the smallest hashes of their ids, go to the driver as sparse
rows, one for an id; a rating table with fewer is used whole.  Scoring covers all texts and is a map without any shuffle.

Defined cases: of several ratings of a document the lowest counts; ratings with nulls and of unknown documents are left
out; of rated documents that share an id the one of the smallest features teaches; a null or wordless text gets grade 0 and probability 0; without any rating, probabilities are null and nothing is
rejected; texts of any length are taken whole; repeated documents are scored each; ids may be of any type; other columns
stay, but for those named expected_grade, p_best and rejected, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import CACHE_WORDS, as_bytes, holds, numbered, release, slices, staged, trim, trimmed

BITS = 18
_EDGE = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
_LOW = (1 << 20) - 1


def slot(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + value) >> (64 - BITS)


class Tokens(dict):
    """word → slot of its core, slot of its punctuation (0: none), capitals, bareness, packed into an integer."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core = word.strip(_EDGE)
        edge = word[: word.find(core)] + b" " + word[word.find(core) + len(core) :] if core else word
        packed = slot(b"w", core.lower()) if core else _LOW
        packed |= (slot(b"p", edge) + 1 if edge != b" " else 0) << 20
        packed |= (len(core) > 1 and core.isupper()) << 40 | (not core) << 41
        self[word] = packed
        return packed


_tokens = Tokens()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots (some may occur twice) and values; empty without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    packed = np.fromiter(map(_tokens.__getitem__, words), np.int64, n)
    core, times = np.unique(packed & _LOW, return_counts=True)
    if core[-1] == _LOW:
        core, times = core[:-1], times[:-1]
    edge, often = np.unique(packed >> 20 & _LOW, return_counts=True)
    if not edge[0]:
        edge, often = edge[1:], often[1:]
    step = lambda share: b"%d" % int(10 * share)
    shares = [slot(b"c", step((packed >> 40 & 1).mean())), slot(b"b", step((packed >> 41).mean())), slot(b"d", step(len(core) / n) + b":%d" % n.bit_length())]
    slots = np.concatenate([core, edge - 1, shares]).astype(np.int32)
    return slots, np.concatenate([np.sqrt(times / n), np.sqrt(often / n), [0.5] * 3]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 … , a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


#: Values whose products are held at once while the model is fitted.
BLOCK = 1 << 20


def fit(rows: Iterable[tuple[int, np.ndarray, np.ndarray]], grades: int, *, l2: float = 3e-5, least_docs: int = 4, steps: int = 200, rate: float = 0.15) -> Model | None:
    """Adam on the whole gradient; rows are (grade, slots, values).  Slots in fewer than least_docs rows weigh nothing."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    times = np.zeros(1 << BITS, np.int32)
    for _, slots_of, _ in rows:
        times[np.unique(slots_of)] += 1
    often = times >= min(least_docs, len(rows))
    for i, (g, s, x) in enumerate(rows):
        rows[i] = (g, s[often[s]], x[often[s]])
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    used = np.flatnonzero(often & (times > 0))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    y = np.array([r[0] for r in rows])
    ends = np.cumsum([len(r[1]) for r in rows])
    at, value = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    for i, end in enumerate(ends):
        _, s, x = rows[i]
        at[end - len(s) : end], value[end - len(s) : end] = place[s], x
        rows[i] = None
    del rows
    blocks, first = [], 0  # rows from first to last, of about BLOCK values
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        begins = np.concatenate([[base], ends[first : last - 1]]) - base
        blocks.append((slice(first, last), slice(base, ends[last - 1]), begins, np.diff(np.concatenate([begins, [ends[last - 1] - base]]))))
        first = last
    share = (np.array([(y >= k).sum() for k in range(1, grades)]) + 0.5) / (len(y) + 1)
    # thresholds as the first one and the logarithms of the gaps, so they stay in order
    first = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v, d = np.zeros_like(p), np.zeros_like(p), len(used)
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))
        z = np.concatenate([np.add.reduceat(p[:d][at[part]] * value[part], begins) for _, part, begins, _ in blocks])
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper = 1 / (1 + np.exp(np.clip(z - edges[y + 1], -60, 60)))
        lower = 1 / (1 + np.exp(np.clip(z - edges[y], -60, 60)))
        prob = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / prob, lower * (1 - lower) / prob
        gz = (du - dl) / len(y)
        gt = np.array([dl[y == k].sum() - du[y == k - 1].sum() for k in range(1, grades)]) / len(y)
        tail = np.cumsum(gt[::-1])[::-1]
        slopes = l2 * p[:d]
        for r, part, _, sizes in blocks:
            slopes += np.bincount(at[part], value[part] * np.repeat(gz[r], sizes), d)
        g = np.concatenate([slopes, tail[:1], tail[1:] * np.exp(p[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (steps + 1))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = p[:d]
    return Model(weights, np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])])))


def train(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, *, most_rows: int = 12_000, id_column: str = "doc_id", text_column: str = "text", **options) -> Model | None:
    """ratings: rows with the id column; grade: 0 … grades − 1."""
    rated = ratings.select(F.col(f"`{id_column}`").cast(docs.schema[id_column].dataType).alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade is not null")
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], chosen.schema)  # most_rows at most: ids and grades

    kind = chosen.schema["id"].dataType.simpleString()

    @trimmed
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [features(x) for x in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], names=["id", "grade", "slots", "vals"])

    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "grade", "text").mapInArrow(rows, f"id {kind}, grade int, slots binary, vals binary")
    found = staged(found.groupBy("id").agg(F.min(F.struct("grade", "slots", "vals")).alias("x")).select("x.*"), "rated")
    # read back a file at a time, in an order that the rows' places don't matter to
    held = found.orderBy("grade", "slots", "vals").toLocalIterator()
    model = fit(((r.grade, np.frombuffer(r.slots, np.int32), np.frombuffer(r.vals, np.float32)) for r in held), grades, **options)
    release(found)
    trim()  # the driver goes on
    return model


def score(docs: DataFrame, model: Model | None, *, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """docs with expected_grade, p_best and rejected (p_best below the threshold)."""
    added = ("expected_grade", "p_best", "rejected")
    own = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*own, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_best", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    at = [f.name for f in own].index(text_column)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        holds("tokens", _tokens.clear)
        for b in slices(batches, f"c{at}"):
            if model is None:
                made = [pa.nulls(b.num_rows, pa.float64()), pa.nulls(b.num_rows, pa.float64()), pa.array([False] * b.num_rows)]
            else:
                got = [features(x) for x in as_bytes(b.column(at))]
                some = np.array([len(s) > 0 for s, _ in got], bool)
                tails = model.tails(np.array([float(model.weights[s] @ x) for s, x in got])) * some[:, None]
                made = [pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] < threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.fieldNames())

    return numbered(docs, own).mapInArrow(run, schema)


def grade() -> Column:
    """Toxic documents are 0, others of low quality 1, good ones 2; a null toxicity counts as none."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
