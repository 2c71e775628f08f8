"""Extension points: encoders, gates, drafters and judges are callables that run in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Gate(Protocol):
    def score(self, text: str) -> float: ...


class Drafter(Protocol):
    def draft(self, context: str) -> str | None: ...


class Refiner(Protocol):
    def refine(self, context: str, draft: str) -> str | None: ...


class LengthGate:
    """A deterministic stand-in: the text's length in thousands, at most 1."""

    def score(self, text: str) -> float:
        return min(len(text), 1000) / 1000.0


class StubJudge:
    """A deterministic stand-in that fails for every seventh key."""

    def __call__(self, key: int, prompt: str) -> str:
        if key % 7 == 0:
            raise RuntimeError("no answer")
        return "noise"


def encoded(df: DataFrame, key: str, text: str, encoder: Encoder) -> DataFrame:
    """key, embedding."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(encoder.encode([x or "" for x in b.column(1).to_pylist()]), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def score(df: DataFrame, text: str, gate: Gate) -> DataFrame:
    """df with the gate's score."""

    def run(x: pd.Series) -> pd.Series:
        return x.fillna("").map(gate.score).astype(float)

    return df.withColumn("score", F.pandas_udf(run, "double")(F.col(text)))


def judged(df: DataFrame, key: str, judge: Callable[[object, str], str], breaker: int | None = None) -> DataFrame:
    """key, verdict; a failure gives no row.  `breaker` failures in a row end the task's partition: what is left stays pending."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for b in batches:
            keys, verdicts = [], []
            for k, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if breaker and failed >= breaker:
                    break
                try:
                    verdicts.append(judge(k, prompt or ""))
                    keys.append(k)
                    failed = 0
                except Exception:  # whatever an outside judge raises leaves its key pending
                    failed += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(verdicts, pa.string())], names=[key, "verdict"])

    return df.select(key, df.columns[1]).mapInArrow(run, f"{key} {kind}, verdict string")


@dataclass
class Run:
    """What a run left: key, verdict of the rows it answered (stored), the calls that were counted, and whether it was broken
    off."""

    answered: DataFrame
    calls: int
    broken: bool


def judged_in_batches(df: DataFrame, key: str, judge: Callable[[object, str], str], breaker: int = 5, batch: int = 10_000, tasks: int = 8) -> Run:
    """The judge over all rows in the order of their keys, batch by batch; `breaker` failures in a row end the run, and what
    comes after them stays pending, as do failures.

    A batch is a job over ranges of its keys.  A task stops calling at its own row of failures; the batch's outcome is then
    read in key order, so where the run ends depends on neither tasks nor batches.  df: key (unique, of a type that sorts),
    prompt; null keys are left out.  A batch's outcome is written, so a batch that was answered isn't asked again."""
    from verdigris.sources.staging import shared

    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    calls = spark.sparkContext.accumulator(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for b in batches:
            keys, verdicts = [], []
            for k, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if failed >= breaker:
                    break
                calls.add(1)
                keys.append(k)
                try:
                    verdicts.append(judge(k, prompt or ""))
                    failed = 0
                except Exception:  # whatever an outside judge raises leaves its key pending
                    verdicts.append(None)
                    failed += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(verdicts, pa.string())], names=[key, "verdict"])

    rows = df.select(F.col(key), F.col(df.columns[1]).alias("prompt")).where(F.col(key).isNotNull())
    answered, last, streak = None, None, 0
    while True:
        todo = rows if last is None else rows.where(F.col(key) > F.lit(last))
        todo = shared(todo.orderBy(key).limit(batch), "pending")
        got = shared(todo.repartitionByRange(tasks, key).sortWithinPartitions(key).mapInArrow(run, f"{key} {kind}, verdict string"), "outcome")
        in_order = Window.orderBy(key)  # a batch's rows, so bounded
        fails = F.col("verdict").isNull().cast("int")
        # the place of the last success before each row: failures since then, with those that the batch before ended on
        marked = todo.select(key).join(got.withColumn("called", F.lit(True)), key, "left").withColumn("at", F.row_number().over(in_order))
        marked = marked.withColumn("since", F.col("at") - F.coalesce(F.max(F.when(F.col("verdict").isNotNull(), F.col("at"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-streak)))
        end = marked.where((F.col("since") >= breaker) & (fails == 1)).agg(F.min("at")).first()[0]
        tail = marked.agg(F.max("at").alias("n"), F.max(key).alias("last"), F.max_by("since", "at").alias("streak")).first()
        kept = marked.where("verdict is not null" + (f" and at < {end}" if end else "")).select(key, "verdict")
        answered = kept if answered is None else answered.union(kept)
        if end or not tail.n or tail.n < batch:
            return Run(shared(answered, "answered"), calls.value, bool(end))
        last, streak = tail.last, tail.streak


class StubDrafter:
    """A deterministic stand-in: the first word is the draft, refined by a mark; nothing for an empty context."""

    def draft(self, context: str) -> str | None:
        return context.split()[0] if context.split() else None

    def refine(self, context: str, draft: str) -> str | None:
        return f"{draft}!"


def drafted(df: DataFrame, key: str, context: str, drafter: Drafter, refiner: Refiner | None = None) -> DataFrame:
    """key, draft, final: a draft for each context, refined if there is a refiner; none where the drafter has none or fails."""
    kind = df.schema[key].dataType.simpleString()

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            draft = drafter.draft(text)
            return draft, draft if draft is None or refiner is None else refiner.refine(text, draft)
        except Exception:  # whatever an outside model raises leaves its row without a draft
            return None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d for d, _ in made], pa.string()), pa.array([f for _, f in made], pa.string())], names=[key, "draft", "final"])

    return df.select(key, context).mapInArrow(run, f"{key} {kind}, draft string, final string")


def planned(pending: DataFrame, key: str, planner: Callable[[DataFrame], DataFrame], classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `classify` makes of the rows that `planner` chooses; both are functions of DataFrames that keep the key.
    A planner may choose among the pending rows only."""
    chosen = planner(pending)
    if key not in chosen.columns:
        raise ValueError(f"the planner lost {key}")
    return classify(pending.join(chosen.select(key).distinct(), key, "left_semi"))
