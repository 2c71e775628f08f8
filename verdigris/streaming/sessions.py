"""Structured Streaming over live sessions: buffers, debounce, suppression, tee, windows.

The stateful operators are `StatefulProcessor`s for transformWithState: list and value state by session, kept in the RocksDB
store.  State is bounded by session: a session's state goes when it was silent for `ttl_ms`.  A run over what is available
has no processing-time clock (ttl_ms None), for a stream with one never ends by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, clock: str) -> DataFrame:
    """rows (session_id and more) through a processor by session; clock: none, ProcessingTime or EventTime."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=clock)


class Ranges:
    """A set of whole numbers as ranges [first, last]: one range for a session without gaps, whatever its length."""

    def __init__(self, first=(), last=()):
        self.held = [[int(a), int(b)] for a, b in zip(first, last, strict=True)]

    def __contains__(self, x: int) -> bool:
        return any(a <= x <= b for a, b in self.held)

    def add(self, numbers) -> None:
        joined: list[list[int]] = []
        for a, b in sorted([*self.held, *([x, x] for x in numbers)]):
            if joined and a <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        self.held = joined

    def __len__(self) -> int:
        return sum(b - a + 1 for a, b in self.held)

    def second_last(self) -> int:
        a, b = self.held[-1]
        return b - 1 if b > a else self.held[-2][1]

    def columns(self) -> tuple[list[int], list[int]]:
        return [a for a, _ in self.held], [b for _, b in self.held]


class Buffer(StatefulProcessor):
    """A session's newest `most` entries.  The list is cut when it is a quarter over, so an entry costs about one write."""

    def __init__(self, most: int, ttl_ms: int | None):
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "turn long, arrived_at timestamp", ttlDurationMs=self.ttl)
        self.size = handle.getValueState("size", "held long, seen long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, seen = map(int, self.size.get() or (0, 0))
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")
        self.entries.appendList(list(zip(new["turn"].astype(int), (t.to_pydatetime() for t in new["arrived_at"]), strict=True)))
        held, seen = held + len(new), seen + len(new)
        if held > self.most + self.most // 4:
            self.entries.put([tuple(x) for x in self.entries.get()][-self.most :])
            held = self.most
        self.size.update((held, seen))
        kept = min(held, self.most)
        oldest = [x[0] for x in self.entries.get()][-kept]
        yield pd.DataFrame({"session_id": [key[0]], "seen": [seen], "kept": [kept], "oldest": [int(oldest)], "newest": [int(new["turn"].iloc[-1])], "arrived_at": [new["arrived_at"].iloc[-1]]})

    def close(self) -> None:
        pass


def buffered(arrived: DataFrame, most: int = 4000, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """session_id, seen, kept, oldest, newest, arrived_at: for each batch that brings a session entries, what its buffer
    holds then.  arrived: session_id, turn, arrived_at (stream); entries of a batch are taken in the order of turns."""
    return stateful(arrived.select("session_id", F.col("turn").cast("long").alias("turn"), "arrived_at"), Buffer(most, ttl_ms), "session_id string, seen long, kept long, oldest long, newest long, arrived_at timestamp", "ProcessingTime" if ttl_ms else "none")


class DueTurns(StatefulProcessor):
    """T3."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("turns", "first array<long>, last array<long>, done long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, done = self.state.get() or ([], [], 0)
        turns = Ranges(first, last)
        turns.add({int(t) for b in rows for t in b["turn"]})
        if len(turns) >= 2 and len(turns) != done:
            done = len(turns)
            yield pd.DataFrame({"session_id": [key[0]], "turn_count": [done], "target": [turns.second_last()]})
        self.state.update((*turns.columns(), done))

    def close(self) -> None:
        pass


def due_turns(turns: DataFrame, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """session_id, turn_count, target: for each batch that brings a session more turns, its last completed turn (the last
    but one), once.  turns: session_id, turn (stream), where a repeated turn counts once.

    The state is the ranges of turns that were seen, so neither the count nor the target is cut short."""
    return stateful(turns, DueTurns(ttl_ms), "session_id string, turn_count long, target long", "ProcessingTime" if ttl_ms else "none")


def arrivals(entries: DataFrame) -> DataFrame:
    """Live entries of main sessions, stamped with their arrival; sidechains are left out (batch or stream)."""
    return entries.where("not coalesce(isSidechain, false)").withColumn("arrived_at", F.current_timestamp())


class Debounce(StatefulProcessor):
    """One timer a session, set anew by each batch.  By event time a burst also ends where a row comes `silence` after the
    one before, so what is told doesn't depend on how rows fall into batches."""

    def __init__(self, silence_ms: int, by_event: bool):
        self.silence, self.by_event = silence_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("burst", "n long, last_ms long")

    def told(self, key, bursts: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]] * len(bursts), "n": [n for n, _ in bursts], "last_ms": [last for _, last in bursts]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = map(int, self.state.get() or (0, -1))
        over: list[tuple[int, int]] = []
        if self.by_event:
            for at in sorted(int(x) for b in rows for x in b["at_ms"]):
                if n and at - last >= self.silence:
                    over.append((n, last))
                    n = 0
                n, last = n + 1, max(last, at) if n else at
        else:
            n, last = n + sum(map(len, rows)), timerValues.getCurrentProcessingTimeInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.silence)
        self.state.update((n, last))
        if over:
            yield self.told(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = map(int, self.state.get())
        self.state.clear()
        yield self.told(key, [(n, last)])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, silence_ms: int = 2000) -> DataFrame:
    """session_id, n of sessions that have been silent for silence_ms; the timer starts again with each batch (a live stream)."""
    return stateful(events, Debounce(silence_ms, False), "session_id string, n long, last_ms long", "ProcessingTime").select("session_id", "n")


def debounced_by_event(events: DataFrame, silence_ms: int = 2000, late: str = "0 seconds") -> DataFrame:
    """session_id, n, last_ms: bursts of a session's events (session_id, ts) that silence_ms of event time have followed.
    Rows later than `late` behind the newest are left out."""
    rows = events.withWatermark("ts", late).select("session_id", "ts", F.unix_millis(F.col("ts")).alias("at_ms"))
    return stateful(rows, Debounce(silence_ms, True), "session_id string, n long, last_ms long", "EventTime")


class Ledger:
    """A session's proposals: at most `cap`, `cooldown` turns apart; a turn counts once."""

    def __init__(self, proposals: int = 0, last: int | None = None, cap: int = 5, cooldown: int = 5):
        self.proposals, self.last, self.cap, self.cooldown = proposals, last, cap, cooldown

    def admits(self, turn: int, score: float, threshold: float) -> bool:
        """Whether this turn proposes.  A score that is no number passes the gate."""
        if score < threshold or self.proposals >= self.cap or (self.last is not None and turn - self.last < self.cooldown):
            return False
        self.proposals, self.last = self.proposals + 1, turn
        return True


def suppressed(rows: DataFrame, threshold: float) -> DataFrame:
    """session_id, turn, score of the turns that propose; a bounded fold over each session in order (batch).  A turn is
    evaluated once: of its rows that with the lowest score."""
    import pyarrow as pa

    def run(batches):
        now, at, ledger = object(), None, Ledger()
        for b in batches:
            keep = []
            for s, turn, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != now:
                    now, at, ledger = s, None, Ledger()
                keep.append(turn != at and ledger.admits(turn, score, threshold))
                at = turn
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = rows.select("session_id", F.col("turn").cast("long").alias("turn"), F.col("score").cast("double").alias("score"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "turn", "score").mapInArrow(run, rows.schema)


class Suppress(StatefulProcessor):
    """T4: a session's ledger and the turns that were evaluated."""

    def __init__(self, threshold: float, ttl_ms: int | None):
        self.threshold, self.ttl = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "proposals long, last long, first array<long>, until array<long>", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last, first, until = self.state.get() or (0, None, [], [])
        ledger, seen = Ledger(int(n), None if last is None or last != last else int(last)), Ranges(first, until)
        b = pd.concat(list(rows)).sort_values(["turn", "score"]).drop_duplicates("turn")
        fresh = [int(t) not in seen for t in b["turn"]]
        keep = [new and ledger.admits(int(t), float(x), self.threshold) for new, t, x in zip(fresh, b["turn"], b["score"], strict=True)]
        seen.add(int(t) for t, new in zip(b["turn"], fresh, strict=True) if new)
        self.state.update((ledger.proposals, ledger.last, *seen.columns()))
        yield b.loc[keep, ["session_id", "turn", "score"]]

    def close(self) -> None:
        pass


def suppressed_stream(rows: DataFrame, threshold: float, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """The same with the ledger as state; turns that come late are evaluated when they come."""
    return stateful(rows, Suppress(threshold, ttl_ms), "session_id string, turn long, score double", "ProcessingTime" if ttl_ms else "none")


def tee(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to all sinks, in their order."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return write


def activity(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """session_id, start, n of each stretch without a longer gap; `late` bounds the state of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), "n")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs the stream over all that is available and reads what it appended."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
