"""Streaming operators (T1–T9) and extension points (V1–V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import formats, hashing
from verdigris.operators import dedup, extend, latest
from verdigris.plans import filters
from verdigris.plans.base import Tables, query
from verdigris.plans.scalars import _FOLD
from verdigris.sources import files
from verdigris.streaming import sessions as S


class CountingEncoder:
    def encode(self, texts: list[str]):
        import numpy as np

        return np.array([[len(x)] for x in texts], np.float32)


def _stream(t: Tables, table: str) -> DataFrame:
    return t.spark.readStream.schema(getattr(t, table).schema).parquet(f"{t.sf_dir}/{table}.parque[t]")  # a pattern, for the table may be one file or a folder


@query("t01_arrivals", "SELECT session_id, least(count(*), 4000) AS n, (list(turn ORDER BY turn))[greatest(count(*) - 4000, 0) + 1] AS oldest FROM turns WHERE turn % 4 > 0 GROUP BY 1", "turns")
def t01(t: Tables) -> DataFrame:
    """Entries of main sessions, stamped as they arrive, in each session's buffer of the newest 4,000."""
    rows = _stream(t, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), (F.col("turn") % 4 == 0).alias("isSidechain"))
    out = S.drain(S.buffered(S.arrivals(rows), 4000, None), files.folder(t.spark, "arrivals"))
    return latest.first_by(out.where("arrived_at is not null"), ["session_id"], [F.desc("seen")]).select("session_id", F.col("kept").alias("n"), "oldest")


@query("t02_debounced", """WITH g AS (SELECT session_id, ts, (epoch_us(ts) // 1000) AS ms, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w < 1800000 THEN 0 ELSE 1 END AS new FROM moments WINDOW w AS (PARTITION BY session_id ORDER BY ts)), s AS (SELECT session_id, ms, sum(new) OVER (PARTITION BY session_id ORDER BY ts) AS k FROM g), b AS (SELECT session_id, count(*) AS n, max(ms) AS last_ms, k FROM s GROUP BY session_id, k)
 SELECT session_id, n, last_ms FROM b WHERE last_ms + 1800000 <= (SELECT max((epoch_us(ts) // 1000)) FROM moments)""", "moments")
def t02(t: Tables) -> DataFrame:
    """Sessions that have been silent for half an hour of event time, once for each burst of events."""
    rows = _stream(t, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    return S.drain(S.debounced_by_event(rows, 1_800_000), files.folder(t.spark, "debounced"))


@query("v04_drafts", "SELECT doc_id, regexp_extract(text, '\\S+') || '!' AS final FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')")
def v04(t: Tables) -> DataFrame:
    """A deterministic drafter and refiner as injected callables."""
    stub = extend.StubDrafter()
    return extend.drafted(t.documents, "doc_id", "text", stub, stub).where("final is not null").select("doc_id", "final")


@query("v08_planned", "SELECT doc_id, n_chars > 500 AS long FROM documents WHERE doc_id % 3 = 0")
def v08(t: Tables) -> DataFrame:
    return extend.planned(t.documents, "doc_id", lambda d: d.where("doc_id % 3 = 0").select("doc_id"), lambda d: d.select("doc_id", (F.col("n_chars") > 500).alias("long")))


@query("v01_encoder", "SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def v01(t: Tables) -> DataFrame:
    """An encoder that counts characters."""
    out = extend.encoded(t.documents.where("text is not null"), "doc_id", "text", CountingEncoder())
    return out.select("doc_id", F.col("embedding")[0].cast("long").alias("n"))


@query("t03_due_turns", "SELECT session_id, count(*) AS turn_count, (list(turn ORDER BY turn))[-2] AS target FROM turns GROUP BY 1 HAVING count(*) >= 2", "turns")
def t03(t: Tables) -> DataFrame:
    turns = _stream(t, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"))
    out = S.drain(S.due_turns(turns, None), files.folder(t.spark, "due"))
    return latest.first_by(out, ["session_id"], [F.desc("turn_count")])


@query("t04_suppression", """WITH RECURSIVE o AS (SELECT session_id, event_id, score, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS i FROM (SELECT session_id, event_id // 10 AS event_id, max(score) AS score FROM moments GROUP BY 1, 2)), g AS (SELECT session_id, event_id, i, score >= 0.6 AS hit, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS n, CASE WHEN score >= 0.6 THEN event_id END AS last FROM o WHERE i = 1
 UNION ALL SELECT o.session_id, o.event_id, o.i, (o.score >= 0.6 AND g.n < 5 AND (g.last IS NULL OR o.event_id - g.last >= 5)), g.n + CASE WHEN o.score >= 0.6 AND g.n < 5 AND (g.last IS NULL OR o.event_id - g.last >= 5) THEN 1 ELSE 0 END, CASE WHEN o.score >= 0.6 AND g.n < 5 AND (g.last IS NULL OR o.event_id - g.last >= 5) THEN o.event_id ELSE g.last END FROM g JOIN o ON o.session_id = g.session_id AND o.i = g.i + 1) SELECT session_id, event_id AS turn FROM g WHERE hit""", "moments")
def t04(t: Tables) -> DataFrame:
    turn = F.floor(F.col("event_id") / 10).cast("long")
    rows = t.moments().groupBy("session_id", turn.alias("turn")).agg(F.max("score").alias("score"))
    return S.suppressed(rows, 0.6).select("session_id", "turn")


@query("t05_scored_twice", "SELECT event_id, score, NOT (score < 0.5) AS passed FROM moments", "moments")
def t05(t: Tables) -> DataFrame:
    """A row before and after the second stage; the last of a key stays."""
    before = t.moments().select("event_id", F.lit(0).alias("seq"), F.lit(None).cast("double").alias("score"))
    after = t.moments().select("event_id", F.lit(1).alias("seq"), "score")
    rows = latest.upsert(before, after, ["event_id"], "seq")
    return rows.select("event_id", "score", (~(F.col("score") < 0.5)).alias("passed"))


@query("t06_tee", "SELECT 'mailbox' AS sink, count(*) AS n FROM turns UNION ALL SELECT 'shadow', count(*) FROM turns", "turns")
def t06(t: Tables) -> DataFrame:
    path = files.folder(t.spark, "tee")
    sinks = [lambda b, e, n=n: b.write.mode("overwrite").parquet(f"{path}/{n}/{e}") for n in ("shadow", "mailbox")]
    _stream(t, "conversations").writeStream.foreachBatch(S.tee(*sinks)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    n = lambda s: t.spark.read.parquet(f"{path}/{s}/*").agg(F.lit(s).alias("sink"), F.count("*").alias("n"))
    return n("shadow").union(n("mailbox"))


@query("t07_mailbox", f"SELECT min(event_id) AS proposal_id, session_id, strftime(min_by(ts, event_id) + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires, {_FOLD.format(k='CAST(min(event_id) AS VARCHAR)', m=10000)} < 1000 AS holdout FROM moments WHERE kind = 'purchase' AND score >= 0.2 GROUP BY session_id", "moments")
def t07(t: Tables) -> DataFrame:
    rows = t.moments().where("kind = 'purchase' and score >= 0.2")
    first = latest.first_by(rows, ["session_id"], [F.col("event_id")])
    return first.select(F.col("event_id").alias("proposal_id"), "session_id", F.date_format(F.col("ts") + F.expr("interval 90 minutes"), "yyyy-MM-dd HH:mm:ss").alias("expires"), hashing.held_out(F.col("event_id").cast("string"), 0.1).alias("holdout"))


@query("t08_resolve_on_prompt", """WITH q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS n FROM moments WHERE kind = 'purchase' AND ts <= TIMESTAMP '2024-01-20'), f AS (SELECT *, ts < TIMESTAMP '2024-01-18' AS stale FROM q)
 SELECT event_id, CASE WHEN stale OR n > 1 THEN 'expired' WHEN event_id % 10 = 3 THEN 'holdout' ELSE 'delivered' END AS state FROM f""", "moments")
def t08(t: Tables) -> DataFrame:
    """Stale ones expire, of the fresh the newest is decided and the others expire."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id")))
    q = t.moments().where("kind = 'purchase' and ts <= timestamp_ntz '2024-01-20'").withColumn("n", n)
    state, _ = filters.delivery(F.lit("live_all"), F.lit(True), F.col("event_id") % 10 == 3, F.lit(0), 20)
    return q.select("event_id", F.when(F.expr("ts < timestamp_ntz '2024-01-18'") | (F.col("n") > 1), "expired").otherwise(state).alias("state"))


@query("t09_activity", "WITH g AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM moments WINDOW w AS (PARTITION BY session_id ORDER BY ts)), s AS (SELECT session_id, ts, sum(new) OVER (PARTITION BY session_id ORDER BY ts) AS k FROM g) SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY session_id, k", "moments")
def t09(t: Tables) -> DataFrame:
    rows = t.moments().select("session_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.activity(rows).select("session_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("v03_gate_score", "SELECT doc_id, least(length(text), 1000) / 1000.0 AS score FROM documents")
def v03(t: Tables) -> DataFrame:
    return extend.score(t.documents.select("doc_id", "text"), "text", extend.LengthGate()).select("doc_id", "score")


@query("v05_structured_judge", "SELECT doc_id, 'noise' AS verdict FROM documents WHERE doc_id % 7 > 0")
def v05(t: Tables) -> DataFrame:
    """Failures give no row, so their keys stay pending."""
    return extend.judged(t.documents.select("doc_id", "text"), "doc_id", extend.StubJudge())


class Unreachable:
    """A judge whose service answers with the prompt's length, but not for the ids of one stretch."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def __call__(self, key: int, prompt: str) -> str:
        if key % 7 == 0 or self.low <= key < self.high:
            raise RuntimeError("no answer")
        return str(len(prompt))


@query("v06_circuit_breaker", """WITH r AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 7 = 0 OR (doc_id >= 120 AND doc_id < 140) AS fails, row_number() OVER (ORDER BY doc_id) AS pos FROM documents), s AS (SELECT *, sum(fails::INTEGER) OVER (ORDER BY pos ROWS 4 PRECEDING) AS f FROM r)
 SELECT doc_id, CAST(length(text) AS VARCHAR) AS verdict FROM s WHERE NOT fails AND pos < (SELECT coalesce(min(pos), 1 << 60) FROM s WHERE f = 5)""")
def v06(t: Tables) -> DataFrame:
    """Verdicts until five failures in a row; all that comes after them stays pending."""
    return extend.judged_in_batches(t.documents.select("doc_id", "text"), "doc_id", Unreachable(120, 140), batch=1000).answered


def first_lines(text: str) -> list[tuple]:
    """A caller's own review format: the first word of a text is the file, its second the comment."""
    words = text.encode().split(maxsplit=2)[:2]
    return [(words[0].decode(), 1, None, words[1].decode())] if len(words) == 2 else []


@query("v07_review_formats", r"""WITH c AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(coalesce(text, '') || E'\n@src/' || lang || ':7 from ' || source, text, ''), '\S+') AS w FROM documents) SELECT doc_id, w[1] AS file, 1 AS line_start, w[2] AS comment FROM c WHERE len(w) >= 2 UNION ALL SELECT doc_id, 'src/' || lang, 7, 'from ' || source FROM c WHERE lang IS NOT NULL AND source IS NOT NULL""")
def v07(t: Tables) -> DataFrame:
    """A registry of one pattern and one callable beside the formats that come with the library."""
    registry = (formats.PatternFormat("cite", r"(?m)^@(\S+):(\d+) (.+)$", 1, 2, 0, (3,)), formats.CallableFormat("words", first_lines))
    cited = F.concat(F.coalesce("text", F.lit("")), F.lit("\n@src/"), "lang", F.lit(":7 from "), "source")
    rows = t.documents.select("doc_id", F.explode(formats.review_comments(F.coalesce(cited, "text"), registry)).alias("c"))
    return rows.select("doc_id", "c.file", "c.line_start", "c.comment")


class Letters:
    """A deterministic embedder: how often each letter of the alphabet stands in a text."""

    def encode(self, texts: list[str]):
        import numpy as np

        counts = [np.bincount(np.frombuffer(x.lower().encode(), np.uint8), minlength=256)[97:123] for x in texts]
        return np.array(counts, np.float32).reshape(len(texts), 26)


@query("v02_embedder")
def v02(t: Tables) -> DataFrame:
    """Near-duplicates by text, and on top of them by an embedder that the caller gives."""
    return dedup.collapse(t.documents.select("doc_id", "text"), "doc_id", "text", embedder=Letters(), cosine=0.9999)
