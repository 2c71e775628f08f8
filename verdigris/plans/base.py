"""Registration of queries, and the driver tables seen as a feedback corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The verdict categories, those that count as steering first.
STEERING = ["wrong_approach", "incorrect_change", "unwanted_action", "style_violation", "premature", "direction"]
CATEGORIES = [*STEERING, "operational_directive", "status_update", "new_task", "question", "other"]


class Tables:
    """The tables below a folder, by attribute; and the corpus's entities that they stand for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        reachable(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def turns(self) -> DataFrame:
        return self.conversations.select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text")

    def moments(self) -> DataFrame:
        return self.events.select("event_id", F.col("user_id").cast("string").alias("session_id"), "ts", F.col("event_type").alias("kind"), "value", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"), "props")

    def feedback(self) -> DataFrame:
        reason = F.expr("case when doc_id % 17 = 0 then 'empty_window' when doc_id % 19 = 0 then 'ambiguous_uuid' end")
        return self.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("dedup_key"), F.col("source").alias("source_kind"), F.expr("concat('s', doc_id % 97)").alias("session_id"), F.expr("concat('e', doc_id div 2)").alias("event_uuid"), "text", "n_chars", "lang", reason.alias("quarantined_reason"))

    def verdicts(self) -> DataFrame:
        part = lambda where, *cols: self.labels.where(where).selectExpr("cast(doc_id as string) as dedup_key", *cols)
        rows = (
            part("true", "'judge' as role", "'v1' as prompt_version", "quality = 1 as is_steering", "doc_id % 11 as cat", "doc_id * 10 as judged_at", "doc_id * 4 as id")
            .union(part("doc_id % 2 = 0", "'judge'", "'v2'", "toxic = 0", "(doc_id + 3) % 11", "doc_id * 10 + 5", "doc_id * 4 + 1"))
            .union(part("doc_id % 10 = 0", "'judge'", "'v2'", "quality = 0", "(doc_id + 5) % 11", "doc_id * 10 + 5", "doc_id * 4 + 2"))
            .union(part("doc_id % 3 = 0", "'auditor'", "'v1'", "toxic = 0", "(doc_id + 1) % 11", "doc_id * 10 + 7", "doc_id * 4 + 3"))
        )
        names = F.array(*map(F.lit, CATEGORIES))
        return rows.select("dedup_key", "role", "prompt_version", "is_steering", F.element_at(names, (F.col("cat") + 1).cast("int")).alias("category"), (F.col("id") % 100 / 100.0).alias("confidence"), "judged_at", "id")

    def pairs(self) -> DataFrame:
        d = self.documents
        one = d.selectExpr("doc_id", "'r1' as prompt_version", "'m1' as model", "doc_id * 2 as refined_at", "explode(sequence(0, cast(doc_id % 3 as int))) as pair_index", "text")
        two = d.where("doc_id % 4 = 0").selectExpr("doc_id", "'r2'", "'m1'", "doc_id * 2 + 1", "explode(sequence(0, cast((doc_id div 4) % 2 as int)))", "text")
        return one.union(two).selectExpr("cast(doc_id as string) as dedup_key", "prompt_version", "model", "refined_at", "pair_index", "concat(pair_index, ':', text) as direction", "reverse(text) as verbatim")


#: The same entities in the oracle's dialect, as common table expressions.
CTE = {
    "turns": "turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text FROM conversations)",
    "moments": "moments AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, ts, event_type AS kind, value, least(value / 100.0, 1.0) AS score, props FROM events)",
    "feedback": "feedback AS (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS dedup_key, source AS source_kind, 's' || (doc_id % 97) AS session_id, 'e' || (doc_id // 2) AS event_uuid, text, n_chars, lang, CASE WHEN doc_id % 17 = 0 THEN 'empty_window' WHEN doc_id % 19 = 0 THEN 'ambiguous_uuid' END AS quarantined_reason FROM documents)",
    "verdicts": "verdicts AS (SELECT dedup_key, role, prompt_version, is_steering, (["
    + ", ".join(f"'{c}'" for c in CATEGORIES)
    + "])[cat + 1] AS category, id % 100 / 100.0 AS confidence, judged_at, id FROM ("
    "SELECT CAST(doc_id AS VARCHAR) AS dedup_key, 'judge' AS role, 'v1' AS prompt_version, quality = 1 AS is_steering, doc_id % 11 AS cat, doc_id * 10 AS judged_at, doc_id * 4 AS id FROM labels UNION ALL "
    "SELECT CAST(doc_id AS VARCHAR), 'judge', 'v2', toxic = 0, (doc_id + 3) % 11, doc_id * 10 + 5, doc_id * 4 + 1 FROM labels WHERE doc_id % 2 = 0 UNION ALL "
    "SELECT CAST(doc_id AS VARCHAR), 'judge', 'v2', quality = 0, (doc_id + 5) % 11, doc_id * 10 + 5, doc_id * 4 + 2 FROM labels WHERE doc_id % 10 = 0 UNION ALL "
    "SELECT CAST(doc_id AS VARCHAR), 'auditor', 'v1', toxic = 0, (doc_id + 1) % 11, doc_id * 10 + 7, doc_id * 4 + 3 FROM labels WHERE doc_id % 3 = 0))",
    "pairs": "pairs AS (SELECT CAST(doc_id AS VARCHAR) AS dedup_key, prompt_version, model, refined_at, pair_index, pair_index || ':' || text AS direction, reverse(text) AS verbatim FROM ("
    "SELECT doc_id, 'r1' AS prompt_version, 'm1' AS model, doc_id * 2 AS refined_at, CAST(unnest(range(0, doc_id % 3 + 1)) AS INTEGER) AS pair_index, text FROM documents UNION ALL "
    "SELECT doc_id, 'r2', 'm1', doc_id * 2 + 1, CAST(unnest(range(0, (doc_id // 4) % 2 + 1)) AS INTEGER), text FROM documents WHERE doc_id % 4 = 0))",
    "latest": "latest AS (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY dedup_key, role ORDER BY prompt_version DESC, judged_at DESC, id DESC) = 1)",
    "judged": "judged AS (SELECT dedup_key, is_steering, category, confidence FROM latest WHERE role = 'judge')",
    "accepted": "accepted AS (SELECT f.*, j.category, j.confidence FROM feedback f JOIN judged j USING (dedup_key) WHERE j.is_steering AND f.quarantined_reason IS NULL)",
    "sessions": "sessions AS (SELECT session_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS messages FROM turns GROUP BY session_id)",
    "scored": "scored AS (SELECT l.doc_id, l.quality = 1 AS label, (d.n_chars % 1000) / 1000.0 AS base, (d.n_chars % 700) / 700.0 AS candidate, d.source AS kind FROM labels l JOIN documents d USING (doc_id))",
}
_NEEDS = {"latest": ["verdicts"], "judged": ["verdicts", "latest"], "accepted": ["feedback", "verdicts", "latest", "judged"], "sessions": ["turns"]}


def query(name: str, sql: str | None = None, *uses: str):
    """Registers fn(tables) under `name`; `sql` is its oracle, over the common table expressions that it uses."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            names = list(dict.fromkeys(x for u in uses for x in [*_NEEDS.get(u, []), u]))
            body = sql.strip()
            ctes = ", ".join(CTE[x] for x in names)
            if ctes:
                recursive = body.upper().startswith("WITH RECURSIVE ")
                rest = body[len("WITH RECURSIVE ") :] if recursive else body[len("WITH ") :] if body.upper().startswith("WITH ") else None
                body = f"WITH {'RECURSIVE ' * recursive}{ctes}{', ' + rest if rest is not None else ' ' + body}"
            ORACLES[name] = body
        return fn

    return add


def sessions(turns: DataFrame) -> DataFrame:
    """session_id, messages: the turns of a session in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("session_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def scored(t: Tables) -> DataFrame:
    """Labelled documents with two arms' scores."""
    d = t.documents.select("doc_id", (F.col("n_chars") % 1000 / 1000.0).alias("base"), (F.col("n_chars") % 700 / 700.0).alias("candidate"), F.col("source").alias("kind"))
    return t.labels.select("doc_id", (F.col("quality") == 1).alias("label")).join(d, "doc_id")
