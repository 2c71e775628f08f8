"""Set operations and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import latest
from verdigris.plans.base import Tables, query


@query("u01_union", "SELECT session_id FROM turns UNION SELECT session_id FROM moments WHERE kind = 'error'", "turns", "moments")
def u01(t: Tables) -> DataFrame:
    return t.turns().select("session_id").union(t.moments().where("kind = 'error'").select("session_id")).distinct()


@query("u02_union_all", "SELECT 'pos' AS kind, session_id, turn FROM turns WHERE role = 'user' UNION ALL SELECT 'neg', session_id, turn FROM turns WHERE role <> 'user' UNION ALL SELECT 'live', session_id, event_id FROM moments WHERE kind = 'view'", "turns", "moments")
def u02(t: Tables) -> DataFrame:
    part = lambda df, kind, turn: df.select(F.lit(kind).alias("kind"), "session_id", F.col(turn).alias("turn"))
    user = F.col("role") == "user"
    return part(t.turns().where(user), "pos", "turn").unionByName(part(t.turns().where(~user), "neg", "turn")).unionByName(part(t.moments().where("kind = 'view'"), "live", "event_id"))


def shared_texts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct stripped texts in both, without blanks."""
    own = lambda df: df.select(T.strip(F.col(df.columns[0])).alias("text")).where("text <> ''")
    return own(a).intersect(own(b))


@query("u03_intersection", """WITH a AS (SELECT trim(unnest(string_split(text, E'\\n')), E' \\t\\r') AS text FROM documents), b AS (SELECT trim(unnest(string_split(text, E'\\n')), E' \\t\\r') AS text FROM benchmark) SELECT text FROM a WHERE text <> '' INTERSECT SELECT text FROM b""")
def u03(t: Tables) -> DataFrame:
    lines = lambda df: df.select(F.explode(F.split("text", "\n")).alias("text"))
    return shared_texts(lines(t.documents), lines(t.benchmark))


@query("u04_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u04(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


def _ledger(t: Tables) -> tuple[DataFrame, DataFrame]:
    m = t.moments().select((F.col("event_id") % 700).alias("key"), "event_id", "kind", "score")
    return latest.first_by(m.where("event_id < 500"), ["key"], [F.col("event_id")]), m.where("event_id >= 400")


_L = "m AS (SELECT event_id % 700 AS key, event_id, kind, score FROM moments), st AS (SELECT * FROM m WHERE event_id < 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1), ba AS (SELECT * FROM m WHERE event_id >= 400)"


@query("u05_insert_or_ignore", f"WITH {_L} SELECT * FROM (SELECT *, 0 AS b FROM st UNION ALL SELECT *, 1 FROM ba) QUALIFY row_number() OVER (PARTITION BY key ORDER BY b, event_id) = 1", "moments")
def u05(t: Tables) -> DataFrame:
    stored, batch = _ledger(t)
    out = latest.insert_or_ignore(stored, batch, ["key"], "event_id")
    return out.join(stored.select("key", F.lit(0).alias("b")), "key", "left").withColumn("b", F.coalesce("b", F.lit(1)))


@query("u06_upsert", f"WITH {_L} SELECT key, event_id, kind, score FROM (SELECT *, 0 AS b FROM st UNION ALL SELECT *, 1 FROM ba) QUALIFY row_number() OVER (PARTITION BY key ORDER BY b DESC, event_id DESC) = 1", "moments")
def u06(t: Tables) -> DataFrame:
    stored, batch = _ledger(t)
    return latest.upsert(stored, batch, ["key"], "event_id")


@query("u07_guarded_upsert", "SELECT session_id, event_id, kind FROM moments QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY kind = 'purchase' DESC, event_id DESC) = 1", "moments")
def u07(t: Tables) -> DataFrame:
    return latest.guarded_upsert(t.moments(), ["session_id"], F.col("kind") == "purchase", "event_id").select("session_id", "event_id", "kind")


@query("u08_reconcile", """WITH e AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_orderkey % 3 > 0), s AS (SELECT l_orderkey AS k, CAST(max(l_orderkey % 1000) AS VARCHAR) AS v FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1)
 SELECT coalesce(e.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'insert' WHEN e.k IS NULL THEN 'delete' WHEN e.v IS DISTINCT FROM s.v THEN 'update' ELSE 'keep' END AS action FROM e FULL JOIN s ON e.k = s.k""")
def u08(t: Tables) -> DataFrame:
    e = t.orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("v"))
    s = t.lineitem.where("l_orderkey % 5 > 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.col("l_orderkey") % 1000).cast("string").alias("v"))
    return latest.reconcile(e, s, ["k"], "v")


@query("u10_batch_classification", f"WITH {_L} SELECT key, event_id, CASE WHEN key NOT IN (SELECT key FROM st) AND row_number() OVER (PARTITION BY key ORDER BY event_id) = 1 THEN 'new' ELSE 'duplicate' END AS status FROM ba", "moments")
def u10(t: Tables) -> DataFrame:
    stored, batch = _ledger(t)
    return latest.classify_batch(stored, batch, ["key"], "event_id").select("key", "event_id", "status")


@query("u11_steering_parent", "SELECT f.session_id, f.event_uuid, f.dedup_key, coalesce(j.is_steering, FALSE) AS steering FROM feedback f LEFT JOIN judged j USING (dedup_key) QUALIFY row_number() OVER (PARTITION BY f.session_id, f.event_uuid ORDER BY coalesce(j.is_steering, FALSE) DESC, f.id DESC) = 1", "feedback", "judged")
def u11(t: Tables) -> DataFrame:
    j = latest.latest_verdict(t.verdicts(), "judge").select("dedup_key", "is_steering")
    rows = t.feedback().join(j, "dedup_key", "left").withColumn("steering", F.coalesce("is_steering", F.lit(False)))
    return latest.first_by(rows, ["session_id", "event_uuid"], [F.desc("steering"), F.desc("id")]).select("session_id", "event_uuid", "dedup_key", "steering")
