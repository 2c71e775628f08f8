"""Window functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import latest, metrics
from verdigris.plans.base import Tables, query, scored, sessions


@query("w01_latest_verdicts", "SELECT dedup_key, role, prompt_version, is_steering, category, id FROM latest", "latest")
def w01(t: Tables) -> DataFrame:
    v = t.verdicts()
    return latest.latest_verdict(v, "judge").union(latest.latest_verdict(v, "auditor")).select("dedup_key", "role", "prompt_version", "is_steering", "category", "id")


@query("w02_latest_at_version", "SELECT dedup_key, is_steering, id FROM verdicts WHERE role = 'judge' AND prompt_version = 'v1' QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY judged_at DESC, id DESC) = 1", "verdicts")
def w02(t: Tables) -> DataFrame:
    return latest.latest_at_version(t.verdicts(), "judge", "v1").select("dedup_key", "is_steering", "id")


@query("w03_latest_generation", "SELECT dedup_key, prompt_version, refined_at, pair_index FROM (SELECT *, dense_rank() OVER (PARTITION BY dedup_key ORDER BY prompt_version DESC, model DESC, refined_at DESC) AS g FROM pairs) WHERE g = 1", "pairs")
def w03(t: Tables) -> DataFrame:
    return latest.latest_generation(t.pairs(), ["dedup_key"], ["prompt_version", "model", "refined_at"]).select("dedup_key", "prompt_version", "refined_at", "pair_index")


@query("w04_freshest", "SELECT event_id, session_id, CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'fresh' ELSE 'expired' END AS state FROM moments WHERE kind = 'purchase'", "moments")
def w04(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.moments().where("kind = 'purchase'").select("event_id", "session_id", F.when(n == 1, "fresh").otherwise("expired").alias("state"))


def tail_messages(turns: DataFrame, cap: int) -> DataFrame:
    """The newest whole messages of a session whose contents fit the cap; an oversize newest one keeps its own tail."""
    after = Window.partitionBy("session_id").orderBy("turn").rowsBetween(0, Window.unboundedFollowing)
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("__sum", F.sum(F.length("text")).over(after)).withColumn("__n", F.row_number().over(newest))
    text = F.when((F.col("__n") == 1) & (F.length("text") > cap), F.substring("text", -cap, cap)).otherwise(F.col("text"))
    return rows.where((F.col("__sum") <= cap) | (F.col("__n") == 1)).select("session_id", "turn", "role", text.alias("text"))


@query("w05_tail_messages", "WITH s AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM turns) SELECT session_id, turn, CASE WHEN n = 1 AND length(text) > 600 THEN right(text, 600) ELSE text END AS text FROM s WHERE z <= 600 OR n = 1", "turns")
def w05(t: Tables) -> DataFrame:
    return tail_messages(t.turns(), 600).select("session_id", "turn", "text")


@query("w06_mid_ranks", "SELECT doc_id, rank() OVER (ORDER BY base) + (count(*) OVER (PARTITION BY base) - 1) / 2.0 AS mid_rank FROM scored", "scored")
def w06(t: Tables) -> DataFrame:
    return metrics.mid_ranks(scored(t), "base").select("doc_id", "mid_rank")


@query("w07_prior_assistant", "SELECT session_id, turn, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM turns", "turns")
def w07(t: Tables) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("role") == "assistant", F.col("text"))
    return t.turns().select("session_id", "turn", F.last(said, ignorenulls=True).over(w).alias("prior"))


def context_window(turns: DataFrame, before: int = 6, after: int = 2, preview: int = 40) -> DataFrame:
    """Each turn with the turns before and after it, clipped."""
    w = Window.partitionBy("session_id").orderBy("turn")
    p = T.clip(F.col("text"), preview)
    return turns.select("session_id", "turn", F.collect_list(p).over(w.rowsBetween(-before, -1)).alias("before"), p.alias("trigger"), F.collect_list(p).over(w.rowsBetween(1, after)).alias("after"))


@query("w08_context_window", """WITH p AS (SELECT session_id, turn, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 40) || '…(+' || (length(text) - 40) || 'ch)' END AS p FROM turns)
 SELECT session_id, turn, coalesce(array_to_string(list(p) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '|'), '') AS before, p AS trigger, coalesce(array_to_string(list(p) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '') AS after FROM p""", "turns")
def w08(t: Tables) -> DataFrame:
    return context_window(t.turns()).select("session_id", "turn", F.array_join("before", "|").alias("before"), "trigger", F.array_join("after", "|").alias("after"))


def anchored_split(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """session_id, anchor, before, trigger: the events of the anchor's turn before the anchor join the context, the rest is
    the trigger.  An anchor that opens its turn, or that no user spoke, leaves the turn whole; one that isn't there is
    an error.  events: session_id, turn, seq (within the turn), role, name; anchors: session_id, turn, anchor (a name)."""
    list_ = F.array_sort(F.collect_list(F.struct("seq", "role", "name")))
    e = events.groupBy("session_id", "turn").agg(list_.alias("e"))
    met = anchors.join(e, ["session_id", "turn"], "left")
    at = F.array_position(F.transform("e", lambda x: x["name"]), F.col("anchor"))
    checked = F.when(F.coalesce(at, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("no anchor "), F.col("anchor"))).cast("bigint")).otherwise(at).cast("int")
    met = met.withColumn("at", checked)
    cut = F.when((F.col("at") > 1) & (F.element_at("e", F.col("at"))["role"] == "user"), F.col("at")).otherwise(1)
    names = lambda c: F.transform(c, lambda x: x["name"])
    return met.withColumn("cut", cut).select("session_id", "anchor", names(F.slice("e", 1, F.col("cut") - 1)).alias("before"), names(F.slice("e", F.col("cut"), F.size("e"))).alias("trigger"))


@query("w09_anchored_split", """WITH e AS (SELECT session_id, turn // 3 AS turn, turn AS seq, role, 'e' || turn AS name FROM turns), a AS (SELECT session_id, turn, arg_max(name, seq) AS anchor FROM e GROUP BY 1, 2),
 x AS (SELECT a.session_id, a.anchor, e.name, e.seq, CASE WHEN c.role = 'user' AND EXISTS (SELECT 1 FROM e f WHERE f.session_id = a.session_id AND f.turn = a.turn AND f.seq < c.seq) THEN c.seq ELSE 0 END AS cut FROM a JOIN e c ON c.session_id = a.session_id AND c.name = a.anchor JOIN e ON e.session_id = a.session_id AND e.turn = a.turn)
 SELECT session_id, anchor, coalesce(string_agg(name, ',' ORDER BY seq) FILTER (seq < cut), '') AS before, string_agg(name, ',' ORDER BY seq) FILTER (seq >= cut) AS trigger FROM x GROUP BY 1, 2""", "turns")
def w09(t: Tables) -> DataFrame:
    """Three messages stand for a turn's events; its last one is the anchor."""
    e = t.turns().select("session_id", F.floor(F.col("turn") / 3).alias("turn"), F.col("turn").alias("seq"), "role", F.concat(F.lit("e"), F.col("turn").cast("string")).alias("name"))
    anchors = e.groupBy("session_id", "turn").agg(F.max_by("name", "seq").alias("anchor"))
    out = anchored_split(e, anchors)
    return out.select("session_id", "anchor", F.array_join("before", ",").alias("before"), F.array_join("trigger", ",").alias("trigger"))


@query("w10_live_window", "SELECT session_id, array_to_string(list_transform(messages[greatest(len(messages) - 6, 1):len(messages) - 1], lambda m: m.role), ',') AS roles FROM sessions WHERE len(messages) >= 2", "sessions")
def w10(t: Tables) -> DataFrame:
    """The last six turns up to the last completed one."""
    m, n = F.col("messages"), F.size("messages")
    start = F.greatest(n - 6, F.lit(1))
    return sessions(t.turns()).where(n >= 2).select("session_id", F.array_join(F.transform(F.slice(m, start, n - start), lambda x: x["role"]), ",").alias("roles"))


@query("w11_rewinds", "SELECT session_id, CAST(k AS INTEGER) AS k, CAST(len(messages) - k AS INTEGER) AS kept, messages[len(messages) - k].role AS last_role FROM sessions, range(0, 6) r(k) WHERE k < len(messages)", "sessions")
def w11(t: Tables) -> DataFrame:
    n = F.size("messages")
    rows = sessions(t.turns()).select("session_id", "messages", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).where(F.col("k") < n)
    return rows.select("session_id", "k", (n - F.col("k")).alias("kept"), F.element_at("messages", n - F.col("k"))["role"].alias("last_role"))


def confidence_sequence(rows: DataFrame, key: str, order: list, x: str, alpha: float = 0.05, truncation: float = 0.5) -> DataFrame:
    """rows with t, low and high: a predictable-mixture empirical-Bernstein sequence of each key's stream of [0, 1] values.

    All sums run over a key's stream in order; streams of different keys are independent partitions."""
    w = Window.partitionBy(key).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    log_term = math.log(2 / alpha)
    out = rows.withColumn("t", F.row_number().over(w))
    for side in ("low", "high"):
        v = F.col(x).cast("double") if side == "low" else 1 - F.col(x).cast("double")
        out = out.withColumn("__x", v).withColumn("__s", F.sum("__x").over(past))
        out = out.withColumn("__q", F.pow(F.col("__x") - F.least((0.5 + F.col("__s")) / (F.col("t") + 1), F.lit(1.0)), 2)).withColumn("__v", (0.25 + F.sum("__q").over(past)) / (F.col("t") + 1))
        out = out.withColumn("__lam", F.least(F.lit(truncation), F.sqrt(2 * log_term / (F.col("t") * F.log(1.0 + F.col("t")) * F.coalesce(F.lag("__v").over(w), F.lit(0.25))))))
        out = out.withColumn("__m", F.coalesce(F.lag("__s").over(w), F.lit(0.0)) / F.greatest(F.col("t") - 1, F.lit(1)))
        out = out.withColumn("__p", F.pow(F.col("__x") - F.col("__m"), 2) * (-F.log(1 - F.col("__lam")) - F.col("__lam")))
        raw = F.greatest((F.sum(F.col("__lam") * F.col("__x")).over(past) - log_term - F.sum("__p").over(past)) / F.sum("__lam").over(past), F.lit(0.0))
        out = out.withColumn("__raw", raw)
        bound = F.max("__raw").over(past)
        out = out.withColumn(side, bound if side == "low" else 1 - bound)
    return out.drop("__x", "__s", "__q", "__v", "__lam", "__m", "__p", "__raw")


def _cs(x: str, side: str) -> str:
    return f"""{side}1 AS (SELECT k, t, {x} AS x, sum({x}) OVER w AS s FROM o WINDOW w AS (PARTITION BY k ORDER BY t)), {side}2 AS (SELECT *, (0.25 + sum((x - least((0.5 + s) / (t + 1), 1.0)) ** 2) OVER w) / (t + 1) AS v FROM {side}1 WINDOW w AS (PARTITION BY k ORDER BY t)),
 {side}3 AS (SELECT *, least(0.5, sqrt(2 * ln(40.0) / (t * ln(1.0 + t) * coalesce(lag(v) OVER w, 0.25)))) AS l, coalesce(lag(s) OVER w, 0.0) / greatest(t - 1, 1) AS m FROM {side}2 WINDOW w AS (PARTITION BY k ORDER BY t)),
 {side} AS (SELECT k, t, greatest((sum(l * x) OVER w - ln(40.0) - sum((x - m) ** 2 * (-ln(1 - l) - l)) OVER w) / sum(l) OVER w, 0.0) AS raw FROM {side}3 WINDOW w AS (PARTITION BY k ORDER BY t))"""


@query("w12_confidence_sequence", f"""WITH o AS (SELECT session_id AS k, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS t, CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM moments), {_cs('x', 'lo')}, {_cs('1 - x', 'hi')}
 SELECT lo.k AS session_id, CAST(lo.t AS INTEGER) AS t, round(max(lo.raw) OVER w, 7) AS low, round(1 - max(hi.raw) OVER w, 7) AS high FROM lo JOIN hi ON lo.k = hi.k AND lo.t = hi.t WINDOW w AS (PARTITION BY lo.k ORDER BY lo.t)""", "moments")
def w12(t: Tables) -> DataFrame:
    rows = t.moments().select("session_id", "ts", "event_id", (F.col("score") > 0.5).cast("int").alias("x"))
    return confidence_sequence(rows, "session_id", ["ts", "event_id"], "x").select("session_id", "t", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"))


@query("w13_rank_bands", """WITH r AS (SELECT doc_id, kind, ntile(4) OVER (PARTITION BY kind ORDER BY base DESC, doc_id) AS band FROM scored), n AS (SELECT *, row_number() OVER (PARTITION BY kind, band ORDER BY sha256('7:' || doc_id), doc_id) AS p FROM r) SELECT doc_id, kind, CAST(band AS INTEGER) AS band FROM n WHERE p <= ([4, 3, 2, 1])[band]""", "scored")
def w13(t: Tables) -> DataFrame:
    """Of four bands by score, 4, 3, 2 and 1 rows in hash order."""
    r = scored(t).select("doc_id", "kind", F.ntile(4).over(Window.partitionBy("kind").orderBy(F.desc("base"), "doc_id")).alias("band"))
    p = F.row_number().over(Window.partitionBy("kind", "band").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id"))
    return r.withColumn("p", p).where(F.col("p") <= F.element_at(F.array(*map(F.lit, (4, 3, 2, 1))), F.col("band"))).select("doc_id", "kind", "band")


@query("w14_pair_ids", "SELECT dedup_key, pair_index, row_number() OVER (PARTITION BY dedup_key ORDER BY refined_at, pair_index) AS place FROM pairs WHERE prompt_version = 'r1'", "pairs")
def w14(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("dedup_key").orderBy("refined_at", "pair_index")).cast("long")
    return t.pairs().where("prompt_version = 'r1'").select("dedup_key", "pair_index", n.alias("place"))


@query("w15_quiet_sessions", "SELECT session_id, max(ts) <= TIMESTAMP '2024-01-29 12:00:00' AS quiet FROM moments WHERE ts <= TIMESTAMP '2024-01-30' GROUP BY 1", "moments")
def w15(t: Tables) -> DataFrame:
    now = F.expr("timestamp_ntz '2024-01-30'")
    return t.moments().where(F.col("ts") <= now).groupBy("session_id").agg((F.max("ts") <= now - F.expr("interval 12 hours")).alias("quiet"))
