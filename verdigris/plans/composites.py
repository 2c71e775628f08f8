"""Composite operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import hashing
from verdigris.functions import text as T
from verdigris.operators import asks, dedup, latest, metrics
from verdigris.plans import aggregates, decisions, joins
from verdigris.plans.decisions import HITS
from verdigris.plans.base import Tables, query, scored, sessions
from verdigris.sources.staging import folder, shared


def ask_entries(t: Tables) -> DataFrame:
    """session_id, line_no, line: transcript lines in which assistant turns ask with words of their text, as recorded over
    several versions: options as objects or labels, answers as text or list, results that are a text, missing or typed."""
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    turns = t.turns().where("role = 'assistant'").withColumn("w", F.regexp_extract_all("text", F.lit(r"\S+"), 0))
    said = F.concat_ws(" ", w(0), w(1), w(2))
    name = F.when(F.col("turn") % 5 < 4, asks.TOOL).otherwise("Bash")
    struct = lambda **fields: F.struct(*(v.alias(k) for k, v in fields.items()))
    call = struct(type=F.lit("tool_use"), id=F.concat(F.lit("t"), "turn"), name=name)
    content = F.when(F.col("turn") % 5 == 3, F.to_json(F.array(call))).otherwise(F.concat(F.lit('[{"type":"text","text":"asking"},'), F.to_json(call), F.lit("]")))
    use = F.concat(F.lit('{"type":"assistant","uuid":"u'), "turn", F.lit('","timestamp":"2024-01-01T00:00:00Z","message":{"role":"assistant","content":'), content, F.lit("}}"))
    first = struct(question=F.concat(said, F.lit("?")), header=w(0), options=F.array(*(struct(label=F.concat(w(i), F.lit(f"-{i}"))) for i in (0, 1))))
    second = struct(question=F.concat(said, F.lit(" more?")), options=F.array(*(F.concat(w(i), F.lit(f"-{i}")) for i in (2, 0))), multiSelect=F.lit(True))
    one = F.when(F.col("turn") % 3 < 2, F.concat(F.when(F.col("turn") % 3 == 0, w(0)).otherwise(w(1)), F.lit("-"), F.col("turn") % 3)).otherwise("something else")
    answers = F.concat(F.lit("{"), F.to_json(F.create_map(first["question"], one)).substr(F.lit(2), F.length(F.to_json(F.create_map(first["question"], one))) - 2), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(","), F.to_json(F.create_map(second["question"], F.array(F.concat(w(0), F.lit("-0")), F.concat(w(2), F.lit("-2"))))).substr(F.lit(2), F.lit(1 << 20)))).otherwise("}"))
    typed = F.concat(F.lit('{"questions":['), F.to_json(first), F.lit(","), F.to_json(second), F.lit('],"answers":'), answers, F.lit("}"))
    result = F.when(F.col("turn") % 7 == 6, F.lit('"declined"')).when(F.col("turn") % 7 == 4, F.lit('{"error":{"code":1}}')).otherwise(typed)
    came = F.concat(F.lit('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t'), "turn", F.lit('"}]},"toolUseResult":'), result, F.lit("}"))
    rows = turns.select("session_id", F.posexplode(F.array(use, F.when(F.col("turn") % 7 != 5, came), F.substring(use, 1, 40))).alias("i", "line"), "turn")
    return rows.where("line is not null").select("session_id", (F.col("turn") * 3 + F.col("i")).alias("line_no"), "line")


_ASKED = """asked AS (SELECT session_id, turn, [coalesce(x, '') FOR x IN [w[1], w[2], w[3]]] AS w FROM (SELECT session_id, turn, regexp_extract_all(text, '\\S+') AS w FROM turns WHERE role = 'assistant' AND turn % 5 < 4)),
 rounds AS (SELECT session_id, turn, 0 AS i, w[1] || ' ' || w[2] || ' ' || w[3] || '?' AS question, w[1] AS header, w[1] || '-0|' || w[2] || '-1' AS options, CASE turn % 3 WHEN 0 THEN w[1] || '-0' WHEN 1 THEN w[2] || '-1' ELSE 'something else' END AS answer, CASE turn % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '' END AS picks, turn % 3 = 2 AS custom FROM asked WHERE turn % 7 NOT IN (4, 5, 6)
 UNION ALL SELECT session_id, turn, 1, w[1] || ' ' || w[2] || ' ' || w[3] || ' more?', '', w[3] || '-2|' || w[1] || '-0', CASE WHEN turn % 2 = 0 THEN w[1] || '-0, ' || w[3] || '-2' END, CASE WHEN turn % 2 = 0 THEN '1,0' ELSE '' END, FALSE FROM asked WHERE turn % 7 NOT IN (4, 5, 6))"""


@query("n01_decision_rounds", f"""WITH {_ASKED} SELECT session_id, 'u' || turn AS event_uuid, i AS round_index, question, header, options, answer, picks, custom, NULL AS result_type FROM rounds
 UNION ALL SELECT session_id, 'u' || turn, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE turn % 7 WHEN 4 THEN 'object' WHEN 5 THEN 'none' ELSE 'string' END FROM asked WHERE turn % 7 IN (4, 5, 6)""", "turns")
def n01(t: Tables) -> DataFrame:
    """Rounds of raw entries, and the uses whose result isn't typed with what stands in its place."""
    rounds, apart = asks.ask_rounds(ask_entries(t))
    rows = rounds.select("session_id", "event_uuid", "round_index", "question", "header", F.array_join("options", "|").alias("options"), "answer", F.array_join(F.transform("chosen_index", lambda x: x.cast("string")), ",").alias("picks"), F.col("is_custom").alias("custom"), F.lit(None).cast("string").alias("result_type"))
    return rows.unionByName(apart.select("session_id", "event_uuid", "result_type"), allowMissingColumns=True)


@query("n02_steer_type_rows")
def n02(t: Tables) -> DataFrame:
    """Role-blocked text of each judged row, one of each group of near-duplicates."""
    j = latest.latest_verdict(t.verdicts(), "judge").select("dedup_key", "category")
    blocks = T.flatten(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    rows = t.feedback().join(j, "dedup_key").select("dedup_key", blocks.alias("text"), "category")
    path = folder(t.spark, "steer-types")
    dedup.write_collapsed(rows, "dedup_key", "text", path)
    return t.spark.read.schema(rows.schema).parquet(f"{path}/rows")


def picks(rounds: DataFrame) -> DataFrame:
    """Rounds of the test split with one choice, on the menu, of two options at least, one of each group of near-duplicates by
    question and options."""
    rows = rounds.where("split = 'test' and not multi_select and not is_custom and size(chosen_index) = 1 and size(options) >= 2")
    rows = shared(rows.dropDuplicates(["id"]).select("id", "session_id", "event_uuid", F.concat_ws("\n", "question", "options").alias("text"), F.col("chosen_index")[0].alias("chosen")), "picks")
    kept = dedup.collapse(rows.select("id", "text"), "id", "text").where("id = representative").select("id")
    return rows.join(kept, "id")


@query("n03_pick_rows")
def n03(t: Tables) -> DataFrame:
    rounds, _ = asks.ask_rounds(ask_entries(t))
    return picks(rounds).select("session_id", "event_uuid", "chosen")


@query("n04_visible_turns", "SELECT session_id, CAST(CASE WHEN messages[-1].role = 'assistant' THEN len(messages) ELSE len(messages) - 1 END AS INTEGER) AS visible FROM sessions", "sessions")
def n04(t: Tables) -> DataFrame:
    m, n = F.col("messages"), F.size("messages")
    seen = F.when(F.element_at(m, -1)["role"] == "assistant", m).otherwise(F.slice(m, 1, n - 1))
    return sessions(t.turns()).select("session_id", F.size(seen).alias("visible"))


@query("n05_ask_recovery", """WITH c AS (SELECT session_id, len(messages) AS n, messages[-1].content AS last, [coalesce(x, '') FOR x IN [w[1], w[2], w[3]]] AS w FROM (SELECT *, regexp_extract_all(coalesce(messages[1].content, ''), '\\S+') AS w FROM sessions))
 SELECT session_id, CAST(CASE WHEN n % 2 = 0 OR n % 3 > 0 THEN n + 1 ELSE n END AS INTEGER) AS messages, CASE WHEN n % 2 = 0 THEN '[assistant asked: H] same' WHEN n % 3 = 0 THEN coalesce(last, '') ELSE CASE WHEN w[1] = '' THEN '[assistant asked] ' ELSE '[assistant asked: ' || w[1] || '] ' END || w[1] || ' ' || w[2] || ' ' || w[3] || '?' || CASE WHEN n % 5 = 0 AND w[2] <> '' THEN E'\\n(recommended: ' || w[2] || ')' ELSE '' END END AS last FROM c""", "sessions")
def n05(t: Tables) -> DataFrame:
    """Contexts of which some hold a previewed ask, which is rewritten; answered questions whose ask is missing get it back."""
    n, w = F.size("messages"), F.regexp_extract_all(F.coalesce(F.get("messages", F.lit(0))["content"], F.lit("")), F.lit(r"\S+"), 0)
    word = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    meta = F.to_json(F.struct(F.concat(F.concat_ws(" ", word(0), word(1), word(2)), F.lit("?")).alias("question"), word(0).alias("header"), F.when(n % 5 == 0, word(1)).alias("recommended_pick"), F.lit("no one's business").alias("answer")))
    preview = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("AskUserQuestion([{'question': 'same', 'header': 'H'}])").alias("content")))
    context = F.when(n % 2 == 0, F.concat("messages", preview)).otherwise(F.col("messages"))
    prompt = asks.with_ask(context, F.when(n % 3 == 0, "free_text").otherwise("question_answer"), meta)
    return sessions(t.turns()).select("session_id", prompt.alias("p")).select("session_id", F.size("p").alias("messages"), F.element_at("p", -1)["content"].alias("last"))


@query("n06_preference_pairs", "SELECT o_orderkey, l_linenumber, o_orderpriority || '>' || l_returnflag AS chosen, o_orderstatus || '>' || l_linestatus AS rejected FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority IS NOT NULL AND l_returnflag IS NOT NULL AND o_orderstatus IS NOT NULL AND l_linestatus IS NOT NULL")
def n06(t: Tables) -> DataFrame:
    sides = ["o_orderpriority", "l_returnflag", "o_orderstatus", "l_linestatus"]
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).dropna(subset=sides)
    return rows.select("o_orderkey", "l_linenumber", F.concat_ws(">", "o_orderpriority", "l_returnflag").alias("chosen"), F.concat_ws(">", "o_orderstatus", "l_linestatus").alias("rejected"))


@query("n07_fidelity_upgrade", "SELECT session_id, kind, event_id, score > 0.8 AS whole FROM moments QUALIFY row_number() OVER (PARTITION BY session_id, kind ORDER BY score > 0.8 DESC, event_id) = 1", "moments")
def n07(t: Tables) -> DataFrame:
    """The first verdict stays, but for a full one that takes a summary's place."""
    rows = t.moments().withColumn("whole", F.col("score") > 0.8)
    return latest.first_by(rows, ["session_id", "kind"], [F.desc("whole"), F.col("event_id")]).select("session_id", "kind", "event_id", "whole")


@query("n08_accrual", """WITH n AS (SELECT session_id, turn, text, 1 AS new FROM turns WHERE turn > 2), o AS (SELECT session_id, turn, text, 0 AS new FROM turns WHERE turn <= 3)
 SELECT session_id, turn, CASE WHEN new = 1 AND length(text) < 60 THEN 'blank_before' END AS reason FROM (SELECT * FROM o UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY new) = 1""", "turns")
def n08(t: Tables) -> DataFrame:
    """New rows with a blank context get a reason; stored rows are left as they are."""
    tagged = t.turns().where("turn <= 3").withColumn("new", F.lit(0)).unionByName(t.turns().where("turn > 2").withColumn("new", F.lit(1)))
    rows = latest.first_by(tagged, ["session_id", "turn"], [F.col("new")])
    return rows.select("session_id", "turn", F.when((F.col("new") == 1) & (F.length("text") < 60), "blank_before").alias("reason"))


@query("n09_gate_insert", "SELECT session_id, min(turn) AS turn FROM turns WHERE regexp_matches(text, '\\S') AND length(text) > 30 GROUP BY 1", "turns")
def n09(t: Tables) -> DataFrame:
    rows = t.turns().where(T.substantive(F.col("text")) & (F.length("text") > 30))
    return latest.first_by(rows, ["session_id"], [F.col("turn")]).select("session_id", "turn")


@query("n10_lineage", "SELECT dedup_key, (SELECT string_agg(role || ':' || prompt_version || ':' || id, ',' ORDER BY role, prompt_version, id) FROM verdicts v WHERE v.dedup_key = f.dedup_key) AS verdicts, (SELECT count(*) FROM pairs p WHERE p.dedup_key = f.dedup_key) AS pairs FROM feedback f", "feedback", "verdicts", "pairs")
def n10(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("role", "prompt_version", "id")))
    v = t.verdicts().groupBy("dedup_key").agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["role"], r["prompt_version"], r["id"].cast("string"))), ",").alias("verdicts"))
    p = t.pairs().groupBy("dedup_key").agg(F.count("*").alias("pairs"))
    return t.feedback().select("dedup_key").join(v, "dedup_key", "left").join(p, "dedup_key", "left").select("dedup_key", "verdicts", F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query("n11_session_ranges", "SELECT session_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS stop FROM moments GROUP BY 1 HAVING count(*) > 1", "moments")
def n11(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t.moments().groupBy("session_id").agg(us(F.min("ts")).alias("start"), us(F.max("ts")).alias("stop"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("n12_latest_attribute", "SELECT session_id, max_by(CASE WHEN kind = 'view' THEN event_id END, ts) FILTER (kind = 'view') AS last_view FROM moments GROUP BY 1", "moments")
def n12(t: Tables) -> DataFrame:
    return t.moments().groupBy("session_id").agg(F.max(F.when(F.col("kind") == "view", F.struct("ts", "event_id")))["event_id"].alias("last_view"))


@query("n13_steer_turns", "SELECT t.session_id, t.turn FROM turns t JOIN (SELECT DISTINCT CAST(event_id % 40 AS VARCHAR) AS session_id, event_id % 7 AS turn FROM moments WHERE kind = 'error') e ON t.session_id = e.session_id AND t.turn = e.turn", "turns", "moments")
def n13(t: Tables) -> DataFrame:
    found = t.moments().where("kind = 'error'").select((F.col("event_id") % 40).cast("string").alias("session_id"), (F.col("event_id") % 7).alias("turn")).distinct()
    return t.turns().select("session_id", "turn").join(found, ["session_id", "turn"])


@query("n14_reaction_attribution", f"WITH r AS ({joins._REPLY}) SELECT m.event_id AS delivery_id, CASE WHEN m.event_id % 5 = 0 THEN 'expired' ELSE {aggregates._KIND} END AS reaction FROM moments m LEFT JOIN r ON m.event_id = r.delivery_id WHERE m.kind = 'purchase' AND m.event_id % 5 < 4", "moments")
def n14(t: Tables) -> DataFrame:
    """Expired deliveries are expired, delivered ones get their reply's reaction, held-out ones none."""
    r = aggregates.reactions(t).where("delivery_id % 5 < 4")
    return r.select("delivery_id", F.when(F.col("delivery_id") % 5 == 0, "expired").otherwise(F.col("reaction")).alias("reaction"))


@query("n15_bulk_transition", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'expired' ELSE o_orderstatus END AS state, count(*) AS n FROM orders GROUP BY 1")
def n15(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "P", "expired").otherwise(F.col("o_orderstatus"))
    return t.orders.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("n16_subset_check", "SELECT count(*) AS missing FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def n16(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("missing"))


@query("n17_drift", "SELECT round(max(abs(base - candidate)), 9) AS worst, round(median(abs(base - candidate)), 9) AS middle, CAST(sum(CASE WHEN abs(base - candidate) > 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS over FROM scored", "scored")
def n17(t: Tables) -> DataFrame:
    d = F.abs(F.col("base") - F.col("candidate"))
    return scored(t).agg(F.round(F.max(d), 9).alias("worst"), F.round(F.median(d), 9).alias("middle"), F.count_if(d > 0.25).alias("over"))


@query("n18_checkpoint_ranking", "WITH c AS (SELECT label, unnest(['base', 'candidate', 'mean', 'steady']) AS checkpoint, unnest([base, candidate, (base + candidate) / 2, 0.5]) AS p FROM scored), a AS (SELECT checkpoint, round(avg(CASE WHEN p.p > n.p THEN 1.0 WHEN p.p = n.p THEN 0.5 ELSE 0.0 END), 9) AS auc FROM c p JOIN c n USING (checkpoint) WHERE p.label AND NOT n.label GROUP BY 1) SELECT checkpoint, auc, CAST(row_number() OVER (ORDER BY auc DESC, checkpoint) AS INTEGER) AS place FROM a", "scored")
def n18(t: Tables) -> DataFrame:
    """Stored probabilities of any number of checkpoints, ranked by AUC."""
    arms = F.create_map(F.lit("base"), "base", F.lit("candidate"), "candidate", F.lit("mean"), (F.col("base") + F.col("candidate")) / 2, F.lit("steady"), F.lit(0.5))
    return metrics.ranked_checkpoints(scored(t).select("label", F.explode(arms).alias("checkpoint", "p")), "label", "checkpoint", "p")


@query("n19_comparison", "SELECT doc_id, base, candidate, label FROM scored", "scored")
def n19(t: Tables) -> DataFrame:
    """Both arms' probabilities, kept by version and id, side by side on the frame."""
    store = scored(t).select("doc_id", F.explode(F.create_map(F.lit("base"), "base", F.lit("candidate"), "candidate")).alias("version", "p"))
    wide = store.groupBy("doc_id").pivot("version", ["base", "candidate"]).agg(F.first("p"))
    return wide.join(scored(t).select("doc_id", "label"), "doc_id")


@query("n21_label_queue", "SELECT 0 AS part, doc_id AS seq, d.text AS text FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 UNION ALL SELECT 1, item_id, text FROM benchmark")
def n21(t: Tables) -> DataFrame:
    a = t.labels.where("quality = 1").join(t.documents, "doc_id").select(F.lit(0).alias("part"), F.col("doc_id").alias("seq"), "text")
    return a.unionByName(t.benchmark.select(F.lit(1).alias("part"), F.col("item_id").alias("seq"), "text")).orderBy("part", "seq")


@query("n22_complete_or_nothing", "SELECT event_id FROM moments WHERE kind = 'view' AND (SELECT bool_and(props IS NOT NULL) FROM moments WHERE kind = 'view')", "moments")
def n22(t: Tables) -> DataFrame:
    rows = t.moments().where("kind = 'view'")
    gate = rows.agg(F.every(F.col("props").isNotNull()).alias("whole"))
    return rows.join(F.broadcast(gate), F.col("whole")).select("event_id")


@query("n23_trajectory", """SELECT session_id, turn // 2 AS step, max(CASE WHEN role = 'user' THEN text END) AS prompt, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS prose, CAST(sum(CASE WHEN length(text) % 3 = 0 AND role = 'user' THEN 1 ELSE 0 END) > 0 AS BOOLEAN) AS steered FROM turns WHERE regexp_matches(text, '\\S') GROUP BY 1, 2""", "turns")
def n23(t: Tables) -> DataFrame:
    user = F.col("role") == "user"
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.col("text").alias("x")))))
    joined = F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda x: x["x"]), " "))
    rows = t.turns().where(T.strip(F.col("text")) != "")
    return rows.groupBy("session_id", F.floor(F.col("turn") / 2).cast("long").alias("step")).agg(F.max(F.when(user, F.col("text"))).alias("prompt"), joined.alias("prose"), (F.count_if(user & (F.length("text") % 3 == 0)) > 0).alias("steered"))


@query("n24_strict_cut", "SELECT event_id, round(1 - score, 9) AS fire, 1 - score > 1 - 0.1 AS fires FROM moments", "moments")
def n24(t: Tables) -> DataFrame:
    return t.moments().select("event_id", F.round(1 - F.col("score"), 9).alias("fire"), (1 - F.col("score") > 0.9).alias("fires"))


@query("n25_hydrated_hits", "WITH " + HITS + " SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, h.doc_id) AS INTEGER) AS place, h.doc_id, d.lang FROM hits h JOIN documents d ON d.doc_id = h.doc_id")
def n25(t: Tables) -> DataFrame:
    """Hits of a search in their order with their documents; stale hits drop out.  The hits are the limit's at most."""
    hits = decisions.index_of(t).search("the and of", 50).withColumnRenamed("id", "doc_id")
    placed = hits.select("doc_id", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id")).alias("place"))
    return F.broadcast(placed).join(t.documents, "doc_id").select("place", "doc_id", "lang")


def until_settled(step, cap: int) -> int:
    """Calls step() until it says that nothing was new, at most cap times; the number of calls."""
    for n in range(1, cap + 1):
        if not step():
            return n
    return cap


@query("n20_sweep", "SELECT count(DISTINCT session_id) AS sampled, CAST(ceil(count(DISTINCT session_id) / greatest(10, ceil(count(DISTINCT session_id) / 4))) + 1 AS INTEGER) AS passes FROM turns", "turns")
def n20(t: Tables) -> DataFrame:
    """Sampling a quarter of the sessions at a time until a pass finds none; what is done is a written table."""
    from verdigris.operators.sampling import draw

    every = t.turns().select("session_id").distinct()
    done, size = [t.spark.createDataFrame([], "session_id string")], max(10, -(-every.count() // 4))

    def step() -> bool:
        new = shared(every.join(done[0], "session_id", "left_anti").orderBy(draw(9, F.col("session_id")), "session_id").limit(size), "sampled")
        done[0] = shared(done[0].union(new), "done")
        return new.limit(1).count() > 0

    passes = until_settled(step, 1000)
    return done[0].agg(F.count("*").alias("sampled"), F.lit(passes).alias("passes"))
