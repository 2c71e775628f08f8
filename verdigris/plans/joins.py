"""Joins (J1–J23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators import latest, similarity, temporal
from verdigris.sources.staging import shared
from verdigris.plans.base import Tables, query


def accepted(t: Tables) -> DataFrame:
    """Feedback whose latest judgement is steering and that isn't quarantined."""
    judged = latest.latest_verdict(t.verdicts(), "judge").where("is_steering").select("dedup_key", "category", "confidence")
    return t.feedback().where("quarantined_reason is null").join(judged, "dedup_key")


@query("j01_accepted_view", "SELECT dedup_key, source_kind, session_id, category, confidence FROM accepted", "accepted")
def j01(t: Tables) -> DataFrame:
    return accepted(t).select("dedup_key", "source_kind", "session_id", "category", "confidence")


@query("j01_accepted_by_category", "SELECT category, count(*) AS accepted, count(DISTINCT session_id) AS sessions, round(avg(confidence), 9) AS mean_confidence FROM accepted GROUP BY category", "accepted")
def j01b(t: Tables) -> DataFrame:
    return accepted(t).groupBy("category").agg(F.count("*").alias("accepted"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


@query("j02_candidates", """WITH a AS (SELECT dedup_key, is_steering AS a_side FROM latest WHERE role = 'auditor'), fl AS (SELECT dedup_key, count(DISTINCT is_steering) > 1 AS flipped FROM verdicts WHERE role = 'judge' GROUP BY 1),
 rf AS (SELECT dedup_key, count(*) AS pairs, max(prompt_version) AS version FROM pairs GROUP BY 1)
 SELECT f.dedup_key, j.is_steering, a.a_side, coalesce(fl.flipped, FALSE) AS flipped, coalesce(rf.pairs, 0) AS pairs, rf.version FROM feedback f LEFT JOIN judged j USING (dedup_key) LEFT JOIN a USING (dedup_key) LEFT JOIN fl USING (dedup_key) LEFT JOIN rf USING (dedup_key)""", "feedback", "judged", "pairs")
def j02(t: Tables) -> DataFrame:
    v = t.verdicts()
    j = latest.latest_verdict(v, "judge").select("dedup_key", "is_steering")
    a = latest.latest_verdict(v, "auditor").select("dedup_key", F.col("is_steering").alias("a_side"))
    flips = v.where("role = 'judge'").groupBy("dedup_key").agg((F.count_distinct("is_steering") > 1).alias("flipped"))
    refined = t.pairs().groupBy("dedup_key").agg(F.count("*").alias("pairs"), F.max("prompt_version").alias("version"))
    out = t.feedback().select("dedup_key")
    for side in (j, a, flips, refined):
        out = out.join(side, "dedup_key", "left")
    return out.select("dedup_key", "is_steering", "a_side", F.coalesce("flipped", F.lit(False)).alias("flipped"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "version")


@query("j03_refined_pairs", """WITH lp AS (SELECT p.* FROM pairs p JOIN (SELECT dedup_key, max(struct_pack(a := prompt_version, b := model, c := refined_at)) AS g FROM pairs GROUP BY 1) m ON p.dedup_key = m.dedup_key AND p.prompt_version = m.g.a AND p.model = m.g.b AND p.refined_at = m.g.c)
 SELECT lp.dedup_key, a.source_kind, a.category, lp.pair_index, lp.direction FROM lp JOIN accepted a USING (dedup_key)""", "pairs", "accepted")
def j03(t: Tables) -> DataFrame:
    pairs = latest.latest_generation(t.pairs(), ["dedup_key"], ["prompt_version", "model", "refined_at"])
    return pairs.join(accepted(t).select("dedup_key", "source_kind", "category", "id"), "dedup_key").orderBy("id", "pair_index").select("dedup_key", "source_kind", "category", "pair_index", "direction")


@query("j04_traces", """WITH j AS (SELECT * FROM verdicts WHERE role = 'judge' AND prompt_version = 'v2' QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY judged_at DESC, id DESC) = 1),
 a AS (SELECT * FROM latest WHERE role = 'auditor') SELECT f.dedup_key, j.is_steering, j.category, a.category AS auditor_category FROM feedback f JOIN j USING (dedup_key) LEFT JOIN a USING (dedup_key)""", "feedback", "latest")
def j04(t: Tables) -> DataFrame:
    v = t.verdicts()
    j = latest.latest_at_version(v, "judge", "v2").select("dedup_key", "is_steering", "category")
    a = latest.latest_verdict(v, "auditor").select("dedup_key", F.col("category").alias("auditor_category"))
    return t.feedback().select("dedup_key").join(j, "dedup_key").join(a, "dedup_key", "left").select("dedup_key", "is_steering", "category", "auditor_category")


@query("j05_optional_parent", """WITH s AS (SELECT session_id || ':' || turn AS sample_key, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(CAST(session_id AS BIGINT) * 3 + turn AS VARCHAR) END AS parent_key FROM turns)
 SELECT s.sample_key, coalesce(f.lang, '') AS lang FROM s LEFT JOIN feedback f ON s.parent_key = f.dedup_key WHERE s.parent_key IS NULL OR f.quarantined_reason IS NULL""", "turns", "feedback")
def j05(t: Tables) -> DataFrame:
    key = F.when(F.col("turn") % 3 != 0, (F.col("session_id").cast("long") * 3 + F.col("turn")).cast("string"))
    s = t.turns().select(F.concat_ws(":", "session_id", "turn").alias("sample_key"), key.alias("parent_key"))
    f = t.feedback().select("dedup_key", "lang", "quarantined_reason")
    return s.join(f, s.parent_key == f.dedup_key, "left").where("parent_key is null or quarantined_reason is null").select("sample_key", F.coalesce("lang", F.lit("")).alias("lang"))


@query("j06_pending", "SELECT f.id, f.dedup_key FROM feedback f WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.dedup_key = f.dedup_key AND v.prompt_version = 'v2') ORDER BY f.id LIMIT 200", "feedback", "verdicts")
def j06(t: Tables) -> DataFrame:
    done = t.verdicts().where("prompt_version = 'v2'").select("dedup_key")
    return t.feedback().select("id", "dedup_key").join(done, "dedup_key", "left_anti").orderBy("id").limit(200).select("id", "dedup_key")


@query("j07_key_lookup", "SELECT dedup_key, source_kind FROM feedback WHERE dedup_key IN (SELECT dedup_key FROM verdicts WHERE role = 'auditor')", "feedback", "verdicts")
def j07(t: Tables) -> DataFrame:
    return t.feedback().join(t.verdicts().where("role = 'auditor'").select("dedup_key"), "dedup_key", "left_semi").select("dedup_key", "source_kind")


@query("j08_anchor", """WITH f AS (SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_returnflag = 'R') WHERE rn = 1)
 SELECT o_orderkey, f.l_partkey, f.l_linenumber FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def j08(t: Tables) -> DataFrame:
    first = latest.first_by(t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    o = t.orders.select("o_orderkey")
    return o.join(first, o.o_orderkey == first.l_orderkey, "left").select("o_orderkey", "l_partkey", "l_linenumber")


@query("j09_family_mismatch", """SELECT DISTINCT d.source FROM documents d JOIN labels l USING (doc_id) WHERE (l.quality = 1 AND d.doc_id % 2 = 0 AND d.lang = 'de') OR (l.quality = 0 AND d.doc_id % 2 = 1)""")
def j09(t: Tables) -> DataFrame:
    d, l = t.documents.select("doc_id", "source", "lang"), t.labels.select("doc_id", "quality")
    odd = F.col("doc_id") % 2 == 1
    return d.join(l, "doc_id").where(((F.col("quality") == 1) & ~odd & (F.col("lang") == "de")) | ((F.col("quality") == 0) & odd)).select("source").distinct()


_HOUR = 3_600_000_000


def shadow_hits(t: Tables) -> DataFrame:
    """Each proposal with the first listed intervention of its session within a day, both ends counted."""
    m = t.moments()
    fired = m.where("kind = 'purchase'").select("event_id", "session_id", temporal.micros("ts").alias("at"))
    other = m.where("kind = 'error'").select("session_id", F.col("event_id").alias("hit"), temporal.micros("ts").alias("hit_at"), F.expr("cast(value as int) % 5").alias("category"))
    near = temporal.band_join(fired, other, ["session_id"], "at", "hit_at", 0, 24 * _HOUR)
    first = temporal.first_match(near, ["event_id"], [F.col("hit")]).select("event_id", "hit", "category")
    return fired.select("event_id", "session_id").join(first, "event_id", "left")


@query("j10_shadow_hit", """SELECT p.event_id, p.session_id, h.hit, h.category FROM moments p LEFT JOIN (SELECT p.event_id, i.event_id AS hit, CAST(trunc(i.value) AS INTEGER) % 5 AS category FROM moments p JOIN moments i ON p.session_id = i.session_id AND i.ts BETWEEN p.ts AND p.ts + INTERVAL 24 HOUR
 WHERE p.kind = 'purchase' AND i.kind = 'error' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY i.event_id) = 1) h USING (event_id) WHERE p.kind = 'purchase'""", "moments")
def j10(t: Tables) -> DataFrame:
    return shadow_hits(t)


def replies(t: Tables) -> DataFrame:
    m = t.moments()
    d = m.where("kind = 'purchase'").select(F.col("event_id").alias("delivery_id"), "session_id", temporal.micros("ts").alias("at"))
    r = m.where("kind = 'click'").select("session_id", F.col("event_id").alias("reply_id"), temporal.micros("ts").alias("reply_at"), F.col("score").alias("reply_score"))
    return temporal.first_reply(d, r, 48 * _HOUR)


_REPLY = """SELECT d.event_id AS delivery_id, r.event_id AS reply_id, r.score AS reply_score FROM moments d JOIN moments r ON d.session_id = r.session_id AND r.ts > d.ts AND r.ts <= d.ts + INTERVAL 48 HOUR
 WHERE d.kind = 'purchase' AND r.kind = 'click' QUALIFY row_number() OVER (PARTITION BY d.event_id ORDER BY r.ts, r.event_id) = 1"""


@query("j11_first_reply", _REPLY, "moments")
def j11(t: Tables) -> DataFrame:
    return replies(t).select("delivery_id", "reply_id", "reply_score")


@query("j12_reaction_override", """WITH h AS (SELECT p.event_id, count(i.event_id) > 0 AS near FROM moments p LEFT JOIN moments i ON p.session_id = i.session_id AND i.kind = 'error' AND i.ts BETWEEN p.ts AND p.ts + INTERVAL 24 HOUR WHERE p.kind = 'purchase' GROUP BY 1)
 SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'accepted' WHEN event_id % 6 = 1 THEN 'diverged' END AS reaction, CASE WHEN event_id % 6 = 0 THEN TRUE WHEN event_id % 6 = 1 THEN FALSE ELSE near END AS hit FROM h""", "moments")
def j12(t: Tables) -> DataFrame:
    hits = shadow_hits(t).select("event_id", F.col("hit").isNotNull().alias("near"))
    reactions = t.moments().where("event_id % 6 < 2").select("event_id", F.when(F.col("event_id") % 6 == 0, "accepted").otherwise("diverged").alias("reaction"))
    return hits.join(reactions, "event_id", "left").select("event_id", "reaction", F.when(F.col("reaction").isNotNull(), F.col("reaction").isin("accepted", "edited")).otherwise(F.col("near")).alias("hit"))


@query("j13_nearest_turn", """SELECT a.session_id, a.turn, b.turn AS steer_turn FROM turns a LEFT JOIN turns b ON a.session_id = b.session_id AND b.role = 'user' AND length(b.text) % 3 = 0 AND abs(b.turn - a.turn) <= 2
 WHERE a.role = 'assistant' QUALIFY row_number() OVER (PARTITION BY a.session_id, a.turn ORDER BY abs(b.turn - a.turn), b.turn) = 1""", "turns")
def j13(t: Tables) -> DataFrame:
    a = t.turns().where("role = 'assistant'").select("session_id", "turn")
    b = t.turns().where("role = 'user' and length(text) % 3 = 0").select("session_id", F.col("turn").alias("steer_turn"))
    near = temporal.band_join(a, b, ["session_id"], "turn", "steer_turn", 2, 2)
    best = latest.first_by(near, ["session_id", "turn"], [F.abs(F.col("steer_turn") - F.col("turn")), F.col("steer_turn")])
    return a.join(best, ["session_id", "turn"], "left")


@query("j14_nearest_range", """WITH s AS (SELECT session_id, min(ts) AS lo, max(ts) AS hi FROM moments GROUP BY 1 HAVING count(*) > 1), o AS (SELECT o_orderkey, TIMESTAMP '2023-12-25' + INTERVAL (o_orderkey % 50) DAY AS tm FROM orders),
 p AS (SELECT tm, session_id FROM (SELECT DISTINCT tm FROM o), s QUALIFY row_number() OVER (PARTITION BY tm ORDER BY CASE WHEN tm BETWEEN lo AND hi THEN 0 WHEN tm < lo THEN epoch_us(lo) - epoch_us(tm) ELSE epoch_us(tm) - epoch_us(hi) END, session_id) = 1)
 SELECT o_orderkey, session_id FROM o JOIN p USING (tm)""", "moments")
def j14(t: Tables) -> DataFrame:
    r = t.moments().groupBy("session_id").agg(F.min(temporal.micros("ts")).alias("lo"), F.max(temporal.micros("ts")).alias("hi"), F.count("*").alias("n")).where("n > 1").select("session_id", "lo", "hi")
    at = F.expr("unix_micros(timestamp '2023-12-25' + make_interval(0, 0, 0, cast(o_orderkey % 50 as int)))")
    o = t.orders.select("o_orderkey", at.alias("at"))
    found = temporal.nearest_ranges(o.select("at").distinct(), r, "at", "lo", "hi", "session_id")
    return o.join(found, "at").select("o_orderkey", "session_id")


@query("j15_nearest_event", """SELECT a.event_id, b.event_id AS nearest FROM moments a JOIN moments b ON a.session_id = b.session_id AND b.kind = 'view' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 86400000000 WHERE a.kind = 'signup'
 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts, b.event_id) = 1""", "moments")
def j15(t: Tables) -> DataFrame:
    m = t.moments()
    a = m.where("kind = 'signup'").select("event_id", "session_id", temporal.micros("ts").alias("at"))
    b = m.where("kind = 'view'").select("session_id", F.col("event_id").alias("nearest"), temporal.micros("ts").alias("near_at"))
    near = temporal.band_join(a, b, ["session_id"], "at", "near_at", 24 * _HOUR, 24 * _HOUR)
    return latest.first_by(near, ["event_id"], [F.abs(F.col("near_at") - F.col("at")), F.col("near_at"), F.col("nearest")]).select("event_id", "nearest")


@query("j16_exclusion_radius", """SELECT a.session_id, a.turn FROM turns a WHERE NOT EXISTS (SELECT 1 FROM turns b WHERE b.session_id = a.session_id AND b.role = 'user' AND length(b.text) % 5 = 0 AND abs(b.turn - a.turn) <= 1)""", "turns")
def j16(t: Tables) -> DataFrame:
    a = t.turns().select("session_id", "turn")
    b = t.turns().where("role = 'user' and length(text) % 5 = 0").select("session_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    return a.join(b, ["session_id", "turn"], "left_anti")


@query("j17_direction_list", "SELECT f.dedup_key, (SELECT string_agg(p.direction, E'\\n' ORDER BY p.prompt_version, p.pair_index) FROM pairs p WHERE p.dedup_key = f.dedup_key) AS directions FROM feedback f", "feedback", "pairs")
def j17(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("prompt_version", "pair_index", "direction")))
    joined = t.pairs().groupBy("dedup_key").agg(F.array_join(F.transform(rows, lambda r: r["direction"]), "\n").alias("directions"))
    return t.feedback().select("dedup_key").join(joined, "dedup_key", "left")


@query("j18_cosine_pairs", """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.5""")
def j18(t: Tables) -> DataFrame:
    return similarity.cosine_pairs(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", 0.5)


@query("j19_minhash_candidates")
def j19(t: Tables) -> DataFrame:
    return similarity.lsh_pairs(shared(similarity.profiles(t.documents.select("doc_id", "text"), "doc_id", "text"), "profiles"), "doc_id")


@query("j20_best_copy", """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS copy, CAST(l_quantity AS BIGINT) AS len, l_shipdate AS mtime FROM lineitem), b AS (SELECT k, max(struct_pack(len := len, mtime := mtime)) AS best FROM c GROUP BY k)
 SELECT b.k, b.best.len AS len, CAST(count(*) AS BIGINT) AS n_best, CASE WHEN count(DISTINCT c.copy) > 1 THEN 'ambiguous' ELSE 'rebuilt' END AS outcome FROM b JOIN c ON b.k = c.k AND c.len = b.best.len AND c.mtime = b.best.mtime GROUP BY 1, 2""")
def j20(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("copy"), F.struct(F.col("l_quantity").cast("long").alias("len"), F.col("l_shipdate").alias("mtime")).alias("score"))
    best = F.max("score").over(Window.partitionBy("k"))
    top = c.withColumn("best", best).where("score = best")
    return top.groupBy("k", F.col("best.len").alias("len")).agg(F.count("*").alias("n_best"), F.when(F.count_distinct("copy") > 1, "ambiguous").otherwise("rebuilt").alias("outcome"))


@query("j21_turn_facts", """WITH s AS (SELECT session_id, turn // 2 AS step, min_by(text, turn) AS steer FROM turns WHERE role = 'user' GROUP BY 1, 2) SELECT t.session_id, t.turn, s.steer FROM turns t LEFT JOIN s ON t.session_id = s.session_id AND t.turn // 2 = s.step""", "turns")
def j21(t: Tables) -> DataFrame:
    step = F.floor(F.col("turn") / 2).cast("long")
    facts = t.turns().where("role = 'user'").groupBy("session_id", step.alias("step")).agg(F.min_by("text", "turn").alias("steer"))
    return t.turns().withColumn("step", step).join(facts, ["session_id", "step"], "left").select("session_id", "turn", "steer")
