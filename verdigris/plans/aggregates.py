"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import latest, metrics
from verdigris.plans import filters, joins
from verdigris.plans.base import Tables, query, scored


@query("a01_most_common", "SELECT kind, count(*) AS n, min(event_id) AS first_seen FROM moments GROUP BY kind", "moments")
def a01(t: Tables) -> DataFrame:
    return t.moments().groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("a02_judged_by_category", "SELECT category, count(*) AS judged, CAST(sum(CAST(is_steering AS INTEGER)) AS BIGINT) AS accepted FROM verdicts WHERE role = 'judge' AND prompt_version = 'v1' GROUP BY category", "verdicts")
def a02(t: Tables) -> DataFrame:
    v = t.verdicts().where("role = 'judge' and prompt_version = 'v1'")
    return v.groupBy("category").agg(F.count("*").alias("judged"), F.sum(F.col("is_steering").cast("int")).alias("accepted"))


@query("a03_flips", "SELECT session_id, count(DISTINCT score > 0.5) > 1 AS flipped FROM moments GROUP BY session_id", "moments")
def a03(t: Tables) -> DataFrame:
    return t.moments().groupBy("session_id").agg((F.count_distinct(F.col("score") > 0.5) > 1).alias("flipped"))


@query("a04_newest_version", "SELECT l_orderkey, max(l_returnflag) AS version, max(l_linestatus) AS model FROM lineitem GROUP BY l_orderkey")
def a04(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("version"), F.max("l_linestatus").alias("model"))


@query("a05_corpus_stats", "SELECT count(*) AS total, CAST(sum(CASE WHEN score < 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS noise, count(DISTINCT session_id) AS sessions, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM moments", "moments")
def a05(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.moments().agg(F.count("*").alias("total"), F.count_if(F.col("score") < 0.1).alias("noise"), F.count_distinct("session_id").alias("sessions"), day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"))


@query("a05_by_kind_and_month", "SELECT kind, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM moments GROUP BY 1, 2", "moments")
def a05b(t: Tables) -> DataFrame:
    return t.moments().groupBy("kind", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("a06_pipeline_stats", """WITH p AS (SELECT dedup_key, count(*) AS n FROM pairs GROUP BY 1) SELECT CASE WHEN is_steering IS NULL THEN 'unjudged' WHEN NOT is_steering THEN 'noise' WHEN coalesce(p.n, 0) > 0 THEN 'refined' ELSE 'accepted' END AS status, count(*) AS n, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS pairs
 FROM feedback LEFT JOIN judged USING (dedup_key) LEFT JOIN p USING (dedup_key) GROUP BY 1""", "feedback", "judged", "pairs")
def a06(t: Tables) -> DataFrame:
    j = latest.latest_verdict(t.verdicts(), "judge").select("dedup_key", "is_steering")
    p = t.pairs().groupBy("dedup_key").agg(F.count("*").alias("n"))
    rows = t.feedback().select("dedup_key").join(j, "dedup_key", "left").join(p, "dedup_key", "left")
    return rows.groupBy(filters.candidate_status(F.col("is_steering"), F.col("n")).alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


@query("a06_category_matrix", "SELECT category, source_kind, count(*) AS n FROM accepted GROUP BY GROUPING SETS ((category, source_kind), (category), ())", "accepted")
def a06b(t: Tables) -> DataFrame:
    return joins.accepted(t).rollup("category", "source_kind").agg(F.count("*").alias("n"))


@query("a07_prune_counts", "SELECT role AS kind, turn AS rewind, count(*) AS n, CAST(sum(CASE WHEN length(text) >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS survivors FROM turns GROUP BY 1, 2", "turns")
def a07(t: Tables) -> DataFrame:
    return t.turns().groupBy(F.col("role").alias("kind"), F.col("turn").alias("rewind")).agg(F.count("*").alias("n"), F.count_if(F.length("text") >= 100).alias("survivors"))


@query("a08_decision_stats", "SELECT count(*) AS total, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS answered, round(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) / count(*), 9) AS share FROM turns", "turns")
def a08(t: Tables) -> DataFrame:
    n = F.count_if(F.col("role") == "user")
    return t.turns().agg(F.count("*").alias("total"), n.alias("answered"), F.round(F.try_divide(n, F.count("*")), 9).alias("share"))


@query("a09_evaluation_by_kind", "SELECT source_kind, count(*) AS judged, CAST(sum(CAST(is_steering AS INTEGER)) AS BIGINT) AS accepted FROM feedback JOIN judged USING (dedup_key) GROUP BY 1", "feedback", "judged")
def a09(t: Tables) -> DataFrame:
    j = latest.latest_verdict(t.verdicts(), "judge").select("dedup_key", "is_steering")
    return t.feedback().join(j, "dedup_key").groupBy("source_kind").agg(F.count("*").alias("judged"), F.sum(F.col("is_steering").cast("int")).alias("accepted"))


@query("a10_audited_estimate", """WITH a AS (SELECT dedup_key, is_steering FROM latest WHERE role = 'auditor') SELECT j.category, count(*) AS audited, CAST(sum(CASE WHEN a.is_steering THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN a.is_steering THEN 1 ELSE 0 END) / count(*), 9) AS rate FROM judged j JOIN a USING (dedup_key) GROUP BY 1""", "judged")
def a10(t: Tables) -> DataFrame:
    v = t.verdicts()
    a = latest.latest_verdict(v, "auditor").select("dedup_key", F.col("is_steering").alias("hit"))
    hits = F.count_if("hit")
    return latest.latest_verdict(v, "judge").join(a, "dedup_key").groupBy("category").agg(F.count("*").alias("audited"), hits.alias("hits"), F.round(F.try_divide(hits, F.count("*")), 9).alias("rate"))


@query("a11_flip_report", """WITH x AS (SELECT dedup_key, prompt_version, is_steering FROM verdicts WHERE role = 'judge' QUALIFY row_number() OVER (PARTITION BY dedup_key, prompt_version ORDER BY judged_at DESC, id DESC) = 1)
 SELECT count(*) AS overlap, CAST(sum(CASE WHEN a.is_steering <> b.is_steering THEN 1 ELSE 0 END) AS BIGINT) AS flips, round(sum(CASE WHEN a.is_steering <> b.is_steering THEN 1 ELSE 0 END) / count(*), 9) AS rate FROM x a JOIN x b ON a.dedup_key = b.dedup_key AND a.prompt_version = 'v1' AND b.prompt_version = 'v2'""", "verdicts")
def a11(t: Tables) -> DataFrame:
    v = t.verdicts()
    a = latest.latest_at_version(v, "judge", "v1").select("dedup_key", F.col("is_steering").alias("a"))
    b = latest.latest_at_version(v, "judge", "v2").select("dedup_key", F.col("is_steering").alias("b"))
    flips = F.count_if(F.col("a") != F.col("b"))
    return a.join(b, "dedup_key").agg(F.count("*").alias("overlap"), flips.alias("flips"), F.round(F.try_divide(flips, F.count("*")), 9).alias("rate"))


@query("a12_disagreements", "SELECT j.dedup_key, j.category, a.category AS auditor_category FROM judged j JOIN latest a ON a.dedup_key = j.dedup_key AND a.role = 'auditor' WHERE j.is_steering <> a.is_steering", "judged")
def a12(t: Tables) -> DataFrame:
    v = t.verdicts()
    a = latest.latest_verdict(v, "auditor").select("dedup_key", F.col("is_steering").alias("side"), F.col("category").alias("auditor_category"))
    return latest.latest_verdict(v, "judge").join(a, "dedup_key").where("is_steering <> side").select("dedup_key", "category", "auditor_category")


@query("a13_shadow_summary", """WITH h AS (SELECT p.event_id, p.session_id, p.score, count(i.event_id) > 0 AS hit FROM moments p LEFT JOIN moments i ON p.session_id = i.session_id AND i.kind = 'error' AND i.ts BETWEEN p.ts AND p.ts + INTERVAL 24 HOUR WHERE p.kind = 'purchase' GROUP BY 1, 2, 3)
 SELECT count(DISTINCT session_id) AS sessions, count(*) AS proposals, CAST(sum(CASE WHEN score < 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS abstained, CAST(sum(CASE WHEN score >= 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS steers, CAST(sum(CASE WHEN score >= 0.2 AND hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN score >= 0.2 AND NOT hit THEN 1 ELSE 0 END) AS BIGINT) AS nuisance FROM h""", "moments")
def a13(t: Tables) -> DataFrame:
    h = joins.shadow_hits(t).join(t.moments().select("event_id", "score"), "event_id")
    steer, hit = F.col("score") >= 0.2, F.col("hit").isNotNull()
    return h.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("proposals"), F.count_if(~steer).alias("abstained"), F.count_if(steer).alias("steers"), F.count_if(steer & hit).alias("hits"), F.count_if(steer & ~hit).alias("nuisance"))


@query("a14_floor_deciles", """WITH r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM moments) SELECT CAST(q AS INTEGER) AS q, (SELECT max(score) FROM r WHERE i = least(n - 1, n * q // 10)) AS score FROM range(1, 10) x(q)""", "moments")
def a14(t: Tables) -> DataFrame:
    """sorted[min(n − 1, ⌊n·q/10⌋)], from counts by distinct score."""
    n = metrics.running(t.moments().groupBy("score").agg(F.count("*").alias("n")), "score", ["n"])
    total = t.moments().agg(F.count("*").alias("total"))
    upto = n.select("score", (F.col("n_before") + F.col("n")).alias("upto"), "n").join(F.broadcast(total), F.lit(True))
    at = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda q: F.struct(q.alias("q"), F.least(F.col("total") - 1, F.floor(F.col("total") * q / 10)).alias("i")))
    inside = F.filter(at, lambda x: (x["i"] < F.col("upto")) & (x["i"] >= F.col("upto") - F.col("n")))
    return upto.select("score", F.explode(inside).alias("x")).select("x.q", "score")


@query("a15_score_stats", """SELECT count(*) AS scored, CAST(sum(CASE WHEN score >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS passed, round(sum(CASE WHEN score >= 0.8 THEN 1 ELSE 0 END) / count(*), 9) AS rate, max(score) AS top, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-29' THEN 1 ELSE 0 END) AS BIGINT) AS last_day FROM moments WHERE ts <= TIMESTAMP '2024-01-30'""", "moments")
def a15(t: Tables) -> DataFrame:
    now = F.expr("timestamp_ntz '2024-01-30'")
    passed = F.count_if(F.col("score") >= 0.8)
    return t.moments().where(F.col("ts") <= now).agg(F.count("*").alias("scored"), passed.alias("passed"), F.round(F.try_divide(passed, F.count("*")), 9).alias("rate"), F.max("score").alias("top"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"), F.count_if(F.col("ts") >= now - F.expr("interval 24 hours")).alias("last_day"))


@query("a16_delivery_counts", "SELECT o_orderstatus AS state, count(*) AS n, CAST(sum(CASE WHEN starts_with(CAST(o_orderdate AS VARCHAR), '1998') THEN 1 ELSE 0 END) AS BIGINT) AS in_1998 FROM orders GROUP BY 1")
def a16(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate").cast("string").startswith("1998")).alias("in_1998"))


def reactions(t: Tables) -> DataFrame:
    d = t.moments().where("kind = 'purchase'").select(F.col("event_id").alias("delivery_id"))
    sim = F.col("reply_score")
    kind = F.when(sim.isNull(), "ignored").when(sim >= 0.7, "accepted").when(sim >= 0.3, "edited").otherwise("diverged")
    return d.join(joins.replies(t).select("delivery_id", "reply_id", "reply_score"), "delivery_id", "left").select("delivery_id", "reply_id", kind.alias("reaction"))


_KIND = "CASE WHEN reply_score IS NULL THEN 'ignored' WHEN reply_score >= 0.7 THEN 'accepted' WHEN reply_score >= 0.3 THEN 'edited' ELSE 'diverged' END"


@query("a17_reaction_counts", f"WITH r AS ({joins._REPLY}) SELECT {_KIND} AS reaction, count(*) AS n FROM moments m LEFT JOIN r ON m.event_id = r.delivery_id WHERE m.kind = 'purchase' GROUP BY 1", "moments")
def a17(t: Tables) -> DataFrame:
    return reactions(t).groupBy("reaction").agg(F.count("*").alias("n"))


@query("a18_outcome_report", "SELECT count(*) AS scored, count(DISTINCT session_id) AS sessions, CAST(sum(CASE WHEN score >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS fired, CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS steered, CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS expired FROM moments", "moments")
def a18(t: Tables) -> DataFrame:
    return t.moments().agg(F.count("*").alias("scored"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("score") >= 0.8).alias("fired"), F.count_if(F.col("kind") == "error").alias("steered"), F.count_if(F.col("kind") == "signup").alias("expired"))


@query("a19_profile", """WITH l AS (SELECT lang AS category, doc_id, text AS line FROM documents), k AS (SELECT category, lower(regexp_replace(regexp_replace(trim(line, E' \\n\\t\\r'), '\\s+', ' ', 'g'), '\\.+$', '')) AS key, count(*) AS support, max(doc_id) AS latest, min_by(line, doc_id) AS line FROM l GROUP BY 1, 2)
 SELECT category, key, support, line, CAST(row_number() OVER (PARTITION BY category ORDER BY support DESC, latest DESC) AS INTEGER) AS place FROM k QUALIFY place <= 12""")
def a19(t: Tables) -> DataFrame:
    """Groups are counted by a digest of their key; texts are read again for the twelve of each category that stay."""
    line = t.documents.select(F.col("lang").alias("category"), "doc_id", F.col("text").alias("line"), T.direction_key(F.col("text")).alias("key")).withColumn("h", F.md5("key"))
    k = line.groupBy("category", "h").agg(F.count("*").alias("support"), F.max("doc_id").alias("latest"), F.min("doc_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("support"), F.desc("latest")))
    best = k.withColumn("place", place).where("place <= 12").withColumnsRenamed({"category": "of", "h": "digest"})
    same = (F.col("doc_id") == F.col("first")) & F.col("category").eqNullSafe(F.col("of")) & F.col("h").eqNullSafe(F.col("digest"))
    return line.join(best, same).select("category", "key", "support", "line", "place")


@query("a20_candidate_pool", "SELECT source, doc_id FROM documents WHERE n_chars > 50 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 8")
def a20(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.where("n_chars > 50").select("source", "doc_id", "n_chars").withColumn("p", place).where("p <= 8").select("source", "doc_id")


@query("a21_joined_directions", "SELECT dedup_key, string_agg(verbatim, E'\\n' ORDER BY prompt_version, pair_index) AS verbatims FROM pairs GROUP BY dedup_key", "pairs")
def a21(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("prompt_version", "pair_index", "verbatim")))
    return t.pairs().groupBy("dedup_key").agg(F.array_join(F.transform(rows, lambda r: r["verbatim"]), "\n").alias("verbatims"))


@query("a22_tool_tally", "SELECT session_id, string_agg(CASE WHEN n > 1 THEN kind || '×' || n ELSE kind END, ', ' ORDER BY kind) AS tally FROM (SELECT session_id, kind, count(*) AS n FROM moments GROUP BY 1, 2) GROUP BY 1", "moments")
def a22(t: Tables) -> DataFrame:
    n = t.moments().groupBy("session_id", "kind").agg(F.count("*").alias("n"))
    name = F.when(F.col("n") > 1, F.concat("kind", F.lit("×"), F.col("n").cast("string"))).otherwise(F.col("kind"))
    names = F.array_sort(F.collect_list(F.struct("kind", name.alias("name"))))
    return n.groupBy("session_id").agg(F.array_join(F.transform(names, lambda x: x["name"]), ", ").alias("tally"))


@query("a23_provenance", """WITH r AS (SELECT doc_id AS id, 'human' AS who, quality AS vote FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'model', toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'guidance', 1 FROM labels WHERE doc_id % 5 = 0)
 SELECT id, min_by(vote, CASE who WHEN 'human' THEN 0 ELSE 1 END) FILTER (who <> 'guidance') AS vote, min(who) FILTER (who <> 'guidance') AS provenance, min_by(vote, CASE who WHEN 'human' THEN 0 ELSE 1 END) FILTER (who <> 'guidance') = max(vote) FILTER (who = 'guidance') AS agrees FROM r GROUP BY id HAVING count(*) FILTER (who <> 'guidance') > 0""")
def a23(t: Tables) -> DataFrame:
    l = t.labels
    part = lambda n, who, vote: l.where(f"doc_id % {n} = 0").select(F.col("doc_id").alias("id"), F.lit(who).alias("who"), vote.cast("int").alias("vote"))
    rows = part(3, "human", F.col("quality")).union(part(2, "model", F.col("toxic"))).union(part(5, "guidance", F.lit(1)))
    told = F.when(F.col("who") == "guidance", F.col("vote"))
    ranked = F.when(F.col("who") != "guidance", F.struct(F.when(F.col("who") == "human", 0).otherwise(1).alias("rank"), "vote", "who"))
    g = rows.groupBy("id").agg(F.min(ranked).alias("best"), F.max(told).alias("told")).where("best is not null")
    return g.select("id", "best.vote", F.col("best.who").alias("provenance"), (F.col("best.vote") == F.col("told")).alias("agrees"))


@query("a24_event_fold", """WITH j AS (SELECT session_id, CASE WHEN kind IN ('click', 'view') THEN 'verdict' ELSE 'note' END AS control, CASE WHEN kind = 'error' THEN NULL ELSE kind END AS value, event_id FROM moments), w AS (SELECT session_id, control, value FROM j QUALIFY row_number() OVER (PARTITION BY session_id, control ORDER BY event_id DESC) = 1)
 SELECT session_id, max(value) FILTER (control = 'verdict') AS verdict, max(value) FILTER (control = 'note') AS note FROM w GROUP BY 1""", "moments")
def a24(t: Tables) -> DataFrame:
    control = F.when(F.col("kind").isin("click", "view"), "verdict").otherwise("note")
    j = t.moments().select("session_id", control.alias("control"), F.when(F.col("kind") != "error", F.col("kind")).alias("value"), "event_id")
    last = lambda c: F.max(F.when(F.col("control") == c, F.struct("event_id", "value")))["value"].alias(c)
    return j.groupBy("session_id").agg(last("verdict"), last("note"))


def dataset_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """16 hex digits of sha256 over the sorted digests of the rows; a row's text is its columns, NULs between.

    A tree: digests are sorted and joined in 65,536 parts by their first four digits, these parts' digests in 256 by two
    digits, and these once more."""
    one = F.sha2(F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    level = rows.select(one.alias("h")).groupBy(F.substring("h", 1, 4).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256)
    level = level.groupBy(F.substring("part", 1, 2).alias("top")).agg(joined.alias("h")).withColumnRenamed("top", "part")
    return level.agg(F.substring(joined, 1, 16).alias("digest"))


#: The tree in the oracle's dialect, over h(h).
TREE = "p4 AS (SELECT substr(h, 1, 4) AS part, sha256(string_agg(h, E'\\n' ORDER BY h)) AS h FROM h GROUP BY 1), p2 AS (SELECT substr(part, 1, 2) AS part, sha256(string_agg(h, E'\\n' ORDER BY part)) AS h FROM p4 GROUP BY 1), p AS (SELECT substr(sha256(string_agg(h, E'\\n' ORDER BY part)), 1, 16) AS digest FROM p2)"


@query("a25_dataset_digest", f"WITH h AS (SELECT sha256(session_id || chr(0) || turn || chr(0) || text) AS h FROM turns), {TREE} SELECT digest FROM p", "turns")
def a25(t: Tables) -> DataFrame:
    return dataset_digest(t.turns(), "session_id", "turn", "text")


@query("a26_wilson", """WITH g AS (SELECT quality, count(*) AS n, sum(toxic)::DOUBLE AS k FROM labels GROUP BY 1), p AS (SELECT *, k / n AS p FROM g) SELECT CAST(quality AS INTEGER) AS quality, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 9) AS high FROM p""")
def a26(t: Tables) -> DataFrame:
    g = t.labels.groupBy(F.col("quality").cast("int").alias("quality")).agg(F.count("*").alias("n"), F.sum("toxic").cast("double").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return g.select("quality", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("a27_calibration", """WITH b AS (SELECT least(CAST(floor(score * 15) AS INTEGER), 14) AS bin, count(*) AS n, avg(score) AS p, avg(CASE WHEN kind = 'error' THEN 1.0 ELSE 0.0 END) AS r FROM moments GROUP BY 1) SELECT round(sum(abs(p - r) * n) / sum(n), 9) AS ece, round(max(abs(p - r)), 9) AS max_gap FROM b""", "moments")
def a27(t: Tables) -> DataFrame:
    rows = t.moments().select("score", (F.col("kind") == "error").alias("label"))
    return metrics.calibration(rows, "label", "score").select(F.round("ece", 9).alias("ece"), F.round("max_gap", 9).alias("max_gap"))


_AP = """SELECT round(sum(pos * cp / cn) / sum(pos), 9) AS average_precision FROM (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM (SELECT base, count(*) AS n, sum(CAST(label AS INTEGER)) AS pos FROM {rows} GROUP BY 1) WINDOW w AS (ORDER BY base DESC))"""


@query("a28_average_precision", _AP.format(rows="scored"), "scored")
def a28(t: Tables) -> DataFrame:
    return metrics.average_precision(scored(t), "label", "base").select(F.round("average_precision", 9).alias("average_precision"))


@query("a29_gate_metrics", " UNION ALL ".join(f"SELECT '{name}' AS slice, * FROM ({_AP.format(rows=f'(SELECT * FROM scored WHERE {cond})')})" for name, cond in (("all", "TRUE"), ("hard", "label OR doc_id % 2 = 0"), ("random", "label OR doc_id % 2 = 1"))), "scored")
def a29(t: Tables) -> DataFrame:
    rows, out = scored(t), None
    for name, cond in (("all", "true"), ("hard", "label or doc_id % 2 = 0"), ("random", "label or doc_id % 2 = 1")):
        one = metrics.average_precision(rows.where(cond), "label", "base").select(F.lit(name).alias("slice"), F.round("average_precision", 9).alias("average_precision"))
        out = one if out is None else out.union(one)
    return out


@query("a30_auc", "SELECT round(avg(CASE WHEN p.base > n.base THEN 1.0 WHEN p.base = n.base THEN 0.5 ELSE 0.0 END), 9) AS auc FROM scored p, scored n WHERE p.label AND NOT n.label", "scored")
def a30(t: Tables) -> DataFrame:
    return metrics.auc(scored(t), "label", "base").select(F.round("auc", 9).alias("auc"))


_DELONG = """p AS (SELECT a.doc_id, avg(CASE WHEN a.base > b.base THEN 1.0 WHEN a.base = b.base THEN 0.5 ELSE 0.0 END) AS x, avg(CASE WHEN a.candidate > b.candidate THEN 1.0 WHEN a.candidate = b.candidate THEN 0.5 ELSE 0.0 END) AS y FROM scored a, scored b WHERE a.label AND NOT b.label GROUP BY 1),
 q AS (SELECT b.doc_id, avg(CASE WHEN a.base > b.base THEN 1.0 WHEN a.base = b.base THEN 0.5 ELSE 0.0 END) AS x, avg(CASE WHEN a.candidate > b.candidate THEN 1.0 WHEN a.candidate = b.candidate THEN 0.5 ELSE 0.0 END) AS y FROM scored a, scored b WHERE a.label AND NOT b.label GROUP BY 1),
 s AS (SELECT (SELECT avg(x) FROM p) AS auc_base, (SELECT avg(y) FROM p) AS auc_candidate, (SELECT var_samp(x) / count(*) FROM p) + (SELECT var_samp(x) / count(*) FROM q) AS va, (SELECT var_samp(y) / count(*) FROM p) + (SELECT var_samp(y) / count(*) FROM q) AS vb, (SELECT covar_samp(x, y) / count(*) FROM p) + (SELECT covar_samp(x, y) / count(*) FROM q) AS cab)"""


@query("a31_delong", f"WITH {_DELONG} SELECT round(auc_base, 9) AS auc_base, round(auc_candidate, 9) AS auc_candidate, round(auc_candidate - auc_base, 9) AS delta, round(sqrt(va), 9) AS se_base, round(sqrt(va + vb - 2 * cab), 9) AS se, round(cab / sqrt(va * vb), 7) AS rho FROM s", "scored")
def a31(t: Tables) -> DataFrame:
    r = metrics.delong(scored(t), "label", "base", "candidate", "doc_id")
    return r.select(*(F.round(c, 7 if c == "rho" else 9).alias(c) for c in ("auc_base", "auc_candidate", "delta", "se_base", "se", "rho")))


@query("a32_rebuild_counts", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'human' WHEN doc_id % 2 = 0 THEN 'model' ELSE 'none' END AS provenance, quality = 1 AS label, CASE WHEN doc_id % 5 = 0 THEN TRUE END AS told FROM labels)
 SELECT provenance, count(*) AS n, CAST(sum(CASE WHEN told = label THEN 1 ELSE 0 END) AS BIGINT) AS agree, CAST(sum(CASE WHEN told <> label THEN 1 ELSE 0 END) AS BIGINT) AS disagree FROM r GROUP BY 1""")
def a32(t: Tables) -> DataFrame:
    d, label = F.col("doc_id"), F.col("quality") == 1
    who = F.when(d % 3 == 0, "human").when(d % 2 == 0, "model").otherwise("none")
    told = F.when(d % 5 == 0, F.lit(True))
    return t.labels.groupBy(who.alias("provenance")).agg(F.count("*").alias("n"), F.count_if(told == label).alias("agree"), F.count_if(told != label).alias("disagree"))
