"""Statistical and decision operators."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris import shared_dir
from verdigris.operators import dedup, exemplars, gate, metrics, search, similarity
from verdigris.plans import aggregates
from verdigris.plans.base import Tables, query, scored
from verdigris.sources.staging import folder


@query("m01_minimum_detectable", f"WITH {aggregates._DELONG} SELECT round(2.801585218112969 * sqrt(va + vb - 2 * cab), 9) AS mde FROM s", "scored")
def m01(t: Tables) -> DataFrame:
    r = metrics.delong(scored(t), "label", "base", "candidate", "doc_id")
    return r.select(F.round(F.lit(metrics.minimum_detectable(1.0)) * F.col("se"), 9).alias("mde"))


@query("m02_actionable", f"WITH {aggregates._DELONG}, v AS (SELECT auc_candidate - auc_base AS d, sqrt(va + vb - 2 * cab) AS se FROM s) SELECT (d - 1.959963984540054 * se > 0 OR d + 1.959963984540054 * se < 0) AS excludes_zero, (d - 1.959963984540054 * se > 0 OR d + 1.959963984540054 * se < 0) AND abs(d) >= 2.801585218112969 * se AS actionable FROM v", "scored")
def m02(t: Tables) -> DataFrame:
    r = metrics.delong(scored(t), "label", "base", "candidate", "doc_id")
    outside = (F.col("low") > 0) | (F.col("high") < 0)
    return r.select(outside.alias("excludes_zero"), (outside & (F.abs("delta") >= metrics.minimum_detectable(1.0) * F.col("se"))).alias("actionable"))


_HM = "sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n))"


@query("m03_hanley_mcneil", f"SELECT p, n, round({_HM}, 9) AS se, round(2.801585218112969 * {_HM} * sqrt(2 * (1 - 0.8)), 9) AS mde FROM (SELECT 0.93::DOUBLE AS a, doc_id + 10 AS p, doc_id * 2 + 20 AS n FROM labels)")
def m03(t: Tables) -> DataFrame:
    rows = t.labels.select((F.col("doc_id") + 10).alias("p"), (F.col("doc_id") * 2 + 20).alias("n"))
    se = metrics.hanley_mcneil(F.lit(0.93), F.col("p"), F.col("n"))
    return rows.select("p", "n", F.round(se, 9).alias("se"), F.round(F.lit(metrics.minimum_detectable(1.0)) * se * F.sqrt(F.lit(2 * (1 - 0.8))), 9).alias("mde"))


@query("m04_fewest_negatives", f"SELECT source, target, min(n) AS negatives FROM (SELECT d.source, 0.93::DOUBLE AS a, count(*) AS p FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 GROUP BY 1) g, (SELECT unnest(range(1, 20001)) AS n) r, (SELECT unnest([0.08, 0.06, 0.04])::DOUBLE AS target) t WHERE {_HM} <= target GROUP BY 1, 2")
def m04(t: Tables) -> DataFrame:
    """For each source, with its positives: how many negatives bring the standard error of an AUC of 0.93 down to a target;
    targets that no number below 20,000 reaches are left out."""
    p = t.labels.where("quality = 1").join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("p"))
    rows = p.withColumn("target", F.explode(F.array(*map(F.lit, (0.08, 0.06, 0.04)))))
    n = metrics.fewest_negatives(F.lit(0.93), F.col("p"), F.col("target"))
    return rows.select("source", "target", n.alias("negatives")).where("negatives <= 20000")


@query("m06_paired_comparison", f"WITH {aggregates._DELONG.replace('FROM scored a, scored b', 'FROM fire a, fire b')} SELECT round(auc_candidate - auc_base, 9) AS delta FROM s".replace("WITH p AS", "WITH fire AS (SELECT doc_id, NOT label AS label, 1 - base AS base, 1 - candidate AS candidate FROM scored), p AS"), "scored")
def m06(t: Tables) -> DataFrame:
    """Both arms on the fire scale, 1 − p, where the negatives are what fires."""
    fire = scored(t).select("doc_id", (~F.col("label")).alias("label"), (1 - F.col("base")).alias("base"), (1 - F.col("candidate")).alias("candidate"))
    return metrics.delong(fire, "label", "base", "candidate", "doc_id").select(F.round("delta", 9).alias("delta"))


@query("m07_fire_threshold", "WITH r AS (SELECT score, count(*) OVER () AS n, count(*) OVER (ORDER BY score DESC) AS upto FROM moments) SELECT max(score) AS threshold FROM r WHERE upto >= floor(n * 2.0 / 100)", "moments")
def m07(t: Tables) -> DataFrame:
    m = t.moments()
    k = m.agg(F.floor(F.count("*") * 2.0 / 100).alias("k"))
    n = metrics.running(m.groupBy("score").agg(F.count("*").alias("n")), "score", ["n"], descending=True)
    upto = n.select("score", (F.col("n_before") + F.col("n")).alias("upto"))
    return upto.join(F.broadcast(k), F.col("upto") >= F.col("k")).agg(F.max("score").alias("threshold"))


@query("m08_matched_fires", "WITH n AS (SELECT count(*) // 20 AS k FROM scored), r AS (SELECT label, row_number() OVER (ORDER BY base DESC, doc_id) <= k AS a, row_number() OVER (ORDER BY candidate DESC, doc_id) <= k AS b FROM scored, n) SELECT CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS fires, CAST(sum(CASE WHEN a AND NOT b AND label THEN 1 ELSE 0 END) AS BIGINT) AS only_base, CAST(sum(CASE WHEN b AND NOT a AND label THEN 1 ELSE 0 END) AS BIGINT) AS only_candidate FROM r", "scored")
def m08(t: Tables) -> DataFrame:
    """Equal numbers of fires in both arms, and the hits that only one of them has."""
    rows = scored(t)
    k = int(rows.count() // 20)
    top = lambda c, name: rows.orderBy(F.desc(c), "doc_id").limit(k).select("doc_id", F.lit(True).alias(name))
    r = rows.join(top("base", "a"), "doc_id", "left").join(top("candidate", "b"), "doc_id", "left").select("label", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    return r.agg(F.count_if("a").alias("fires"), F.count_if(F.col("a") & ~F.col("b") & F.col("label")).alias("only_base"), F.count_if(F.col("b") & ~F.col("a") & F.col("label")).alias("only_candidate"))


@query("m09_temperature")
def m09(t: Tables) -> DataFrame:
    rows = t.moments().select((F.col("score") * 4 - 2).alias("z"), (F.col("kind") == "error").alias("label"))
    return t.spark.createDataFrame([(gate.temperature(rows, "z", "label"),)], "temperature double")


@query("m10_lexical_gate")
def m10(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id", F.col("toxic").cast("int").alias("label")).join(t.documents.select("doc_id", "text"), "doc_id")
    return gate.score(gate.train(rows, "doc_id", "text", "label"), t.documents.select("doc_id", "text"), "doc_id", "text")


#: BM25 of three terms in the oracle's dialect, as common table expressions.
HITS = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), st AS (SELECT avg(n) AS a, count(*) AS docs FROM len), tf AS (SELECT doc_id, term, count(*) AS f FROM tok WHERE term IN ('the', 'and', 'of') GROUP BY 1, 2), df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1),
 hits AS (SELECT tf.doc_id, sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / a))) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1 HAVING count(*) = 3 ORDER BY score DESC, doc_id LIMIT 50)"""


def index_of(t: Tables) -> search.Index:
    """The stored index of these documents, kept in the shared folder as long as the corpus's key stays."""
    name = hashlib.sha256(t.sf_dir.encode()).hexdigest()[:16]
    index = search.Index(t.spark, f"{shared_dir(t.spark)}/verdigris/search-{name}")
    index.ensure(t.documents, "doc_id", ["text"], m12(t).first().key)
    return index


@query("m11_bm25", f"WITH {HITS} SELECT doc_id, round(score, 6) AS score FROM hits")
def m11(t: Tables) -> DataFrame:
    return index_of(t).search("the and of", 50).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("m12_index_staleness", "SELECT count(*) || ':' || max(refined_at) || ':' || (SELECT count(*) || ':' || max(judged_at) FROM verdicts) AS key FROM pairs", "pairs", "verdicts")
def m12(t: Tables) -> DataFrame:
    return search.staleness(t.pairs(), "refined_at", t.verdicts(), "judged_at")


@query("m12_index_rebuilds", r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), n AS (SELECT doc_id % 2 = 0 AS even, count(DISTINCT doc_id) AS docs, count(DISTINCT CASE WHEN term = 'the' THEN doc_id END) AS hits FROM tok GROUP BY 1)
 SELECT 'first' AS step, TRUE AS built, docs, hits FROM n WHERE even UNION ALL SELECT 'same key', FALSE, docs, hits FROM n WHERE even UNION ALL SELECT 'moved key', TRUE, CAST(sum(docs) AS BIGINT), CAST(sum(hits) AS BIGINT) FROM n""")
def m12_rebuilds(t: Tables) -> DataFrame:
    """An index over every other document, opened again, and after the rest has come: whether it was built, and what it holds."""
    index, key = search.Index(t.spark, folder(t.spark, "search")), search.staleness(t.documents, "doc_id", t.labels, "doc_id").first().key
    even, rows = t.documents.where("doc_id % 2 = 0"), []
    for step, docs, stale in (("first", even, "even:" + key), ("same key", even, "even:" + key), ("moved key", t.documents, key)):
        built = index.ensure(docs, "doc_id", ["text"], stale)
        rows.append((step, built, index.state().docs, index.frequencies(["the"]).get("the", 0)))
    return t.spark.createDataFrame(rows, "step string, built boolean, docs long, hits long")


@query("m13_near_duplicates")
def m13(t: Tables) -> DataFrame:
    return dedup.collapse(t.documents.select("doc_id", "text"), "doc_id", "text")


@query("m14_semantic_duplicates")
def m14(t: Tables) -> DataFrame:
    """Links by text and by stored vectors together, for all documents that have a vector."""
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = t.documents.select("doc_id", "text").join(e.select("doc_id"), "doc_id", "left_semi")
    return dedup.collapse(docs, "doc_id", "text", vectors=e)


@query("m15_leaks", "SELECT DISTINCT b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def m15(t: Tables) -> DataFrame:
    """Items whose text stands in some document, by fingerprints of windows."""
    return dedup.contained(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")


@query("m16_corrected_labels", "WITH v AS (SELECT doc_id, quality AS frame, unnest([toxic, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE toxic END, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END]) AS vote FROM labels) SELECT doc_id, CAST(CASE WHEN min(vote) = max(vote) THEN max(vote) ELSE max(frame) END AS INTEGER) AS label, min(vote) <> max(vote) AS split FROM v GROUP BY 1")
def m16(t: Tables) -> DataFrame:
    d, x = F.col("doc_id"), F.col("toxic")
    votes = F.array(x, F.when(d % 3 == 0, F.lit(1)).otherwise(x), F.when(d % 7 == 0, 1 - x).otherwise(x))
    low, high = F.array_min(votes), F.array_max(votes)
    return t.labels.select("doc_id", F.when(low == high, high).otherwise(F.col("quality")).cast("int").alias("label"), (low != high).alias("split"))


@query("m17_training_pool")
def m17(t: Tables) -> DataFrame:
    from verdigris.operators import sampling as S

    kept = dedup.collapse(t.documents.select("doc_id", "text"), "doc_id", "text").where("doc_id = representative").select("doc_id")
    rows = t.labels.select("doc_id", F.col("quality").cast("bigint").alias("quality")).join(kept, "doc_id")
    train = S.carve(rows, ["quality"], "doc_id", 0.1, 21).where("split = 'train'").drop("split")
    n = train.groupBy("quality").agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    extra = n.join(F.broadcast(top), F.lit(True)).select("quality", (F.col("top") - F.col("n")).alias("n_extra"))
    pool = S.repeat_to(train, extra, "doc_id", 22, ["quality"])
    return pool.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "copy", F.col("text").alias("prompt"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("completion"))


def should_retrain(digest, incumbent, force):
    """Forced, no incumbent, or the incumbent was trained on other data."""
    return force | incumbent.isNull() | (incumbent != digest)


@query("m18_retrain_trigger", "SELECT 'moved' AS incumbent, FALSE AS force, count(*) FILTER (turn >= 3) > 0 AS retrain FROM turns UNION ALL SELECT 'same', FALSE, FALSE UNION ALL SELECT 'same', TRUE, TRUE UNION ALL SELECT 'none', FALSE, TRUE", "turns")
def m18(t: Tables) -> DataFrame:
    """Against an incumbent of earlier turns, of the same turns, of the same turns but forced, and none."""
    now = aggregates.dataset_digest(t.turns(), "session_id", "turn", "text")
    old = aggregates.dataset_digest(t.turns().where("turn < 3"), "session_id", "turn", "text").withColumnRenamed("digest", "stored")
    cases = F.inline(F.array(*(F.struct(F.lit(name).alias("incumbent"), stored.alias("held"), F.lit(force).alias("force")) for name, stored, force in (("moved", F.col("stored"), False), ("same", F.col("digest"), False), ("same", F.col("digest"), True), ("none", F.lit(None).cast("string"), False)))))
    rows = now.join(F.broadcast(old), F.lit(True)).select("digest", cases)
    return rows.select("incumbent", "force", should_retrain(F.col("digest"), F.col("held"), F.col("force")).alias("retrain"))


class Lengths:
    """A deterministic encoder: the text's length."""

    def encode(self, texts: list[str]):
        import numpy as np

        return np.array([[len(x)] for x in texts], np.float32)


@query("m19_pending_embeddings", "SELECT d.doc_id FROM documents d WHERE d.doc_id % 10 > 0 AND NOT (d.doc_id % 3 = 0 AND coalesce(d.n_chars, 0) > 200)")
def m19(t: Tables) -> DataFrame:
    """Rows of the train split that a stored index of some of them has no vector for."""
    index, train = exemplars.EmbeddingIndex(t.spark, folder(t.spark, "exemplars")), t.documents.where("doc_id % 10 > 0")
    index.refresh(train.where("doc_id % 3 = 0 and n_chars > 200"), "doc_id", "text", Lengths())
    return index.pending(train, "doc_id", "text").select("doc_id")


@query("m19_embedding_index", """WITH d AS (SELECT *, CASE WHEN doc_id % 4 = 1 AND length(coalesce(text, '')) <= 16000 THEN 1 ELSE 0 END AS changed FROM documents WHERE doc_id % 10 > 0)
 SELECT 'first' AS step, count(*) AS encoded, 0 AS kept, 0 AS removed, sum(least(length(coalesce(text, '')), 16000))::BIGINT AS length FROM d UNION ALL SELECT 'unchanged', 0, count(*), 0, sum(least(length(coalesce(text, '')), 16000))::BIGINT FROM d
 UNION ALL SELECT 'some changed', sum(changed)::BIGINT, sum(1 - changed)::BIGINT, 0, sum(least(length(coalesce(text, '')) + changed, 16000))::BIGINT FROM d
 UNION ALL SELECT 'some gone', 0, count(*) FILTER (doc_id % 7 > 0), count(*) FILTER (doc_id % 7 = 0), sum(least(length(coalesce(text, '')) + changed, 16000)) FILTER (doc_id % 7 > 0)::BIGINT FROM d""")
def m19_runs(t: Tables) -> DataFrame:
    """Four runs of one index over the train split: first, unchanged, with some texts changed, with some rows gone.  `length`
    sums what the index then holds."""
    index, train = exemplars.EmbeddingIndex(t.spark, folder(t.spark, "exemplars")), t.documents.where("doc_id % 10 > 0").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    changed = train.withColumn("text", F.when((F.col("doc_id") % 4 == 1) & (F.length("text") <= 16_000), F.concat(F.lit("+"), "text")).otherwise(F.col("text")))
    rows = []
    for step, docs in (("first", train), ("unchanged", train), ("some changed", changed), ("some gone", changed.where("doc_id % 7 > 0"))):
        r = index.refresh(docs, "doc_id", "text", Lengths())
        rows.append((step, r.encoded, r.kept, r.removed, index.table().agg(F.sum(F.col("embedding")[0].cast("long"))).first()[0]))
    return t.spark.createDataFrame(rows, "step string, encoded long, kept long, removed long, length long")


@query("m20_prediction_stub", f"WITH {HITS} SELECT 'the and of' AS question, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS place, doc_id, round(score, 6) AS score, CAST(NULL AS VARCHAR) AS choice FROM hits")
def m20(t: Tables) -> DataFrame:
    """Evidence only: the documents that speak for an answer, best first; it never chooses."""
    hits = index_of(t).search("the and of", 50)
    place = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id"))  # of the limit's hits
    return hits.select(F.lit("the and of").alias("question"), place.alias("place"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("choice"))


def finite(*columns):
    """None is null, a NaN or infinite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return ~reduce(lambda a, b: a | b, map(bad, columns))


def gate_bar(pr_auc, recall, incumbent_pr_auc, incumbent_recall, has_incumbent):
    """promote and reason: strictly better PR-AUC, recall at the alert budget not worse; metrics that are no numbers fail."""
    reason = F.when(~has_incumbent, "no incumbent").when(~finite(pr_auc, recall, incumbent_pr_auc, incumbent_recall), "non-finite").when(pr_auc <= incumbent_pr_auc, "pr_auc").when(recall < incumbent_recall, "recall").otherwise("better")
    return F.struct(reason.isin("no incumbent", "better").alias("promote"), reason.alias("reason"))


def watcher_bar(auc, incumbent_auc, wins, losses, significant, budget_held, actionable, harmful):
    """promote and reason.  An actionable loss of AUC always refuses, any other difference is noise.  `harmful` (the
    incumbent is favoured by judged harm) is null until judged: then coverage wins must match losses; once judged, coverage
    must be significant instead.  The fire budget must hold either way."""
    regressed = actionable & (auc < incumbent_auc)
    judged = significant & budget_held & ~regressed & ~harmful
    reason = F.when(~finite(auc, incumbent_auc, wins, losses), "non-finite").when(harmful.isNotNull(), F.when(judged, "judged, promotes").otherwise("judged, refuses"))
    reason = F.coalesce(reason, F.when(regressed, "regression").when(~budget_held, "budget").when(wins < losses, "coverage").otherwise("held"))
    return F.struct(reason.isin("judged, promotes", "held").alias("promote"), reason.alias("reason"))


@query("m05_promotion_bars", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE candidate END AS c, base AS b, doc_id % 13 > 0 AS held, doc_id % 5 AS wins, doc_id % 3 AS losses, abs(candidate - base) > 0.05 AS act, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS harmful FROM scored),
 g AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'no incumbent' WHEN c IS NULL THEN 'non-finite' WHEN c <= b THEN 'pr_auc' WHEN c / 2 < b / 2 + 0.1 THEN 'recall' ELSE 'better' END AS gate,
 CASE WHEN c IS NULL THEN 'non-finite' WHEN harmful IS NOT NULL THEN CASE WHEN wins > losses AND held AND NOT (act AND c < b) AND NOT harmful THEN 'judged, promotes' ELSE 'judged, refuses' END WHEN act AND c < b THEN 'regression' WHEN NOT held THEN 'budget' WHEN wins < losses THEN 'coverage' ELSE 'held' END AS watcher FROM x)
 SELECT doc_id, gate IN ('no incumbent', 'better') AS gate_promotes, gate AS gate_reason, watcher IN ('judged, promotes', 'held') AS watcher_promotes, watcher AS watcher_reason FROM g""", "scored")
def m05(t: Tables) -> DataFrame:
    """Both bars over arms that stand for a candidate's and an incumbent's metrics."""
    d, base = F.col("doc_id"), F.col("base")
    c = F.when(d % 11 == 0, F.lit(float("nan"))).otherwise(F.col("candidate"))
    gate = gate_bar(c, c / 2, base, base / 2 + 0.1, d % 17 != 0)
    harmful = F.when(d % 4 == 0, True).when(d % 4 == 1, False)
    watcher = watcher_bar(c, base, d % 5, d % 3, d % 5 > d % 3, d % 13 > 0, F.abs(F.col("candidate") - base) > 0.05, harmful)
    rows = scored(t).select("doc_id", gate.alias("g"), watcher.alias("w"))
    return rows.select("doc_id", F.col("g.promote").alias("gate_promotes"), F.col("g.reason").alias("gate_reason"), F.col("w.promote").alias("watcher_promotes"), F.col("w.reason").alias("watcher_reason"))
