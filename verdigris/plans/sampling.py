"""Sort, limit, top-k and sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import sampling as S
from verdigris.operators import similarity
from verdigris.plans.base import Tables, query, scored


@query("k01_recent", "SELECT event_id, session_id FROM moments WHERE kind = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25", "moments")
def k01(t: Tables) -> DataFrame:
    return t.moments().where("kind = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "session_id")


def nearest(t: Tables, n: int) -> DataFrame:
    """The n vectors most like vector 0."""
    probe = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("probe"))
    sim = F.round(similarity.cosine(F.col("probe"), F.col("embedding")), 9)
    rows = t.embeddings.where("vec_id > 0").join(F.broadcast(probe), F.lit(True))
    return rows.select("vec_id", sim.alias("similarity"), "embedding").orderBy(F.desc("similarity"), "vec_id").limit(n)


@query("k02_nearest", "WITH p AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id > 0) SELECT vec_id, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 9) AS similarity FROM e, p ORDER BY similarity DESC, vec_id LIMIT 32")
def k02(t: Tables) -> DataFrame:
    return nearest(t, 32).select("vec_id", "similarity")


def mmr(vectors: np.ndarray, sims: np.ndarray, k: int, d: float) -> list[int]:
    """Greedy: the next has the largest (1 − d)·similarity − d·its largest similarity to what was picked."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    v = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    picked: list[int] = []
    near = np.zeros(len(v))
    while len(picked) < min(k, len(v)):
        gain = (1 - d) * sims - d * near
        gain[picked] = -np.inf
        picked.append(int(gain.argmax()))
        near = np.maximum(near, v @ v[picked[-1]]) if len(picked) > 1 else v @ v[picked[-1]]
    return picked


@query("k03_mmr")
def k03(t: Tables) -> DataFrame:
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["similarity", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        got = mmr(np.stack(group["embedding"]).astype(float), group["similarity"].to_numpy(), 8, 0.5)
        return pd.DataFrame({"vec_id": group["vec_id"].to_numpy()[got], "place": np.arange(1, len(got) + 1)})

    return nearest(t, 32).withColumn("probe", F.lit(0)).groupBy("probe").applyInPandas(run, "vec_id long, place int")


_RANK = "row_number() OVER (PARTITION BY {p} ORDER BY sha256('{s}:' || doc_id), doc_id)"


@query("k04_carve", f"WITH n AS (SELECT quality, greatest(round_even(count(*) * 0.15, 0), 1) AS q FROM labels GROUP BY 1), r AS (SELECT doc_id, quality, {_RANK.format(p='quality', s=5)} AS p FROM labels) SELECT r.doc_id, CASE WHEN p <= q THEN 'val' ELSE 'train' END AS split FROM r JOIN n USING (quality)")
def k04(t: Tables) -> DataFrame:
    return S.carve(t.labels, ["quality"], "doc_id", 0.15, 5).select("doc_id", "split")


@query("k05_carve_by_kind", f"WITH n AS (SELECT label, kind, greatest(round_even(count(*) * 0.1, 0), 1) AS q FROM scored GROUP BY 1, 2), r AS (SELECT doc_id, label, kind, {_RANK.format(p='label, kind', s=6)} AS p FROM scored) SELECT r.doc_id, CASE WHEN p <= q THEN 'val' ELSE 'train' END AS split FROM r JOIN n ON r.label = n.label AND r.kind = n.kind", "scored")
def k05(t: Tables) -> DataFrame:
    return S.carve(scored(t), ["label", "kind"], "doc_id", 0.1, 6).select("doc_id", "split")


@query("k06_oversample", f"WITH c AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM labels), r AS (SELECT doc_id, quality, {_RANK.format(p='quality', s=7)} AS pl FROM labels) SELECT doc_id, CAST(unnest(range(0, 1 + CASE WHEN quality = 0 AND c.p > c.n THEN (c.p - c.n) // c.n + CASE WHEN pl <= (c.p - c.n) % c.n THEN 1 ELSE 0 END ELSE 0 END)) AS INTEGER) AS copy FROM r, c")
def k06(t: Tables) -> DataFrame:
    """The minority to parity."""
    n = t.labels.agg(F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("n"))
    extra = n.select(F.lit(0).cast("bigint").alias("quality"), F.greatest(F.col("p") - F.col("n"), F.lit(0)).alias("n_extra"))
    rows = t.labels.select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    return S.repeat_to(rows, extra, "doc_id", 7, ["quality"]).select("doc_id", "copy")


@query("k07_oversample_factor", f"WITH r AS (SELECT doc_id, {_RANK.format(p='1', s=8)} AS pl, count(*) OVER () AS n FROM labels WHERE toxic = 1) SELECT doc_id, CAST(unnest(range(0, 1 + CAST(round_even(n * 1.5, 0) AS BIGINT) // n + CASE WHEN pl <= CAST(round_even(n * 1.5, 0) AS BIGINT) % n THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM r")
def k07(t: Tables) -> DataFrame:
    rows = t.labels.where("toxic = 1").select("doc_id", F.col("toxic").cast("bigint").alias("toxic"))
    extra = rows.groupBy("toxic").agg(F.bround(F.count("*") * F.lit(1.5)).cast("bigint").alias("n_extra"))
    return S.repeat_to(rows, extra, "doc_id", 8, ["toxic"]).select("doc_id", "copy")


@query("k08_session_sample", "WITH s AS (SELECT DISTINCT session_id FROM turns WHERE CAST(session_id AS BIGINT) % 4 > 0) SELECT session_id FROM s ORDER BY sha256('9:' || session_id), session_id LIMIT 10", "turns")
def k08(t: Tables) -> DataFrame:
    done = t.turns().where("cast(session_id as bigint) % 4 = 0").select("session_id")
    return t.turns().select("session_id").distinct().join(done, "session_id", "left_anti").orderBy(S.draw(9, F.col("session_id")), "session_id").limit(10)


@query("k09_audit_sample", "WITH g AS (SELECT doc_id, kind, CASE WHEN kind IN ('src1', 'src2', 'src3') THEN kind ELSE '__rest' END AS g FROM scored) SELECT doc_id, kind FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY sha256('11:' || doc_id), doc_id) <= CASE g WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 WHEN 'src3' THEN 4 ELSE 20 END", "scored")
def k09(t: Tables) -> DataFrame:
    return S.quota_sample(scored(t).select("doc_id", "kind"), "kind", {"src1": 3, "src2": 2, "src3": 4}, 20, "doc_id", 11)


@query("k10_diagnostic_pools", "WITH g AS (SELECT doc_id, CASE WHEN base > 0.9 AND label THEN 'a' WHEN base > 0.9 THEN 'b' WHEN base < 0.2 AND label THEN 'c' ELSE 'd' END AS pool FROM scored) SELECT doc_id, pool FROM g QUALIFY pool IN ('a', 'b') OR row_number() OVER (PARTITION BY pool ORDER BY sha256('12:' || doc_id), doc_id) <= 10", "scored")
def k10(t: Tables) -> DataFrame:
    """Four disjoint pools by priority: two whole, two by draw."""
    high, label = F.col("base") > 0.9, F.col("label")
    pool = F.when(high & label, "a").when(high, "b").when((F.col("base") < 0.2) & label, "c").otherwise("d")
    rows = S.ranked(scored(t).select("doc_id", pool.alias("pool")), ["pool"], "doc_id", 12)
    return rows.where(F.col("pool").isin("a", "b") | (F.col("place") <= 10)).select("doc_id", "pool")


@query("k11_stratified_rows", f"WITH n AS (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS total FROM labels GROUP BY 1), r AS (SELECT doc_id, quality, {_RANK.format(p='quality', s=13)} AS p FROM labels) SELECT r.doc_id, r.quality = 1 AS label FROM r JOIN n USING (quality) WHERE p <= greatest(1, n.n * 40 // n.total)")
def k11(t: Tables) -> DataFrame:
    """At most 40 rows, in proportion, one of a class at least."""
    n = t.labels.groupBy("quality").agg(F.count("*").alias("n"))
    n = n.join(F.broadcast(t.labels.agg(F.count("*").alias("total"))), F.lit(True)).select("quality", F.greatest(F.lit(1), F.floor(F.col("n") * 40 / F.col("total"))).alias("quota"))
    return S.ranked(t.labels, ["quality"], "doc_id", 13).join(n, "quality").where("place <= quota").select("doc_id", (F.col("quality") == 1).alias("label"))


@query("k12_bootstrap_auc")
def k12(t: Tables) -> DataFrame:
    return S.bootstrap_auc(scored(t).withColumnRenamed("doc_id", "__id"), "label", "base", 200, 3)


@query("k13_greedy_budget", """WITH RECURSIVE o AS (SELECT session_id, turn, length(text) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i FROM turns), g AS (SELECT session_id, turn, i, n <= 700 AS kept, CASE WHEN n <= 700 THEN n ELSE 0 END AS used FROM o WHERE i = 1
 UNION ALL SELECT o.session_id, o.turn, o.i, g.used + o.n <= 700, g.used + CASE WHEN g.used + o.n <= 700 THEN o.n ELSE 0 END FROM g JOIN o ON o.session_id = g.session_id AND o.i = g.i + 1) SELECT session_id, turn FROM g WHERE kept""", "turns")
def k13(t: Tables) -> DataFrame:
    return S.greedy(t.turns().withColumn("n", F.length("text")), "session_id", ["turn"], "n", 700).select("session_id", "turn")


@query("k14_request_batches", """WITH RECURSIVE o AS (SELECT session_id, turn, length(text) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i FROM turns), g AS (SELECT session_id, turn, i, 0 AS batch, 1 AS k, n AS used FROM o WHERE i = 1
 UNION ALL SELECT o.session_id, o.turn, o.i, g.batch + CASE WHEN g.k >= 3 OR g.used + o.n > 900 THEN 1 ELSE 0 END, CASE WHEN g.k >= 3 OR g.used + o.n > 900 THEN 1 ELSE g.k + 1 END, CASE WHEN g.k >= 3 OR g.used + o.n > 900 THEN o.n ELSE g.used + o.n END FROM g JOIN o ON o.session_id = g.session_id AND o.i = g.i + 1) SELECT session_id, turn, CAST(batch AS INTEGER) AS batch FROM g""", "turns")
def k14(t: Tables) -> DataFrame:
    return S.batches(t.turns().withColumn("n", F.length("text")), "session_id", ["turn"], "n", 3, 900).select("session_id", "turn", "batch")


@query("k15_weekly_seed", "SELECT DISTINCT CAST(isoyear(o_orderdate) * 100 + week(o_orderdate) AS INTEGER) AS seed FROM orders")
def k15(t: Tables) -> DataFrame:
    seed = F.extract(F.lit("YEAROFWEEK"), "o_orderdate") * 100 + F.weekofyear("o_orderdate")
    return t.orders.select(seed.cast("int").alias("seed")).distinct()
