"""The registered queries of this subpackage, over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import load, new_path, staged


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import token_orc

    path = new_path(spark, "token_orc")
    token_orc.write_tokens(load(spark, sf_dir, "documents"), path)
    return token_orc.digests(spark, path)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import packing

    return packing.pack(load(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import lines

    return lines.deduplicated(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import jaccard

    return jaccard.similar_groups(load(spark, sf_dir, "documents"))


def op5_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import class_lm, language

    held_out = F.coalesce(language.fold("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", held_out)
    return class_lm.score(docs, class_lm.learn(docs.where("not held_out")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import licenses

    return licenses.scan(load(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import decontaminate

    return decontaminate.digest(decontaminate.contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import matroska

    return matroska.features(staged(matroska.store(load(spark, sf_dir, "documents").select("doc_id", "text")), "media"))


def op8_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import language

    docs = load(spark, sf_dir, "documents")
    model = language.train(docs.where(language.fold("doc_id", 5) != 0))
    held_out = F.coalesce(language.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return language.predict(docs.select("doc_id", "text", held_out), model).drop("text")


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import quality

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, load(spark, sf_dir, "labels"), quality.grade(), 3)
    return quality.score(docs, model).drop("text")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import near

    return near.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import vector_codes

    return vector_codes.compressed(load(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.llm import fim

    return fim.digests(fim.transformed(load(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS7 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS4 = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_H13 = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)::BIGINT AS h{i + 1}" for i in range(4))


def _codes(book: str) -> str:
    """For each part of `parts` its nearest entry of a codebook: vec_id, part, x, entry, far."""
    return f"SELECT vec_id, part, x, unnest(min_by({{'entry': entry, 'far': far}}, {{'far': far, 'entry': entry}})::STRUCT(entry BIGINT, far BIGINT), recursive := true) FROM (SELECT p.vec_id, p.part, p.x, b.entry, CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS BIGINT) AS far FROM parts p JOIN {book} b USING (part)) GROUP BY 1, 2, 3"


def _refined(codes: str, book: str) -> str:
    """The codebook after a round: integer means, rounded down; entries without parts stay."""
    means = "SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (SELECT part, entry, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM {codes}) GROUP BY 1, 2, 3) GROUP BY 1, 2".format(codes=codes)
    return f"SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN ({means}) m USING (part, entry)"


ORACLES = {
    "op12_vector_codes": f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 parts AS (SELECT vec_id, part, q[part * len(q) // 16 + 1:(part + 1) * len(q) // 16] AS x FROM (SELECT vec_id, q, unnest(range(16)) AS part FROM kept)),
 b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts QUALIFY entry < 64),
 c1 AS MATERIALIZED ({_codes("b0")}), b1 AS MATERIALIZED ({_refined("c1", "b0")}), c2 AS MATERIALIZED ({_codes("b1")}), b2 AS MATERIALIZED ({_refined("c2", "b1")}), c3 AS MATERIALIZED ({_codes("b2")}),
 e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM c3 GROUP BY 1),
 d AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
 l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN kept USING (vec_id) GROUP BY 1)
 SELECT e.vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN kept USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM kept.label, d""",
    "op13_fill_in_middle": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
 d AS (SELECT *, {_H13}, len(u) AS n FROM t),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
 p AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op4_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS4} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * o >= 80 * (x.n + y.n - o)),
 r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY 1, 2""",
    "op7_winnowing": f"""WITH w AS (SELECT doc_id, {_WORDS7} AS ws FROM documents), iw AS (SELECT item_id, {_WORDS7} AS ws FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM iw WHERE len(ws) > 0)),
 dg AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 1, 0) + 1)) AS p FROM w, (SELECT DISTINCT n FROM win))),
 hit AS (SELECT doc_id, item_id, n, p FROM dg JOIN win USING (n, g)),
 pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
 SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
