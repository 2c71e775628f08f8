"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import formats, hashing
from verdigris.functions import text as T
from verdigris.operators import similarity
from verdigris.plans.base import Tables, query, sessions

_FOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i: ('0x' || substr(sha256({k}), i, 1))::BIGINT)), lambda a, d: (a * 16 + d) % {m})"


@query("x01_session_split", f"SELECT session_id, CASE WHEN {_FOLD.format(k='session_id', m=10)} = 0 THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT session_id FROM turns)", "turns")
def x01(t: Tables) -> DataFrame:
    return t.turns().select("session_id").distinct().select("session_id", hashing.split_of(F.col("session_id")).alias("split"))


@query("x02_holdout", f"SELECT o_orderkey, {_FOLD.format(k='CAST(o_orderkey AS VARCHAR)', m=10000)} < 1500 AS held_out FROM orders")
def x02(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", hashing.held_out(F.col("o_orderkey").cast("string"), 0.15).alias("held_out"))


@query("x03_dedup_key", "SELECT session_id, turn, sha256(session_id || chr(0) || 'transcript_message' || chr(0) || text) AS key FROM turns", "turns")
def x03(t: Tables) -> DataFrame:
    return t.turns().select("session_id", "turn", hashing.dedup_key(F.col("session_id"), F.lit("transcript_message"), F.col("text")).alias("key"))


@query("x04_round_id", "SELECT session_id, turn, substr(sha256(session_id || ':e' || turn || ':' || CASE WHEN turn % 2 = 0 THEN 'None' ELSE 't' || turn END || ':0'), 1, 16) AS id FROM turns", "turns")
def x04(t: Tables) -> DataFrame:
    turn = F.col("turn").cast("string")
    tool = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("t"), turn))
    return t.turns().select("session_id", "turn", hashing.round_id(F.col("session_id"), F.concat(F.lit("e"), turn), tool, F.lit(0)).alias("id"))


_PATH = "CASE page_id % 4 WHEN 0 THEN '/home/u/-Users-me-Code-app-Code-' || page_id || '/x.jsonl' WHEN 1 THEN '/h/-a-projects-b' || page_id || '/x' WHEN 2 THEN '/h/--plain' || page_id || '/y' ELSE '/h/-r-worktrees-w' || page_id || '/z' END"


@query("x05_project_label", f"WITH p AS (SELECT page_id, string_split({_PATH}, '/')[-2] AS n FROM pages) SELECT page_id, CASE WHEN contains(n, '-Code-') THEN string_split(n, '-Code-')[-1] WHEN contains(n, '-projects-') THEN string_split(n, '-projects-')[-1] WHEN contains(n, '-worktrees-') THEN string_split(n, '-worktrees-')[-1] ELSE ltrim(n, '-') END AS label FROM p")
def x05(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.expr(_PATH).alias("p")).select("page_id", T.project_label(F.col("p")).alias("label"))


@query("x06_path_rewrite", "SELECT page_id, replace(url, '.example.', '.test.') AS url FROM pages")
def x06(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.replace("url", F.lit(".example."), F.lit(".test.")).alias("url"))


@query("x07_direction_key", "SELECT doc_id, lower(regexp_replace(regexp_replace(trim(text, E' \\n\\t\\r'), '\\s+', ' ', 'g'), '\\.+$', '')) AS key FROM documents")
def x07(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.direction_key(F.col("text")).alias("key"))


@query("x08_truncate", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(substr(text, 1, 59), E' \\n\\t\\r') || '…' END AS short, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 60) || '…(+' || (length(text) - 60) || 'ch)' END AS clipped FROM documents")
def x08(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncate(F.col("text"), 60).alias("short"), T.clip(F.col("text"), 60).alias("clipped"))


@query("x09_flatten", "SELECT session_id, array_to_string(list_transform(messages, lambda m: '<' || m.role || E'>\\n' || m.content), E'\\n\\n') AS text FROM sessions", "sessions")
def x09(t: Tables) -> DataFrame:
    return sessions(t.turns()).select("session_id", T.flatten(F.col("messages")).alias("text"))


@query("x10_unflatten", "SELECT session_id, CAST(len(messages) AS INTEGER) AS n, array_to_string(list_transform(messages, lambda m: m.role), ',') AS roles, array_to_string(list_transform(messages, lambda m: m.content), '|') AS contents FROM sessions", "sessions")
def x10(t: Tables) -> DataFrame:
    """The round trip: a flattened session gives its messages again."""
    m = T.unflatten(T.flatten(F.col("messages")))
    out = sessions(t.turns()).select("session_id", m.alias("m"))
    return out.select("session_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.array_join(F.transform("m", lambda x: x["content"]), "|").alias("contents"))




@query("x11_scrub", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'a b' WHEN 1 THEN 'keep ' ELSE 'plain ' || turn END AS text FROM conversations")
def x11(t: Tables) -> DataFrame:
    tagged = F.expr("case conv_id % 3 when 0 then concat('a <proposal id=\"1\">x', turn, '</proposal> \\n b') when 1 then concat('keep <proposal>cut ', turn) else concat('plain ', turn) end")
    return t.conversations.select("conv_id", "turn", T.scrub(tagged, "proposal").alias("text"))


@query("x12_think_strip", "SELECT conv_id, turn, trim(regexp_replace(' <think>' || turn || E'\\nx</think> say ' || turn || '<think>y</think>', '<think>(.|\\n)*?</think>', '', 'g')) AS text FROM conversations")
def x12(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" <think>"), "turn", F.lit("\nx</think> say "), "turn", F.lit("<think>y</think>"))
    return t.conversations.select("conv_id", "turn", T.strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")).alias("text"))


@query("x13_ask_rewrite", "SELECT session_id, turn, 'before [assistant asked: H] ' || rtrim(replace(text, E'\\n', ' ')) || E'\\n- Yes\\n- No\\n(recommended: Yes)' AS text FROM turns", "turns")
def x13(t: Tables) -> DataFrame:
    """Each turn's text as the question of a previewed call, quoted as the preview quotes it."""
    said = F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    raw = F.concat(F.lit("before AskUserQuestion([{'question': '"), said, F.lit("', 'header': 'H', 'options': [{'label': 'Yes (Recommended)'}, {'label': \"No\"}]}]) after"))
    return t.turns().select("session_id", "turn", formats.ask_blocks(raw).alias("text"))


@query("x14_review_cites", """SELECT doc_id, 'src/a' || doc_id || '.py' AS file, CAST(doc_id % 90 + 1 AS INTEGER) AS line_start, CAST(doc_id % 90 + 5 AS INTEGER) AS line_end, 'fix ' || lang AS comment FROM documents UNION ALL SELECT doc_id, 'b.py', 7, NULL, 'claim ' || source || ' try it' FROM documents WHERE doc_id % 2 = 0
 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'W' || doc_id || ' [BUG] In ' || lang || ' FIX: mend it Tests: add' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'c.py', 3, 9, 'found do' FROM documents WHERE doc_id % 5 = 0""")
def x14(t: Tables) -> DataFrame:
    """Comments in all four forms."""
    finding = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n- file: b.py:7\n- theme: t\n- claim: claim "), "source", F.lit("\n- suggestion: try it\n"))).otherwise("")
    stream = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n### W"), "doc_id", F.lit(" [BUG] — In "), "lang", F.lit("\nFIX: mend it\nother\nTests: add"))).otherwise("")
    raw = F.concat(F.lit("see\nIn src/a"), "doc_id", F.lit(".py:L"), F.col("doc_id") % 90 + 1, F.lit("-"), F.col("doc_id") % 90 + 5, F.lit(": fix "), "lang", finding, stream)
    json = F.when(F.col("doc_id") % 5 == 0, F.lit('{"confirmedHigh": [{"path": "c.py", "lines": "3-9", "message": "found", "fix": "do"}]}')).otherwise("")
    rows = t.documents.select("doc_id", F.explode(F.array(raw, json)).alias("raw"))
    return rows.select("doc_id", F.explode(formats.review_comments(F.col("raw"))).alias("c")).select("doc_id", "c.file", "c.line_start", "c.line_end", "c.comment")


@query("x15_option_selection", """SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '1,2' WHEN 2 THEN '2' WHEN 3 THEN '0' ELSE '' END AS picks, doc_id % 4 = 2 AS custom FROM documents""")
def x15(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.array(F.lit("a"), F.lit("a, b"), F.lit("c")).alias("options"), F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, "a, b, c").when(F.col("doc_id") % 4 == 2, "c, other").otherwise("a").alias("answer"), (F.col("doc_id") % 4 < 3).alias("multi"))
    s = rows.select("doc_id", formats.selection(F.col("answer"), F.col("options"), F.col("multi")).alias("s"))
    return s.select("doc_id", F.array_join(F.transform("s.picks", lambda x: x.cast("string")), ",").alias("picks"), "s.custom")


@query("x16_templates", "SELECT session_id, turn, rtrim(CASE WHEN turn % 2 = 0 THEN '[assistant asked: H' || turn || '] ' ELSE '[assistant asked] ' END || text) || E'\\n- yes\\n- no' || CASE WHEN turn % 3 = 0 THEN E'\\n(recommended: yes)' ELSE '' END AS block FROM turns", "turns")
def x16(t: Tables) -> DataFrame:
    header = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("H"), F.col("turn").cast("string"))).otherwise("")
    recommended = F.when(F.col("turn") % 3 == 0, "yes").otherwise("")
    return t.turns().select("session_id", "turn", formats.ask_block(F.col("text"), header, F.array(F.lit("yes"), F.lit("no")), recommended).alias("block"))


@query("x17_file_language", "WITH p AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS n FROM pages) SELECT page_id, lower(CASE WHEN regexp_extract(n, '[^.]\\.([^.]+)$', 1) <> '' THEN regexp_extract(n, '[^.]\\.([^.]+)$', 1) ELSE n END) AS language FROM p")
def x17(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.language_of_file(F.regexp_replace("url", r"[?#].*$", "")).alias("language"))


_TOK = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+')), lambda x: x <> '')"


@query("x18_token_jaccard", f"""WITH p AS (SELECT session_id, turn, {_TOK.format(c='text')} AS a, {_TOK.format(c='lag(text) OVER (PARTITION BY session_id ORDER BY turn)')} AS b FROM turns) SELECT session_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS similarity FROM p""", "turns")
def x18(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.coalesce(F.lag("text").over(Window.partitionBy("session_id").orderBy("turn")), F.lit(""))
    rows = t.turns().withColumn("before", before)
    return rows.select("session_id", "turn", F.round(T.token_jaccard(F.col("text"), F.col("before")), 9).alias("similarity"))


@query("x19_cosine", "WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, lag(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings) SELECT vec_id, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 9) AS cosine FROM n WHERE u IS NOT NULL")
def x19(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    e = t.embeddings.withColumn("u", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("u is not null")
    return e.select("vec_id", F.round(similarity.cosine(F.col("u"), F.col("embedding")), 9).alias("cosine"))


@query("x20_reaction_bands", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'ignored' WHEN score >= 0.7 THEN 'accepted' WHEN score >= 0.3 THEN 'edited' ELSE 'diverged' END AS reaction FROM moments", "moments")
def x20(t: Tables) -> DataFrame:
    sim = F.when(F.col("event_id") % 9 != 0, F.col("score"))
    return t.moments().select("event_id", F.when(sim.isNull(), "ignored").when(sim >= 0.7, "accepted").when(sim >= 0.3, "edited").otherwise("diverged").alias("reaction"))


@query("x21_word_edit_distance")
def x21(t: Tables) -> DataFrame:
    """Whole turns against themselves with words exchanged."""
    rows = t.turns().select("session_id", "turn", F.col("text").alias("a"), F.regexp_replace("text", "the", "a").alias("b"))
    return rows.select("session_id", "turn", formats.word_distance(F.col("a"), F.col("b")).alias("distance"))


_SH = "list_distinct(list_transform(range(0, greatest(octet_length(encode({c})) - 4, 0)), lambda i: list_reduce(list_transform(range(0, 5), lambda k: CAST('0x' || substr(hex(encode({c})), 2 * (i + k) + 1, 2) AS BIGINT)), lambda a, b: a * 257 + b)))"


@query("x22_shingles", f"SELECT session_id, turn, CAST(len(s) AS INTEGER) AS n, coalesce(list_min(s), -1) AS least, coalesce(CAST(list_sum(s) AS BIGINT), 0) AS total FROM (SELECT session_id, turn, {_SH.format(c='text')} AS s FROM turns)", "turns")
def x22(t: Tables) -> DataFrame:
    key = F.struct("session_id", "turn").alias("key")
    rows = similarity.shingle_sets(t.turns().select(key, "text"), "key", "text")
    return rows.select("key.session_id", "key.turn", F.size("s").alias("n"), F.coalesce(F.array_min("s"), F.lit(-1)).alias("least"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("x23_shingle_jaccard", f"WITH s AS (SELECT session_id, turn, {_SH.format(c='text')} AS a, {_SH.format(c='substr(text, 11)')} AS b FROM turns) SELECT session_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS similarity FROM s", "turns")
def x23(t: Tables) -> DataFrame:
    """Each turn against itself without its first ten characters."""
    rows = t.turns().select("session_id", "turn", "text", F.expr("substring(text, 11)").alias("rest"))
    return similarity.shingle_similarity(rows, ["session_id", "turn"], "text", "rest").withColumn("similarity", F.round("similarity", 9))


_A, _B = similarity.coefficients(128, 17)


@query("x24_minhash", f"WITH s AS (SELECT session_id, turn, list_transform({_SH.format(c='text')}, lambda h: h % 2147483647) AS s FROM turns) SELECT session_id, turn, array_to_string(list_transform(range(1, 129), lambda p: list_min(list_transform(s, lambda h: (({_A})[p] * h + ({_B})[p]) % 2147483647))), ',') AS signature FROM s WHERE len(s) > 0", "turns")
def x24(t: Tables) -> DataFrame:
    rows = t.turns().select(F.struct("session_id", "turn").alias("key"), "session_id", "turn", "text")
    ids = rows.select(F.concat_ws(":", "session_id", "turn").alias("key"), "text")
    signed = similarity.minhash(ids, "key", "text", 128, 17).where("signature is not null")
    return signed.select(F.substring_index("key", ":", 1).alias("session_id"), F.substring_index("key", ":", -1).cast("long").alias("turn"), F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query("x25_timestamps", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(ts) END AS micros FROM moments", "moments")
def x25(t: Tables) -> DataFrame:
    """ISO text to an instant: naive is UTC, an offset counts, blank and broken are null."""
    raw = F.when(F.col("event_id") % 3 == 0, "not a time").when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    return t.moments().select("event_id", F.unix_micros(F.try_to_timestamp(raw)).alias("micros"))


@query("x26_expiry", "SELECT event_id, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires, TIMESTAMP '2024-01-15' >= ts + INTERVAL 90 MINUTE AS expired FROM moments", "moments")
def x26(t: Tables) -> DataFrame:
    end = F.col("ts") + F.expr("interval 90 minutes")
    return t.moments().select("event_id", F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("expires"), (F.expr("timestamp_ntz '2024-01-15'") >= end).alias("expired"))


@query("x27_json_meta", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k":' || (props->>'$.k') || '}' ELSE '{"k":' || (props->>'$.k') || ',"kind":"' || kind || '"}' END AS meta FROM moments""", "moments")
def x27(t: Tables) -> DataFrame:
    meta = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.col("event_id") % 2 == 1, F.col("kind")).alias("kind"))
    return t.moments().select("event_id", F.to_json(meta).alias("meta"))


@query("x28_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(score * 4 - 2) / 1.5)), 9) AS p FROM moments", "moments")
def x28(t: Tables) -> DataFrame:
    return t.moments().select("event_id", F.round(1 / (1 + F.exp(-(F.col("score") * 4 - 2) / 1.5)), 9).alias("p"))


@query("x29_probability_lines", "SELECT event_id, 0 AS n, least(1.0, (event_id % 130) / 100.0)::DOUBLE AS p FROM moments UNION ALL SELECT event_id, 1, 0.25::DOUBLE FROM moments", "moments")
def x29(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("0: "), (F.col("event_id") % 130 / 100.0).cast("string"), F.lit("\n1: 0.25\nnoise"))
    return t.moments().select("event_id", F.explode(formats.probabilities(raw, 2)).alias("n", "p"))


@query("x30_completion_choice", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN kind END AS choice FROM moments", "moments")
def x30(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "  ").when(F.col("event_id") % 3 == 1, " NONE\n").otherwise(F.concat(F.lit(" "), "kind"))
    return t.moments().select("event_id", F.nullif(F.nullif(T.strip(raw), F.lit("")), F.lit("NONE")).alias("choice"))


@query("x31_heuristic_gate", "SELECT session_id, CASE WHEN len(messages) >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM sessions", "sessions")
def x31(t: Tables) -> DataFrame:
    headers = F.regexp_count(T.flatten(F.col("messages")), F.lit(r"(?:\A|\n\n)<(system|user|assistant)>\n"))
    return sessions(t.turns()).select("session_id", F.when(headers >= 3, 1.0).otherwise(0.0).alias("score"))
