"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.plans.base import STEERING, Tables, query, sessions

_ACKS = ["ok", "okay", "yes", "thanks", "continue", "go on", "proceed"]
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)

#: Our own definitions of the kinds of junk: patterns that a text of the kind begins with.
JUNK = {
    "structural": r"^\[Request interrupted|^Caveat:",
    "agent_injection": r"^<(system-reminder|task-notification)",
    "stop_hook": r"^Stop hook feedback",
    "continuation": r"^This session is being continued",
    "command_echo": r"^<(command-name|command-message|local-command)",
}


def event_filter(events: DataFrame, *, roles: tuple[str, ...] = ("user",), junk: dict[str, str] = JUNK, phrases: list[str] = _ACKS, least: int = 2) -> DataFrame:
    """Events of these roles that say something: no sidechain, meta or compacted ones (columns that are missing or null
    count as false), not empty, none of the kinds of junk or of the phrases, and `least` characters long."""
    said = T.strip(F.col("text"))
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_sidechain", "is_meta", "is_compacted") if c in events.columns]
    keep = F.col("role").isin(*roles) & (F.length(said) >= max(1, least)) & ~F.lower(said).isin(phrases)
    for flag in flags:
        keep = keep & ~flag
    for pattern in junk.values():
        keep = keep & ~said.rlike(pattern)
    return events.where(keep)


_F01 = "CASE turn % 9 WHEN 3 THEN '<command-name>/x' WHEN 4 THEN '[Request interrupted by user]' WHEN 5 THEN ' Okay' WHEN 6 THEN 'x' WHEN 7 THEN '<system-reminder>' || text WHEN 8 THEN 'Stop hook feedback: ' || text ELSE text END"


@query("f01_event_filter", f"""SELECT session_id, turn, said AS text FROM (SELECT session_id, turn, role, {_F01} AS said FROM turns) WHERE role = 'user' AND turn % 11 > 2 AND length(trim(said, E' \\n\\t\\r')) >= 2
 AND lower(trim(said, E' \\n\\t\\r')) NOT IN ({_IN(_ACKS)}) AND turn % 9 NOT IN (3, 4, 7, 8)""", "turns")
def f01(t: Tables) -> DataFrame:
    turn = F.col("turn") % 11
    rows = t.turns().select("session_id", "turn", "role", F.expr(_F01).alias("text"), (turn == 0).alias("is_sidechain"), (turn == 1).alias("is_meta"), (turn == 2).alias("is_compacted"))
    return event_filter(rows).select("session_id", "turn", "text")


_DETECTOR = "case when turn % 5 = 0 then 'review_comment' when turn % 5 = 1 then 'transcript_message' when turn % 5 = 2 then 'plan_reentry' when turn % 5 = 3 then 'interrupt' else 'denial' end"


@query("f02_survival_gate", f"""WITH s AS (SELECT *, {_DETECTOR} AS detector, lag(role) OVER (PARTITION BY session_id ORDER BY turn) AS before,
 role = 'user' AND length(text) >= 20 AS keep FROM turns)
 SELECT session_id, turn, detector, CASE detector WHEN 'review_comment' THEN CASE WHEN turn % 2 = 0 THEN keep ELSE TRUE END
 WHEN 'transcript_message' THEN keep AND coalesce(before = 'assistant', FALSE) WHEN 'plan_reentry' THEN keep ELSE TRUE END AS survives FROM s""", "turns")
def f02(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("session_id").orderBy("turn"))
    s = t.turns().select("*", F.expr(_DETECTOR).alias("detector"), before.alias("before"), F.when(F.col("turn") % 2 == 0, "typed").otherwise("surfaced").alias("provenance"))
    keep = (F.col("role") == "user") & (F.length("text") >= 20)
    review = F.when(F.col("provenance") == "typed", keep).when(F.col("provenance") == "surfaced", True).otherwise(F.raise_error(F.concat(F.lit("unknown provenance "), F.col("provenance"))).cast("boolean"))
    ok = F.when(F.col("detector") == "review_comment", review).when(F.col("detector") == "transcript_message", keep & F.coalesce(F.col("before") == "assistant", F.lit(False))).when(F.col("detector") == "plan_reentry", keep).otherwise(True)
    return s.select("session_id", "turn", "detector", ok.alias("survives"))


@query("f03_detector_category", f"""SELECT session_id, turn, CASE WHEN d = 'transcript_message' THEN 'transcript_message' WHEN d = 'plan_reentry' THEN 'plan_review' WHEN d IN ('denial','interrupt') THEN 'interrupt_rejection' ELSE 'review_comment' END AS source_kind,
 array_to_string(CASE WHEN d = 'plan_reentry' THEN [session_id, 'plan_review', 'plan_reentry', text] WHEN d = 'transcript_message' THEN [session_id, 'transcript_message', text]
 WHEN d IN ('denial','interrupt') THEN [session_id, 'interrupt_rejection', text] ELSE [session_id, 'review_comment', '', '', '', text] END, '|') AS parts FROM (SELECT *, {_DETECTOR} AS d FROM turns)""", "turns")
def f03(t: Tables) -> DataFrame:
    d = F.expr(_DETECTOR)
    kind = F.when(d == "transcript_message", "transcript_message").when(d == "plan_reentry", "plan_review").when(d.isin("denial", "interrupt"), "interrupt_rejection").otherwise("review_comment")
    middle = F.when(d == "plan_reentry", F.array(F.lit("plan_reentry"))).when(d == "review_comment", F.array(*[F.lit("")] * 3)).otherwise(F.array().cast("array<string>"))
    return t.turns().select("session_id", "turn", kind.alias("source_kind"), F.array_join(F.concat(F.array("session_id", kind), middle, F.array("text")), "|").alias("parts"))


@query("f04_quarantine", "SELECT dedup_key, quarantined_reason FROM feedback WHERE quarantined_reason IS NULL OR quarantined_reason IN ('empty_window')", "feedback")
def f04(t: Tables) -> DataFrame:
    reason = F.col("quarantined_reason")
    return t.feedback().where(reason.isNull() | reason.isin("empty_window")).select("dedup_key", "quarantined_reason")


@query("f05_substantive_messages", "SELECT session_id, len(list_filter(messages, lambda m: regexp_matches(m.content, '\\S'))) > 0 AS substantive FROM sessions", "sessions")
def f05(t: Tables) -> DataFrame:
    return sessions(t.turns()).select("session_id", T.has_content(F.col("messages")).alias("substantive"))


@query("f06_gate_text_substantive", """SELECT session_id, turn, regexp_matches(regexp_replace('<' || role || E'>\\n' || CASE WHEN turn % 3 = 0 THEN '' ELSE text END, '(\\A|\\n\\n)<\\w+>\\n', '', 'g'), '\\S') AS substantive FROM turns""", "turns")
def f06(t: Tables) -> DataFrame:
    gate = F.concat(F.lit("<"), "role", F.lit(">\n"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")))
    return t.turns().select("session_id", "turn", T.substantive(gate).alias("substantive"))


@query("f07_steering_membership", f"SELECT dedup_key, role, id, category, category IN ({_IN(STEERING)}) AS steering FROM verdicts", "verdicts")
def f07(t: Tables) -> DataFrame:
    return t.verdicts().select("dedup_key", "role", "id", "category", F.col("category").isin(STEERING).alias("steering"))


def candidate_status(steering, pair_count):
    """unjudged, noise, refined or accepted."""
    return F.when(steering.isNull(), "unjudged").when(~steering, "noise").when(F.coalesce(pair_count, F.lit(0)) > 0, "refined").otherwise("accepted")


@query("f08_candidate_status", "SELECT dedup_key, CASE WHEN is_steering IS NULL THEN 'unjudged' WHEN NOT is_steering THEN 'noise' WHEN id % 4 > 0 THEN 'refined' ELSE 'accepted' END AS status FROM feedback LEFT JOIN judged USING (dedup_key)", "feedback", "judged")
def f08(t: Tables) -> DataFrame:
    from verdigris.operators.latest import latest_verdict

    j = latest_verdict(t.verdicts(), "judge").select("dedup_key", "is_steering")
    return t.feedback().join(j, "dedup_key", "left").select("dedup_key", candidate_status(F.col("is_steering"), F.col("id") % 4).alias("status"))


@query("f09_agreement", """SELECT doc_id, CASE WHEN a IS NULL OR j IS NULL THEN NULL WHEN j = a THEN 'agree' ELSE 'disagree' END AS agreement,
 CASE WHEN e IS NULL OR j IS NULL THEN NULL WHEN j = e THEN 'pass' ELSE 'fail' END AS golden FROM (SELECT doc_id, quality = 1 AS j, CASE WHEN doc_id % 3 = 0 THEN toxic = 0 END AS a, CASE WHEN doc_id % 5 = 0 THEN TRUE END AS e FROM labels)""")
def f09(t: Tables) -> DataFrame:
    j, a, e = F.col("quality") == 1, F.when(F.col("doc_id") % 3 == 0, F.col("toxic") == 0), F.when(F.col("doc_id") % 5 == 0, F.lit(True))
    same = lambda x, y, yes, no: F.when(x.isNull() | y.isNull(), None).when(x == y, yes).otherwise(no)
    return t.labels.select("doc_id", same(j, a, "agree", "disagree").alias("agreement"), same(j, e, "pass", "fail").alias("golden"))


@query("f10_noise_floor", """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS confidence, CAST(props->>'$.k' AS BIGINT) < 30 AS noise FROM events""")
def f10(t: Tables) -> DataFrame:
    c = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", c.alias("confidence"), (c < 30).alias("noise"))


@query("f11_deliverable", """SELECT session_id, turn, length(text) <= 500 AND position(E'\\n\\n' IN trim(text, E' \\n\\t\\r')) = 0 AND NOT contains(text, '<proposal') AND NOT contains(text, '</proposal') AS deliverable FROM turns""", "turns")
def f11(t: Tables) -> DataFrame:
    return t.turns().select("session_id", "turn", T.deliverable(F.col("text")).alias("deliverable"))


def allowed(path, roots: list[str]):
    """Equal to a root, or below one."""
    return F.exists(F.array(*map(F.lit, roots)), lambda a: (path == a) | path.startswith(F.concat(a, F.lit("/"))))


@query("f12_allow_list", """SELECT page_id, p = '/en' OR starts_with(p, '/en/') OR p = '/fr/825' OR starts_with(p, '/fr/825/') AS allowed FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS p FROM pages)""")
def f12(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return t.pages.select("page_id", path.alias("p")).select("page_id", allowed(F.col("p"), ["/en", "/fr/825"]).alias("allowed"))


def delivery(mode, may, holdout, delivered, most):
    """state and emit of a popped steer."""
    live = F.when(holdout, "holdout").when(delivered >= most, "suppressed_budget").otherwise("delivered")
    state = F.when(mode.isin("mirror", "shadow"), "mirror").when((mode == "live_allow") & ~may, "mirror").when(mode.isin("live_allow", "live_all"), live).otherwise(F.raise_error(F.concat(F.lit("unknown mode "), mode)))
    return state.alias("state"), (state == "delivered").alias("emit")


_MODES = ["mirror", "shadow", "live_allow", "live_all"]


@query("f13_delivery_decision", """WITH m AS (SELECT event_id, (['mirror','shadow','live_allow','live_all'])[event_id % 4 + 1] AS mode, event_id % 3 > 0 AS may, event_id % 10 = 3 AS holdout, event_id % 25 AS delivered FROM events),
 s AS (SELECT event_id, CASE WHEN mode IN ('mirror','shadow') OR (mode = 'live_allow' AND NOT may) THEN 'mirror' WHEN holdout THEN 'holdout' WHEN delivered >= 20 THEN 'suppressed_budget' ELSE 'delivered' END AS state FROM m)
 SELECT event_id, state, state = 'delivered' AS emit FROM s""")
def f13(t: Tables) -> DataFrame:
    e = F.col("event_id")
    mode = F.element_at(F.array(*map(F.lit, _MODES)), (e % 4 + 1).cast("int"))
    return t.events.select(e, mode.alias("mode")).select("event_id", *delivery(F.col("mode"), e % 3 > 0, e % 10 == 3, e % 25, 20))


def checked(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """df; missing columns raise at once, repeated ids when rows are read."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    n = F.count("*")
    once = df.groupBy(key).agg(F.when(n > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(key).cast("string")))).cast("boolean").alias("__twice"))
    return df.join(once.where("__twice is null").select(key), key)


@query("f14_validated", "SELECT doc_id, text FROM documents")
def f14(t: Tables) -> DataFrame:
    return checked(t.documents.select("doc_id", "text"), ["doc_id", "text"], "doc_id")


@query("f15_view_projection", """SELECT s.session_id, CAST(len(messages) AS INTEGER) AS n_prompt, messages[1].content AS first_prompt, messages[-1].content AS completion FROM sessions s WHERE messages[-1].role = 'assistant'""", "sessions")
def f15(t: Tables) -> DataFrame:
    m = F.col("messages")
    last = F.element_at(m, -1)
    content = F.when(T.strip(last["content"]) == "", F.raise_error(F.concat(F.lit("empty completion in "), F.col("session_id")))).otherwise(last["content"])
    return sessions(t.turns()).where(last["role"] == "assistant").select("session_id", F.size(m).alias("n_prompt"), F.element_at(m, 1)["content"].alias("first_prompt"), content.alias("completion"))


_LIVE = [("view", "pos", True, 0.9), ("click", "pos-corrected", True, 0.7), ("signup", "pos-corrected", True, 0.5), ("error", "neg", False, 0.8)]


@query("f16_live_labels", "SELECT event_id, CASE kind WHEN 'view' THEN 'pos' WHEN 'click' THEN 'pos-corrected' WHEN 'signup' THEN 'pos-corrected' ELSE 'neg' END AS tag, kind <> 'error' AS label, CASE kind WHEN 'view' THEN 0.9::DOUBLE WHEN 'click' THEN 0.7::DOUBLE WHEN 'signup' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM moments WHERE kind <> 'purchase'", "moments")
def f16(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(_LIVE, "kind string, tag string, label boolean, confidence double")
    return t.moments().join(F.broadcast(table), "kind").select("event_id", "tag", "label", "confidence")


@query("f17_excluded_rows", "SELECT count(*) AS labelled, CAST(sum(CASE WHEN NOT regexp_matches(text, '\\S') OR length(text) < 40 THEN 1 ELSE 0 END) AS BIGINT) AS quarantined FROM turns", "turns")
def f17(t: Tables) -> DataFrame:
    return t.turns().agg(F.count("*").alias("labelled"), F.count_if((T.strip(F.col("text")) == "") | (F.length("text") < 40)).alias("quarantined"))
