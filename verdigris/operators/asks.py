"""Ask rounds from raw transcript entries, whose shape drifts: entries stay VARIANT until a field is taken.

An entry is a JSON line.  Uses of the ask tool stand in `message.content` of assistant entries; their results come in later
entries of the session, as a block of `message.content` that names the use, beside `toolUseResult`.  A result with questions
is typed and gives a row for each question, its answer looked up by the question's text.  A use whose result is something
else, or missing, is set apart with the kind of what stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import formats, hashing

# The ask tool's name, and the mark that every ask block begins with.
TOOL = "AskUserQuestion"
MARK = "[assistant asked"


def at(v: Column | str, path: str, kind: str = "string") -> Column:
    """What stands at the path, if it can be read as the kind."""
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    """string, object, array, bigint …; none where nothing stands."""
    return F.coalesce(F.lower(F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)), F.lit("none"))


def blocks(entries: DataFrame, *kept: str) -> DataFrame:
    """kept columns, entry, block: the content blocks of entries (session_id, line); content that is no list has none, and a
    line that is no JSON is left out."""
    parsed = entries.select("session_id", "line_no", F.try_parse_json("line").alias("entry")).where("entry is not null")
    return parsed.select(*kept, "entry", F.explode(at("entry", "$.message.content", "array<variant>")).alias("block"))


def ask_uses(entries: DataFrame) -> DataFrame:
    """session_id, event_uuid, occurred_at, tool_use_id, result (VARIANT): each use of the ask tool with its first result."""
    rows = blocks(entries, "session_id", "line_no")
    used = rows.where((at("entry", "$.type") == "assistant") & (at("block", "$.type") == "tool_use") & (at("block", "$.name") == TOOL))
    used = used.select("session_id", at("entry", "$.uuid").alias("event_uuid"), at("entry", "$.timestamp").alias("occurred_at"), at("block", "$.id").alias("tool_use_id"))
    came = rows.where(at("block", "$.type") == "tool_result").select("session_id", "line_no", at("block", "$.tool_use_id").alias("tool_use_id"), F.to_json(at("entry", "$.toolUseResult", "variant")).alias("result"))
    first = came.groupBy("session_id", "tool_use_id").agg(F.min_by("result", "line_no").alias("result"))
    return used.join(first, ["session_id", "tool_use_id"], "left").withColumn("result", F.try_parse_json("result"))


def ask_rounds(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rounds of typed uses, and the uses that are set apart (session_id, event_uuid, tool_use_id, result_type).

    entries: session_id, line_no (order within the session), line (JSON).  rounds: id, session_id, occurred_at, event_uuid,
    tool_use_id, round_index, question, header, options, multi_select, answer, chosen_index, is_custom, split.  An answer may
    be a text or a list of labels; options may be labels or objects that have one."""
    uses = ask_uses(entries).withColumn("questions", at("result", "$.questions", "array<variant>"))
    label = lambda o: F.coalesce(at(o, "$.label"), F.when(kind_of(o) == "string", at(o, "$")), F.lit(""))
    rows = uses.where("questions is not null").select("*", F.posexplode("questions").alias("round_index", "q"))
    said = F.try_element_at(at("result", "$.answers", "map<string,variant>"), at("q", "$.question"))
    answer = F.coalesce(F.array_join(F.when(kind_of(said) == "array", at(said, "$", "array<string>")), ", "), at(said, "$"))
    rows = rows.select(
        hashing.round_id(F.col("session_id"), F.col("event_uuid"), F.col("tool_use_id"), F.col("round_index")).alias("id"),
        "session_id", "occurred_at", "event_uuid", "tool_use_id", "round_index",
        at("q", "$.question").alias("question"), F.coalesce(at("q", "$.header"), F.lit("")).alias("header"),
        F.coalesce(F.transform(at("q", "$.options", "array<variant>"), label), F.array().cast("array<string>")).alias("options"),
        F.coalesce(at("q", "$.multiSelect", "boolean"), F.lit(False)).alias("multi_select"), answer.alias("answer"),
    )
    pick = formats.selection(F.col("answer"), F.col("options"), F.col("multi_select"))
    rounds = rows.select("*", pick.alias("s")).select(*rows.columns, F.col("s.picks").alias("chosen_index"), F.col("s.custom").alias("is_custom"), hashing.split_of(F.col("session_id")).alias("split"))
    apart = uses.where("questions is null").select("session_id", "event_uuid", "tool_use_id", kind_of(F.col("result")).alias("result_type"))
    return rounds, apart


def ask_message(source_kind: Column, meta: Column) -> Column:
    """The assistant's question as a message, for traces of answered questions; null for others.  meta: JSON; only what the
    assistant wrote is read of it, never the answer."""
    v = F.try_parse_json(meta)
    field = lambda name: F.coalesce(at(v, f"$.{name}"), F.lit(""))
    block = formats.ask_block(field("question"), field("header"), F.array().cast("array<string>"), field("recommended_pick"))
    return F.when((source_kind == "question_answer") & (field("question") != ""), F.struct(F.lit("assistant").alias("role"), block.alias("content")))


def with_ask(context: Column, source_kind: Column, meta: Column) -> Column:
    """The messages of a context (role, content), with calls of the ask tool as ask blocks, and with the recovered question at
    the end where none of them holds one."""
    kind = "array<struct<role:string,content:string>>"
    seen = F.transform(context, lambda m: F.struct(m["role"].alias("role"), formats.ask_blocks(F.coalesce(m["content"], F.lit(""))).alias("content"))).cast(kind)
    ask = ask_message(source_kind, meta)
    return F.when(ask.isNotNull() & ~F.exists(seen, lambda m: m["content"].contains(MARK)), F.concat(seen, F.array(ask).cast(kind))).otherwise(seen)
