import json

from pyspark.sql import functions as F

from verdigris.operators import asks, extend


def lines(spark, rows):
    return spark.createDataFrame([(s, i, x if isinstance(x, str) else json.dumps(x)) for i, (s, x) in enumerate(rows)], "session_id string, line_no long, line string")


def use(uid, tool, *more, name="AskUserQuestion"):
    return {"type": "assistant", "uuid": uid, "timestamp": "2024-05-01T10:00:00Z", "message": {"content": [{"type": "text", "text": "so"}, {"type": "tool_use", "id": tool, "name": name, "input": {}}, *more]}}


def came(tool, result):
    return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": tool}]}, "toolUseResult": result}


def q(question, options, **more):
    return {"question": question, "options": options, **more}


def test_rounds_of_entries_as_they_are_recorded(spark):
    two = {"questions": [q("Which?", [{"label": "a", "description": "d"}, {"label": "a, b"}], header="H"), q("And?", ["x", "y"], multiSelect=True)], "answers": {"And?": ["y", "x"], "Which?": "a, b"}}
    rows = [
        ("s1", use("u1", "t1")),
        ("s1", "{half a line"),
        ("s1", came("t1", two)),
        ("s1", came("t1", "a later result of the same use")),
        ("s1", use("u2", "t2", {"type": "tool_use", "id": "t3", "name": "AskUserQuestion"})),  # two uses in one entry
        ("s1", came("t3", {"questions": [], "answers": {}})),  # typed, without a question
        ("s1", use("u3", "t4", name="Bash")),
        ("s1", came("t4", two)),
        ("s2", use("u1", "t1")),  # the same ids in another session
        ("s2", came("t1", ["x"])),
        ("s2", use("u5", "t5")),
        ("s2", came("t5", {"questions": [q("Free?", [], header=None), {"question": None}], "answers": {"Free?": "said"}})),
        ("s2", {"type": "assistant", "message": {"content": "plain text"}}),
        ("s2", {"type": "summary"}),
        ("s2", "[1, 2]"),
    ]
    rounds, apart = asks.ask_rounds(lines(spark, rows))
    got = {(r.session_id, r.event_uuid, r.round_index): r for r in rounds.collect()}
    assert sorted(got) == [("s1", "u1", 0), ("s1", "u1", 1), ("s2", "u5", 0), ("s2", "u5", 1)]
    a, b, c, d = (got[k] for k in sorted(got))
    assert (a.question, a.header, a.options, a.multi_select, a.answer, a.chosen_index, a.is_custom) == ("Which?", "H", ["a", "a, b"], False, "a, b", [1], False)
    assert (b.header, b.options, b.multi_select, b.answer, b.chosen_index, b.is_custom) == ("", ["x", "y"], True, "y, x", [1, 0], False)
    assert (c.header, c.options, c.answer, c.chosen_index, c.is_custom) == ("", [], "said", [], True)
    assert (d.question, d.answer, d.chosen_index, d.is_custom) == (None, None, [], False)
    assert len({r.id for r in got.values()}) == 4 and all(len(r.id) == 16 for r in got.values())
    assert sorted(map(tuple, apart.collect())) == [("s1", "u2", "t2", "none"), ("s2", "u1", "t1", "array")]


def test_asks_come_back_where_none_stands(spark):
    meta = json.dumps({"question": "Go on?", "header": "Plan", "recommended_pick": "yes", "answer": "secret"})
    said = [("user", "hello")]
    call = [("assistant", "AskUserQuestion([{'question': 'Go?', 'header': 'H'}])")]
    rows = [(0, said, "question_answer", meta), (1, said + call, "question_answer", meta), (2, said, "typed", meta), (3, said, "question_answer", "{}"), (4, [], "question_answer", json.dumps({"question": "Q"})), (5, said, "question_answer", "{broken"), (6, said, "question_answer", None), (7, said, None, meta)]
    df = spark.createDataFrame(rows, "i int, c array<struct<role:string,content:string>>, k string, m string")
    got = {r.i: [m.content for m in r.p] for r in df.select("i", asks.with_ask(F.col("c"), F.col("k"), F.col("m")).alias("p")).collect()}
    assert got == {0: ["hello", "[assistant asked: Plan] Go on?\n(recommended: yes)"], 1: ["hello", "[assistant asked: H] Go?"], 2: ["hello"], 3: ["hello"], 4: ["[assistant asked] Q"], 5: ["hello"], 6: ["hello"], 7: ["hello"]}


def test_five_failures_in_a_row_end_the_run(spark):
    def judge(bad):
        def ask(key, prompt):
            if key in bad:
                raise RuntimeError
            return prompt

        return ask

    df = spark.createDataFrame([(i, f"p{i}") for i in range(100)], "id long, text string").repartition(5)
    for bad, stop in (({3, 4, 5, 6, 8, 9, 10, 11}, 100), (set(range(38, 43)), 42), (set(range(97, 100)), 100)):
        for batch, tasks in ((1000, 4), (40, 2)):
            run = extend.judged_in_batches(df, "id", judge(bad), batch=batch, tasks=tasks)
            assert sorted(r.id for r in run.answered.collect()) == [i for i in range(stop) if i not in bad]
            assert run.broken == (stop < 100) and run.calls <= 100
    assert extend.judged_in_batches(df, "id", judge(set(range(100))), batch=10, tasks=1).calls == 5
    assert extend.judged_in_batches(df.where("id < 0"), "id", judge(set())).answered.count() == 0
