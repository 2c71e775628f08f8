"""Boundaries and the operators that SQL doesn't express."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris.functions import formats, hashing
from verdigris.functions import text as T
from verdigris.operators import dedup, extend, gate, metrics, sampling, similarity, temporal
from verdigris.plans.sampling import mmr
from verdigris.plans.windows import anchored_split, confidence_sequence
from verdigris.sources import files, tables
from verdigris.streaming import sessions as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hits_are_closed_and_replies_half_open(spark):
    d = spark.createDataFrame([(1, "s", 100)], "delivery_id long, session_id string, at long")
    r = spark.createDataFrame([("s", 7, 100), ("s", 8, 110)], "session_id string, reply_id long, reply_at long")
    assert temporal.first_reply(d, r, 10).first().reply_id == 8
    assert temporal.first_reply(d, r, 9).count() == 0
    near = temporal.band_join(d, r, ["session_id"], "at", "reply_at", 0, 10)
    assert sorted(x.reply_id for x in near.collect()) == [7, 8]
    assert temporal.band_join(d, r.where("false"), ["session_id"], "at", "reply_at", 0, 10, "left").count() == 1


def test_nearest_ties_go_to_the_earlier(spark):
    a = spark.createDataFrame([("s", 5)], "session_id string, turn long")
    b = spark.createDataFrame([("s", 4), ("s", 6)], "session_id string, other long")
    assert temporal.nearest(a, b, ["session_id"], "turn", "other", 2, "turn").first().other == 4


def test_two_jaccards(spark):
    assert one(spark, T.token_jaccard(F.lit(""), F.lit(" "))) == 1.0
    assert one(spark, T.token_jaccard(F.lit(""), F.lit("a"))) == 0.0
    empty = similarity.shingle_hashes(F.lit("abcd"))
    assert one(spark, similarity.shingle_jaccard(empty, empty)) == 0.0
    assert one(spark, similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert sorted(one(spark, similarity.shingle_hashes(F.lit("abcdefé")))) == similarity.byte_shingles("abcdefé").tolist()


def test_scrub_and_flatten(spark):
    assert one(spark, T.scrub(F.lit("a<proposal x>b</proposal>  c <proposal>d"), "proposal")) == "ac "
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi\n\nthere").alias("content")))
    assert [tuple(x) for x in one(spark, T.unflatten(T.flatten(m)))] == [("user", "hi\n\nthere")]
    assert one(spark, T.unflatten(F.lit(""))) == []
    assert [tuple(x) for x in one(spark, T.unflatten(F.lit("bare")))] == [("user", "bare")]


def test_hash_split_equals_python(spark):
    import hashlib

    keys = ["", "a", "ß", "x" * 100]
    got = [r.m for r in spark.createDataFrame([(k,) for k in keys], "k string").select(hashing.sha_mod(F.col("k"), 10_000).alias("m")).collect()]
    assert got == [int(hashlib.sha256(k.encode()).hexdigest(), 16) % 10_000 for k in keys]


def of_row(spark, column, **values):
    row = spark.createDataFrame([tuple(v[1] for v in values.values())], ", ".join(f"{k} {v[0]}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def picks_by_search(answer, options, multi):
    """All ways to read an answer as labels, longest labels first."""
    last = {o: i for i, o in enumerate(options)}
    if answer is None:
        return [], False
    if not multi:
        return ([last[answer]], False) if answer in last else ([], True)
    out = []
    while answer:
        fit = [o for o in last if o and (answer == o or answer.startswith(o + ", "))]
        if not fit:
            return out, True
        out.append(last[max(fit, key=len)])
        answer = answer[len(max(fit, key=len)) + 2 :]
    return out, False


def test_selection(spark):
    rng, rows = random.Random(2), []
    for _ in range(300):
        options = [rng.choice(["a", "b", "a, b", "c.d", "(x", "Keep \\E it", "q", "b, c.d", "A"]) for _ in range(rng.randint(0, 5))]
        said = [rng.choice([*options, "zz"]) if options else "zz" for _ in range(rng.randint(0, 3))]
        rows.append((rng.choice([", ".join(said), *options, "", ", ".join(said) + ", and more", None]), options, rng.random() < 0.7))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, answer string, options array<string>, multi boolean")
    for r in df.select("i", formats.selection(F.col("answer"), F.col("options"), F.col("multi")).alias("s")).collect():
        assert (r.s.picks, r.s.custom) == picks_by_search(*rows[r.i]), rows[r.i]


def test_ask_rewrite(spark):
    def read(text):
        return of_row(spark, formats.ask_blocks(F.col("t")), t=("string", text))

    clipped = "assistant: fine\nAskUserQuestion([{'question': 'Which part first?', 'header': 'Part', 'multiSelect': False, 'options': [{'label': 'One'}, {'label': 'Two + three (Recommended)'}, {'label': 'Fo…(+31ch))"
    assert read(clipped) == "assistant: fine\n[assistant asked: Part] Which part first?\n- One\n- Two + three\n(recommended: Two + three)"
    assert read("AskUserQuestion([{'question': 'Half of i…(+40ch))") == "[assistant asked] Half of i…"
    assert read("AskUserQuestion(<cut before any field>") == "AskUserQuestion(<cut before any field>"
    assert read("no asks here\n") == "no asks here\n" and read(None) is None
    two = "x AskUserQuestion([{'question': 'A?', 'header': 'P', 'options': [{'label': 'x'}]}, {'question': 'B?', 'header': 'Q', 'options': [{'label': 'y'}]}])"
    assert read(two) == "x [assistant asked: P] A?\n[assistant asked: Q] B?"
    quoted = "AskUserQuestion([{'question': \"What does 'this' show?\", 'header': 'It\\'s', 'options': [{'label': 'Fl…(+9ch))"
    assert read(quoted) == "[assistant asked: It's] What does 'this' show?"


def test_review_formats(spark):
    def read(text, *registry):
        got = of_row(spark, formats.review_comments(F.col("t"), registry or formats.REVIEW_FORMATS), t=("string", text))
        return [tuple(c) for c in got]

    assert read("see\nIn src/a.py:L10-12: drop the guard\nIn a/b.py:L5: fix this\nIn Makefile:L3: no\nIn short: nothing") == [("src/a.py", 10, 12, "drop the guard"), ("a/b.py", 5, None, "fix this"), ("Makefile", 3, None, "no")]
    assert read("In src/x.py: whole file") == [("src/x.py", None, None, "whole file")]
    assert read("- file: p/m.py:42\n- theme: t\n- claim: leaks a handle\n- suggestion: close it") == [("p/m.py", 42, None, "leaks a handle close it")]
    assert read("- file: a.py:7\n- suggestion: extract it") == [("a.py", 7, None, "extract it")]
    streams = "intro\n### W1 [BUG] — Broken  \nFIX: mend it\nwords\nTests: add one\n### Ab-2 [DEBT]— Other\n### not a header\nFIX: of none"
    assert read(streams) == [(None, None, None, "W1 [BUG] Broken FIX: mend it Tests: add one"), (None, None, None, "Ab-2 [DEBT] Other")]
    assert read('{"path": "a.py", "lines": "3-9", "problem": "bad", "fix": "do"}') == [("a.py", 3, 9, "bad do")]
    assert read('{"confirmedHigh": [{"file": "b.py", "line": 4, "why": "w"}, {"file": "c.py"}]}') == [("b.py", 4, None, "w")]
    assert read('[{"message": "m"}, {"x": 1}]') == [(None, None, None, "m")]
    assert read(None) == [] and read("") == [] and read("{not json") == []
    shout = formats.CallableFormat("shout", lambda t: [("f", 1, 2, w) for w in t.split() if w.isupper()])
    assert read("In a.py:L1: NO", shout) == [("f", 1, 2, "NO")]


def test_auc_edges_and_delong(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.4, rng.randint(0, 20) / 20, rng.randint(0, 20) / 20) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label boolean, x double, y double")
    pos, neg = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    want = np.mean([(p[2] > n[2]) + 0.5 * (p[2] == n[2]) for p in pos for n in neg])
    assert metrics.auc(df, "label", "x").first().auc == pytest.approx(want)
    v10 = np.array([[np.mean([(p[c] > n[c]) + 0.5 * (p[c] == n[c]) for n in neg]) for p in pos] for c in (2, 3)])
    v01 = np.array([[np.mean([(p[c] > n[c]) + 0.5 * (p[c] == n[c]) for p in pos]) for n in neg] for c in (2, 3)])
    s = np.cov(v10) / len(pos) + np.cov(v01) / len(neg)
    got = metrics.delong(df, "label", "x", "y", "id").first()
    assert got.se == pytest.approx(math.sqrt(s[0, 0] + s[1, 1] - 2 * s[0, 1]))
    assert metrics.auc(df.where("label"), "label", "x").first().auc is None
    assert metrics.auc(df.where("false"), "label", "x").first().auc is None


def test_published_constants():
    assert metrics.minimum_detectable(1.0) == pytest.approx(2.8016, abs=1e-4)
    assert metrics.clopper_pearson_upper(0, 59) == pytest.approx(1 - 0.05 ** (1 / 59))
    assert metrics.clopper_pearson_upper(5, 5) == 1.0


def test_confidence_sequence_against_a_loop(spark):
    rng = random.Random(5)
    for xs in ([float(rng.random() < 0.3) for _ in range(60)], [1.0] * 20, [0.0] * 20):
        df = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i long, x double")
        got = [(r.low, r.high) for r in confidence_sequence(df, "k", ["i"], "x").orderBy("t").collect()]
        sides = []
        for stream in (xs, [1 - x for x in xs]):
            out, s, q, v, lam, lx, p, best = [], 0.0, 0.0, 0.25, 0.0, 0.0, 0.0, 0.0
            for t, x in enumerate(stream, 1):
                step = min(0.5, math.sqrt(2 * math.log(40) / (t * math.log(1 + t) * v)))
                mean = s / (t - 1) if t > 1 else 0.0
                lam, lx, p = lam + step, lx + step * x, p + (x - mean) ** 2 * (-math.log(1 - step) - step)
                s += x
                q += (x - min((0.5 + s) / (t + 1), 1.0)) ** 2
                v = (0.25 + q) / (t + 1)
                best = max(best, (lx - math.log(40) - p) / lam, 0.0)
                out.append(best)
            sides.append(out)
        assert np.allclose(got, [(a, 1 - b) for a, b in zip(*sides, strict=True)])


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    docs, i = [], 0
    for _ in range(25):
        base = "".join(rng.choice("abcdefgh ") for _ in range(200))
        for _ in range(rng.choice([1, 1, 4])):
            at = rng.randrange(190)
            docs.append((i, base[:at] + "XY" + base[at + 2 :]))
            i += 1
    docs += [(900, None), (901, "abc"), (902, "abc")]
    got = {r.doc_id: r.component for r in dedup.collapse(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    sets = {d: set(similarity.byte_shingles(t).tolist()) for d, t in docs}
    root = {d: d for d, _ in docs}
    for _ in range(3):
        for a in sets:
            for b in sets:
                u = len(sets[a] | sets[b])
                if u and len(sets[a] & sets[b]) / u >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_mmr_prefers_variety():
    v = np.array([[1, 0], [1, 0.01], [0.6, 0.8]])
    assert mmr(v, np.array([1.0, 0.99, 0.6]), 2, 0.5) == [0, 2]


def test_bootstrap_interval_holds_the_auc(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0, (i % 3 == 0) * 0.3 + (i * 37 % 100) / 100) for i in range(300)], "__id long, label boolean, x double")
    auc = metrics.auc(rows, "label", "x").first().auc
    r = sampling.bootstrap_auc(rows, "label", "x", 200, 1).first()
    assert r.low < auc < r.high and r.high - r.low < 0.2


def test_temperature_recovers_the_scale(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        z = rng.uniform(-4, 4)
        rows.append((z * 3, rng.random() < 1 / (1 + math.exp(-z))))
    assert gate.temperature(spark.createDataFrame(rows, "z double, label boolean"), "z", "label") == pytest.approx(3, rel=0.15)


def test_import_findings_and_frozen(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "x_issues.jsonl").write_text('{"file":"a","line":3,"message":"m"}\n\n{"file":"b","line":1,"message":"n","dismissed":true}\n')
    assert [tuple(r) for r in files.findings(spark, p).collect()] == [("a", 3, "m")]
    (tmp_path / "b.json").write_text('{"version": 1, "rows": [{"id": "1", "label": "yes"}]}')
    assert files.import_batch(spark, f"{p}/b.json", 1, ["id", "label"], ["yes"]).collect()[0].id == "1"
    with pytest.raises(Exception, match="unknown keys"):
        files.import_batch(spark, f"{p}/b.json", 1, ["label"], ["yes"]).collect()
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    files.freeze(df, f"{p}/f")
    with pytest.raises(ValueError, match="frozen"):
        files.freeze(df.union(df), f"{p}/f")
    (tmp_path / "f" / "rows" / "part-more.txt").write_text("{}\n")
    with pytest.raises(ValueError, match="changed"):
        files.read_frozen(spark, f"{p}/f", "id long, text string")


def test_broken_files_stay_unrecorded(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"user","uuid":"1","sessionId":"s"}\n')
    (tmp_path / "b.jsonl").write_text('{"type":"user","uuid":"2","sessionId":"s"}\n{broken\n')
    rows, registry = files.scan(spark, str(tmp_path), spark.createDataFrame([], files.REGISTRY))
    assert [r.uuid for r in rows.collect()] == ["1"]
    assert [r.path.rsplit("/", 1)[1] for r in registry.collect()] == ["a.jsonl"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i // 3, float("nan") if i == 4 else (i * 7 % 10) / 10) for i in range(90)]
    df = spark.createDataFrame(rows, "session_id string, turn long, score double").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = S.drain(S.suppressed_stream(stream, 0.6, None), str(tmp_path))
    assert sorted((r.session_id, r.turn) for r in got.collect()) == sorted((r.session_id, r.turn) for r in S.suppressed(df, 0.6).collect())
    assert S.Ledger().admits(0, float("nan"), 0.5)


def test_judges_and_encoders(spark):
    df = spark.createDataFrame([(i, "t") for i in range(20)], "doc_id long, text string").coalesce(1)

    def never(key, prompt):
        raise RuntimeError

    assert extend.judged(df, "doc_id", never, breaker=5).count() == 0
    assert extend.judged(df, "doc_id", extend.StubJudge()).count() == 17

    class Lengths:
        def encode(self, texts):
            return np.array([[len(t), 1] for t in texts], float)

    assert extend.encoded(df, "doc_id", "text", Lengths()).first().embedding == [1.0, 1.0]
    assert isinstance(extend.score(df, "text", extend.LengthGate()).toPandas(), pd.DataFrame)


def test_due_turns_of_long_sessions_and_late_ones(spark, tmp_path):
    """Past 4,000 turns the count goes on, each target comes once, and repeated or late turns count once."""
    parts = [range(4100), [4100], [4100, 4101], [5000], [4102], [7]]
    for i, part in enumerate(parts):
        spark.createDataFrame([("s", t) for t in part], "session_id string, turn long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("session_id string, turn long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = sorted((r.turn_count, r.target) for r in S.drain(S.due_turns(stream, None), str(tmp_path)).collect())
    assert got[-1] == (4104, 4102) and len(got) <= 5 and (4101, 4099) in got


def test_debounce_waits_for_silence(spark, tmp_path):
    import time

    spark.createDataFrame([("a",), ("a",), ("b",)], "session_id string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("session_id string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = S.debounced(stream, 500).writeStream.format("memory").queryName("quiet").outputMode("append").trigger(processingTime="300 milliseconds").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("quiet").count() < 2:
            time.sleep(0.5)
        assert sorted(map(tuple, spark.table("quiet").collect())) == [("a", 2), ("b", 1)]
    finally:
        q.stop()


def test_claims_are_first_wins_and_outlive_a_dead_writer(spark, tmp_path):
    asked = lambda rows: spark.createDataFrame(rows, tables.CLAIMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sorted((r.key, r.owner) for r in tables.claim(spark.readStream.schema(tables.CLAIMS).parquet(f"{tmp_path}/in"), f"{tmp_path}/claims", f"{tmp_path}/c").collect())
    assert tables.claims(spark, f"{tmp_path}/claims").count() == 0
    asked([("a", "x", 2), ("a", "y", 1), ("b", "x", 1), (None, "x", 1)])
    assert run() == [("a", "y"), ("b", "x")]
    asked([("a", "x", 0), ("c", "x", 5), ("c", "w", 5)])
    # a writer that died in the middle of the next batch has left half of its folder
    (tmp_path / "claims" / "epoch=1" / "_temporary").mkdir(parents=True)
    assert run() == [("a", "y"), ("b", "x"), ("c", "w")]
    assert run() == [("a", "y"), ("b", "x"), ("c", "w")]


def test_leaks_against_plain_containment(spark):
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("ab cdéf\n") for _ in range(n))
    docs = [(i, text(rng.choice([5, 40, 400, 3000]))) for i in range(60)] + [(90, None), (91, ""), (92, "x" * 100), (93, "x" * 100)]
    items = []
    for i in range(120):
        body = rng.choice(docs[:60])[1]
        n = rng.choice([16, 17, 20, 63, 64, 65, 90, 200])
        at = rng.randrange(max(1, len(body) - n))
        cut = body[at : at + n]
        items.append((i, cut if i % 3 else cut[: len(cut) // 2] + "Z" + cut[len(cut) // 2 :]))
    items += [(500, "x" * 64), (501, "x" * 101), (502, None), (503, ""), (504, "é"), (505, "ab"), (506, "q"), (507, "xxxxxxxxx")]
    want = {i for i, x in items if x and any(x in (d or "") for _, d in docs)}
    got = dedup.contained(spark.createDataFrame(items, "i long, t string"), "i", "t", spark.createDataFrame(docs, "d long, body string").repartition(3), "d", "body")
    rows = [r.i for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and 500 in want and 501 not in want


def test_files_by_size_and_name(spark, tmp_path):
    for name, n in (("b.jsonl", 40_000), ("a.jsonl", 32_768), ("small.jsonl", 32_767), ("agent-1.jsonl", 50_000), ("c.txt", 50_000)):
        (tmp_path / name).write_bytes(b"x" * n)
    assert [r.path.rsplit("/", 1)[1] for r in files.candidates(spark, str(tmp_path)).collect()] == ["a.jsonl", "b.jsonl"]


def test_receipts_and_frozen_sets(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, text string")
    files.write_with_receipt(rows, f"{tmp_path}/r", {"digest": "d", "quarantined": 1})
    back, receipt = files.read_with_receipt(spark, f"{tmp_path}/r")
    assert receipt == {"digest": "d", "quarantined": 1} and back.count() == 20
    rows.write.parquet(f"{tmp_path}/bare")
    with pytest.raises(ValueError):
        files.read_with_receipt(spark, f"{tmp_path}/bare")
    first = files.freeze(rows, f"{tmp_path}/f")
    assert files.freeze(rows.repartition(3).orderBy(F.desc("id")), f"{tmp_path}/f") == first
    with pytest.raises(ValueError):
        files.freeze(rows.limit(3), f"{tmp_path}/f")
    spark.createDataFrame([("{}",)], "value string").write.mode("append").text(f"{tmp_path}/f/rows")
    with pytest.raises(ValueError):
        files.read_frozen(spark, f"{tmp_path}/f", rows.schema)


def test_anchors(spark):
    e = spark.createDataFrame([("s", 0, i, r, f"e{i}") for i, r in enumerate(["user", "assistant", "user", "assistant"])], "session_id string, turn int, seq int, role string, name string")
    read = lambda a: tuple(anchored_split(e, spark.createDataFrame([("s", 0, a)], "session_id string, turn int, anchor string")).first())[2:]
    assert read("e2") == (["e0", "e1"], ["e2", "e3"])
    assert read("e0") == read("e1") == ([], ["e0", "e1", "e2", "e3"])
    with pytest.raises(Exception, match="no anchor"):
        read("e9")


def test_a_family_whose_smallest_row_is_far_from_some(spark):
    """Members drift from a core; groups must be those of all pairs."""
    rng, docs = random.Random(11), []
    core = [rng.choice("abcdefghij") * rng.randint(2, 6) + str(rng.randint(0, 99)) for _ in range(60)]
    for i in range(150):
        w = list(core)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(60)] = "x" + str(rng.randint(0, 9999))
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets = {i: set(similarity.byte_shingles(t).tolist()) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and len(x & y) / len(x | y) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.component for r in dedup.collapse(df, "doc_id", "text").collect()} == {i: find(i) for i in root}
    assert len(set(map(find, root))) > 1


def test_vectors_on_top_of_text(spark):
    docs = spark.createDataFrame([(1, "the first text of all"), (2, "the first text of all"), (3, "quite another one"), (4, "nothing like it here")], "doc_id long, text string")

    class Turned:
        def encode(self, texts):
            return np.array([[1.0, 0.01 * len(t)] if "text" in t or "another" in t else [0.0, 1.0] for t in texts])

    got = {r.doc_id: r for r in dedup.collapse(docs, "doc_id", "text", embedder=Turned()).collect()}
    assert got[1].component == got[2].component == got[3].component == 1 and got[4].component == 4
    assert sum(r.marginal for r in got.values()) == 1
    plain = dedup.collapse(docs, "doc_id", "text").collect()
    assert {r.doc_id: r.component for r in plain} == {1: 1, 2: 1, 3: 3, 4: 4} and not any(r.marginal for r in plain)


def test_running_sums(spark):
    rng = random.Random(6)
    rows = [(rng.choice([rng.random(), 0.5, float("nan"), None]) if i % 5 else None, rng.randint(0, 9)) for i in range(400)]
    n = spark.createDataFrame(rows, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))
    for down in (False, True):
        got = metrics.running(n, "s", ["n"], descending=down).collect()
        key = lambda s: (0, 0) if s is None else (2, 0) if s != s else (1, s)
        upto, want = 0, {}
        for r in sorted(got, key=lambda r: key(r.s), reverse=down):
            want[key(r.s)] = upto
            upto += r.n
        assert all(want[key(r.s)] == r.n_before for r in got) and len(got) > 80
    assert metrics.running(n.where("false"), "s", ["n"]).collect() == []


def test_nearest_ranges(spark):
    rng = random.Random(9)
    ranges = [(f"k{i}", lo := rng.randint(0, 10_000), lo + rng.choice([0, 5, 300])) for i in range(40)] + [("far", 90_000, 90_100)]
    points = sorted({rng.randint(-500, 11_000) for _ in range(200)} | {89_000, 95_000})
    got = {r.at: r.key for r in temporal.nearest_ranges(spark.createDataFrame([(p,) for p in points], "at long"), spark.createDataFrame(ranges, "key string, lo long, hi long"), "at", "lo", "hi", "key", width=1000).collect()}
    assert got == {p: min((0 if lo <= p <= hi else lo - p if p < lo else p - hi, k) for k, lo, hi in ranges)[1] for p in points}


def test_drafters_and_planners(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "x")], "id long, text string")
    stub = extend.StubDrafter()
    assert sorted(map(tuple, extend.drafted(df, "id", "text", stub, stub).collect())) == [(1, "one", "one!"), (2, None, None), (3, "x", "x!")]
    assert extend.planned(df, "id", lambda d: d.where("id > 1").select("id"), lambda d: d.withColumn("k", F.lit(1))).count() == 2
    with pytest.raises(ValueError):
        extend.planned(df, "id", lambda d: d.select("text"), lambda d: d)


def test_word_distance(spark):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choice(["a", "b", "c,", "d.", "é"]) for _ in range(rng.randint(0, 90)))
    rows = [(i, text(), text()) for i in range(60)] + [(90, None, "a b"), (91, "", ""), (92, "same, words", "same, words")]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    tokens = lambda t: re.findall(r"\w+|[^\w\s]", t or "")
    want = {i: plain(tokens(a), tokens(b)) / max(len(tokens(a)), len(tokens(b)), 1) for i, a, b in rows}
    df = spark.createDataFrame(rows, "id long, a string, b string")
    assert {r.id: r.d for r in df.select("id", formats.word_distance(F.col("a"), F.col("b")).alias("d")).collect()} == want


def test_mmr_against_plain_loops():
    rng = np.random.default_rng(3)
    v, sims = rng.normal(size=(30, 5)), rng.random(30)
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    want = []
    while len(want) < 10:
        rest = [i for i in range(30) if i not in want]
        want.append(max(rest, key=lambda i: 0.6 * sims[i] - 0.4 * max((cos(v[i], v[j]) for j in want), default=0.0)))
    assert mmr(v, sims, 10, 0.4) == want and len(mmr(v[:3], sims[:3], 10, 0.4)) == 3


def test_temperature_against_a_fine_grid(spark):
    rng = random.Random(4)
    rows = [(z := rng.gauss(0, 3), rng.random() < 1 / (1 + math.exp(-z / 2))) for _ in range(400)]
    loss = lambda t: sum(math.log1p(math.exp(-z / t if y else z / t)) for z, y in rows)
    got = gate.temperature(spark.createDataFrame(rows, "z double, label boolean"), "z", "label")
    assert loss(got) <= min(loss(0.05 * 1.01**k) for k in range(600)) + 1e-3


def test_bootstrap_against_plain_resamples(spark):
    rng = random.Random(5)
    rows = [(i, rng.random() < 0.4, rng.randint(0, 12) / 12) for i in range(80)]
    df = spark.createDataFrame(rows, "__id long, label boolean, x double")
    u = {(r.i, r.k): (r.h & ((1 << 52) - 1)) / float(1 << 52) for r in df.select(F.col("__id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")).select("i", "k", F.xxhash64(F.lit(1), "k", "i").alias("h")).collect()}
    share = [math.exp(-1) / math.factorial(k) for k in range(7)]
    aucs = []
    for k in range(40):
        w = {i: sum(u[i, k] >= sum(share[: j + 1]) for j in range(7)) for i, _, _ in rows}
        pairs = [(w[a] * w[b], (x > y) + 0.5 * (x == y)) for a, la, x in rows if la for b, lb, y in rows if not lb]
        total = sum(n for n, _ in pairs)
        if total:
            aucs.append(sum(n * g for n, g in pairs) / total)
    r = sampling.bootstrap_auc(df, "label", "x", 40, 1).first()
    assert min(aucs) - 1e-9 <= r.low <= np.quantile(aucs, 0.1) and np.quantile(aucs, 0.9) <= r.high <= max(aucs) + 1e-9


def test_lexical_gate_separates(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["plain", "words", "here", "again"] + ["awful", "wrong"] * (i % 2)) for _ in range(12)), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = gate.train(df.where("id < 80"), "id", "text", "label")
    held = gate.score(model, df.where("id >= 80"), "id", "text").join(df, "id").collect()
    assert np.mean([(r.p > 0.5) == bool(r.label) for r in held]) > 0.9


def test_gate_against_plain_numpy(spark):
    """Vocabulary, weights and scores are those of a version in plain Python."""
    from collections import Counter

    rng = random.Random(8)
    pool = ["plain", "words", "here", "a", "b-c", "été", "x1"] + ["awful", "wrong", "bad"]
    rows = [(i, " ".join(rng.choices(pool, [3] * 7 + [1 + 5 * (i % 3 == 0)] * 3, k=rng.randint(0, 14))), int(i % 3 == 0)) for i in range(90)] + [(90, None, 0), (91, "?", 1)]
    df = spark.createDataFrame(rows, "id long, text string, label int").repartition(3)

    def grams(text):
        text, out = (text or "").lower(), Counter()
        w = re.findall(r"\b\w\w+\b", text)
        out.update((0, x) for x in w + [f"{x} {y}" for x, y in zip(w, w[1:])])
        for x in text.split():
            p = f" {x} "
            for n in (3, 4, 5):
                out.update((1, p[i : i + n]) for i in range(max(1, len(p) - n + 1)))
                if len(p) <= n:
                    break
        return out

    counts, n = [grams(t) for _, t, _ in rows], len(rows)
    df_of, total = Counter(g for c in counts for g in c), Counter()
    for c in counts:
        total.update(c)
    words = [g for g in df_of if g[0] == 0 and df_of[g] >= 2]
    chars = sorted((g for g in df_of if g[0] == 1 and df_of[g] >= 3), key=lambda g: (-total[g], g))[:40]
    place = {g: i for i, g in enumerate(sorted(words + chars))}
    x = np.zeros((n, len(place)))
    for i, c in enumerate(counts):
        for g, f in c.items():
            if g in place:
                x[i, place[g]] = (1 + math.log(f)) * (math.log((1 + n) / (1 + df_of[g])) + 1)
        for block in (0, 1):
            at = [j for g, j in place.items() if g[0] == block]
            norm = np.linalg.norm(x[i, at])
            x[i, at] /= norm or 1
    y = np.array([lab for _, _, lab in rows])
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    full, w = np.hstack([x, np.ones((n, 1))]), np.zeros(len(place) + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 0
    for _ in range(60):  # Newton
        p = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve(4.0 * full.T @ (full * (weight * p * (1 - p))[:, None]) + ridge, 4.0 * full.T @ (weight * (p - y)) + ridge @ w)
    model = gate.train(df, "id", "text", "label", char_min_df=3, most=(1 << 20, 40), steps=400, tol=1e-9)
    got = {(r.block, r.gram): r.weight for r in model.weights().collect()}
    assert set(got) == set(place)
    assert max(abs(got[g] - w[j]) for g, j in place.items()) < 1e-3
    p = 1 / (1 + np.exp(-full @ w))
    assert {r.id: round(r.p, 3) for r in gate.score(model, df, "id", "text").collect()} == pytest.approx({i: p[i] for i, _, _ in rows}, abs=2e-3)


def test_fold_of_a_digest_is_compiled(spark):
    """No function of higher order, which Spark interprets digit by digit."""
    plan = spark.range(1).select(hashing.sha_mod(F.col("id").cast("string"), 10_000))._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan
    with pytest.raises(ValueError, match="modulus"):
        hashing.sha_mod(F.lit("a"), 1 << 28)


def test_transcripts_are_not_a_file_a_session(spark, tmp_path):
    from verdigris.plans import sources
    from verdigris.plans.base import Tables

    rows = [(i // 3, i % 3, "user", f"text {i}") for i in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    t = Tables(spark, str(tmp_path))
    assert files.listing(spark, sources._written(t), "*.txt").count() <= 2
    assert sorted((r.session_id, r.turn, r.text) for r in sources.s02(t).collect()) == sorted((str(c), n, x) for c, n, _, x in rows)


def test_similarity_of_each_row(spark):
    """A row a row, repeated keys too, and no shuffle."""
    rows = [("s", 1, "same text", "same text"), ("s", 1, "same text", "other one"), ("s", 2, None, ""), (None, 3, "abcdef", "bcdefg")]
    made = similarity.shingle_similarity(spark.createDataFrame(rows, "k string, n long, a string, b string"), ["k", "n"], "a", "b")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.k), r.n, r.similarity) for r in made.collect()) == [("None", 3, 1 / 3), ("s", 1, 0.0), ("s", 1, 1.0), ("s", 2, 0.0)]


def test_cells_leave_in_parts(spark, monkeypatch):
    """What a worker holds at once depends on neither the pivots nor the visits of a batch; the cells are the same."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)], "id long, v array<double>").coalesce(1)
    got = lambda: sorted((r.cell, r.guest, r.core, r.id) for r in similarity.cosine_cells(df, "id", "v", 0.5, 4).collect())
    whole = got()
    monkeypatch.setattr(similarity, "ANGLES", 40)
    assert got() == whole and len(whole) > 90


def test_grams_stay_where_texts_are_read(spark):
    """Counts leave a task summed up over its texts, and places are found without a shuffle."""
    df = spark.createDataFrame([(i, "same words") for i in range(50)], "id long, text string").coalesce(1)
    tallies = gate.tallied(df, "text")
    assert {(r.df, r.total) for r in tallies.where("block = 0").collect()} == {(50, 50)} and tallies.where("gram = 'same words'").count() == 1
    held = gate.vocabulary(tallies, 50, 2, 5, (10, 10))
    made = gate.placed(df, "id", "text", held)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 50


def test_files_of_rows_share_a_folder(spark, tmp_path):
    """A file for each row, however many; no folder for each, and none where there are no rows."""
    rows = spark.range(80).selectExpr("concat('{\"type\":\"a\"}\n{\"type\":\"b', id, '\"}') as value").repartition(3)
    files.append_files(rows.where("false"), f"{tmp_path}/each")
    files.append_files(rows, f"{tmp_path}/each")
    files.append_files(rows.where("value like '%b7%'"), f"{tmp_path}/each")
    paths = [r.path for r in files.listing(spark, f"{tmp_path}/each", "*.txt").collect()]
    assert len(set(paths)) == 91 and len({p.rsplit("/", 1)[0] for p in paths}) == 1
    assert files.transcripts(spark, f"{tmp_path}/each").groupBy("path").count().where("count <> 2").count() == 0


def test_grams_are_counted_by_arrays(monkeypatch):
    """Counts and places are those of grams as strings, with letters beyond those that have a number too; and 1 MB of text
    takes a few seconds of a core."""
    import time
    from collections import Counter

    import pyarrow as pa

    def grams(text):
        text, out = (text or "").lower(), Counter()
        w = re.findall(r"\b\w\w+\b", text)
        out.update((0, x) for x in w + [f"{x} {y}" for x, y in zip(w, w[1:])])
        for p in (f" {x} " for x in text.split()):
            out.update((1, p[i : i + n]) for n in (3, 4, 5) for i in range(len(p) - n + 1))
        return out

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeé-ß漢字Ωİ", k=rng.randint(1, 9))) for _ in range(60)) for _ in range(40)] + [None, "", " ", "a", "b\0c \0", "x y  z"]
    want, total = Counter(), Counter()
    for c in map(grams, texts):
        want.update(set(c))
        total.update(c)
    kept = sorted(want)[::2]
    table = pa.table({"block": pa.array([k for k, _ in kept], pa.int32()), "gram": [g for _, g in kept], "place": pa.array(range(len(kept)), pa.int32())})
    for letters in (gate.LETTERS, 7):
        monkeypatch.setattr(gate, "LETTERS", letters)
        held, places = gate.Tally(), gate.Places(table)
        for x in texts:
            held.add(x)
        assert {(r["block"], r["gram"]): (r["df"], r["total"]) for r in held.batch().to_pylist()} == {g: (n, total[g]) for g, n in want.items()}
        for x in texts:
            c = grams(x)
            assert list(zip(*(y.tolist() for y in places.find(x)))) == [(i, c[g]) for i, g in enumerate(kept) if g in c]
    monkeypatch.undo()
    held, words = gate.Tally(), ["".join(rng.choices("abcdefghij", k=7)) for _ in range(2000)]
    began = time.process_time()
    for _ in range(25):
        held.add(" ".join(rng.choices(words, k=5000)))
    assert time.process_time() - began < 3


def test_files_are_scanned_by_portions(spark, tmp_path, monkeypatch):
    """No reader is given more than a portion of the files, and the scan and the listing are whole."""
    monkeypatch.setattr(files, "PORTION", 10)
    rows = spark.range(45).selectExpr("""concat('{"type":"a', id, '"}') as value""")
    files.append_files(rows, f"{tmp_path}/each")
    files.append_files(rows.limit(3), f"{tmp_path}/each")
    (tmp_path / "each/plain.txt").write_text('{"type":"b"}\n')
    (tmp_path / "each/broken.txt").write_text("{no\n")
    seen, read = [], files._listed
    monkeypatch.setattr(files, "_listed", lambda s, paths, pattern: seen.append(made := read(s, paths, pattern)) or made)
    entries, registry = files.scan(spark, f"{tmp_path}/each", spark.createDataFrame([], files.REGISTRY), pattern="*.txt")
    assert entries.count() == registry.count() == 49 and entries.where("type = 'b'").count() == 1
    assert len(seen) > 2 and max(x.count() for x in seen) < 30
    assert files.scan(spark, f"{tmp_path}/each", registry, pattern="*.txt")[0].count() == 0
    assert files.listing(spark, f"{tmp_path}/each", "*.txt").select("path").distinct().count() == 50
