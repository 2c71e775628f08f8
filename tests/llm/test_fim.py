import hashlib
import re

import pytest
from pyspark.sql import functions as F

from verdigris.llm import fim, queries

UNITS = {
    "lines": r"[^\n]*\n|[^\n]+",
    "words": r"^\s+|\S+\s*",
    "tokens": r"\s+|\w+|[^\w\s]+",
    "sentences": r"[^.!?。！？]*(?:[.!?。！？](?!\s)[^.!?。！？]*)*[.!?。！？](?=\s)|[\s\S]+\Z",
    "characters": r"[\s\S]",
}
TEXTS = ["", "a", "\n", "\n\n", "a\n", "a\nb", "a\r\nb\n\n\nc", " x  y\tz ", "one two. three? four!\nfive", "é😀\n😀😀 ü。 x", "<P> in\nthe text\n", "a<\nS>\n", "a<S", "tail<", "$1\\ \\n\n(.*)\n"]


def by_hand(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    u = re.findall(UNITS["lines"], text)
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not u or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (key, len(u), "plain", None, None, text)
    form = "spm" if h[3] % 100 < spm else "psm"
    return (key, len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("grammar", fim.GRAMMARS)
def test_units_are_those_of_the_grammar(spark, grammar):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "ab\n" * 3000])], "i int, t string")
    for i, t, got in rows.select("i", "t", fim.units(F.col("t"), grammar)).collect():
        assert "".join(got) == t
        if grammar != "tokens":  # Java's \w is ASCII
            assert got == re.findall(UNITS[grammar], t), (grammar, i)


def test_rows_by_hand(spark):
    rows = [(i * 37 + k, t) for i, t in enumerate(TEXTS) for k in range(12)] + [(None, "x\ny\nz\n"), (5, None), (5, None), (6, "l\n" * 40_000)]
    docs = spark.createDataFrame([(i, t, "kept", 1, 2.0) for i, t in rows], "`the.id` long, text string, c0 string, n int, whole double").repartition(4)
    made = fim.transformed(docs, "the.id")
    assert made.columns == ["the.id", "text", "c0", "whole", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.select("`the.id`", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("r"), "text", "c0").collect()
    order = lambda x: sorted(x, key=str)
    assert order(tuple(r)[:6] for r in got) == order(by_hand(*r) for r in rows)
    assert all(r.r == (r.text or "") and r.c0 == "kept" for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rate_seed_markers_and_no_rows(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\nd\n") for i in range(400)], "doc_id long, text string")
    got = fim.transformed(docs, rate=30, spm=20, seed=11).collect()
    assert sorted(tuple(r[:1] + r[2:]) for r in got) == sorted(by_hand(i, "a\nb\nc\nd\n", 11, 30, 20) for i in range(400))
    other = ("[pre]", "[suf]", "[mid].*")
    made = fim.transformed(docs, markers=other)
    assert made.where(fim.restored(F.col("output"), F.col("form"), other) == F.col("text")).count() == 400
    for bad in (("a", "ab", "c"), ("x", "x", "y"), ("", "a", "b"), ("abca", "x", "y")):
        with pytest.raises(ValueError):
            fim.checked(bad)
    with pytest.raises(ValueError):
        fim.transformed(docs.withColumnRenamed("text", "output"), text="output")
    assert fim.digests(fim.transformed(docs.limit(0))).count() == 0


def test_query_takes_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, n, form, p, m, sha(out), sha(t or "")) for i, t in docs.select("doc_id", "text").collect() for _, n, form, p, m, out in [by_hand(i, t)]]
    assert sorted(map(tuple, queries.op13_fill_in_middle(spark, sf_dir).collect())) == sorted(want)
