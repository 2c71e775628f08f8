import hashlib
import random
import re

from verdigris.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = split(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[p : p + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r[0]: tuple(r[1:]) for r in decontaminate.digest(decontaminate.contamination(d, b, **kw)).collect()}


def test_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "B", "c", "É1", "dd"])
    text = lambda n: "".join(word() + rng.choice([" ", "-", ".\n", "\t"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 25))) for i in range(30)] + [(100, None), (101, "q x y z"), (102, "a " * 40)]
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)] + [(200, None), (201, ""), (202, "!!"), (203, "q. X y_Z"), (204, "a " * 5000)]
    docs += [(300 + i, text(9) + t + text(4)) for i, t in items[:20]]
    for kw in ({}, {"block_bytes": 60}, {"k": 10}, {"k": 1}):
        assert run(spark, docs, items, **kw) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == {}


def test_given_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert any(x[-1] for x in got.values())
