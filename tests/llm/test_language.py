import zlib

import numpy as np

from verdigris.llm import language
from verdigris.llm import queries as q


def test_codes_keep_apart():
    for n in (1, 2, 3, 4, 7, 8, 40):
        c = language.codewords(n)
        assert c.shape[0] == n and set(np.unique(c)) <= {-1, 1}
        for i in range(n):
            for j in range(i):
                assert (c[i] != c[j]).sum() >= (c.shape[1] + 1) // 2 if n <= 7 else (c[i] != c[j]).any()


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = q.op8_output_codes(spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def brute(rows, bits=14, scale=40.0):
    """The whole of operator 8 with dictionaries and loops: (id, text, lang) → (prediction, score)."""
    from collections import Counter
    from math import exp, log, log1p

    def grams(text):
        folded = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in b" " + text.encode() + b" ")
        while b"  " in folded:
            folded = folded.replace(b"  ", b" ")
        two = [(folded[i] << 8 | folded[i + 1]) + (1 << 24) for i in range(len(folded) - 1)]
        three = [folded[i] << 16 | folded[i + 1] << 8 | folded[i + 2] for i in range(len(folded) - 2)]
        return Counter((g * 2654435761 % 2**32) >> (32 - bits) for g in two + three)

    counts = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(grams(text))
    langs = sorted(counts)
    share = {x: {g: (counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * 2**bits) for g in range(2**bits)} for x in langs}
    n = max(1, 2 ** (len(langs) - 1) - 1)  # the exhaustive code
    codes = [[1] * n] + [[1 if j >> (len(langs) - 2 - i) & 1 else -1 for j in range(n)] for i in range(len(langs) - 1)]
    weights, trust = [], []
    for j in range(n):
        plus, minus = [x for x, c in zip(langs, codes) if c[j] > 0], [x for x, c in zip(langs, codes) if c[j] < 0]
        weights.append([log(sum(share[x][g] for x in plus) / len(plus)) - log(sum(share[x][g] for x in minus) / len(minus)) for g in range(2**bits)])
        trust.append(max(0, min(c[j] * sum(share[x][g] * weights[j][g] for g in range(2**bits)) for x, c in zip(langs, codes))))
    trust = [t / sum(trust) * n for t in trust]
    out = {}
    for i, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            out[i] = ("und", 0.0)
            continue
        g = grams(text)
        size = sum(g.values())
        margins = [sum(k * w[x] for x, k in g.items()) * min(size, scale) / size for w in weights]
        loss = [sum(t * log1p(exp(-m * c)) for t, m, c in zip(trust, margins, code)) for code in codes]
        p = [exp(min(loss) - x) for x in loss]
        best = max(range(len(langs)), key=lambda k: (p[k], -k))
        out[i] = (langs[best], p[best] / sum(p))
    return out


def test_the_query_against_brute_force(spark, sf_dir, tmp_path):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 !?", None), (1003, "Der Hund, die Katze", None), (1004, "x", None), (1005, "日本語", None), (1006, "the " * 20_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    for r in q.op8_output_codes(spark, str(tmp_path)).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3, (r, want[r.doc_id])


def test_repeated_rows_and_any_ids(spark):
    rows = [("a", "the cat and the hat", "en", 7), ("a", "the cat and the hat", "en", 7), ("b", "der Hund und die Katze", "de", 8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "my.score"])
    got = language.predict(docs, language.train(docs))
    assert got.columns[:4] == docs.columns
    assert sorted((r.doc_id, r.lang_pred) for r in got.collect()) == [("a", "en"), ("a", "en"), ("b", "de")]


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat", "en", 1.0), (2, "der Hund und die Katze", "de", 2.0), (3, None, "en", 0.0), (4, "12 !! ", None, 0.0), (5, "", "de", 0.0), (6, "the " * 50_000, None, 0.0), (7, "ß", None, 0.0), (8, "日本", None, 0.0)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["en", "de", "und", "und", "und", "en"]
    assert got[7].lang_pred in ("de", "en") and got[8].lang_pred in ("de", "en")
    assert all(r.lang_pred == "und" for r in language.predict(docs, language.train(docs.where("false"))).collect())
    assert language.predict(docs.where("false"), None).collect() == []
    one = language.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(docs, one).collect()} == {"en", "und"}
