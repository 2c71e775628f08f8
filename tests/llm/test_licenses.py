import random

import numpy as np

from verdigris.llm import licenses
from verdigris.llm.decontaminate import words_of


def brute(texts, templates, containment=0.8):
    """All windows of twice a template's size, by sets of word tuples."""
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = {}
    for d, t in texts:
        run = grams(words_of((t or "").encode()))
        for m, (_, template) in enumerate(templates):
            own = set(grams(words_of((template or "").encode())))
            best = max((len(own & set(run[s : s + 2 * len(own)])) / len(own) for s in range(0, len(run), len(own))), default=0) if own else 0
            if best >= containment:
                out[d, m] = best
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + "licensed under the License of version software".split()
    texts = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        for _ in range(rng.choice([0, 1, 1, 3])):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.4:
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = t
        texts.append((i, " ".join(words)))
    texts += [(900, None), (901, ""), (902, "the mit"), (903, "Released under the MIT License.\n" * 3000), (904, "Released under the MIT License")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, license string").repartition(3)
    got = licenses.scan(docs).collect()
    assert {(r.doc_id, r.template): round(r.containment, 9) for r in got} == {k: round(v, 9) for k, v in brute(texts, licenses.TEMPLATES).items()}
    assert all(0 <= r.first_word <= r.last_word for r in got)
    assert licenses.scan(docs, [("a", None), ("b", "")]).collect() == []
    assert licenses.scan(docs.where("false")).collect() == []


def test_bands_hold_the_promised_probability():
    for s in (0.1, 0.36, 0.9):
        b = licenses.bands_for(s, 1e-4)
        assert (1 - s) ** b <= 1e-4 < (1 - s) ** (b - 2) if b > 2 else True
    bank, rng, missed = licenses.Bank(licenses.TEMPLATES[:2], 0.8, 1e-2), np.random.default_rng(0), 0
    for _ in range(300):
        run = rng.integers(0, 2**63, 400).astype(np.uint64)
        at = int(rng.integers(0, 330))
        own = licenses.shingle_run(words_of(licenses.TEMPLATES[1][1].encode()))
        run[at : at + len(own)] = own
        missed += (0, 1) not in bank.scan([run])
    assert missed <= 12


def test_repeated_rows_and_the_query(spark, tmp_path):
    from verdigris.llm.queries import op6_license_scan

    text = "intro words " + dict(licenses.TEMPLATES)["MIT-whole"] + " and what follows"
    rows = [("a", text), ("a", text), ("b", "nothing"), (None, "Released under the MIT License")]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.license) for r in op6_license_scan(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([("a", "MIT-text"), ("a", "MIT-text"), ("a", "MIT-whole"), ("a", "MIT-whole"), (None, "MIT")], key=str)
