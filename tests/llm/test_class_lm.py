import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from verdigris.llm import class_lm
from verdigris.llm import queries as q
from verdigris.llm.common import HashIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENDED = "\n"


def mixed(x):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * times % 2**64
    return x ^ x >> 31


def hashed(word):
    return mixed(sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(word.encode())) % 2**64)


def signature(word):
    raw = word.encode()[::-1][:3]
    return mixed(sum(c << 8 * i for i, c in enumerate(raw))) % class_lm.SIGNATURES


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [ENDED]


def classes_of(model, count):
    """word → its class, its place among the vocabulary's words or None."""
    v = model.vocabulary
    at = {int(h): i for i, h in enumerate(v.keys)}

    def of(word):
        if word == ENDED:
            return len(model.transition) - 1, None
        i = at.get(hashed(word))
        return (int(v.own[i]) if i is not None else int(v.classes[v.heads + signature(word)])), i

    return of


def brute(rows, model):
    """The contract's base, and the model's probabilities one token after the other."""
    count = Counter(w for d, t, h in rows if not h for w in words(t))
    n, v = sum(count.values()), len(count)
    assert (n, v, count[ENDED]) == (model.tokens, model.distinct, model.ends)
    of = classes_of(model, count)
    tail = {}
    for w, k in count.items():
        if w != ENDED and of(w)[1] is None:
            tail.setdefault(signature(w), []).append(k)
        elif w != ENDED:
            assert model.vocabulary.n[of(w)[1]] == k
    out = []
    for d, t, h in rows:
        ws, base, total, before = words(t), 0.0, 0.0, len(model.transition) - 1
        for w in ws:
            base += math.log10((count[w] + 1) / (n + v + 1))
            c, place = of(w)
            total += model.transition[before, c]
            if place is not None:
                total += math.log10(count[w] + 0.5) - model.mass[c]
            elif w != ENDED:
                inside = tail.get(signature(w), [])
                total += math.log10(sum(inside) + 0.5) - model.mass[c]
                share = (count[w] - model.discount) if count[w] else model.discount * len(inside) if inside else 1
                total += math.log10(share / (sum(inside) or 1))
            before = c
        out.append((d, h, len(ws), sum(count[w] > 0 for w in ws), n, base, total))
    return out


@pytest.mark.parametrize("vocabulary", [1_000_000, 40])
def test_against_brute_force(spark, vocabulary):
    rng = random.Random(3)
    pool = ["the", "The", "a", "of", "é"] * 8 + [f"w{i}" for i in range(400)] + ["日本", "x\x00y"]
    rows = [(i, rng.choice(["", " ", "\n"]) + " \t".join(rng.choice(pool) for _ in range(rng.randint(0, 60))), i % 5 == 2) for i in range(150)]
    rows += [(500, None, False), (501, "", True), (None, "unheard-of word", True), (3, "the " * 30_000, False), (3, "the", False)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, held_out boolean, h string, n int").repartition(3)
    model = class_lm.learn(docs.where("not held_out"), head=20, classes=6, vocabulary=vocabulary)
    got = [tuple(r)[:7] for r in class_lm.score(docs, model).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for a, b in zip(sorted(got, key=key), sorted(brute(rows, model), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, "a b c d the the of z z " * (i % 3 + 1) + f"x{i} y{i % 20}") for i in range(30)], "doc_id long, text string")
    m = class_lm.learn(docs, head=4, classes=4)
    assert np.allclose((10.0**m.transition).sum(1), 1)
    v = m.vocabulary
    word = np.log10(v.n + 0.5) - m.mass[v.own]
    for c in range(3):
        assert np.isclose((10.0 ** word[v.own == c]).sum() + (10.0 ** m.unit_emission()[v.classes[v.heads : v.end] == c]).sum(), 1)
    count = Counter(w for r in docs.collect() for w in words(r.text) if w != ENDED)
    of = classes_of(m, count)
    for s in range(class_lm.SIGNATURES):
        inside = [n for w, n in count.items() if of(w)[1] is None and signature(w) == s]
        assert m.rare[s] == sum(inside) and m.kinds[s] == len(inside)
        if inside:
            assert np.isclose((sum(n - m.discount for n in inside) + 10 ** m.unseen()[s]) / 10 ** m.seen()[s], 1)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 40)
    b = np.zeros((41, 41), int)
    for _ in range(20_000):
        i = rng.integers(0, 40)
        b[i, rng.choice(np.flatnonzero(truth == (truth[i] + 1) % 3))] += 1
    own = class_lm.exchange(b, 4)
    assert all(len(set(own[:40][truth == c])) == 1 for c in range(3)) and own[40] == 3


def test_words_beyond_the_head_join_their_classes(spark):
    """Nouns follow articles and verbs follow nouns; with few head words, the others find their class by their contexts."""
    rng = random.Random(5)
    kinds = [[f"q{i}{c}" for i in range(60)] for c in "nvd"]
    text = lambda: " ".join(rng.choice(kinds[k % 3]) for k in range(rng.randint(3, 40)))
    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string").repartition(3)
    m = class_lm.learn(docs, head=12, classes=4)
    of = classes_of(m, None)
    assert len(m.vocabulary.keys) == 180 > m.vocabulary.heads
    common = [Counter(of(w)[0] for w in kind).most_common(1)[0] for kind in kinds]
    assert len({c for c, _ in common}) == 3 and sum(n for _, n in common) >= 170


def test_the_table_is_that_of_the_corpus(spark):
    """Contexts and class bigrams against plain counting."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    m = class_lm.learn(docs, head=3, classes=4, sweeps=1)
    of, last = classes_of(m, None), len(m.transition) - 1
    want = np.zeros((4, 4))
    for t in texts:
        before = last
        for w in words(t):
            c = of(w)[0]
            want[before, c] += 1
            before = c
    assert (class_lm.class_bigrams(docs, m.vocabulary, 4) == want).all()
    share = (want.sum(0) + 0.5) / (want.sum() + 2)
    assert np.allclose(m.transition, np.log10((want + 5 * share) / (want.sum(1, keepdims=True) + 5)))


def test_index_and_tokens():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    asked = np.concatenate([keys[::3], rng.integers(0, 2**63, 3000).astype(np.uint64), keys[:1] + np.uint64(1)])
    place = {int(k): i for i, k in enumerate(keys)}
    assert HashIndex(keys).of(asked).tolist() == [place.get(int(x), -1) for x in asked]
    assert HashIndex(keys[:0]).of(asked).max() == -1
    texts = ["A bb", None, "", "é\x0b日 本", "xyz", "  ", "Tail \n"]
    rows, h, sig = class_lm.tokens(pa.array(texts))
    want = [(i, hashed(w), signature(w)) for i, t in enumerate(texts) for w in words(t)[:-1]]
    assert list(zip(rows.tolist(), h.tolist(), sig.tolist(), strict=True)) == want


def test_held_out_texts_score_better_than_the_base(spark, sf_dir):
    got = q.op5_class_ngrams(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in got if r.held_out} == {d for d in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([("b", "a b", True), ("c", None, True)], "doc_id string, text string, held_out boolean")
    got = class_lm.score(docs, class_lm.learn(docs.where("false"))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [("b", 3, 0, 0), ("c", 1, 0, 0)]
    assert class_lm.score(docs.where("false"), class_lm.learn(docs)).collect() == []
