import random

import numpy as np
import pyarrow as pa

from verdigris.llm import common, quality


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(5, 120))]
        g = rng.choice([0, 1, 2, 2, 2])
        if g == 0:
            for k in range(0, len(words), 12):
                words[k] = rng.choice(["vile", "Nasty"])
        if g == 1:
            words = [w + "!!!" for w in words]
        rows.append((i, " ".join(words), g))
    return rows


def test_held_out_accuracy_and_selection(spark):
    rows = corpus(1200, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, rejected string").repartition(4)
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, _, g in rows if i < 800] + [(5, None, None), (None, 1, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, quality.grade(), 3)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(g, got[i]) for i, _, g in rows if i >= 800]
    assert np.mean([(g < 2) == r.rejected for g, r in held]) > 0.98
    means = [np.mean([r.expected_grade for g, r in held if g == k]) for k in range(3)]
    assert means == sorted(means)
    assert (np.diff(model.thresholds) > 0).all()
    again = quality.train(docs.repartition(2), labels.repartition(3), quality.grade(), 3)
    assert np.array_equal(again.weights, model.weights)


def brute_features(text):
    """slot → value by plain counting."""
    import xxhash

    edge = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()).encode()
    slot = lambda kind, value: xxhash.xxh3_64_intdigest(kind + value) >> (64 - quality.BITS)
    words, out = text.encode().split(), []
    cores, edges, caps, bare = {}, {}, 0, 0
    for w in words:
        core = w.strip(edge)
        around = w[: w.find(core)] + b" " + w[w.find(core) + len(core) :] if core else w
        if core:
            s = slot(b"w", core.lower())
            cores[s] = cores.get(s, 0) + 1
        if around != b" ":
            s = slot(b"p", around)
            edges[s] = edges.get(s, 0) + 1
        caps += len(core) > 1 and core.isupper()
        bare += not core
    if not words:
        return []
    n = len(words)
    out = [(s, (k / n) ** 0.5) for part in (cores, edges) for s, k in part.items()]
    out += [(slot(b"c", b"%d" % int(10 * (caps / n))), 0.5), (slot(b"b", b"%d" % int(10 * (bare / n))), 0.5), (slot(b"d", b"%d" % int(10 * (len(cores) / n)) + b":%d" % n.bit_length()), 0.5)]
    return out


def test_the_query_against_brute_force(spark, tmp_path):
    """Scores by plain sums and sigmoids over the fitted weights; the fit itself against plain gradient descent below."""
    from math import exp

    from verdigris.llm.queries import op9_ordinal_quality

    rows = [(i, t) for i, t, _ in corpus(300, 8)] + [(900, None), (901, ""), (902, "OK!! --- (x) A.B \"q\""), (902, "***"), (903, "word " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, _, g in corpus(300, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.train(docs, labels, quality.grade(), 3)
    want = []
    for i, t in rows:
        f = brute_features(t or "")
        z = sum(float(model.weights[s]) * x for s, x in f)
        tails = [1 / (1 + exp(float(k) - z)) for k in model.thresholds] if f else [0.0, 0.0]
        want.append((i, round(sum(tails), 3), round(tails[1], 3), tails[1] < 0.5))
    got = [(r.doc_id, round(r.expected_grade, 3), round(r.p_best, 3), r.rejected) for r in op9_ordinal_quality(spark, str(tmp_path)).collect()]
    near = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) < 0.003 and abs(a[2] - b[2]) < 0.003 and (a[3] == b[3] or abs(a[2] - 0.5) < 0.01)
    assert len(got) == len(want) and all(near(a, b) for a, b in zip(sorted(got), sorted(want), strict=True))


def test_fit_against_plain_gradient_descent():
    """The likelihood that plain full-gradient steps with numeric derivatives reach is no better than the fit's."""
    rng = np.random.default_rng(4)
    truth = rng.normal(size=6)
    rows = []
    for _ in range(400):
        s = rng.choice(6, 3, replace=False).astype(np.int32)
        z = truth[s].sum() + rng.logistic() * 0.5
        rows.append((int(z > -0.5) + int(z > 0.8), s, np.ones(3, np.float32)))
    m = quality.fit(rows, 3, least_docs=1, l2=1e-4)

    def loss(w, cut):
        z = np.array([w[s].sum() for _, s, _ in rows])
        edges = np.concatenate([[-40], np.sort(cut), [40]])
        y = np.array([g for g, _, _ in rows])
        p = 1 / (1 + np.exp(z - edges[y + 1])) - 1 / (1 + np.exp(z - edges[y]))
        return -np.log(np.maximum(p, 1e-12)).mean() + 0.5e-4 * (w**2).sum()

    x = np.concatenate([np.zeros(6), [-0.5, 0.5]])
    for _ in range(1500):
        g = np.array([(loss(*np.split(x + d, [6])) - loss(*np.split(x - d, [6]))) / 2e-5 for d in np.eye(8) * 1e-5])
        x -= 1.0 * g
    assert loss(m.weights[:6].astype(float), m.thresholds) <= loss(*np.split(x, [6])) + 2e-3


def test_gradient_matches_brute_force_likelihood():
    rng = np.random.default_rng(1)
    rows = [(int(g), np.array([g, 3 + i % 4], np.int32), np.array([1.0, 0.5], np.float32)) for i, g in enumerate(rng.integers(0, 3, 300))]
    m = quality.fit(rows, 3, least_docs=1)
    p = m.tails(np.array([m.weights[s] @ x for _, s, x in rows]))
    cum = np.concatenate([np.ones((300, 1)), p, np.zeros((300, 1))], 1)
    y = np.array([r[0] for r in rows])
    assert -np.log(cum[np.arange(300), y] - cum[np.arange(300), y + 1]).mean() < 0.2


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "***"), (4, "a " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    none = quality.score(docs, quality.train(docs, labels.where("false"), quality.grade(), 3)).collect()
    assert all(r.p_best is None and r.rejected is False for r in none) and len(none) == 5
    some = quality.score(docs, quality.train(docs, labels, quality.grade(), 3)).collect()
    assert all(r.rejected and r.expected_grade == 0 for r in some if not (r.text or "").strip())
    assert quality.score(docs.where("false"), None).collect() == []
    assert quality.train(docs.where("false"), labels, quality.grade(), 3) is None


def test_workers_give_memory_back(spark, monkeypatch):
    """The map over batches ends with common.trim, so that a worker that waits beside the next stage holds little."""
    maps, trims = [], []
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a, **k: maps.append(run) or real(self, run, *a, **k))
    quality.score(docs, None)
    monkeypatch.setattr(common, "trim", lambda: trims.append(1))
    out = list(maps[0](iter([pa.RecordBatch.from_pydict({"c0": [1, 2], "c1": ["some words", None]})])))
    assert [b.num_rows for b in out] == [2] and trims
