import random

import numpy as np
import pytest

from verdigris.operators import dedup, similarity
from verdigris.sources.staging import shared


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if find(i) != find(j) and linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def alike(sets, threshold=0.8):
    def linked(i, j):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) < threshold * max(len(a), len(b)) or not len(a):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both) >= threshold

    return linked


def texts(seed, families, members, shared_part):
    """Families whose members share a part of their text and drift."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    rows = []
    for _ in range(families):
        core = [word() for _ in range(int(90 * shared_part))]
        base = [word() for _ in range(90 - len(core))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 90])):
                if own:
                    own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(core + own)))
            if rng.random() < 0.2:
                base = own
    return rows


def test_groups_are_those_of_all_pairs(spark):
    rows = texts(3, 12, 40, 0.5) + texts(4, 30, 3, 0.0)
    rows = [(i * 3, t) for i, (_, t) in enumerate(rows)] + [(9000, None), (9001, "abc"), (9002, "abc"), (9003, rows[5][1]), (9004, rows[5][1])]
    want = components([i for i, _ in rows], alike({i: similarity.byte_shingles(t) for i, t in rows}))
    assert len(set(want.values())) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup.collapse(df, "doc_id", "text").collect()
    assert {r.doc_id: r.component for r in got} == want
    assert all(want[r.representative] == r.component for r in got)
    pairs = similarity.lsh_pairs(shared(similarity.profiles(df, "doc_id", "text"), "t"), "doc_id").collect()
    found = components([i for i, _ in rows], lambda i, j, held={(r.a, r.b) for r in pairs}, ok=alike({i: similarity.byte_shingles(t) for i, t in rows}): (i, j) in held and ok(i, j))
    assert found == want and all(r.a < r.b for r in pairs)


def test_a_family_of_unlike_rows_gives_few_candidates(spark):
    """1,500 texts that share two thirds: all are below 0.8, and most pairs share a bucket."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    core = " ".join(word() for _ in range(100))
    rows = [(i, core + " " + " ".join(word() for _ in range(50))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    profiled = shared(similarity.profiles(df, "doc_id", "text"), "family")
    nodes, copies = similarity.distinct_sets(profiled, "doc_id")
    assert copies.count() == 0
    assert similarity.cells(nodes, "doc_id").groupBy("band", "hash").count().agg({"count": "max"}).first()[0] > 100
    assert similarity.lsh_pairs(profiled, "doc_id").count() <= 50_000
    assert dedup.collapse(df, "doc_id", "text").where("doc_id <> component").count() == 0


def brute(rows):
    """component of each id and the texts' representative by all pairs; rows: (key, text)."""
    want = components([i for i, _ in rows], alike({i: similarity.byte_shingles(t) for i, t in rows}))
    return want


def representatives(spark, want):
    """The member with the smallest hash of each component."""
    df = spark.createDataFrame(list(want.items()), ["k", "c"])
    return {r.k for r in df.selectExpr("k", "c", "xxhash64(k) as h").selectExpr("min_by(k, struct(h, k)) over (partition by c) as k").distinct().collect()}


def test_statistics_of_the_pass_that_writes(spark, tmp_path):
    import json

    rows = [(f"k{i}", t, i) for i, (_, t) in enumerate(texts(5, 6, 12, 0.5))] + [("n", None, -1), ("e", "", -2)]
    df = spark.createDataFrame(rows, "key string, text string, more int").repartition(4)
    want = representatives(spark, brute([(k, t) for k, t, _ in rows]))
    stats = dedup.write_collapsed(df, "key", "text", str(tmp_path))
    assert stats == {"rows": len(rows), "kept": len(want), "lexical": len(rows) - len(want), "marginal": 0}
    assert json.loads((tmp_path / "stats.json").read_text()) == stats
    assert {(r.key, r.text, r.more) for r in spark.read.parquet(f"{tmp_path}/rows").collect()} == {r for r in rows if r[0] in want}


def test_queries_keep_what_all_pairs_keep(spark, sf_dir):
    from verdigris.plans import composites, decisions
    from verdigris.plans.base import Tables
    from verdigris.operators import latest

    t = Tables(spark, sf_dir)
    j = latest.latest_verdict(t.verdicts(), "judge").select("dedup_key", "category")
    rows = [(r.dedup_key, f"<user>\n{r.text}") for r in t.feedback().join(j, "dedup_key").where("text is not null").collect()]
    none = [r.dedup_key for r in t.feedback().join(j, "dedup_key").where("text is null").collect()]
    want = representatives(spark, brute(rows)) | set(none)
    assert {r.dedup_key for r in composites.n02(t).collect()} == want
    docs = {r.doc_id: r.text for r in t.documents.collect()}
    kept = representatives(spark, brute(list(docs.items())))
    pool = decisions.m17(t).collect()
    assert {r.doc_id for r in pool} <= kept and all(r.prompt == docs[r.doc_id] for r in pool)
    n = {c: sum(r.completion == c for r in pool) for c in ("yes", "no")}
    assert n["yes"] == n["no"] > 0 and len({(r.doc_id, r.copy) for r in pool}) == len(pool)


def clustered(seed, n, dim=24, centres=30, spread=0.08):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim)) * rng.choice([0.0, 1.0, 4.0], n)[:, None]
    v[::97] = 0
    return v


@pytest.mark.parametrize("block", [16, 4096])
def test_cosine_pairs_are_all_pairs(spark, block):
    v = clustered(1, 500)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    u = similarity.unit_rows(v.tolist())
    for threshold in (0.92, 0.5, -0.2):
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)))}
        got = similarity.cosine_pairs(df, "id", "v", threshold, block).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
        ids = list(range(500))
        forest = [(r.a, r.b) for r in similarity.cosine_pairs(df, "id", "v", threshold, block, forest=True).collect()]
        assert components(ids, lambda i, j, h={tuple(sorted(p)) for p in forest}: (i, j) in h) == components(ids, lambda i, j, h=want: (i, j) in h)


def test_clustered_vectors_meet_in_few_groups(spark):
    """Four times the vectors meet in far fewer than sixteen times the groups, and copies give links, not pairs."""
    met = []
    for n in (400, 1600):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(clustered(2, n, spread=0.01))], "id long, v array<double>")
        cells = similarity.cosine_cells(df, "id", "v", 0.97, 16).groupBy("cell").count().collect()
        met.append(sum(r["count"] ** 2 for r in cells))
    assert met[1] < 8 * met[0]
    same = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(900)], "id long, v array<double>")
    assert similarity.cosine_pairs(same, "id", "v", 0.999, 64, forest=True).count() < 4 * 900


def test_rows_of_a_bucket_meet_in_classes_of_size(spark):
    """Crowded buckets in portions of 16 against all pairs, keys of text: each pair once, those that sizes keep apart not at all."""
    from pyspark.sql import functions as F

    rows = [(f"k{i}", t) for i, t in texts(11, 6, 40, 0.6)]
    rows += [(f"x{i}", t[: len(t) // (1 + i % 5)]) for i, (_, t) in enumerate(texts(12, 4, 30, 0.7))]
    nodes, _ = similarity.distinct_sets(shared(similarity.profiles(spark.createDataFrame(rows, "k string, text string"), "k", "text"), "t"), "k")
    side = lambda p: nodes.select(F.col("k").alias(p), F.col("bands").alias(f"{p}_bands"), F.col("size").alias(f"{p}_size"), F.col("sketch").alias(f"{p}_sketch"))
    shares = F.exists(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), lambda x: x)
    want = {(r.a, r.b) for r in side("a").crossJoin(side("b")).where((F.col("a") < F.col("b")) & shares & similarity.may_be_alike("a_", "b_", 0.8)).select("a", "b").collect()}
    held = shared(similarity.cells(nodes, "k").join(nodes.select("k", F.col("k").alias("comp"), "size", "sketch", "bands"), "k"), "t")
    for portion in (16, 1024):
        for part in (held, held.drop("bands")):
            got = [(r.a, r.b) for r in similarity.met(part, "k", 0.8, portion).collect()]
            assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    x, y = (np.concatenate(z) for z in zip(*similarity.alike_places(np.zeros(3, int), np.array([0, 0, 2]), np.array([100, 70, 90]), np.zeros((12, 3), np.uint64), 0.8), strict=True))
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 2)]


def test_pairs_are_verified_on_texts(spark, monkeypatch):
    """What is stored and joined to the pairs are texts, not their sets, which take eight times the bytes."""
    texts = [None, "", "abc", "the quick brown fox jumps", "the quick brown fox jumped", "the quick brown fox jumps", "héllo wörld, héllo", "héllo wörld, hello", "something else"]
    kinds, kept = [], dedup.shared
    monkeypatch.setattr(dedup, "shared", lambda df, name: (kinds.append((name, dict(df.dtypes))), kept(df, name))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    every = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    found = dedup.similar_sets(docs, kept(spark.createDataFrame(every, "a long, b long"), "pairs"), "id", "text", 0.8)
    sets = [{(t or "").encode()[k : k + 5] for k in range(len((t or "").encode()) - 4)} for t in texts]
    assert {(r.a, r.b) for r in found.collect()} == {(i, j) for i, j in every if sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert ("texts", {"id": "bigint", "text": "string"}) in kinds and not any("binary" in k.values() for _, k in kinds)


def test_vectors_travel_once_for_each_part(spark, monkeypatch):
    """Vectors without clusters are shuffled once for each part that they meet, whatever the blocks; parts of few give the same."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(700, 12))
    v[600:] = v[:100] + 0.02 * rng.normal(size=(100, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    u = similarity.unit_rows(v.tolist())
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.5, 1)))}
    made, read = [], similarity.cosine_cells
    monkeypatch.setattr(similarity, "cosine_cells", lambda *a: made.append(x := read(*a)) or x)
    for part in (similarity.PART, 64):
        monkeypatch.setattr(similarity, "PART", part)
        got = [(r.a, r.b) for r in similarity.cosine_pairs(df, "id", "v", 0.5, 8).collect()]
        assert set(got) == want and len(got) == len(want)
        forest = [(r.a, r.b) for r in similarity.cosine_pairs(df, "id", "v", 0.5, 8, forest=True).collect()]
        assert set(forest) <= want and components(range(700), lambda i, j, h=set(forest): (i, j) in h) == components(range(700), lambda i, j: (i, j) in want)
    assert made[0].count() == 700


def test_staged_tables_leave_no_shuffle_files(spark):
    import time

    from verdigris.sources.staging import shared

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, manager = spark.conf.get(key), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size())) if f.startswith("shuffle")}
    held = files()
    shared(spark.range(1000).repartition(3, "id"), "ids")  # no count here, for it has a shuffle of its own
    left = lambda: {f for f in files() - held if f.endswith(".data")}
    for _ in range(50):  # files go a moment after the write
        if not left():
            break
        time.sleep(0.1)
    assert not left() and spark.conf.get(key) == before
