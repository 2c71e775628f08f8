import random
import re

import numpy as np
import pytest
import xxhash

from verdigris.llm import common, near, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows, radius=3):
    """(id, component) of rows (id, fingerprint) by all pairs."""
    fps = np.array([f for _, f in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            root[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def grouped(spark, rows, **options):
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in rows]
    table = common.staged(spark.createDataFrame(signed, "doc_id long, fp long").repartition(5), "test-fps")
    return sorted(((r.doc_id, r.component_id) for r in near.grouped(table, **options).collect()), key=str)


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("segments", [2, 4])
def test_against_all_pairs(spark, segments):
    rng = random.Random(segments)
    rows = []
    for _ in range(120):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 4])):  # chains of 1 to 5 flips
            rows.append((len(rows) * 7 % 100_003, fp))
            fp = flipped(rng, fp, rng.choice([0, 1, 2, 3, 3, 4, 5]))
    assert grouped(spark, rows, segments=segments) == groups(rows)


def test_dense_values_and_strays(spark):
    """Thousands of fingerprints around a centre, strays at 3 bits from just one of them, groups that share a half only."""
    rng = random.Random(5)
    centre, rows = rng.getrandbits(64), []
    cluster = {flipped(rng, centre, rng.choice([1, 2, 2, 3, 4])) for _ in range(1500)}
    cluster |= {flipped(rng, f, 3) for f in rng.sample(sorted(cluster), 40)}
    cluster |= {(centre & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(200)}
    rows = [(i, f) for i, f in enumerate(rng.sample(sorted(cluster), len(cluster)))]
    want = groups(rows)
    assert 1 < len({c for _, c in want}) < len(rows)
    assert grouped(spark, rows) == want
    assert grouped(spark, rows, dense=10**9) == want
    assert grouped(spark, rows, dense=1) == want


def test_other_radii(spark):
    rng = random.Random(9)
    rows = [(i, flipped(rng, f, rng.randrange(4))) for i, f in enumerate(rng.choices([rng.getrandbits(64) for _ in range(40)], k=200))]
    assert grouped(spark, rows, radius=1) == groups(rows, 1)
    assert grouped(spark, rows, radius=2) == groups(rows, 2)
    with pytest.raises(ValueError):
        grouped(spark, rows[:2], radius=4, segments=2)
    assert grouped(spark, rows, radius=4, segments=4) == groups(rows, 4)


def test_defined_cases(spark):
    rng = random.Random(3)
    long = " ".join("w%d" % rng.randrange(9000) for _ in range(120_000))
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE\u00a0two", "ÀB c d e", "àb c d e", long, long + " end", "x y z " * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "One"), (None, "x y z " * 50), (None, "alone in this world of words"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in rows], "doc_id long, text string, fp int, component_id string").repartition(3)
    got = near.near_duplicates(docs).collect()
    fps = [(i, by_hand(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == groups(fps)
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=str) == sorted(((i, f"{f:016x}") for i, f in fps), key=str)
    assert near.near_duplicates(docs.limit(0)).count() == 0
    named = near.near_duplicates(docs.selectExpr("cast(doc_id as string) as `a.b`", "text as `t.t`"), "a.b", "t.t")
    assert named.columns == ["a.b", "fingerprint", "component_id"] and named.count() == len(rows)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [(i, by_hand(t)) for i, t in docs]
    got = queries.op11_simhash(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{f:016x}") for i, f in fps)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(groups(fps))


def test_what_grows_is_not_broadcast(spark, monkeypatch):
    """Staged tables take few bytes on disk, so Spark would take them for small ones and send them through the driver."""
    plans = []

    def seen(df, name, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name, *rest)

    kept = common.staged
    monkeypatch.setattr(near, "staged", seen)
    monkeypatch.setattr(common, "staged", seen)
    monkeypatch.setattr(common, "MOST_ROWS", 0, raising=False)
    rng = random.Random(5)
    family = [7 ^ (1 << b) for b in range(64)] + [rng.getrandbits(64) for _ in range(50)]
    rows = list(enumerate([*family, *family[:9]]))
    assert grouped(spark, rows) == groups(rows)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    table = kept(spark.range(9), "test-large")
    assert "SortMergeJoin" in table.join(common.small(table), "id")._jdf.queryExecution().executedPlan().toString()
