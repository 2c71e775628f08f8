import random
import re
from collections import defaultdict

from verdigris.llm import common, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    seen = set()
    for members in at.values():
        for x, i in enumerate(members):
            for j in members[x + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def run(spark, rows, parts=4):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string").repartition(parts)
    return sorted(map(tuple, jaccard.similar_groups(docs).collect()))


def variants(seed, n, length):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 5000)
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(rng.choice(length))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(rng.randint(1, 3))]
            rows.append((len(rows) * 7 % 10007, " ".join(copy)))
    return rows


def test_long_and_short_sets_against_brute_force(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = variants(1, 500, [6, 7, 8, 9, 12, 20, 40, 150])
    rows += [(20_000 + i, f"own{i} {passage} " + " ".join(f"x{i}_{j}" for j in range(i % 70))) for i in range(80)]
    rows += [(30_000, None), (30_001, ""), (30_002, " \t\n"), (30_003, "A b"), (30_004, "a b"), (30_005, "a B"), (30_006, "a b c d e"), (30_006, "a b c d e"), (30_007, "z " * 30_000), (30_008, "z " * 29_000), (30_009, "a\x0bb\x0cc d e f")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_blocks_and_unbroadcast_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    monkeypatch.setattr(jaccard, "OFTEN", 1)
    monkeypatch.setattr(jaccard, "MOST_COMMON", 10)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = variants(9, 250, [7, 30, 80])
    assert run(spark, rows) == brute(rows)


def test_the_boundary_follows_cost():
    assert jaccard.boundary({500: 1000}, 0, 0.8) >= 1
    assert jaccard.boundary({5: 1000}, 50_000, 0.8) >= 5
    assert jaccard.boundary({}, 0, 0.8) >= 1
    assert [jaccard.least_overlap(n, 0.8) for n in (1, 2, 3, 4, 5, 10)] == [1, 2, 3, 4, 4, 8]


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, repeated rows, null ids and texts, clashing and dotted names."""
    u = "u v w x y z " * 3
    t = "a b c d e f g h i j"
    rows = [(1, t), (2, t), (2, u), (3, u + "x"), (7, t), (7, t), (None, t), (4, None), (4, None), (5, ""), (6, "only here and nowhere else at all"), (6, "only here and nowhere else at all"), (None, "null id alone in its own group yes")]
    docs = spark.createDataFrame([(i, x, "m", k, 0) for k, (i, x) in enumerate(rows)], ["doc_id", "text", "node", "a.b", "hash"]).repartition(3)
    got = jaccard.representatives(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, t), (2, u), (4, None), (4, None), (5, ""), (6, rows[10][1]), (None, rows[12][1])], key=str)
    assert jaccard.representatives(docs.where("false")).count() == 0


def test_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("b", "a b c d e f"), ("a", "A b c d e f"), ("c", "other"), (None, "a b c d e f"), (None, "third")], "doc_id string, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.similar_groups(docs).collect()), key=str)
    assert got == sorted([("a", "a"), ("b", "a"), ("c", "c"), (None, "a"), (None, None)], key=str)
