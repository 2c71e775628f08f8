import hashlib
import math
import random

import numpy as np
import pytest

from verdigris.llm import vector_codes


def by_hand(rows, parts=16, many=64, rounds=2, scale=256):
    """(id, code, error, label_error, sha) by plain loops over Python integers, all sums taken anew each round."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda q: [tuple(q[p * w : p * w + w]) for p in range(parts)]
    raw = lambda q: np.array(q, "<i4").tobytes()
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, raw(r[1])))[:many]
    books = [[cut(q)[p] for _, q, _ in first] for p in range(parts)]

    def assign(q):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(q))]

    for _ in range(rounds):
        sums = {}
        for _, q, _ in kept:
            for p, (_, k) in enumerate(assign(q)):
                n, s = sums.get((p, k), (0, [0] * w))
                sums[p, k] = n + 1, [a + b for a, b in zip(s, cut(q)[p])]
        books = [[tuple(x // sums[p, k][0] for x in sums[p, k][1]) if (p, k) in sums else e for k, e in enumerate(book)] for p, book in enumerate(books)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    done = [(i, "".join(f"{k:02x}" for _, k in assign(q)), sum(d for d, _ in assign(q)), lab) for i, q, lab in kept]
    by_label = {}
    for _, _, e, lab in done:
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted(((i, c, e, by_label[lab], sha) for i, c, e, lab in done), key=str)


def run(spark, rows, kind="float", **options):
    table = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, q int, codes string").repartition(4)
    return sorted(map(tuple, vector_codes.compressed(table, **options).collect()), key=str)


def vectors(seed, n, dim, labels=5):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return [(i * 7 % 10_007, [f32(x + rng.gauss(0, 0.2)) for x in rng.choice(centres)], rng.choice([None, *range(labels)])) for i in range(n)]


def test_against_plain_loops(spark):
    rows = vectors(1, 400, 32)
    assert run(spark, rows) == by_hand(rows)


def test_more_rounds_and_other_shapes(spark):
    rows = vectors(2, 150, 12)
    assert run(spark, rows, parts=4, many=300, rounds=5) == by_hand(rows, 4, 300, 5)
    assert run(spark, rows, parts=3, many=8, rounds=7, scale=16) == by_hand(rows, 3, 8, 7, 16)
    assert run(spark, rows, parts=6, many=1, rounds=0) == by_hand(rows, 6, 1, 0)


def test_defined_cases(spark):
    rng = random.Random(4)
    inf, nan = float("inf"), float("nan")
    base = [round(rng.uniform(-2, 2), 3) for _ in range(16)]
    bad = [None, [], [*base[:15], None], [*base[:15], nan], [*base[:15], inf], [*base[:15], -inf], [None] * 16]
    rows = [(i, v, 1) for i, v in enumerate(bad)]
    rows += [(50, base, None), (50, base, None), (50, base[::-1], 2), (None, base, 2), (9, [0.0] * 16, 1), (10, [-0.001] * 16, 1)]
    rows += [(100 + i, base, 7) for i in range(200)]  # a third and more of one vector and label
    rows += [(1000 + i, [x + (i % 7) / 256 for x in base], None) for i in range(120)]
    assert run(spark, rows, "double") == by_hand(rows)
    assert run(spark, rows[:7], "double") == [] and run(spark, []) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randint(-260_000, 260_000) + rng.random() for _ in range(64)], i % 3) for i in range(80)]
    assert run(spark, rows, "double", many=16) == by_hand(rows, many=16)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30] * 16, 1)], "double")
    with pytest.raises(ValueError, match="cut alike"):
        run(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)])
    with pytest.raises(ValueError, match="cut alike"):
        run(spark, [(1, [1.0] * 17, 1)])


def test_only_what_moved_is_shuffled(spark):
    from verdigris.llm.common import staged

    rows = spark.createDataFrame(vectors(3, 500, 16), "vec_id long, embedding array<float>, label int")
    rows = staged(vector_codes.integers(rows, "vec_id", "embedding", "label", 256), "test-vectors")
    books, first = vector_codes.learn(rows, many=8, rounds=1)
    assert first.where("before is null").count() == 500
    old = books.entries.copy()
    second = staged(vector_codes.assigned(first, old), "test-second")
    moved = second.where("before <> codes").count()
    assert 0 < moved < 500
    delta = vector_codes.changes(second, old).collect()
    counts = sum(d for place, d in delta if place % 2 == 1)  # width 1: sums and counts alternate
    assert counts == 0  # what one entry gains another loses
    settled = staged(vector_codes.assigned(second, old), "test-third")
    assert vector_codes.changes(settled, old).count() == 0


def test_decoded_is_near(spark):
    rows = vectors(8, 300, 32)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    from verdigris.llm.common import staged

    whole = staged(vector_codes.integers(table, "vec_id", "embedding", "label", 256), "test-whole")
    books, last = vector_codes.learn(whole, many=32, rounds=4)
    at = {r.id: r for r in vector_codes.encoded(last, books).collect()}
    for i, v, _ in rows:
        assert ((vector_codes.decoded(at[i].codes, books) - np.array(v)) ** 2).sum() == pytest.approx(at[i].error / 256**2, abs=0.6)
