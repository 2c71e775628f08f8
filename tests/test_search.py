import math
import random
import re

import pytest
from pyspark.sql import functions as F

from verdigris.operators import search


def by_hand(rows, query, limit, k1=1.2, b=0.75):
    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    docs = {i: tok(t) for i, t in rows if i is not None and tok(t)}
    ask = list(dict.fromkeys(tok(query)))
    mean = sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in ask}
    out = []
    for i, d in docs.items():
        if ask and all(t in d for t in ask):
            out.append((i, sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in ask)))
    return [(i, round(s, 9)) for i, s in sorted(out, key=lambda x: (-round(x[1], 12), x[0]))[:limit]]


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "die", "été", "x_1", "42"] + [f"w{i}" for i in range(300)]
    weights = [60, 40, 20, 9, 5, 3, 2] + [1] * 300
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 8, 30, 200])))) for i in range(n)]


def built(spark, path, rows, **options):
    index = search.Index(spark, str(path))
    assert index.ensure(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", ["text"], "k1", **options)
    return index


@pytest.mark.parametrize("block_docs", [16, 1 << 20])
def test_hits_are_those_of_plain_loops(spark, tmp_path, block_docs):
    rows = corpus(1, 900) + [(1000, None), (1001, ""), (1002, "!!"), (None, "alpha beta")]
    index = built(spark, tmp_path, rows, block_docs=block_docs, buckets=5)
    for query, limit in (("alpha", 5), ("beta ALPHA gamma, alpha", 40), ("42 été", 2000), ("alpha unheard", 5), ("?!", 5)):
        got = [(r.id, round(r.score, 9)) for r in index.search(query, limit, first=2).collect()]
        assert got == by_hand(rows, query, limit), query


def test_the_second_search_reads_postings_only(spark, tmp_path):
    rows = corpus(2, 400)
    spark.createDataFrame(rows, "id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, index = spark.read.parquet(f"{tmp_path}/documents.parquet"), search.Index(spark, f"{tmp_path}/index")
    assert index.ensure(docs, "id", ["text"], "a", block_docs=32)
    first = index.search("alpha beta", 10).collect()
    assert not index.ensure(docs, "id", ["text"], "a")
    again = index.search("alpha beta", 10)
    plan = again._jdf.queryExecution().toString()
    assert again.inputFiles() and all("/index/postings-" in f for f in again.inputFiles())
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*In\(term, \[alpha,beta\]\)", plan)
    assert again.collect() == first and index.state().build == 1
    more = docs.union(spark.createDataFrame([(9999, "alpha beta")], "id long, text string"))
    assert index.ensure(more, "id", ["text"], "b", block_docs=32)
    assert index.state().build == 2 and 9999 in [r.id for r in index.search("alpha beta", 500).collect()]
    assert again.collect() == first  # the table before the last is still there


def test_blocks_are_bounded_and_pruned(spark, tmp_path):
    rows = [(i, "common " + "other " * (i % 50)) for i in range(3000)]
    index = built(spark, tmp_path, rows, block_docs=64)
    stored = spark.read.parquet(index.state().at)
    assert stored.where("term = 'common'").agg(F.max("n")).first()[0] <= 150 and stored.where("term = 'common'").count() > 20
    assert [r.id for r in index.search("common", 3).collect()] == [0, 50, 100]
    with pytest.raises(ValueError):
        search.Index(spark, f"{tmp_path}/none").search("x", 1)
    assert search.Index(spark, f"{tmp_path}/e").ensure(spark.createDataFrame([], "id long, text string"), "id", ["text"], "k")
    assert search.Index(spark, f"{tmp_path}/e").search("common", 3).count() == 0


def test_postings_are_not_shuffled_as_rows(spark):
    """One shuffle, of documents to their blocks; no list is collected by a sort."""
    docs = spark.createDataFrame(corpus(4, 60), "id long, text string")
    plan = search.postings(docs, "id", ["text"], 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan
