import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_jaccard import brute as groups
from test_lines import expected as repeated_lines
from test_packing import check

from verdigris.llm import quality


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect() if not rows else rows[last]
        out = stage(spark, spark.createDataFrame(before, docs.schema), sf_dir)
        rows[name], last = out.collect(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and 0 < len(rows[name]) < len(before) or name in ("line dedup", "n-gram Jaccard join")
        texts = [(r.doc_id, r.text) for r in before]
        if name == "quality classifier":
            model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.grade(), 3)
            z = {r.doc_id: (model.weights[s] @ x, len(s)) for r in before for s, x in [quality.features((r.text or "").encode())]}
            assert {r.doc_id for r in rows[name]} == {d for d, (v, n) in z.items() if n and model.tails(v.reshape(1))[0, -1] >= 0.5}
        elif name == "line dedup":
            # what is left of each document are its own lines in order, without nothing but lines that all pairs would drop
            gone, exact = repeated_lines(texts)
            left = {r.doc_id: r.text for r in rows[name]}
            least = {d: [x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone] for d, t in texts if t is not None}
            dropped = 0
            for d, t in texts:
                if t is not None:
                    own = left.get(d, "").split("\n") if d in left else []
                    rest = iter(t.split("\n"))
                    assert all(any(x == y for y in rest) for x in own)
                    assert all(own.count(x) >= least[d].count(x) for x in least[d] if any(c.isalnum() for c in x))
                    dropped += sum(any(c.isalnum() for c in x) for x in t.split("\n")) - sum(any(c.isalnum() for c in x) for x in own)
            assert dropped - exact >= 0.9 * (len(gone) - exact) and dropped <= len(gone)
            assert all(any(c.isalnum() for c in r.text) for r in rows[name] if r.text != dict(texts)[r.doc_id])
            assert all(r.n_chars == len(r.text) for r in rows[name])
        elif name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in rows[name]) == sorted({c for _, _, c in groups(texts)})
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert {r.doc_id for r in rows[name]} == {d for d, x in leaks(texts, items).items() if not x[-1]}
        else:
            used, least = check(rows[name], texts, 2048)
            assert used <= 1.02 * least + 1
    whole = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()
    assert {tuple(r) for r in whole} == {(r.doc_id, r.piece, r.ids_crc32) for r in rows[last]}


def test_odd_tables(spark, sf_dir):
    """Empty tables, nulls, repeated rows and ids, columns of dotted names and of names that operators make."""
    names = ["doc_id", "text", "n_chars", "lines_dropped", "hit_items", "p_best", "a.b", "doc", "component", "hash", "c0"]
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text), (1, text), (2, text), (2, "other words of the second text with one id"), (None, text), (3, None), (4, ""), (5, "x " * 3000), (None, "a b c d e f")]
    odd = spark.createDataFrame([(i, t, None if t is None else len(t), "mine", 7, 0.5, "dot", "d", None, 3, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long, lines_dropped string, hit_items int, p_best double, `a.b` string, doc string, component string, hash int, c0 int")
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == names, name
            got = out.collect()
            assert all((r.lines_dropped, r.hit_items, r.p_best, r["a.b"], r.hash) == ("mine", 7, 0.5, "dot", 3) for r in got), name
            kept = sorted((r.doc_id or 0, r.text or "") for r in got)
            if docs is odd and name == "n-gram Jaccard join":
                assert kept == sorted([(1, text), (2, rows[3][1]), (3, ""), (4, ""), (5, rows[7][1]), (0, "a b c d e f")])
            elif docs is odd and name == "line dedup":
                assert [t for d, t in kept].count(text) == 3 and len(kept) == len(rows) - 1
        assert stage_pieces(spark, docs, sf_dir) == (len(rows) + 1 if docs is odd else 0)


def stage_pieces(spark, docs, sf_dir):
    """Pieces of the last stage: the long text takes two."""
    return corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()
