from verdigris.operators import exemplars

SEEN = "id long, text string"


def counting(path):
    """An encoder that leaves a file for each text that it was asked for."""

    class Counting:
        def encode(self, texts):
            import uuid
            from pathlib import Path

            import numpy as np

            for t in texts:
                Path(path, uuid.uuid4().hex).write_text(t)
            return np.array([[len(t), 1.0] for t in texts], float).reshape(len(texts), 2)

    return Counting()


def calls(path):
    found = sorted(p.read_text() for p in path.iterdir())
    for p in path.iterdir():
        p.unlink()
    return found


def test_only_what_changed_is_encoded(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    index, encoder = exemplars.EmbeddingIndex(spark, f"{tmp_path}/index"), counting(str(asked))
    docs = lambda rows: spark.createDataFrame(rows, SEEN)
    held = lambda: {r.key: r.embedding[0] for r in index.table().collect()}
    long = "x" * 20_000
    first = [(1, "a"), (2, "bb"), (3, None), (4, long)]
    r = index.refresh(docs(first), "id", "text", encoder)
    assert (r.run, r.encoded, r.kept, r.removed) == (1, 4, 0, 0) and calls(asked) == ["", "a", "bb", "x" * 16_000]
    assert held() == {1: 1, 2: 2, 3: 0, 4: 16_000}
    r = index.refresh(docs(first), "id", "text", encoder)
    assert (r.encoded, r.kept, r.removed) == (0, 4, 0) and calls(asked) == []
    # only the head of the long text differs, so its tail's digest is the same
    r = index.refresh(docs([(1, "a"), (2, "changed"), (4, "y" + long), (5, "new")]), "id", "text", encoder)
    assert (r.encoded, r.kept, r.removed) == (2, 2, 1) and calls(asked) == ["changed", "new"]
    assert held() == {1: 1, 2: 7, 4: 16_000, 5: 3}
    r = index.refresh(docs([(2, "bb"), (5, "new")]), "id", "text", encoder)
    assert (r.encoded, r.kept, r.removed) == (0, 2, 2) and calls(asked) == []  # a text that changed back is still known
    assert held() == {2: 2, 5: 3}
    assert index.compact() == 4 and held() == {2: 2, 5: 3}
    assert index.refresh(docs([(2, "bb"), (5, "new")]), "id", "text", encoder).encoded == 0
    assert index.refresh(docs([]), "id", "text", encoder).removed == 2 and held() == {}


def test_a_run_that_dies_changes_nothing(spark, tmp_path):
    class Broken:
        def encode(self, texts):
            raise RuntimeError("no model")

    class One:
        def encode(self, texts):
            import numpy as np

            return np.ones((len(texts), 1))

    index = exemplars.EmbeddingIndex(spark, f"{tmp_path}/index")
    index.refresh(spark.createDataFrame([(1, "a")], SEEN), "id", "text", One())
    try:
        index.refresh(spark.createDataFrame([(1, "a"), (2, "b")], SEEN), "id", "text", Broken())
        raise AssertionError("it must fail")
    except Exception as e:
        assert "no model" in str(e)
    assert [r.key for r in index.table().collect()] == [1]
    assert index.refresh(spark.createDataFrame([(1, "a"), (2, "b")], SEEN), "id", "text", One()).encoded == 1


def test_texts_do_not_move_where_nothing_is_pending(spark, tmp_path):
    """The index is too large to be broadcast, and what it lacks isn't: the texts are joined where they are read."""

    class One:
        def encode(self, texts):
            import numpy as np

            return np.ones((len(texts), 1))

    index, rows = exemplars.EmbeddingIndex(spark, f"{tmp_path}/index"), [(i, f"text {i}") for i in range(2000)] + [(None, "no key")]
    spark.createDataFrame(rows, SEEN).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    index.refresh(docs.where("id is not null"), "id", "text", One())
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "3000")
    try:
        todo = index.pending(docs, "id", "text")
        assert [(r.id, r.text) for r in todo.collect()] == [(None, "no key")]
        assert "SortMergeJoin" not in todo._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
