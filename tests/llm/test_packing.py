import random
import zlib
from collections import defaultdict

import numpy as np
from test_token_orc import whole

from verdigris.llm import packing


def check(rows, texts, size):
    """rows: of the result; texts: by doc_id."""
    want = {}
    for (i, t), ids in zip(texts, whole("word_bpe_49k.json", [t or "" for _, t in texts]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        for k in range(-(-len(ids) // size)):
            part = ids[k * size : (k + 1) * size]
            want[i, k] = (k * size, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(n for _, n, _ in want.values()) // size)


def test_whole_result(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [(10_000 + i, t) for i, t in enumerate([None, "", " ", "a", "a", "x " * 5000])]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, piece int").repartition(5)
    for size in (2048, 64):
        n, least = check(packing.pack(docs, size=size).collect(), texts, size)
        assert n <= 1.02 * least + 1
    assert packing.pack(docs.where("false")).collect() == []


def test_plan_uses_each_piece_once():
    rng = random.Random(3)
    for size, n in ((10, 100), (100, 5000), (2048, 20000), (1, 3)):
        h = np.bincount([min(size, 1 + int(rng.expovariate(3 / size))) for _ in range(n)], minlength=size + 1)
        got = np.zeros(size + 1, int)
        for parts, times in packing.plan(h, size):
            assert sum(parts) <= size and times > 0
            for k in parts:
                got[k] += times
        assert (got == h).all()
        used = sum(t for _, t in packing.plan(h, size))
        assert used <= 1.03 * -(-int((h * np.arange(size + 1)).sum()) // size) + 1
    assert packing.plan(np.zeros(11, int), 10) == []


def test_a_worker_encodes_little_text_at_once(spark, monkeypatch):
    """Beside a cache of units, a worker's memory grows with the text that it encodes at once: half a megabyte."""
    from verdigris.llm import encoding

    asked, plain = [], encoding.UnitEncoder.encode
    monkeypatch.setattr(encoding.UnitEncoder, "encode", lambda self, texts: asked.append(sum(len(t) for t in texts.to_pylist())) or plain(self, texts))
    monkeypatch.setattr("pyspark.TaskContext.get", classmethod(lambda cls: type("C", (), {"partitionId": lambda self: 0})()))

    class Docs:
        """Hands its map over instead of running it."""

        schema = spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": ["some words " * 500] * 400})
            return sum(b.num_rows for b in run([batch]))

    assert packing.token_pieces(Docs()) == 400
    assert sum(asked) == 400 * 5500 and max(asked) <= 512 << 10
