import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.llm import token_orc
from verdigris.llm.common import new_path
from verdigris.llm.encoding import encoder, tokenizer_file

ODD = ["", " ", "a  b", "a \n b", " lead", "trail ", "x  y  z", "it's we'll 'tis", "\n\n\n", "a\tb c", "<|endoftext|> x", "naïve ÉCOLE ß Σίσυφος", "1234 56,7 !!! ...", "é ́x", "\x1c \x1f a", "x " * 3000, "a  " * 50 + "b", "a\x01b c", "x!'s y's, z''s", "l\nm\n\nn\n", "\n", "a\n b", "a \nb.c,d", "1,234.5%", "t\u00a0 u\u3000v", "<|startoftext|>a.b", "a<|endoftext|>", "\t<|ENDOFTEXT|> b", "x\n<|endoftext|>\n<|startoftext|>  y", "<|endoftext |> <|end", "Ⓐ<|EndOfText|>"]


def whole(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_equal_whole_texts(spark, sf_dir, name, kind):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    for _ in range(2):
        ids, ends = encoder(name, kind).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == whole(name, texts)


def test_round_trip_and_positions(spark):
    rows = [(5, "b c"), (1, None), (3, "a  b " * 2000), (5, "b c"), (2, ""), (None, "x")]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, shard string, n_tokens int").repartition(3)
    path = new_path(spark, "t")
    token_orc.write_tokens(docs, path)
    got = sorted(map(tuple, token_orc.digests(spark, path).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole("byte_bpe_50k.json", [t or ""])[0] + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert [r.doc_id for r in token_orc.lookup(spark, path, [3]).collect()] == [3]


def test_empty_table(spark):
    path = new_path(spark, "t")
    token_orc.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_orc.digests(spark, path).collect() == []


def test_stripes_and_pruning(spark):
    """Small stripes make several to a file; a lookup reads few of the rows, by row indexes and Bloom filters."""
    from pyarrow import orc

    docs = spark.range(0, 60_000, 3).select("id", F.concat_ws(" ", *(F.xxhash64("id", F.lit(i)).cast("string") for i in range(6))).alias("text")).withColumnRenamed("id", "doc_id").coalesce(2)
    path = new_path(spark, "t")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_orc.write_tokens(docs, path, stripe_mb=1, row_index_stride=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [p for p in Path(path.removeprefix("file:")).iterdir() if p.suffix == ".orc"]
    files = [orc.ORCFile(str(p)) for p in parts]
    assert sum(f.nrows for f in files) == 20_000 and max(f.nstripes for f in files) > 1
    ids = [i for f in sorted(files, key=lambda f: f.read(columns=["doc_id"])["doc_id"][0].as_py()) for i in f.read(columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids) == list(range(0, 60_000, 3))
    by_stripe = [f.read_stripe(i, columns=["doc_id"]) for f in files for i in range(f.nstripes)]
    assert sum(len(s) for s in by_stripe) == 20_000

    def scanned(wanted):
        found = token_orc.lookup(spark, path, wanted)
        assert sorted(r.doc_id for r in found.collect()) == [i for i in wanted if i % 3 == 0]
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().get("numOutputRows").get().value()

    assert 0 < scanned([30_000]) <= 2000
    # between two stored ids, so statistics can't tell: only the Bloom filter can
    assert scanned([30_001]) == 0
