import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import matroska as m


@pytest.mark.parametrize("n", [1, 64, 1024, 1025, 8192, 8193, 100_000, 131_072, 300_000])
def test_round_trip(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    data = m.mux(payload)
    got = m.parse(data)
    assert m.payload_of(data, got) == payload
    assert got.doc_type == "matroska" and got.tracks[1]["codec"] == "A_PCM/INT/LIT" and got.tracks[1]["bits"] == 8
    assert [p.timestamp_ns for p in got.packets] == [i * 128_000_000 for i in range(len(got.packets))]
    assert [c[2] for c in got.cues] == got.clusters


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=20), st.sampled_from([m.XIPH, m.EBML_LACING]))
def test_lacing(frames, lacing):
    data = m.block(3, -5, frames, lacing)
    _, _, a, b = next(m.elements(data, 0, len(data)))
    track, rel, _, ranges = m.frames_of(data, a, b)
    assert (track, rel, [data[i : i + n] for i, n in ranges]) == (3, -5, frames)


def test_unknown_sizes_and_block_groups():
    cluster = m.number(m.TIMESTAMP, 40) + m.element(m.BLOCK_GROUP, m.block(1, 2, [b"ab"], 0, m.BLOCK) + m.number(m.BLOCK_DURATION, 1))
    unknown = lambda kind: kind.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    data = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + unknown(m.SEGMENT) + unknown(m.CLUSTER) + cluster + unknown(m.CLUSTER) + cluster
    got = m.parse(data)
    assert [(p.timestamp_ns, data[p.offset : p.offset + p.length], p.cluster) for p in got.packets] == [(42_000_000, b"ab", 0), (42_000_000, b"ab", 1)]
    with pytest.raises(ValueError):
        m.parse(data[:-1])


def test_broken_media():
    data = m.mux(bytes(20_000))
    for cut in range(0, len(data), 97):
        with pytest.raises(ValueError):
            m.parse(data[:cut] + b"\xff" * 3)
    for lacing in (m.XIPH, m.EBML_LACING):
        block = m.block(1, 0, [b"a" * 300, b"b" * 300, b"c" * 300], lacing)
        _, _, a, b = next(m.elements(block, 0, len(block)))
        for end in range(a, a + 12):
            with pytest.raises(ValueError):
                m.frames_of(block[:end], a, end)
    even = m.block(1, 0, [b"a" * 300, b"b" * 300, b"c" * 300], m.FIXED)
    with pytest.raises(ValueError):
        m.frames_of(even[:-1], even.index(b"a" * 300) - 5, len(even) - 1)


def plain_feature(payload):
    """Counts by arithmetic and levels by plain loops."""
    frames = -(-len(payload) // 1024)
    clusters = -(-len(payload) // (1024 * 8 * 16))
    x = [b - 128 for b in payload]
    rms = (sum(v * v for v in x) / len(x)) ** 0.5
    crossings = sum((u >= 0) != (v >= 0) for u, v in zip(x, x[1:], strict=False))
    return f"clusters={clusters} blocks={-(-len(payload) // 8192)} packets={frames} cues={clusters} ms={len(payload) * 1000 // 8000} rms={rms:.4f} crossings={crossings}"


def test_the_query_on_whole_texts(spark, tmp_path):
    """Every column of op10_matroska against plain Python, packets against the payload."""
    from verdigris.llm.queries import op10_matroska

    rows = [(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (4, "x" * 200_000), (5, "y" * 64), (6, "word " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_matroska(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (next(t for i, t in rows if i == r.doc_id) or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.feature == plain_feature(padded)
        stored = m.mux(padded)
        assert (r.media_bytes, r.media_sha256, r.error) == (len(stored), hashlib.sha256(stored).hexdigest(), None)
        assert len(stored) > len(padded)


def test_columns(spark):
    rows = [("a", None, 1), ("b", "x" * 200_000, 2), ("b", "x" * 200_000, 2)]
    docs = spark.createDataFrame(rows, ["id", "text", "my.column"])
    stored = m.store(docs)
    assert stored.columns == ["id", "my.column", "n_bytes", "media"]
    packets = m.packet_table(stored)
    assert packets.columns[:3] == ["id", "my.column", "n_bytes"]
    assert packets.where("id = 'b' and `my.column` = 2").count() == 2 * -(-200_000 // 1024)
    odd = spark.createDataFrame([(1, None), (2, b""), (3, b"\x1a\x45"), (4, m.mux(b"abc"))], "doc_id long, media binary")
    got = {r.doc_id: r for r in m.features(odd).collect()}
    assert got[1].feature is None and got[1].error is None and got[3].error and got[3].feature is None and got[4].payload_bytes == 3
    table = [(r.doc_id, r.byte_length, r.error is None) for r in m.packet_table(odd).collect()]
    assert sorted(table, key=str) == [(3, None, False), (4, 3, True)]
    assert m.packet_table(stored.where("false")).count() == 0 == m.features(stored.where("false")).count()
