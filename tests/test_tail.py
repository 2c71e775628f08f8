from pathlib import Path

import pytest

from verdigris.sources import tail
from verdigris.streaming import sessions as S


def test_appended_lines_come_once(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)

    def run():
        stream = spark.readStream.format("tail").option("glob", "*.jsonl").load(f"file://{root}")
        return sorted((Path(r.path).name, r.begin, r.line) for r in S.drain(stream, str(tmp_path)).collect())

    (root / "a.jsonl").write_text("one\ntwo\nhal")
    (root / "other.txt").write_text("no\n")
    want = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    assert run() == want
    assert run() == want  # nothing new after a restart; the half-written line waits
    with (root / "a.jsonl").open("a") as f:
        f.write("f\nthree\n")
    (root / "deep" / "b.jsonl").write_text("é\n\n")
    want += [("a.jsonl", 8, "half"), ("a.jsonl", 13, "three"), ("b.jsonl", 0, "é"), ("b.jsonl", 3, "")]
    assert run() == sorted(want)
    (root / "a.jsonl").write_text("new\n")  # replaced by a shorter file
    assert run() == sorted([*want, ("a.jsonl", 0, "new")])


@pytest.mark.parametrize("split,step", [(7, 3), (64, 1 << 20), (1, 2)])
def test_splits_give_each_line_once(tmp_path, monkeypatch, split, step):
    monkeypatch.setattr(tail, "SPLIT", split)
    monkeypatch.setattr(tail, "STEP", step)
    lines = ["", "a", "bcdefghijkl", "", "m" * 40, "no", "p"]
    (tmp_path / "x").write_text("\n".join(lines) + "\nhalf a line")
    reader = tail.TailReader(f"file://{tmp_path}", "*")
    end = reader.latestOffset()
    assert list(end.values()) == [len("\n".join(lines)) + 1]
    got = [r for p in reader.partitions({}, end) for r in reader.read(p)]
    assert [line for _, _, line in got] == lines
    text = (tmp_path / "x").read_text()
    assert all(text[b : b + len(line)] == line for _, b, line in got)
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
