"""Growing files as a stream: a Python data source whose offset is, for each file, how many of its bytes were read.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("glob", "*.jsonl").load("file:///transcripts")

Every line that ends in a newline comes once, with its file and where in it the line begins; a last line that is still being
written waits for its end.  A file that became shorter than what was read of it was replaced, and is read from its start.
The checkpoint holds the offsets, so a restart goes on where the last batch ended.  Files are opened by pyarrow's file
systems (local, HDFS, object stores); large pieces are cut into splits, which read the lines that begin in them.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, begin long, line string"
#: Bytes that one task reads, and that are read at once in search of a file's last newline.
SPLIT, STEP = 64 << 20, 1 << 20


@dataclass
class Piece(InputPartition):
    path: str
    begin: int
    end: int
    first: int  # where the file's new part begins: no line stands across it


def opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def last_newline(held, begin: int, size: int) -> int:
    """The byte after the last newline in [begin, size), or begin."""
    end = size
    while end > begin:
        low = max(begin, end - STEP)
        held.seek(low)
        at = held.read(end - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        end = low
    return begin


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, glob: str):
        self.root, self.glob = root, glob
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What may be read now: of each file the bytes up to its last newline."""
        from pyarrow import fs

        system, root = opened(self.root)
        found: dict[str, int] = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.type != fs.FileType.File or not fnmatch.fnmatch(f.base_name, self.glob):
                continue
            seen = self.known.get(f.path, 0)
            seen = seen if seen <= f.size else 0
            if f.size > seen:
                with system.open_input_file(f.path) as held:
                    seen = last_newline(held, seen, f.size)
            found[f.path] = seen
        self.known = found
        return dict(sorted(found.items()))

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, size in end.items():
            first = start.get(path, 0)
            first = first if first <= size else 0  # it was replaced
            out += [Piece(path, low, min(low + SPLIT, size), first) for low in range(first, size, SPLIT)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        """The lines that begin in the piece; the last may end beyond it."""
        system, _ = opened(self.root)
        with system.open_input_file(partition.path) as held:
            size, at, rest = held.size(), partition.begin, b""
            if at > partition.first:  # the line that stands across the border belongs to the piece before
                held.seek(at - 1)
                while True:
                    chunk = held.read(STEP)
                    if not chunk or (cut := chunk.find(b"\n")) >= 0:
                        at = at - 1 + cut + 1 if chunk else size
                        break
                    at += len(chunk)
            where = at
            while where < partition.end:
                held.seek(at)
                chunk = held.read(min(STEP, size - at))
                if not chunk:
                    return
                at += len(chunk)
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if where >= partition.end:
                        return
                    yield partition.path, where, line.decode("utf-8", "replace")
                    where += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("glob", "*"))
