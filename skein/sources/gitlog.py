"""Git histories as a data source, for tables and for streams: ``format("gitlog")``.

A log is a text of ``git log --numstat`` whose commits start with ``hash␞epoch␞subject␞author``. Files are cut into ranges
of bytes; a range has the commits that start in it. A stream's offset is the size of every file: logs grow at their end, so
each micro-batch reads what has been added. Files are reached by Arrow, on every file system that it knows.

Defined results: binary rows and lines that are no numstat are left out, a commit without files gives no row, a broken
count is zero, an empty file nothing. ``suffix`` keeps the files that end in it.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "commit string, ts timestamp, author string, file string, added long, deleted long"
RANGE_BYTES = 32 << 20
MARK = b"\x1e"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def sizes(path: str) -> dict[str, int]:
    """The files at or below a path, hidden ones left out, and their sizes."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}


def is_head(line: bytes) -> bool:
    return len(line) > 41 and line[40:41] == MARK and all(c in b"0123456789abcdef" for c in line[:40])


def rows(part: Range, base: str, suffix: str = "") -> Iterator[tuple]:
    """The changes of the commits that start in a range."""
    fs = pafs.FileSystem.from_uri(base)[0] if "://" in base or base.startswith("file:") else pafs.LocalFileSystem()
    number = lambda x: int(x) if x.isdigit() else 0
    with fs.open_input_file(part.path) as f:
        at = max(0, part.start - 1)
        f.seek(at)
        left, held, head, live = b"", 0, None, True
        while live:
            data = f.read(1 << 20)
            lines = (left + data).split(b"\n")
            left = lines.pop() if data else b""
            for line in lines:
                begin, held = at + held, held + len(line) + 1
                if is_head(line) and begin >= part.start:
                    if begin >= part.end:
                        live = False
                        break
                    head = line.decode("utf-8", "replace").split("\x1e")
                elif head and len(head) >= 4 and line.count(b"\t") >= 2:
                    added, deleted, name = line.decode("utf-8", "replace").split("\t", 2)
                    name = name.strip()
                    if not (added == deleted == "-") and name.endswith(suffix):
                        ts = dt.datetime.fromtimestamp(int(head[1]), dt.timezone.utc) if head[1].lstrip("-").isdigit() else None
                        yield head[0], ts, head[3], name, number(added), number(deleted)
            if not data:
                live = False


def ranges(files: dict[str, int], since: dict[str, int], size: int) -> list[Range]:
    return [Range(p, lo, min(lo + size, n)) for p, n in sorted(files.items()) for lo in range(since.get(p, 0), n, size)]


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(sizes(self.base), {}, self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows(partition, self.base, self.suffix) if partition else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.base, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(sizes(self.base), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(json.loads(end["files"]), json.loads(start["files"]), self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows(partition, self.base, self.suffix)


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: object) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
