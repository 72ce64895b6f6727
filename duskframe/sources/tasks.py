"""A stream of processing tasks: a task list that grows, read in splits by the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that a task of Spark reads.
SPLIT = 1 << 20


class TaskSource(DataSource):
    """Format "duskframe_tasks". Options: path, a file of JSON lines with one task each (a local path that driver and
    executors share, or an address that Arrow can open), and split (bytes). A batch is what has come since the one
    before, however much, in as many tasks as it has splits. A line belongs to the split in which it begins, so
    each is read once; a line without its end is one that is still being written. The driver looks at the size of
    the file and for its last line end, nothing else."""

    @classmethod
    def name(cls) -> str:
        return "duskframe_tasks"

    def schema(self) -> str:
        return "id string, image_id string, image_url string, reply_subject string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("split", SPLIT)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options.get("split", SPLIT)))


class Split(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def open_place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the place there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _task(line: bytes) -> tuple:
    x = json.loads(line)
    return tuple(None if x.get(c) is None else str(x[c]) for c in ("id", "image_id", "image_url", "reply_subject"))


def _tasks(path: str, split: Split) -> Iterator[tuple]:
    """Tasks of the lines that begin in a split."""
    files, place = open_place(path)
    with files.open_input_file(place) as raw:
        at = max(split.start - 1, 0)
        raw.seek(at)
        rest, skip = b"", split.start > 0  # what comes before the first line end is of the split before
        while True:
            block = raw.read(1 << 18)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            for line in lines:
                if not skip:
                    if at >= split.end:
                        return
                    if line.strip():
                        yield _task(line)
                skip = False
                at += len(line) + 1
            if not block:
                return


def _end(path: str) -> int:
    """Where the last whole line of the file ends."""
    files, place = open_place(path)
    if files.get_file_info(place).type != fs.FileType.File:
        return 0
    with files.open_input_file(place) as raw:
        end = raw.size()
        while end:
            start = max(0, end - (1 << 16))
            raw.seek(start)
            found = raw.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


def _splits(start: int, end: int, size: int) -> list[Split]:
    return [Split(at, min(at + size, end)) for at in range(start, end, size)]


def jobs(rows: DataFrame, slugs: list[str]) -> DataFrame:
    """Jobs (id, pipeline_slug) of the named pipelines, in order of id."""
    return rows.filter(F.col("pipeline_slug").isin(slugs)).orderBy("id")


class _Batch(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        return _splits(0, _end(self.path), self.split)

    def read(self, partition: Split) -> Iterator[tuple]:
        return _tasks(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": _end(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return _splits(start["at"], end["at"], self.split)

    def read(self, partition: Split) -> Iterator[tuple]:
        return _tasks(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the place reached is in the query's checkpoint."""


def register(spark) -> None:
    spark.dataSource.register(TaskSource)
