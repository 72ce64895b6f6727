"""A sink of results: files that are written by the executors and count once the driver has named them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .tasks import open_place


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its file, results that can be posted, results that can't."""

    file: str
    accepted: int
    dropped: int


class ResultSink(DataSource):
    """Format "duskframe_results". Options: path, and batch (the number of the batch, for a batch write; a stream
    has its own). Rows without a reply_subject have no one to go to: they are counted, not written.

    Each task writes a file of JSON lines; `batches/<number>.json` names the files of a batch and its counts. A
    batch that fails leaves files that no one names and tries to delete them; a batch that is written again finds
    its number taken and leaves the first one as it is.
    """

    @classmethod
    def name(cls) -> str:
        return "duskframe_results"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options["path"], int(self.options["batch"]))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"])


def _write(root: str, rows: Iterator[Row]) -> Written:
    files, place = open_place(root)
    name, accepted, dropped = f"{uuid.uuid4().hex}.jsonl", 0, 0
    with files.open_output_stream(f"{place}/parts/{name}") as out:
        for row in rows:
            if row["reply_subject"] is None:
                dropped += 1
            else:
                out.write(json.dumps(row.asDict(recursive=True), default=str).encode() + b"\n")
                accepted += 1
    return Written(name, accepted, dropped)


def _prepare(root: str) -> None:
    files, place = open_place(root)
    for folder in ("parts", "batches"):
        files.create_dir(f"{place}/{folder}", recursive=True)


def _discard(root: str, messages: list[Written | None]) -> None:
    files, place = open_place(root)
    for m in messages:
        if m is not None:
            files.delete_file(f"{place}/parts/{m.file}")


def _name(root: str, messages: list[Written | None], batch: int) -> None:
    """Make a batch count. One query has one driver, so no two name a batch at the same time."""
    files, place = open_place(root)
    target = f"{place}/batches/{batch:012d}.json"
    if files.get_file_info(target).is_file:
        _discard(root, messages)
        return
    done = [m for m in messages if m is not None]
    text = {"batch": batch, "files": [m.file for m in done if m.accepted], "accepted": sum(m.accepted for m in done), "dropped": sum(m.dropped for m in done)}
    draft = f"{place}/batches/.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(json.dumps(text).encode() + b"\n")
    files.move(draft, target)


class _BatchWriter(DataSourceWriter):
    def __init__(self, root: str, batch: int):
        self.root, self.batch = root, batch
        _prepare(root)

    def write(self, iterator: Iterator[Row]) -> Written:
        return _write(self.root, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _name(self.root, messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        _discard(self.root, messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, root: str):
        self.root = root
        _prepare(root)

    def write(self, iterator: Iterator[Row]) -> Written:
        return _write(self.root, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _name(self.root, messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _discard(self.root, messages)


def batches(spark: SparkSession, root: str) -> DataFrame:
    """batch, files, accepted, dropped of all batches that count."""
    return spark.read.schema("batch long, files array<string>, accepted long, dropped long").json(f"{root}/batches")


def results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The results of all batches that count: rows of files that a batch names."""
    named = batches(spark, root).select(F.explode("files").alias("__file"))
    rows = spark.read.schema(schema).json(f"{root}/parts").withColumn("__file", F.col("_metadata.file_name"))
    return rows.join(named, "__file", "left_semi").drop("__file")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultSink)
