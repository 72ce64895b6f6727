"""Tables that several writers change: rows in buckets by a key, and a version that names the files of each bucket.

A change reads one version, writes the buckets it touches anew beside the old ones, and puts the next version in
place, which succeeds for one writer only. Who comes too late tries again: where no bucket of theirs was touched,
with the newest version as it is, else by doing the change again. Readers hold on to a version; its files
stay until `vacuum`.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .snapshots import _fs

BUCKET = "__bucket"


class Conflict(Exception):
    """Another writer has changed the same buckets, again and again."""


class Version:
    """One state of a table: its number, and the folder of each bucket that has rows."""

    def __init__(self, table: VersionedTable, number: int, text: dict):
        self.table, self.number, self.parts = table, number, {int(b): path for b, path in text["parts"].items()}
        self.schema, self.key, self.buckets = T.StructType.fromJson(text["schema"]), text["key"], text["buckets"]

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; others are not even listed. __bucket is the bucket of each row."""
        wanted = self.parts if buckets is None else [b for b in set(buckets) if b in self.parts]
        spark = self.table.spark
        rows = spark.read.schema(self.schema).parquet(*[f"{self.table.root}/data/{self.parts[b]}" for b in wanted]) if wanted else spark.createDataFrame([], self.schema)
        return rows.withColumn(BUCKET, self.bucket(*[F.col(c) for c in self.key]))

    def bucket(self, *values: Column) -> Column:
        """The bucket of key values."""
        return F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")

    def touched(self, changes: DataFrame, by: Sequence[str] | None = None) -> list[int]:
        """Buckets of the rows that `changes` names: by the key or, if it has other columns (`by`), by looking for
        them, which reads these columns alone. At most as many as the table has."""
        if by is None:
            found = changes.select(self.bucket(*[F.col(c).cast(self.schema[c].dataType) for c in self.key]).alias(BUCKET))
        else:
            found = self.read().select(BUCKET, *by).join(changes.select(*by), list(by), "left_semi").select(BUCKET)
        return sorted(r[0] for r in found.distinct().collect())


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, df: DataFrame, root: str, key: Sequence[str], buckets: int = 64) -> VersionedTable:
        """A new table of the rows of `df`, dealt by `key`; fails where there is one."""
        table = cls(df.sparkSession, root)
        empty = {"schema": df.schema.jsonValue(), "key": list(key), "buckets": buckets, "parts": {}}
        before = Version(table, -1, empty)
        if not table._put(0, empty | {"parts": table._write(df, before)}):
            raise FileExistsError(root)
        return table

    def _numbers(self) -> list[int]:
        place, fs = _fs(self.spark, f"{self.root}/versions")
        if not fs.exists(place):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(place) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version, the newest if no number is given."""
        number = max(self._numbers()) if number is None else number
        text = self.spark.read.text(f"{self.root}/versions/{number:012d}.json", wholetext=True).first()[0]
        return Version(self, number, json.loads(text))

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        return self.version().read().drop(BUCKET)

    def _write(self, rows: DataFrame, base: Version) -> dict[int, str]:
        """Write rows into new folders of their buckets, which no version names yet; the folder of each bucket."""
        name = uuid.uuid4().hex
        rows = rows.select([f.name for f in base.schema]).withColumn(BUCKET, base.bucket(*[F.col(c) for c in base.key]))
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{name}")
        place, fs = _fs(self.spark, f"{self.root}/data/{name}")
        folders = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
        return {int(f.split("=")[1]): f"{name}/{f}" for f in folders}

    def _put(self, number: int, text: dict) -> bool:
        """Put a version in place, if there is none of its number: a whole file, by one step that fails if the name is taken."""
        place, fs = _fs(self.spark, f"{self.root}/versions/{number:012d}.json")
        draft, _ = _fs(self.spark, f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(text).encode())
        out.close()
        try:
            if fs.getScheme() == "file":  # renaming replaces files here, a second link to a file never does
                os.link(draft.toUri().getPath(), place.toUri().getPath())
            else:
                jvm = self.spark._jvm
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, none)
        except FileExistsError:
            return False
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        finally:
            fs.delete(draft, False)
        return True

    def commit(self, base: Version, rows: DataFrame, touched: Iterable[int]) -> Version | None:
        """Replace the touched buckets by `rows`, which must lie in them. None if they were changed since `base`."""
        touched, new, seen = set(touched), self._write(rows, base), base
        if not set(new) <= touched:
            raise ValueError("rows outside the touched buckets")
        while True:
            parts = {b: path for b, path in seen.parts.items() if b not in touched} | new
            number = seen.number + 1
            if self._put(number, {"schema": base.schema.jsonValue(), "key": base.key, "buckets": base.buckets, "parts": parts}):
                return self.version(number)
            seen = self.version()
            if any(seen.parts.get(b) != base.parts.get(b) for b in touched):
                return None

    def change(self, work: Callable[[Version], tuple[DataFrame, Iterable[int], object] | None], attempts: int = 50):
        """Do `work` on the newest version until its commit succeeds. It gives the new rows of the touched buckets,
        the buckets, and what to return; None if nothing is to be done."""
        for _ in range(attempts):
            base = self.version()
            done = work(base)
            if done is None:
                return None
            rows, touched, result = done
            if self.commit(base, rows, touched) is not None:
                return result
        raise Conflict(self.root)

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the newest `keep`, and the folders that no kept version names; the number of folders.
        For a time when no one writes or reads an older version."""
        numbers = self._numbers()
        named = {path for n in numbers[-keep:] for path in self.version(n).parts.values()}
        gone = 0
        for n in numbers[:-keep]:
            place, fs = _fs(self.spark, f"{self.root}/versions/{n:012d}.json")
            fs.delete(place, False)
        data, fs = _fs(self.spark, f"{self.root}/data")
        for write in fs.listStatus(data) if fs.exists(data) else []:
            folders = [f.getPath() for f in fs.listStatus(write.getPath()) if f.isDirectory()]
            old = [f for f in folders if f"{write.getPath().getName()}/{f.getName()}" not in named]
            gone += len(old)
            for f in [write.getPath()] if len(old) == len(folders) else old:
                fs.delete(f, True)
        return gone
