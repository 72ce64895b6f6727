"""Photos on a file system: listing, timestamps from names and EXIF, sizes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times
from ..schemas import IMAGE_EXTENSIONS

_TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
# EXIF tags.
_EXIF_POINTER, _DATETIME, _ORIGINAL, _DIGITIZED = 0x8769, 0x0132, 0x9003, 0x9004


def _segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, place, body) of the segments of a JPEG file up to its picture."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield marker, at, data[at + 4 : at + 2 + size]
        if marker == 0xDA:
            return
        at += 2 + size


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG file."""
    for marker, _, body in _segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack(">HH", body[1:5])
            return width, height
    return None


def exif_time(data: bytes) -> datetime | None:
    """The time that a photo was taken, by its EXIF data; offsets are left out."""
    for marker, _, body in _segments(data):
        if marker == 0xE1 and body[:6] == b"Exif\x00\x00":
            tags = _tags(body[6:])
            text = next((tags[t] for t in (_ORIGINAL, _DIGITIZED, _DATETIME) if t in tags), "")
            try:
                return datetime.strptime(text[:19], "%Y:%m:%d %H:%M:%S")
            except ValueError:
                return None
    return None


def _tags(tiff: bytes) -> dict[int, str]:
    """Text tags of the first directory and the one that it points to."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    found: dict[int, str] = {}
    if order is None or len(tiff) < 8:
        return found
    todo = [struct.unpack(order + "I", tiff[4:8])[0]]
    for at in todo:
        if at + 2 > len(tiff):
            continue
        for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, count, value = struct.unpack(order + "HHII", entry)
            if tag == _EXIF_POINTER and len(todo) < 2:
                todo.append(value)
            elif kind == 2:
                raw = entry[8 : 8 + count] if count * _TYPE_SIZE[kind] <= 4 else tiff[value : value + count]
                found[tag] = raw.rstrip(b"\x00").decode("ascii", "replace")
    return found


@F.pandas_udf(T.TimestampType())
def _exif_times(content: pd.Series) -> pd.Series:
    return pd.to_datetime(content.map(lambda x: None if x is None else exif_time(bytes(x))))


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def _sizes(content: pd.Series) -> pd.DataFrame:
    sizes = [(None if x is None else jpeg_size(bytes(x))) or (None, None) for x in content]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")


#: Bytes of a file that go to Python first: those of its header. Where the frame comes later, the file follows.
HEADER = 256 << 10


def _shape(head: Column, content: Column, filesize: Column) -> Column:
    """Width and height of a photo, from its first bytes or, if these do not have them, from all."""
    first = _sizes(head)
    rest = _sizes(F.when(first["width"].isNull() & (filesize > HEADER), content))
    return F.struct(F.coalesce(first["width"], rest["width"]).alias("width"), F.coalesce(first["height"], rest["height"]).alias("height"))


def named_images(spark: SparkSession, base: str, names: DataFrame, name: str = "path") -> DataFrame:
    """The files under a folder whose path relative to it is in a list of names."""
    wanted = names.select(F.col(name).alias("__name")).distinct()
    rows = list_images(spark, base)
    return rows.join(wanted, relative_path(F.col("path"), base) == F.col("__name"), "left_semi")


def list_images(spark: SparkSession, base: str) -> DataFrame:
    """path, filesize and modificationTime of the photos under a folder; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return files.filter(F.col("path").rlike(IMAGE_EXTENSIONS)).select("path", F.col("length").alias("filesize"), "modificationTime")


def find_images(spark: SparkSession, base: str, check_exif: bool = True, skip_missing_timestamps: bool = True, absolute_paths: bool = True) -> DataFrame:
    """Scan records: path, timestamp, shape, filesize.

    The time is that in the name; only files without one are read for their EXIF time (the two kinds are
    separate branches, since a Python function is not spared by a condition). Sizes need the bytes as well.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).filter(F.col("path").rlike(IMAGE_EXTENSIONS))
    rows = files.select("path", F.col("length").alias("filesize"), "content", F.substring("content", 1, HEADER).alias("head"), times.timestamp_in_name(F.col("path")).alias("timestamp"))
    shape = _shape(F.col("head"), F.col("content"), F.col("filesize"))
    named = rows.filter("timestamp is not null").withColumn("shape", shape).drop("content", "head")
    other = rows.filter("timestamp is null").withColumn("shape", shape).drop("content")
    taken = _exif_times("head").cast("timestamp_ntz") if check_exif else F.lit(None).cast("timestamp_ntz")
    out = named.unionByName(other.withColumn("timestamp", taken).drop("head"))
    if skip_missing_timestamps:
        out = out.filter("timestamp is not null")
    if not absolute_paths:
        out = out.withColumn("path", relative_path(F.col("path"), base))
    return out.select("path", "timestamp", "shape", "filesize")


def relative_path(path: Column, base: str) -> Column:
    return F.regexp_replace(path, "^.*" + base.rstrip("/").replace("\\", "\\\\") + "/", "")


def timestamped_folders(paths: DataFrame) -> DataFrame:
    """folder and day of the folders on the paths whose name is a day, in order of day."""
    part = paths.select(F.explode(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))).alias("name"))
    return part.distinct().withColumn("day", times.folder_day(F.col("name"))).filter("day is not null").orderBy("day", "name")
