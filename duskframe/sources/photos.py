"""Opening photos: decoded pixels of those that were pulled from a queue, errors for the others, crops of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queues
from ..plans import maintenance
from ..plans.versions import VersionedTable
from .images import named_images, relative_path


def open_photos(spark: SparkSession, base: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, errors) of `wanted` (id, path under `base`): id, path, width, height, channels, pixels of those that can
    be decoded, and id, path, error of those that are missing or can't be. Pixels are rows from the top, without gaps.

    `wanted` is what was pulled, a few rows; only these files are read. A null path is a missing file.
    """
    there = named_images(spark, base, wanted).select("path", relative_path(F.col("path"), base).alias("name"))
    paths = [r["path"] for r in there.select("path").collect()]  # no more than were pulled
    if paths:
        found = spark.read.format("image").load(paths).select("image.*")
    else:
        found = spark.createDataFrame([], "origin string, height int, width int, nChannels int, mode int, data binary")
    found = found.select(relative_path(F.col("origin"), base).alias("name"), "width", "height", F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))
    rows = wanted.select("id", "path").join(found, F.col("path") == F.col("name"), "left")
    readable = F.coalesce(F.col("height") > 0, F.lit(False))
    word = F.when(F.col("name").isNull(), "missing").otherwise("unreadable")
    return rows.filter(readable).drop("name"), rows.filter(~readable).select("id", "path", word.alias("error"))


def pull_photos(table: VersionedTable, base: str, n: int) -> tuple[DataFrame, DataFrame] | None:
    """Pull the first n waiting photos out of a stored queue and open them, as `open_photos`; None if none waits. A photo
    that can't be opened no longer waits either: it is in the errors, for whoever decides whether to queue it again."""
    taken = maintenance.pull(table, queues.QUEUES["source_images"], n)
    return None if taken is None else open_photos(table.spark, base, taken)


def crop_rows(pixels: Column, width: Column, height: Column, channels: Column, box: Column) -> Column:
    """The part of a photo within a box: struct(width, height, channels, rows), rows as an array of bytes. Corners are
    cut to whole numbers and to the photo's edges; null where nothing is left, or the box is null."""
    x1, x2 = (F.least(F.greatest(F.get(box, k).cast("int"), F.lit(0)), width) for k in (0, 2))
    y1, y2 = (F.least(F.greatest(F.get(box, k).cast("int"), F.lit(0)), height) for k in (1, 3))
    # Bound once: what a lambda says of others is computed for each of its members.
    part = F.struct(pixels.alias("p"), (width * channels).alias("line"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), channels.alias("c"))

    def cut(b: Column) -> Column:
        lines = F.transform(F.sequence(b["y1"], b["y2"] - 1), lambda y: F.substr(b["p"], y * b["line"] + b["x1"] * b["c"] + 1, (b["x2"] - b["x1"]) * b["c"]))
        whole = F.struct((b["x2"] - b["x1"]).alias("width"), (b["y2"] - b["y1"]).alias("height"), b["c"].alias("channels"), lines.alias("rows"))
        return F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), whole)

    return F.get(F.transform(F.array(part), cut), 0)


def crops(photos: DataFrame, detections: DataFrame) -> DataFrame:
    """id, image_id and crop (`crop_rows`) of the detections (id, image_id, bbox) of opened photos. Boxes come to their
    photo as one list, so pixels are moved once for a photo, not for each box; boxes without extent have a null crop."""
    boxes = detections.groupBy(F.col("image_id").alias("id")).agg(F.collect_list(F.struct(F.col("id").alias("id"), F.col("bbox").cast("array<double>").alias("bbox"))).alias("boxes"))
    rows = photos.join(boxes, "id")
    cut = F.transform("boxes", lambda b: F.struct(b["id"].alias("id"), crop_rows(F.col("pixels"), F.col("width"), F.col("height"), F.col("channels"), b["bbox"]).alias("crop")))
    return rows.select(F.col("id").alias("image_id"), F.explode(cut).alias("x")).select("x.id", "image_id", "x.crop")
