"""Names of taxa, and category maps of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors

TAXON = T.StructType([T.StructField("taxonID", T.LongType()), T.StructField("canonicalName", T.StringType()), T.StructField("taxonRank", T.StringType())])


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    """A Darwin Core table, tab separated; the first row of an id counts."""
    rows = spark.read.schema(TAXON).option("sep", "\t").option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    first = rows.select("*", place.alias("place")).groupBy("taxonID").agg(F.min_by(F.struct("canonicalName", "taxonRank"), "place").alias("first"))
    return first.select("taxonID", "first.canonicalName", "first.taxonRank")


def name_labels(rows: DataFrame, taxa: DataFrame, label: str = "label", id_column: str = "taxonID", name_column: str = "canonicalName") -> DataFrame:
    """Add taxon_name: of labels that are numbers the taxon's name if it is known, else the label itself."""
    known = taxa.select(F.col(id_column).cast("long").alias("__id"), F.col(name_column).alias("__name"))
    return rows.join(known, F.col(label).try_cast("long") == F.col("__id"), "left").withColumn("taxon_name", F.coalesce("__name", label)).drop("__id", "__name")


def read_category_map(text: Column) -> Column:
    """index -> label of a JSON object of label -> index."""
    return vectors.category_map(F.from_json(text, "map<string,int>"))


def read_track_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON object of sequence -> frames."""
    from ..schemas import TRACK_FILE_ROW

    text = spark.read.option("wholetext", True).text(path)
    frames = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(TRACK_FILE_ROW)))
    return text.select(F.explode(frames).alias("key", "frames")).select("key", F.inline("frames"))
