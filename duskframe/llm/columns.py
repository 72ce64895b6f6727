"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, for a regular expression: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(*parts: Column) -> Column:
    """A double in (0, 1], fixed by the values of `parts`."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(1)) * F.lit(2.0**-53)


#: Rows of an Arrow batch: texts are long, and a batch is held whole on both sides of a Python worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS, where they are more."""
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
