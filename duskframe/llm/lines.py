"""Dropping lines that many documents share.

Lines are exploded with their places, normalised and hashed to 128 bits; for each hash the distinct documents are
counted. Lines of a hash that enough documents hold go, but for those of one document, and what is left of a text
is put together by place. Texts go through one shuffle, the last; before it only hashes and keys do.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Characters that are stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: A key that holds more than one in so many of the counted pairs is hot: at most so many keys are.
HOT_PART = 10_000
#: Parts in which the lines of a hot key are met.
SALTS = 64


def split_lines(text: Column) -> Column:
    """The lines of a text, between line feeds; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(df: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """doc_id, row (hash of the text), pos, h1, h2 of all lines of `least_chars` code points or more."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    rows = rows.select("doc_id", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.char_length("key") >= least_chars)
    rows = rows.withColumn("key", F.translate("key", string.ascii_uppercase, string.ascii_lowercase))
    return rows.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def shared_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """h1, h2, n_docs, keeper (the largest doc_id) of the keys that `least_docs` documents or more hold."""
    held = lines.select("h1", "h2", "doc_id").distinct()
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= least_docs)


def drop_shared_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Replace `text` by what is left of it, and add n_lines (before) and n_dropped.

    The key of a line is the line without white space at its ends, A-Z in lower case. Keys of `least_chars` code
    points or more that `least_docs` or more documents hold lose all their lines, repeats within a text too, but in
    the document of the largest id. Rows of one id are one document; rows without an id are one document as well,
    the least. Null and empty texts have one line, which stays; a null text becomes an empty one. An empty table
    gives no rows. Columns n_lines and n_dropped of the input are replaced, other columns pass through.

    A key that a large part of all rows holds is met in SALTS parts: hot keys are at most HOT_PART by their
    definition, so they are broadcast, and the lines of each are dealt by hashes of their rows.
    """
    scratch = Scratch(df.sparkSession, "lines")
    df = df.drop("n_lines", "n_dropped")
    lines = line_keys(df, doc_id, text, least_chars)
    shared = scratch.save(shared_keys(lines, least_docs))
    total = shared.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") * HOT_PART > total
    named = shared.filter(hot).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    lines = lines.join(F.broadcast(named), (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "left")
    salt = F.when(F.col("__h1").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "row", "pos"), F.lit(SALTS)).cast("int"))
    lines = lines.select("doc_id", "row", "pos", "h1", "h2", salt.alias("salt"))
    keys = shared.select("h1", "h2", "keeper", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    gone = lines.join(keys, ["h1", "h2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = scratch.save(gone.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__gone")))
    rows = df.join(gone, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__row")), "left")
    places = lambda all_lines: F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__gone"))
    # The lines are bound once, as the only member of an array: an expression within a lambda is computed for each member.
    rest = F.transform(F.array(split_lines(F.col(text))), lambda x: F.array_join(F.transform(places(x), lambda i: x[i]), "\n"))[0]
    columns = {
        "n_lines": F.size(split_lines(F.col(text))).cast("long"),
        "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
        text: F.when(F.col("__gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(rest),
    }
    return rows.withColumns(columns).select(*df.columns, "n_lines", "n_dropped")
