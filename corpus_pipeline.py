"""From raw documents to a tokenised training mix, in five stages.

All stages take whole texts of any length, pass other columns through under their names, and give no rows for an
empty table. What each makes of nulls, empty texts, ties and repeated rows is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskframe.llm import bpe, langid, minhash, mixing, toxicity
from duskframe.llm.scratch import Scratch

#: A document is toxic at this score or more.
TOXIC = 0.5
#: A document's language is known at this probability or more.
CERTAIN = 0.5
#: Rank file of the vocabulary.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC. The model learns from all labelled documents.

    Null and empty texts score as texts without evidence; repeated rows are scored each. Labels without an id or a
    value teach nothing, and nor do labels of other documents. Where a class has no labelled text (as in an empty
    table of labels) there is nothing to tell toxic texts by, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels, F.lit(True))
    return toxicity.score(docs, model, name="__score").filter(F.col("__score") < TOXIC).drop("__score")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; texts without a letter, or of uncertain language, go.

    So do null and empty texts, and all documents of a corpus that names no language. Equally likely languages: the
    one that sorts first. Repeated rows are judged each.
    """
    model = langid.train(docs.select("text", "lang"))
    rows = langid.predict(docs, model, lang="__lang", score="__score")
    return rows.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= CERTAIN)).drop("__lang", "__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every group of near copies.

    Texts without words (null, empty, blank) are near nothing and stay. Of rows that repeat an id one stays; rows
    without an id can't be told apart by one and all stay.
    """
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, three times at most.

    A null source is a source, the last in order. Null, empty and blank texts have no size and are not taken. Rows
    that share an id, or have none, are taken one by one, in an order that their texts decide, so reruns agree.
    """
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids (little-endian 32-bit) of every row, in a round trip: a row whose ids
    do not decode to its text fails the stage. Null and empty texts have no ids; repeated rows are encoded each."""
    ranks = bpe.load(spark, public_tokenizers.path(VOCABULARY))
    rows = bpe.decode_documents(bpe.encode_documents(docs.select("doc_id", "source", "text"), ranks), ranks)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    ids = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text")))
    return rows.select("doc_id", "source", "n_tokens", ids.alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("tokenize", tokenize),
]

#: Learnt models and hashed sketches can't be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
