"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, langid, licenses, lines, merkle, minhash, mixing, oracle, sharding, tokens, toxicity, vectors, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(key: str, n: int) -> Column:
    """CRC-32 of a key's text, modulo n. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op3_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.compare_with_edits(_table(spark, sf_dir, "documents"), characters=True)
    return rows.select("doc_id", "n_chars", "edited_sha256", winnowing.fingerprint_text(F.col("kept")).alias("fingerprint"), winnowing.fingerprint_text(F.col("edited_kept")).alias("edited_fingerprint"), "near_edited", "near_next")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _fold("doc_id", 4) == 2
    model = langid.train(docs.filter(~held_out).select("text", "lang"))
    rows = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, lang="lang_pred", score="score")
    return rows.select("doc_id", "held_out", "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    model = tokens.load(spark, vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    return tokens.count_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("doc_id", "n_tokens")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), _fold("doc_id", 5) != 0)
    rows = toxicity.score(docs.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "text"), model, name="score")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_groups(_table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    ranks = bpe.load(spark, vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = bpe.decode_documents(bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks), ranks)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    text = F.col("text")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.shard_records(docs, "doc_id", [1.0] * shards, [1.0] * (shards + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    manifest = merkle.Manifest(_table(spark, sf_dir, "documents"), claims=tampered, claimed=F.col("doc_id").isNotNull() & (_fold("doc_id", 7) == 0))
    return manifest.audit().withColumnRenamed("key", "doc_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mix": op2_source_mix,
    "op3_minhash_groups": op3_minhash_groups,
    "op4_winnowing": op4_winnowing,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_vector_groups": op8_vector_groups,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_sharding": op10_sharding,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_line_dedup": op13_line_dedup,
}
SQL: dict[str, str] = oracle.SQL
