"""The stages of corpus_pipeline on a small table, each against a plain version of what it is to keep."""

import os
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_minhash import plain_groups
from test_native import _plain_targets

from duskframe.llm import bpe, catalog, langid, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    tables = {"documents": spark.read.parquet(f"{DATA}/documents.parquet")}
    before = "documents"
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[before], DATA).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
        before = name
    rows = {k: [r.asDict() for r in v.collect()] for k, v in tables.items()}
    for name in ("toxicity", "language", "near_copies", "mix"):
        assert tables[name].columns == tables["documents"].columns

    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(tables["documents"].select("doc_id", "text"), labels, F.lit(True))
    scores = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(tables["documents"].select("doc_id", "text"), model).collect()}
    assert {r["doc_id"] for r in rows["toxicity"]} == {d for d, s in scores.items() if s < corpus_pipeline.TOXIC}

    known = langid.predict(tables["toxicity"], langid.train(tables["toxicity"].select("text", "lang"))).filter("lang_pred != 'und' and lang_score >= 0.5")
    assert {r["doc_id"] for r in rows["language"]} == {r["doc_id"] for r in known.collect()}

    groups = plain_groups([(r["doc_id"], r["text"]) for r in rows["language"]])
    assert sorted(r["doc_id"] for r in rows["near_copies"]) == sorted(d for d, c in groups.items() if d == c)

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows["near_copies"]:
        sizes[r["source"]] += size(r["text"])
        longest[r["source"]] = max(longest[r["source"]], size(r["text"]))
    for r in rows["mix"]:
        taken[r["source"]] += size(r["text"])
    targets = _plain_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in sizes)
    assert max(Counter(r["doc_id"] for r in rows["mix"]).values()) <= 3

    with open(P.path(corpus_pipeline.VOCABULARY), "rb") as f:
        plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.BytePairs.from_file(f.read()).ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in rows["mix"]}
    assert Counter(r["doc_id"] for r in rows["tokenize"]) == Counter(r["doc_id"] for r in rows["mix"])
    for r in rows["tokenize"]:
        ids = plain.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in catalog.QUERIES} == set(range(1, 14))


def test_stages_on_odd_rows(spark, docs, none, tmp_path):
    """Nulls, empty and long texts, repeated rows, rows without an id, clashing columns; no labels, no rows."""
    repeated = docs.filter("doc_id < 30").unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")).limit(12))
    odd = docs.unionByName(repeated)
    odd = odd.withColumn("text", F.when(F.col("doc_id") == 1, F.concat(F.lit("long "), F.repeat(F.lit("word another 漢字 "), 30_000))).otherwise(F.col("text")))
    odd.write.parquet(str(tmp_path / "odd"))
    spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, start in enumerate((spark.read.parquet(str(tmp_path / "odd")), none)):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            before = rows
            stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / f"{k}-{name}"))
            rows = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            if name != "tokenize":
                assert rows.columns == start.columns
            if name == "toxicity":  # no class has a label that counts: all stay
                assert rows.count() == start.count()
            if name == "language":
                assert rows.filter("text is null or text in ('', ' \n\t ')").count() == 0
            if name == "near_copies":
                assert rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0
                assert rows.filter("doc_id is null").count() == before.filter("doc_id is null").count()
        assert (rows.count() > 0) == (k == 0) and rows.columns == ["doc_id", "source", "n_tokens", "ids"]
        assert rows.filter("octet_length(ids) != 4 * n_tokens").count() == 0
