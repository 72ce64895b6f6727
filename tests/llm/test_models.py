"""Language ID and toxicity: accuracy on rows that were held out."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from duskframe.llm import langid, perfect, textbytes, toxicity
from duskframe.llm.scratch import Scratch

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "fr": "eau oi ou ion ent que le de la é è aux tre ment ai".split(), "de": "sch ei en er ch ung ge ä ü te st be ie ver".split()}
RUDE = {"en": ["idiot", "scum"], "fr": ["veju", "vequ"], "de": ["lowei", "lostra"]}


def _doc(rng, lang, toxic):
    word = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(rng.randint(40, 120))]
    if toxic:
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE[lang]) + ("" if lang == "en" else word()))
    return " ".join(words) + "."


def _tables(spark, n=900):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang, toxic = rng.choice(list(SYLLABLES)), int(rng.random() < 0.25)
        rows.append((i, _doc(rng, lang, toxic), lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_language_held_out(spark):
    rows = _tables(spark, 300)
    model = langid.train(rows.filter("doc_id % 4 != 2").select("text", "lang"))
    out = langid.predict(rows.filter("doc_id % 4 = 2"), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in out)


def test_language_without_letters(spark, docs, none):
    model = langid.train(docs.select("text", "lang"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "é"), (5, "a" * 300_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["lang_score"] == 0
    assert rows[4]["lang_pred"] in ("en", "fr") and rows[5]["lang_pred"] in ("en", "fr")
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(none.select("text", "lang"))).collect()} == {"und"}


def test_language_counts_are_exact():
    texts = ["Ab é", "", "漢字", "x", "漢字kana" * 9]
    for size in (3, 20, 1 << 18):
        seen = [0] * len(texts)
        for i, _, data, at, lead in textbytes.blocks(pa.array(texts), size, lead=2):
            for buckets, of in langid.gram_buckets(data, at, lead):
                for t in of:
                    seen[i + t] += 1
        assert seen == [4 + 3 + 2, 0, 2 + 1, 1, 54 + 53 + 52]


def _bucket(gram):
    total = len(gram)
    for c in gram:
        total = (total * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    total ^= total >> 29
    return (total * 0xBF58476D1CE4E5B9) % 2**64 >> 48


def test_language_against_a_plain_version(spark):
    """Multinomial naive Bayes with dictionaries."""
    rows = [tuple(r) for r in _tables(spark, 120).select("doc_id", "text", "lang").collect()] + [(900, None, "en"), (901, "", "en"), (902, "text", None)]
    grams = lambda t: [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    lower = lambda t: "".join(c.lower() if len(c.lower()) == 1 and ord(c) < 0x250 else c for c in t)
    counts, priors = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        if text is not None and lang is not None:
            priors[lang] += 1
            counts[lang].update(_bucket(g) for g in grams(lower(text)))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang"))
    for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == "und" and r["lang_score"] == 0
            continue
        total = {}
        for lang in sorted(priors):
            whole = sum(counts[lang].values()) + langid.ALPHA * langid.BUCKETS
            total[lang] = math.log(priors[lang] / sum(priors.values())) + sum(math.log((counts[lang][_bucket(g)] + langid.ALPHA) / whole) for g in grams(lower(r["text"])))
        best = max(total, key=total.get)
        assert r["lang_pred"] == best
        assert abs(r["lang_score"] - 1 / sum(math.exp(x - total[best]) for x in total.values())) < 1e-3


def _plain_kneser_ney(rows, most=10**9):
    """P(character | three before it) of both classes, by dictionaries of strings; rows: (text, toxic or None).
    `most`: grams that are kept of each order."""
    fold = lambda t: "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalnum() else " " for c in t)
    padded = lambda t: "   " + fold(t)
    grams = lambda t: [padded(t)[i : i + 4] for i in range(len(fold(t)))]
    every = {g for t, _ in rows for g in grams(t)}
    levels = {4: [Counter(g for t, c in rows if c == k for g in set(grams(t))) for k in (0, 1)]}
    types = every
    for m in (3, 2, 1):
        levels[m] = Counter(g[1:] for g in types)
        types = set(levels[m])

    def number(gram):
        n = 0
        for c in gram:
            n = n << 16 | ord(c)
        return n - 2**64 if n >= 2**63 else n

    n0, n1 = (sum(c.values()) for c in levels[4])
    evidence = {4: {g: abs(levels[4][1][g] * n0 - levels[4][0][g] * n1) for g in levels[4][0] | levels[4][1]}}
    for m in (3, 2, 1):
        evidence[m] = Counter(levels[m])
        for upper in levels[4] if m == 3 else [levels[m + 1]]:
            for g, n in upper.items():
                evidence[m][g[:-1]] += n
    kept = {m: set(sorted(e, key=lambda g: (-e[g], number(g)))[:most]) for m, e in evidence.items()}

    def cut(counts):
        d = toxicity.discounts([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)])
        return {g: d[min(n, 3) - 1] if g in kept[len(g)] else n for g, n in counts.items()}

    def contexts(counts, d):
        total, taken = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            taken[g[:-1]] += d[g]
        return total, taken

    made = {m: (counts, d := cut(counts), *contexts(counts, d)) for m in (1, 2, 3) for counts in [levels[m]]}
    made |= {(4, k): (counts, d := cut(counts), *contexts(counts, d)) for k, counts in enumerate(levels[4])}

    def p(gram, key):
        counts, d, total, taken = made[key]
        m = len(gram)
        lower = 1 / (len(levels[1]) + 1) if m == 1 else p(gram[1:], m - 1)
        u = gram[:-1] if not gram[:-1] or gram[:-1] in kept[m - 1] else None
        return (counts.get(gram, 0) - d.get(gram, 0) + taken[u] * lower) / total[u] if total[u] else lower

    return lambda text: sum(math.log(p(g, (4, 1)) / p(g, (4, 0))) for g in grams(text)) / (len(fold(text)) + toxicity.SHORT)


def test_toxicity_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 500)
    rows = [(r["doc_id"], r["text"], r["toxic"]) for r in _tables(spark, 60).collect()]
    rows += [(1000 + i, t, c) for i, (t, c) in enumerate([("Élan  — 漢字 x9", 1), ("zzzz zzzz", None), ("", 0), (_doc(random.Random(1), "en", 1) * 3, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.ToxicityModel(toxicity.gram_counts(df.select("text", F.coalesce("toxic", F.lit(-1)).alias("toxic"))), Scratch(spark, "test"))
    plain = _plain_kneser_ney([(t, c) for _, t, c in rows])
    asked = rows + [(2000, "unseen Ünseen qqq 漢 x", None)]
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 150)
    pruned = toxicity.ToxicityModel(toxicity.gram_counts(df.select("text", F.coalesce("toxic", F.lit(-1)).alias("toxic"))), Scratch(spark, "test"))
    assert len(pruned.tables[4].values) == 151
    plain_pruned = _plain_kneser_ney([(t, c) for _, t, c in rows], 150)
    got = {r["doc_id"]: r["difference"] for r in toxicity.differences(df, pruned).collect()}
    assert all(abs(got[d] - plain_pruned(t)) < 1e-6 for d, t, _ in rows)
    for size in (64, 1 << 18):
        out = {}
        for i, j, data, at, lead in textbytes.blocks(pa.array([t for _, t, _ in asked]), size, lead=3):
            total, n = model.compare(data, at, lead)
            for k in range(i, j):
                a, b = out.get(k, (0.0, 0))
                out[k] = a + total[k - i], b + n[k - i]
        for k, (_, t, _) in enumerate(asked):
            assert abs(out[k][0] / (out[k][1] + toxicity.SHORT) - plain(t)) < 1e-6, t
    got = {r["doc_id"]: r["difference"] for r in toxicity.differences(df, model).collect()}
    assert all(abs(got[d] - plain(t)) < 1e-6 for d, t, _ in rows)


def test_toxicity_beyond_the_bound_of_grams(spark, monkeypatch):
    """With room for a tenth of the grams of each order clean documents still pass and most toxic ones do not."""
    rows = _tables(spark)
    found, figures = [], []
    for most in (1 << 21, None):
        if most is None:
            most = found[0] // 10
            assert most < found[0]
        monkeypatch.setattr(toxicity, "MAX_GRAMS", most)
        model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.col("doc_id") % 5 != 0)
        found.append(len(model.tables[4].values) - 1)
        out = toxicity.score(rows.filter("doc_id % 5 = 0"), model).collect()
        hit, toxic = np.array([r["toxic_score"] >= 0.5 for r in out]), np.array([r["toxic"] == 1 for r in out])
        assert all(0 <= r["toxic_score"] <= 1 for r in out)
        figures.append((hit[toxic].mean(), hit[~toxic].mean()))
    assert found[1] == most
    assert figures[1][0] > 0.6 and figures[1][1] < 0.05


def test_toxicity_scores_do_not_depend_on_the_bound_of_grams(spark, monkeypatch):
    """Grams beyond the bound are looked up by joins, of texts that were learnt from and of others, rows that repeat too."""
    rows = _tables(spark, 300)
    asked = rows.select("doc_id", "text").unionByName(spark.createDataFrame([(2000, "unseen Ünseen qqq 漢 x"), (2000, "unseen Ünseen qqq 漢 x"), (None, None), (2001, "")], "doc_id long, text string"))
    got = []
    for most in (1 << 21, 500, 40):
        monkeypatch.setattr(toxicity, "MAX_GRAMS", most)
        model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.lit(True))
        out = toxicity.score(asked, model)
        assert out.columns == ["doc_id", "text", "toxic_score"]
        got.append(sorted((r["doc_id"] or -1, r["toxic_score"]) for r in out.collect()))
    for other in got[1:]:
        assert [d for d, _ in other] == [d for d, _ in got[0]]
        assert max(abs(a - b) for (_, a), (_, b) in zip(got[0], other)) < 1e-4


def test_toxicity_held_out(spark):
    rows = _tables(spark)
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.col("doc_id") % 5 != 0)
    out = toxicity.score(rows.filter("doc_id % 5 = 0"), model).collect()
    found = np.array([r["toxic_score"] >= 0.5 for r in out])
    toxic = np.array([r["toxic"] == 1 for r in out])
    assert found[toxic].mean() > 0.8 and found[~toxic].mean() < 0.05


def test_toxicity_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), labels, F.lit(True))
    assert model is None and {r["toxic_score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    rows = _tables(spark, 200)
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")), F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "é" * 100_000)], "doc_id long, text string")
    assert all(0 <= r["toxic_score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(none, model).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    table = perfect.PerfectHash(keys)
    assert sorted(table.find(keys)) == list(range(len(keys)))
    assert (table.find(rng.integers(2**63, 2**64 - 1, 500, dtype=np.uint64)) == -1).all()
    assert (perfect.PerfectHash(keys[:0]).find(keys[:3]) == -1).all()
