"""Merkle manifests, fill-in-the-middle and line dedup, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskframe.llm import catalog, fim, lines, merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _up(nodes, fanout):
    return [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]


def _path(nodes, i, fanout):
    path = []
    while len(nodes) > 1:
        s = i // fanout * fanout
        path.append((nodes[s:i], nodes[i + 1 : s + fanout]))
        nodes, i = _up(nodes, fanout), i // fanout
    return path, nodes[0]


def _plain_manifest(rows, fanout=2):
    """(doc_id, leaf, path, subroot, root) of every row; rows are (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        groups[lang].append((d is not None, d or 0, H(*map(_field, (d, source, lang, n, text))), d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
    found = {g: [_path([x[2] for x in groups[g]], i, fanout) for i in range(len(groups[g]))] for g in order}
    tops = [found[g][0][1] for g in order]
    out = []
    for k, g in enumerate(order):
        rest, root = _path(tops, k, fanout)
        out += [(x[3], x[2], path + rest, top, root) for x, (path, top) in zip(groups[g], found[g])]
    return out


def _sorted(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 9), (4, 4)])
def test_manifest(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i * 3 if i % 17 else None, rng.choice([None, "", "é\x00漢", f"t{i}"]), lang, rng.choice([None, "s"]), rng.choice([None, i])) for i in range(90) for lang in [rng.choice(["en", "en", "en", "fr", "élan", None])]]
    rows += [(900, "x", "once", None, 1), *[(None, "same", "en", "s", 4)] * 7, *[(3, "same", "fr", "s", 4)] * 3]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "at", "n", "digest", "claim", "block", "key", "root", "path")})
    manifest = merkle.Manifest(df.repartition(5), fanout=fanout, claims={"n_chars": F.col("n_chars") + 1}, claimed=F.col("doc_id") % 2 == 0)
    want = _plain_manifest(rows, fanout)
    got = manifest.proofs().collect()
    assert _sorted((r["key"], r["leaf"], [(x["left"], x["right"]) for x in r["path"]], r["subroot"], r["root"]) for r in got) == _sorted((d, leaf, [("".join(a), "".join(b)) for a, b in path], top, root) for d, leaf, path, top, root in want)
    assert all(merkle.fold(r["leaf"], r["path"]) == r["root"] for r in got)
    claim = defaultdict(set)
    for d, text, lang, source, n in rows:
        leaf = H(*map(_field, (d, source, lang, n, text)))
        claim[leaf].add(H(*map(_field, (d, source, lang, n + 1, text))) if d is not None and d % 2 == 0 and n is not None else leaf)
    plain = []
    for d, leaf, path, top, root in want:
        (node,) = claim[leaf]
        for a, b in path:
            node = H(*a, node, *b)
        plain.append((d, leaf, top, root, H(*[x for a, b in path for x in [*a, *b]]), node, node == root))
    audit = manifest.audit().collect()
    assert _sorted(map(tuple, audit)) == _sorted(plain)
    assert {r["verified"] for r in audit} == {True, False}
    sizes = {r["group"]: (r["n"], r["subroot"]) for r in manifest.subroots().collect()}
    assert sum(n for n, _ in sizes.values()) == len(rows) and {s for _, s in sizes.values()} == {x[3] for x in want} and None in sizes


def test_manifest_of_one_and_none(spark, none):
    (row,) = merkle.Manifest(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).audit().collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == H("1:1", "-", "-", "-", "-") and row["proof_sha256"] == H() and row["verified"]
    manifest = merkle.Manifest(none)
    assert manifest.audit().count() == manifest.proofs().count() == manifest.subroots().count() == 0
    with pytest.raises(ValueError):
        merkle.Manifest(none, fanout=1)


def test_manifest_query(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    data = {r[0]: r for r in rows}
    got = {r["doc_id"]: r for r in catalog.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    for d, leaf, path, top, root in _plain_manifest(rows):
        _, text, lang, source, n = data[d]
        node = H(*map(_field, (d, source, lang, n + 1, text))) if zlib.crc32(str(d).encode()) % 7 == 0 and n is not None else leaf
        for a, b in path:
            node = H(*a, node, *b)
        r = got[d]
        assert (r["leaf"], r["subroot"], r["root"], r["folded_root"], r["verified"]) == (leaf, top, root, node, node == root)
        assert r["proof_sha256"] == H(*[x for a, b in path for x in [*a, *b]])


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _plain_fim(doc_id, text, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_bits():
    rng = np.random.default_rng(3)
    for size in (1, 7, 8, 511, 512, 513, 40_000):
        for share in (0.001, 0.3, 1.0):
            bits = rng.random(size) < share
            vector = fim.BitVector(np.packbits(bits))
            at = np.unique(np.r_[0, size, rng.integers(0, size + 1, 300)])
            assert (vector.rank(at) == np.r_[0, np.cumsum(bits)][at]).all()
            places = np.flatnonzero(bits)
            if len(places):
                assert (vector.select(np.arange(1, len(places) + 1)) == places).all()


def test_token_ends_in_chunks(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab  \n漢") for _ in range(rng.randint(0, 90))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    want = [int(o) + len(t[: m.end()].encode()) - 1 for t, o in zip(texts, at) for m in TOKEN.finditer(t)]
    for chunk in (8, 64, 1 << 20):
        monkeypatch.setattr(fim, "CHUNK", chunk)
        ends = fim.token_ends(np.frombuffer(b"".join(raw), np.uint8), at)
        assert ends.before[-1] == len(want) and ends.select(np.arange(1, len(want) + 1)).tolist() == want


def test_fill_in_middle(spark, docs, corpus):
    odd = ["<P>", "a <S> b", "<", "<<", "<P", "a <P b <S c <M", " < < < ", "<S\x0b>", "\x1c\x85 \xa0", "   ", "\n", "é 漢\t字 ", "x " * 5000, "😀 😀  "]
    rows = [(c[0], c[1]) for c in corpus] + [(10_000 + 20 * i + j, t) for i, t in enumerate(odd) for j in range(12)] + [(None, "a b c"), (None, None), (5, "r r r"), (5, "r r r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "form", "first", "output", "other", "cut")})
    out = fim.transform(df, rate=90, spm_rate=50)
    assert sorted(out.columns) == sorted([*df.columns, "prefix_chars", "middle_chars"])
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=key) == sorted(((d, *_plain_fim(d, t, 90, 50), t or "") for d, t in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_empty(spark, none, docs, tmp_path):
    assert fim.transform(none).count() == 0
    assert fim.cut_texts(spark.createDataFrame([], "t string").toArrow().column(0).combine_chunks(), np.zeros(0, int), np.zeros(0, int)).to_pylist() == []
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in catalog.op12_fill_in_middle(spark, str(tmp_path)).join(docs.select("doc_id", "text"), "doc_id").collect():
        n, form, p, m, output = _plain_fim(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, sha(output), sha(r["text"] or ""))


def _plain_lines(rows, least_chars=20, least_docs=3):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blanks).translate(lower)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    keeper = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def test_lines(spark, monkeypatch):
    rng = random.Random(5)
    hot = "This line stands in very many documents"
    pool = [hot, hot.upper(), f"\t {hot} \r", "x" * 19, "y" * 20, "É" + "é" * 19, "é" * 20, "漢" * 20, "İstanbul is a long enough line", "i̇stanbul is a long enough line", "", "   ", "short", *[f"a line of some length {i}" for i in range(30)], "a passage with\x1cother blanks\xa0 "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    rows += [(200 + i, hot + "\n" + f"own {i}") for i in range(60)] + [(None, hot + "\nnull id"), (None, hot + "\nnull id"), (None, pool[14]), (7, rows[7][1]), (7, hot), (7, hot), (500, None), (501, ""), (502, "\n"), (503, "\n" * 3000 + hot + "\n" + "y" * 20), (504, "z" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "pos", "h1", "h2", "salt", "keeper", "n_docs", "key", "line", "n_lines")})
    for part in (10_000, 4, 0):  # keys are hot from one 10,000th, from a quarter, never
        monkeypatch.setattr(lines, "HOT_PART", part)
        out = lines.drop_shared_lines(df.repartition(6))
        assert out.columns == [*[c for c in df.columns if c != "n_lines"], "n_lines", "n_dropped"]
        key = lambda x: tuple(map(str, x))
        got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=key)
        assert got == sorted(_plain_lines(rows), key=key)
    assert sum(x[3] for x in got) > 200


def test_lines_empty(none):
    assert lines.drop_shared_lines(none).count() == 0


def test_lines_without_shared_ones(spark):
    rows = [(1, "alone"), (2, None)]
    assert sorted(map(tuple, lines.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, "alone", 1, 0), (2, "", 1, 0)]
