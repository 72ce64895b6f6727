import os
import random
import re
import time

import numpy as np
import pyarrow as pa

from duskframe.llm import minhash, textbytes


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_groups(rows):
    """Components by comparing all pairs."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in parent}


def test_against_all_pairs(spark, docs, corpus):
    rows = minhash.near_groups(docs).collect()
    expected = plain_groups(corpus)
    assert len(rows) == len(corpus)
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {c[0]: len(shingles(c[1])) for c in corpus}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in expected.items() if i == c)


def test_large_groups_in_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for d in range(40):
        words = list(base)
        for e in range(d % 13):
            words[(7 * e + d) % 100] = f"x{d}-{e}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(df).collect()} == plain_groups(rows)


def test_long_buckets_of_unlike_sets(spark, monkeypatch):
    """Texts around a shared passage fill buckets without being near copies; a few of them are."""
    monkeypatch.setattr(minhash, "TILE", 64)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in range(500):
        share = 60 if d % 2 else rng.randint(40, 60)
        own = [f"o{d}-{i}" for i in range(25)]
        rows.append((d, " ".join(own[:12] + passage[:share] + own[12:])))
        if d % 50 == 0:
            rows.append((1000 + d, " ".join(own[:12] + passage[:share] + own[12:-1] + ["z"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_groups(rows)
    assert 10 <= len(rows) - len(set(expected.values()))
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(df).collect()} == expected


def test_no_task_holds_more_than_a_few_tiles(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(minhash, "TILE", 16)
    link = minhash._link_tiles

    def counted(percent):
        run = link(percent)

        def count(table):
            (tmp_path / f"{time.time_ns()}-{os.getpid()}").write_text(str(table.num_rows))
            return run(table)

        return count

    monkeypatch.setattr(minhash, "_link_tiles", counted)
    base = [f"w{i}" for i in range(100)]
    rows = [(d, " ".join(base[:30] + [f"x{d}"] + base[31:])) for d in range(400)]
    out = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {0}
    held = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert len(held) > 100 and max(held) <= 100  # 25 chunks: about 2 x 16 sets in each of 325 tiles


def _spoilt(n, start, rng):
    """Copies of one text of 100 words, most of them near the first, some only near others, some near none."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for d in range(n):
        words = list(base)
        for e in range(rng.choice((0, 1, 1, 1, 2, 3, 4, 6, 9))):
            words[rng.randrange(100)] = f"x{d}-{e}"
        rows.append((start + d, " ".join(words)))
    return rows


def test_leaders_first(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "LED", 1)
    rows = _spoilt(150, 1000, random.Random(7)) + [(d, f"a b c d e f g {d % 5} h i j k l m n o p q") for d in range(40)]
    expected = plain_groups(rows)
    assert len(set(expected.values())) > 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(df).collect()} == expected


def test_sets_of_a_large_cluster_are_sent_a_few_times(spark, monkeypatch, tmp_path):
    """Sets that meet grow in proportion to the cluster."""
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "LED", 4)
    link = minhash._link_tiles

    def counted(percent):
        run = link(percent)

        def count(table):
            (tmp_path / f"{time.time_ns()}-{os.getpid()}").write_text(str(table.num_rows))
            return run(table)

        return count

    monkeypatch.setattr(minhash, "_link_tiles", counted)
    base = [f"w{i}" for i in range(100)]
    sent = []
    for n in (300, 600):
        rows = [(d, " ".join(base[:30] + [f"x{d}"] + base[31:])) for d in range(n)]
        out = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["component_id"] for r in out} == {0}
        files = list(tmp_path.iterdir())
        held = [int(f.read_text()) for f in files]
        assert max(held) <= 60
        sent.append(sum(held))
        for f in files:
            f.unlink()
    assert sent[0] <= 2 * 300 and sent[1] <= 2 * 600  # all tiles: 19 and 38 copies of each


def test_repeated_and_null_ids(spark):
    same = "one two three four five six seven"
    rows = [(3, same), (3, same), (5, same), (3, "a b c d e f"), (9, "a b c d e f"), (None, same), (None, None)]
    out = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 7
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(3, 3), (5, 3), (9, 3), (None, None)}
    kept = minhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 3]


def test_empty(none):
    assert minhash.near_groups(none).count() == 0


def test_sketch_estimates_likeness():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    for share in (0.0, 0.5, 0.9):
        n = int(1000 * share)
        a, b = hashes[:1000], hashes[1000 - n : 2000 - n][:1000]
        both = np.concatenate([a, b])
        owner = np.repeat([0, 1], [len(a), len(b)])
        s = minhash.fill_bins(both, owner, 2, 1024)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.07
    one = minhash.fill_bins(hashes[:1], np.zeros(1, np.int64), 1)
    assert (one != 2**64 - 1).all()  # a set of one fills every bin


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.int64) for _ in range(9)]
    got = minhash.shared_counts(sets[:4], sets[4:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]).all()


def test_words_of_long_texts():
    texts = ["one two  three\n" * 30, "x" * 200, None, "a b", "end " * 50]
    whole = {i: (h.tolist(), of.tolist()) for i, _, h, of in textbytes.word_blocks(pa.array(texts[:1]))}
    parts = list(textbytes.word_blocks(pa.array(texts), 40))
    assert parts[0][2].tolist() == whole[0][0]
    assert sum(len(p[2]) for p in parts) == 90 + 1 + 0 + 2 + 50 and [p[:2] for p in parts][0] == (0, 1)
    twins = ["".join("th"[bin(i).count("1") & 1 ^ k] for i in range(2048)) for k in (0, 1)]
    assert len({h for _, _, hashes, _ in minhash._sets(pa.array(twins)) for h in hashes.tolist()}) == 2  # Thue-Morse words


def test_words_at_text_ends():
    for i, j, data, at, _ in textbytes.blocks(pa.array(["ab", "cd ef", None, "", " g"]), 6):
        start, end, of = textbytes.words(data, at)
        assert [bytes(data[s:e]).decode() for s, e in zip(start, end)] == [w for t in ["ab", "cd ef", "", "", " g"][i:j] for w in t.split()]
