"""License scans, mixing, winnowing, sharding."""

import hashlib
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from duskframe.llm import catalog, licenses, mixing, sharding, winnowing


def test_licenses(spark, docs, corpus):
    rows = {r["doc_id"]: r for r in licenses.license_report(docs).collect()}
    assert len(rows) == len(corpus)
    marks = re.compile(r"[\x09-\x0D\x21-\x2f:-@\[-`{-~ ]+")
    grams = lambda t: {(a, b) for w in [[x for x in marks.split(t.lower()) if x]] for a, b in zip(w, w[1:])}
    templates = {k: grams(v) for k, v in licenses.TEMPLATES.items()}
    for doc_id, text, *_ in corpus:
        lines = re.split(r"\r\n|\r|\n", text or "")
        units = [grams(x) for x in lines + ([text] if len(lines) > 1 else [])]
        dice = [(2 * len(u & t) / (len(u) + len(t)), k) for u in units for k, t in templates.items() if u]
        best = max((d for d, _ in dice), default=0)
        assert (rows[doc_id]["dice"] or 0) == (best if best >= 0.8 else 0)


def test_license_texts_match_themselves(spark):
    texts = [(i, t if i % 2 else t.replace(" the ", "\n THE  ")) for i, t in enumerate(licenses.TEMPLATES.values())]
    rows = licenses.license_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r["dice"] == 1.0 for r in rows) and len({r["license"] for r in rows}) == len(texts)


def test_licenses_empty(none):
    assert licenses.license_report(none).count() == 0
    assert licenses.scan_passages(none).count() == 0


def _plain_passages(text, threshold=0.8):
    marks = re.compile(r"[\x09-\x0D\x21-\x2f:-@\[-`{-~ ]+")
    seq = lambda t: [p for w in [[x for x in marks.split(t.lower()) if x]] for p in zip(w, w[1:])]
    grams, met = seq(text), []
    for name, template in licenses.TEMPLATES.items():
        known = seq(template)
        if (2 - threshold) * len(set(grams) & set(known)) < threshold * len(set(known)):
            continue
        votes = Counter(i - known.index(g) for i, g in enumerate(grams) if g in known)
        start = min(votes, key=lambda d: (-votes[d], d))
        first, last = max(start, 0), start + len(known) - 1
        window = set(grams[first:last + 1])
        dice = 2 * len(window & set(known)) / (len(window) + len(set(known)))
        if dice >= threshold:
            met.append((-dice, name, first, last))
    return sorted((m[1], -m[2] - 1, -m[0]) for m in met if not any(o[2] <= m[3] and m[2] <= o[3] and o[:2] < m[:2] for o in met))


def test_licenses_inside_longer_texts(spark):
    code = "".join(f"int f{i}(int a, int b) {{ return a + b * {i}; }}\n" for i in range(200))
    wrap = lambda t, mark: "".join(f"{mark} {x}\n" for x in textwrap.wrap(t, 60))
    texts = {}
    for name, template in licenses.TEMPLATES.items():
        edited = template.split(" ")
        edited[len(edited) // 2:len(edited) // 2] = ["Copyright", "2024"]
        for form in (wrap(template, "#"), wrap(template, " *").replace("\n", "\r\n"), wrap(" ".join(edited), "//"), template[:len(template) // 3]):
            texts[len(texts)] = code[:900] + form + code
    texts[len(texts)] = wrap(licenses.TEMPLATES["MIT"], "#") + code + wrap(licenses.TEMPLATES["ISC"], "#")
    texts[len(texts)] = ("the software is provided to the user of the software " * 3000)
    rows = [*texts.items(), (None, texts[0]), (None, texts[0]), (len(texts), None), (len(texts) + 1, "")]
    got = defaultdict(list)
    for r in licenses.scan_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["license"], r["unit"], r["dice"]))
    for key, text in texts.items():
        assert sorted(got[key]) == _plain_passages(text), key
    names = list(licenses.TEMPLATES)
    for i in range(len(names)):
        assert got[4 * i][0][0] == got[4 * i + 1][0][0] == names[i] and got[4 * i][0][2] == 1.0
        assert names[i] not in {g[0] for g in got[4 * i + 3]}
    assert {g[0] for g in got[4 * len(names)]} == {"MIT", "ISC"} and not got[len(texts) - 1]
    assert len(got[None]) == 2
    report = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert report[0]["license"] == names[0] and report[0]["n_units"] == 1 and report[3]["n_units"] == 0


def test_most_votes(spark):
    rows = [([3, 1, 3, 1, 2],), ([5],), ([],), ([-2, -2, 7],)]
    out = spark.createDataFrame(rows, "x array<int>").select(licenses._most_votes(F.col("x")).alias("m")).collect()
    assert [r["m"] for r in out] == [1, 5, None, -2]


def _plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over


def test_mixing(spark, docs, corpus):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r["doc_id"]: r["size"] for r in rows} == {c[0]: count(c[1]) for c in corpus}
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    targets = _plain_targets(sizes)
    for r in rows:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s]
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"]] += 1
    assert got == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_mixing_is_close_and_fair(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end as source", "repeat('w ', cast(1 + id % 50 as int)) as text")
    out = mixing.mix_sources(rows).groupBy("source").agg({"taken": "sum", "target": "max", "copies": "avg"}).collect()
    for r in out:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 50


def test_mixing_repeats_and_empty(spark, none):
    rows = spark.createDataFrame([(1, "a", "x y z")] * 5 + [(2, "b", "p q")], "doc_id long, source string, text string")
    assert mixing.mix_sources(rows).count() == 6
    assert mixing.apply_mix(rows).filter("doc_id = 1").count() == sum(r["copies"] for r in mixing.mix_sources(rows).filter("doc_id = 1").collect())
    assert mixing.mix_sources(none).count() == 0 and mixing.apply_mix(none).count() == 0
    odd = spark.createDataFrame([(None, None, "x y z")] * 9000 + [(None, None, None), (1, None, "p"), (None, "a", "q r")], "doc_id long, source string, text string")
    mixed = mixing.mix_sources(odd).collect()
    assert len(mixed) == 9003
    taken = sum(r["taken"] for r in mixed if r["source"] is None)
    assert abs(taken - next(r["target"] for r in mixed if r["source"] is None)) <= 3
    assert mixing.apply_mix(odd).count() == sum(r["copies"] for r in mixed)


def test_mixing_of_a_hot_key(spark):
    """Rows without an id, of one size and source: numbered in blocks, equal texts among them."""
    rows = spark.range(30_000).selectExpr("cast(null as long) as doc_id", "case when id % 3 = 0 then 'b' else 'a' end as source", "case when id % 5 = 0 then 'x y' else concat('w ', id) end as text")
    taken = {r["source"]: r["n"] for r in mixing.mix_sources(rows).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    mixed = mixing.apply_mix(rows)
    assert {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()} == taken
    assert mixed.filter("text != 'x y'").groupBy("text").count().filter("count > 3").count() == 0


def test_mixing_does_not_depend_on_the_layout(spark):
    """Rows of one key, or without one: a rerun over other partitions takes the same texts."""
    rows = spark.range(6_000).selectExpr("case when id % 2 = 0 then id % 4 end as doc_id", "case when id % 3 = 0 then 'b' else 'a' end as source", "concat('w ', id % 4000) as text")
    count = lambda df: sorted((tuple(r) for r in mixing.apply_mix(df).groupBy("doc_id", "source", "text").count().collect()), key=str)
    first = count(rows)
    assert first == count(rows.repartition(7, "text")) == count(rows.orderBy(F.desc("text")).coalesce(2))
    assert len({r[2] for r in first}) < 4000


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _plain_winnow(text, k=5, window=16):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return []
    hashes = []
    for i in range(max(1, len(words) - k + 1)):
        h = 42
        for w in words[i : i + k]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        hashes.append(h >> 32)
    kept = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if not kept or kept[-1] != (hashes[at], at):
            kept.append((hashes[at], at))
    return kept


def test_winnowing(spark, docs, corpus):
    rows = {r["doc_id"]: r for r in winnowing.fingerprint(docs).collect()}
    for doc_id, text, *_ in corpus:
        got = list(zip(rows[doc_id]["hashes"], rows[doc_id]["positions"]))
        assert got == _plain_winnow(text), doc_id
    texts = {c[0]: c[1] or "" for c in corpus}
    ids = sorted(texts)
    for r in winnowing.compare_with_edits(docs).collect():
        text, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        a, b, c = ({h for h, _ in _plain_winnow(t)} for t in (text, edited, after))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        assert abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12


def test_winnowing_rightmost_ties(spark):
    text = "a b c d e " * 12
    row = winnowing.fingerprint(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert list(zip(row["hashes"], row["positions"])) == _plain_winnow(text)


def test_winnowing_odd_tables(spark, none):
    assert winnowing.compare_with_edits(none).count() == 0
    rows = spark.createDataFrame([(1, "abcdefgh"), (1, "abcdefgh"), (2, None), (None, "zz")], "doc_id long, text string")
    assert winnowing.compare_with_edits(rows).count() == 4
    alone = winnowing.compare_with_edits(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def _plain_characters(text, k=8):
    """Rolling: each gram's value from the one before it."""
    turn = lambda x, n: (x << n | x >> 64 - n) % 2**64
    points = [xxhash.xxh64_intdigest(c.encode(), 42) for c in re.sub(r"[\x20\x09-\x0D]", " ", text or "")]
    if not points:
        return []
    if len(points) < k:
        return [(xxhash.xxh64_intdigest(re.sub(r"[\x20\x09-\x0D]", " ", text).encode(), 42) >> 32, 0)]
    value, grams = 0, []
    for i, c in enumerate(points):
        value = turn(value, 1) ^ c ^ (turn(points[i - k], k) if i >= k else 0)
        if i >= k - 1:
            grams.append(value >> 32)
    window = 16 if len(grams) >= 64 else 4 if len(grams) >= 16 else 1
    kept = []
    for i in range(len(grams) - window + 1):
        part = grams[i : i + window]
        at = i + max(j for j, g in enumerate(part) if g == min(part))
        if not kept or kept[-1] != (grams[at], at):
            kept.append((grams[at], at))
    return kept


def test_winnowing_of_characters(spark, docs, corpus):
    rows = {r["doc_id"]: list(zip(r["h"], r["p"])) for r in docs.select("doc_id", winnowing.winnow_characters(docs["text"]).alias("k")).selectExpr("doc_id", "transform(k, g -> shiftrightunsigned(g, 31)) h", "transform(k, g -> 2147483647 - (g & 2147483647)) p").collect()}
    for doc_id, text, *_ in corpus:
        assert rows[doc_id] == _plain_characters(text), doc_id


def _check_op4(texts, rows):
    """Rows of op4 by id against the plain version."""
    ids = sorted(texts)
    fp = {i: _plain_characters(texts[i]) for i in ids}
    show = lambda kept: " ".join(f"{h:x}@{p}" for h, p in kept)
    like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
    for place, i in enumerate(ids):
        text, follows = texts[i], ids[(place + 1) % len(ids)]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + texts[follows][:quarter]
        kept, r = _plain_characters(edited), rows[i]
        a, b, c = ({h for h, _ in x} for x in (fp[i], kept, fp[follows]))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == show(fp[i]) and r["edited_fingerprint"] == show(kept), i
        assert abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12


def test_op4_against_a_plain_version(spark, corpus, tmp_path):
    rng = random.Random(9)
    texts = {c[0]: c[1] or "" for c in corpus}
    for i in range(300):  # lengths about those at which windows change, few letters, so that hashes tie
        texts[5000 + i] = "".join(rng.choice("ab \n") for _ in range(rng.randint(60, 130))) if i % 3 else "".join(rng.choice("ab😀é") for _ in range(rng.randint(0, 400)))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in catalog.op4_winnowing(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    _check_op4(texts, rows)


def test_op4_sees_texts_without_blanks_and_short_texts(spark, tmp_path):
    rng = random.Random(2)
    han = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(2000)) for _ in range(2)]
    near = han[0][:999] + "x" + han[0][1000:]
    short = ["The quick brown fox jumps over the lazy dog near the river bank.", "Pack my box with five dozen liquor jugs, then go home at once."]
    texts = dict(enumerate([han[0], near, han[1], "😀 mixed", *short]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in catalog.op4_winnowing(spark, str(tmp_path)).collect()}
    _check_op4(texts, out)
    assert out[0]["near_next"] > 0.8 and 0.5 < out[0]["near_edited"] < 1
    assert all(0.2 < out[i]["near_edited"] < 1 for i in (4, 5))


def test_next_rows(spark):
    rows = spark.range(0, 5000, 7).selectExpr("id as doc_id", "cast(id as string) as text")
    found = {r["doc_id"]: r["next"] for r in winnowing.with_next(rows, {}, ranges=16).collect()}
    assert len(found) == 715 and all(n["doc_id"] == (d + 7 if d + 7 < 5000 else 0) and n["text"] == str(n["doc_id"]) for d, n in found.items())


def test_next_rows_of_hot_ids(spark):
    """Rows without an id, and rows of one id, are dealt to many ranges; each row has a next one."""
    rows = spark.range(30_000).selectExpr("case when id < 10000 then null when id < 20000 then 7 else id end as doc_id", "cast(id as string) as text")
    out = winnowing.with_next(rows, {}, ranges=64)
    assert out.select("doc_id", "text").distinct().count() == 30_000 and out.select("next.doc_id", "next.text").distinct().count() == 30_000
    ordered = {(r["doc_id"], r["text"]): (r["next"]["doc_id"], r["next"]["text"]) for r in out.collect()}
    assert sum(a[0] is None and b[0] is not None for a, b in ordered.items()) == 1 and sum(a[0] == 7 and b[0] != 7 for a, b in ordered.items()) == 1


def test_sharding(spark, docs):
    df = spark.range(20_000).toDF("doc_id")
    rows = sharding.shard_records(df, "doc_id", [1.0] * 8, [1.0] * 9).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(abs(len(s) - 2500) < 300 for s in by.values())
    assert abs(sum(r["grown_shard"] == 8 for r in rows) - 20_000 / 9) < 300
    weighted = df.select(sharding.rendezvous_shard(df["doc_id"], [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count().collect()
    assert {r["s"] for r in weighted} == {0, 1} and abs(max(r["count"] for r in weighted) - 15_000) < 400


def test_sharding_against_a_plain_version(spark):
    """Rendezvous hashing with the hash library."""

    def chain(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x, seed)
        return seed

    def shard(key, weights):
        stem = chain((0).to_bytes(4, "little"), key.encode())
        race = [(-math.log(((chain(stem.to_bytes(8, "little"), s.to_bytes(4, "little")) >> 11) + 1) * 2.0**-53) / w, s) for s, w in enumerate(weights)]
        return min(race)[1]

    weights = [1.0, 2.0, 1.0, 0.5, 3.0]
    for r in sharding.shard_records(spark.range(500).toDF("doc_id"), "doc_id", weights, [*weights, 1.0]).collect():
        assert r["shard"] == shard(str(r["doc_id"]), weights) and r["grown_shard"] == shard(str(r["doc_id"]), [*weights, 1.0])


def test_sharding_of_one_key(spark):
    rows = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "id as size", "'mine' as shard", "1.5 as slot")
    out = sharding.shard_records(rows, "doc_id", [1.0] * 4, [1.0] * 5)
    assert set(out.columns) == {"doc_id", "size", "shard", "grown_shard", "slot"}
    got = out.collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(20_000))
    again = sharding.shard_records(rows.repartition(5), "doc_id", [1.0] * 4, [1.0] * 5).collect()
    assert {r["size"]: r["slot"] for r in got} == {r["size"]: r["slot"] for r in again}


def test_sharding_repeats_and_empty(spark, none):
    rows = sharding.shard_records(spark.createDataFrame([(1,), (1,), (None,), (None,)], "doc_id long"), "doc_id", [1.0] * 3).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.shard_records(none, "doc_id", [1.0] * 3).count() == 0
