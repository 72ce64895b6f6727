import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from duskframe.llm import bpe, textbytes

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return bpe.BytePairs.from_file(f.read())


@pytest.fixture(scope="module")
def plain(coder):
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_random_texts(coder, plain):
    rng = random.Random(1)
    parts = [*"abst'lrevedm''   \n\t.,!1239éñß漢字🙂 　\x85", "\x1c", "ć", "½", "'s", "'ll", "'re ", " '", "  '", "\n'", "'S", "don't", " ’s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(8000)] + ["", "a" * 4000, " " * 3000 + "x", "<|endoftext|>", "'s"]
    for i, j, data, at, _ in textbytes.blocks(pa.array(texts), 1 << 14):
        ids, ends = coder.encode_run(data, at)
        for k in range(i, j):
            own = ids[ends[k - i] : ends[k - i + 1]]
            assert own.tolist() == plain.encode_ordinary(texts[k]), texts[k]
            assert bytes(coder.decode(own)) == texts[k].encode()


def test_long_texts_come_in_parts(coder, plain):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b's", " ", "  ", "\n", " 12", "é", "漢", "!", "'ll"]) for _ in range(900)) for _ in range(20)] + ["x" * 500, " " * 500, None, ""]
    parts = {}
    for i, j, data, at, _ in textbytes.blocks(pa.array(texts), 64):
        ids, ends = coder.encode_run(data, at)
        for k in range(i, j):
            parts[k] = parts.get(k, []) + ids[ends[k - i] : ends[k - i + 1]].tolist()
    assert parts == {k: plain.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_texts_without_blanks_come_in_parts(coder, plain):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["漢", "字", "，", "か", "'s", "'", "é", "12", "\u3000", "\u3000 ", "!", "x", "\n", "🙂"]) for _ in range(700)) for _ in range(40)]
    parts, runs = {}, 0
    for i, j, data, at, _ in textbytes.blocks(pa.array(texts), 64, cuts=coder.boundaries):
        ids, ends = coder.encode_run(data, at)
        runs += 1
        for k in range(i, j):
            parts[k] = parts.get(k, []) + ids[ends[k - i] : ends[k - i + 1]].tolist()
    assert parts == {k: plain.encode_ordinary(t) for k, t in enumerate(texts)}
    assert runs > 20 * len(texts)


def test_long_pre_tokens_are_merged_in_parts(coder, plain, monkeypatch):
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4F00)] + list("qxzkjv") + ["the", "ing", "ж", "ß"]
    texts = ["".join(rng.choice(letters) for _ in range(3000)) for _ in range(10)] + ["a" * 5000, "=" * 5000]
    whole = [coder.merge(t.encode()).tolist() for t in texts]
    assert whole == [plain.encode_ordinary(t) for t in texts]
    spans, real = [], coder._merge
    monkeypatch.setattr(bpe, "MERGED", 100)
    monkeypatch.setattr(coder, "_merge", lambda piece: spans.append(len(piece)) or real(piece))
    assert [coder.merge(t.encode()).tolist() for t in texts[:10]] == whole[:10]
    assert max(spans) < 1000
    assert [coder.merge(t.encode()).tolist() for t in texts[10:]] == whole[10:]


def test_equal_hashes_do_not_make_equal_tokens(monkeypatch):
    real = textbytes.lane_hashes

    def clash(values, within, first, length, seed=0):
        return real(values >> np.uint64(8) << np.uint64(8), within, first, length, seed)  # the first byte does not count

    monkeypatch.setattr(textbytes, "lane_hashes", clash)
    pairs = bpe.BytePairs({b"ab": 300, b"cdef": 301})
    data = np.frombuffer(b"xb", np.uint8)
    assert pairs.find(data, np.array([0]), np.array([2])).tolist() == [-1]
    assert pairs.find(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [300]


def test_repeating_words_have_hashes_of_their_own():
    """Thue-Morse words make sums of powers equal."""
    for n in (1024, 2048, 4096):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        both = "".join("th"[b] for b in bits), "".join("ht"[b] for b in bits)
        data = np.frombuffer("".join(both).encode(), np.uint8)
        start = np.array([0, n])
        assert all(len(set(textbytes.span_hashes(data, start, start + n, seed).tolist())) == 2 for seed in range(8))


def test_documents(spark, docs, corpus, plain):
    ranks = bpe.load(spark, PATH)
    rows = bpe.decode_documents(bpe.encode_documents(docs.select("doc_id", "text"), ranks), ranks).collect()
    texts = {c[0]: c[1] or "" for c in corpus}
    for r in rows:
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    assert len(rows) == len(corpus)


def test_empty(spark, none):
    ranks = bpe.load(spark, PATH)
    assert bpe.decode_documents(bpe.encode_documents(none, ranks), ranks).count() == 0
