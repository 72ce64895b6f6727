import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

from duskframe.llm import textbytes, tokens

PATH = P.path("piece_bpe_32k.model")


def _varint(raw, at):
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 128:
            return value, at


def _fields(raw):
    """(number, start, value start, end) of the fields of a message."""
    at = 0
    while at < len(raw):
        start = at
        tag, at = _varint(raw, at)
        kind = tag & 7
        value = at
        if kind == 0:
            _, at = _varint(raw, at)
        elif kind == 2:
            size, value = _varint(raw, at)
            at = value + size
        else:
            at += {1: 8, 5: 4}[kind]
        yield tag >> 3, start, value, at


def unigram(raw):
    """The model file with its type changed to unigram: the library's lattice then segments with its pieces."""
    out = bytearray(raw)
    for number, _, value, end in _fields(raw):
        if number == 2:
            for inner, _, at, _ in _fields(raw[value:end]):
                if inner == 3:
                    out[value + at] = 1
    return bytes(out)


def best_counts(plain, text):
    """Numbers of pieces of the library's best segmentations (several, if they are equally good)."""
    if not text:
        return {0}
    found = plain.nbest_encode(text, nbest_size=8, out_type=int)
    least = min(plain.get_score(i) for i in range(plain.get_piece_size()) if not plain.is_byte(i)) - tokens.UNKNOWN_PENALTY
    score = lambda ids: sum(least if plain.is_unknown(i) else plain.get_score(i) for i in ids)
    top = max(map(score, found))
    return {len(x) for x in found if score(x) == top}


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def plain(model):
    return sentencepiece.SentencePieceProcessor(model_proto=unigram(model))


def test_against_the_library(model, plain):
    counter = tokens.UnigramCounter(tokens.read_pieces(model))
    assert counter.split
    rng = random.Random(2)
    parts = [*"abcdefgthe  .,!19éßø", "the", " of", "tion", "ing", " a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["", "a" * 40, "the of the house"]
    got = []
    for _, _, data, at, _ in textbytes.blocks(pa.array(texts), 1 << 12):
        got += counter.count_run(data, at).tolist()
    for text, n in zip(texts, got):
        assert n in best_counts(plain, text), text


def test_ties_go_to_the_piece_that_begins_first():
    counter = tokens.UnigramCounter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0)])
    assert counter.count("ab") == 1 and counter.count("abc") == 1 and counter.count("cab") == 2


def test_unknown_characters_count_as_bytes():
    counter = tokens.UnigramCounter([("a", -1.0), ("é", -5.0)])
    assert counter.count("a漢a") == 5 and counter.count("é") == 1
    assert tokens.UnigramCounter([("a", -1.0)], byte_fallback=False).count("漢") == 1


def test_equal_hashes_do_not_make_equal_counts(model, monkeypatch):
    """Segments are told apart by their bytes, in a task of any company; long texts come in parts."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    texts = ["".join("th"[b] for b in bits), "".join("ht"[b] for b in bits), "a  bc the  end " * 40, "the", "tha", "thb x"]
    alone = [tokens.UnigramCounter(tokens.read_pieces(model)).count("▁" + t.replace(" ", "▁")) for t in texts]
    for size, hashes in ((1 << 16, textbytes.lane_hashes), (64, textbytes.lane_hashes), (1 << 16, lambda values, within, first, length, seed=0: np.zeros(len(length), np.uint64))):
        monkeypatch.setattr(textbytes, "lane_hashes", hashes)
        counter, total = tokens.UnigramCounter(tokens.read_pieces(model)), np.zeros(len(texts), int)
        for i, j, data, at, part in textbytes.blocks(pa.array(texts), size):
            total[i:j] += counter.count_run(data, at, part == -1)
        assert total.tolist() == alone


def test_texts_without_blanks_come_in_parts(model):
    """A plain table of all sums over the whole text decides."""
    pieces = tokens.read_pieces(model)
    scores = dict(pieces)
    counter = tokens.UnigramCounter(pieces)

    def plain(text):
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            ways = [(best[a][0] + scores[text[a:end]], best[a][1] + 1) for a in range(max(0, end - counter.longest), end) if text[a:end] in scores]
            if text[end - 1] not in counter.single:
                ways.append((best[end - 1][0] + counter.unknown, best[end - 1][1] + len(text[end - 1].encode())))
            best.append(max(ways, key=lambda way: way[0]))  # the first of equal ones begins first
        return best[-1][1]

    rng = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E40)] + ["the", "ation", "x", "q", "é", "Ж", "，"]
    texts = ["".join(rng.choice(letters) for _ in range(1500)) for _ in range(6)] + ["a" * 3000]
    total, runs = np.zeros(len(texts), int), 0
    for i, j, data, at, part in textbytes.blocks(pa.array(texts), 600, cuts=counter.boundaries):
        total[i:j] += counter.count_run(data, at, part == -1)
        runs += 1
    assert total.tolist() == [plain("▁" + t) for t in texts]
    assert runs > 5 * len(texts)


def test_documents(spark, docs, corpus, model):
    rows = {r["doc_id"]: r["n_tokens"] for r in tokens.count_documents(docs, tokens.load(spark, PATH)).collect()}
    exact = tokens.UnigramCounter(tokens.read_pieces(model))
    assert rows == {c[0]: exact.count("▁" + c[1].replace(" ", "▁")) if c[1] else 0 for c in corpus}


def test_empty(spark, none):
    assert tokens.count_documents(none, tokens.load(spark, PATH)).count() == 0
