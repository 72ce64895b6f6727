"""Byte-level BPE encoding and decoding from a file of ranks.

Texts are split into pre-tokens on arrays of character classes, a block of texts at a time. Every pre-token
is looked up whole in a minimal perfect hash of the vocabulary; most are found. The others are merged: a heap
gives the pair of least rank (the leftmost among equals) over a linked list of pieces. A pre-token that is
met again is not merged again while it is remembered.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes
from .columns import small_batches
from .perfect import PerfectHash

#: Bytes of merged pre-tokens (and ENTRY more for each) that a worker remembers, in two halves: when the younger
#: one is full, it becomes the older one, of which only what is met again is kept.
REMEMBERED = 64 << 20
ENTRY = 200
#: Bytes of a pre-token that are merged at once; a longer one is merged in parts that no token reaches across.
MERGED = 1 << 16
SEED = 3
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3

# The white space of the pattern, as inclusive ranges of code points.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# The endings that the pattern takes with an apostrophe.
ENDINGS = ("s", "t", "d", "m", "re", "ve", "ll")


def character_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            out[ord(every[found.start()]) : ord(every[found.end() - 1]) + 1] = kind
    for first, last in WHITE_SPACE:
        out[first : last + 1] = _SPACE
    return out


def split_places(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of a run of texts start, in code points."""
    n = len(points)
    kind = classes[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    last = np.zeros(n, bool)  # the last character of a text
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first] = 255
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 255, kind[1:]
    after[last] = 255
    start = kind != before
    # Of a run of white space that something follows, the last character is a token of its own, or, if a blank,
    # the beginning of what follows.
    tail = (kind == _SPACE) & (after != _SPACE) & (after != 255)
    start |= tail
    prefix = np.flatnonzero(tail & (points == 32))
    start[prefix + 1] = False
    # An apostrophe where a token begins takes one of the endings with it.
    mark = np.flatnonzero((points == 0x27) & start & (after == _LETTER))
    if len(mark):
        one = points[mark + 1]
        second = mark + 2
        inside = (second < n) & ~first[np.minimum(second, n - 1)]
        two = np.where(inside, points[np.minimum(second, n - 1)], 0)
        length = np.zeros(len(mark), np.int64)
        for ending in ENDINGS:
            fits = one == ord(ending[0])
            if len(ending) == 2:
                fits &= two == ord(ending[1])
            length[fits] = len(ending)
        mark, length = mark[length > 0], length[length > 0]
        start[mark + 1] = False
        rest = mark + 1 + length
        rest = rest[rest < n]
        start[rest] |= kind[rest] == _LETTER
    return np.flatnonzero(start)


class BytePairs:
    """A vocabulary of byte strings by rank, for encoding and decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens])
        self.longest = int(self.lengths.max())
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        used = np.flatnonzero(self.lengths)
        values, within, first = textbytes.lanes(self.bytes, self.starts[used], self.starts[used] + self.lengths[used])
        self.lanes, self.first_lane = values, np.zeros(len(tokens), np.int64)
        self.first_lane[used] = first
        keys = textbytes.lane_hashes(values, within, first, self.lengths[used], SEED)
        self.whole = PerfectHash(keys)
        self.rank_of = np.empty(len(used), np.int64)
        self.rank_of[self.whole.find(keys)] = used
        self.single = [ranks.get(bytes((k,))) for k in range(256)]
        self.pairs = [ranks.get(bytes(divmod(k, 256)), -1) for k in range(1 << 16)]
        self.merged: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        self.classes = None

    @staticmethod
    def from_file(lines: bytes) -> BytePairs:
        return BytePairs({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token})

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ids of the spans of bytes that are tokens, -1 for the others."""
        length = end - start
        values, within, first = textbytes.lanes(data, start, end)
        number = self.whole.find(textbytes.lane_hashes(values, within, first, length, SEED))
        ids = self.rank_of[np.maximum(number, 0)]
        found = (number >= 0) & (self.lengths[ids] == length)
        # A hash says where to look; the bytes decide.
        count = np.diff(np.append(first, len(values)))
        own = np.repeat(found, count)
        at = np.repeat(self.first_lane[ids], count) + within
        found &= np.logical_and.reduceat(own & (self.lanes[np.where(own, at, 0)] == values), first)
        return np.where(found, ids, -1)

    def boundaries(self, part: np.ndarray) -> np.ndarray:
        """Places in a stretch of bytes where a pre-token starts, whatever lies around the stretch.

        These are changes of class after anything but white space (its last character may go with what follows)
        and the apostrophe (it may take letters with it).
        """
        if self.classes is None:
            self.classes = character_classes()
        text, lead = textbytes.characters(part)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        return lead[1:][(kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & (points[:-1] != 0x27)]

    def _apart(self, piece: bytes, place: int) -> bool:
        """Whether no token of the vocabulary lies across a place, so that nothing is ever merged across it."""
        ranks, n, longest = self.ranks, len(piece), self.longest
        return not any(piece[a:b] in ranks for a in range(place - 1, max(-1, place - longest), -1) for b in range(place + 1, min(n, a + longest) + 1))

    def merge(self, piece: bytes) -> array:
        """Ids of one pre-token that isn't a token as a whole."""
        n = len(piece)
        if n <= MERGED:
            return array("I", self._merge(piece))
        out, at = array("I"), 0
        while at < n:
            end = n if n - at <= MERGED else next((p for p in range(at + MERGED, n) if self._apart(piece, p)), n)
            out.extend(self._merge(piece[at:end]))
            at = end
        return out

    def _merge(self, piece: bytes) -> list[int]:
        """Ids of a run of bytes by merging alone.

        An entry of the heap is a number: rank, then where the pair starts, then where it ends.
        """
        get, pairs, single, n = self.ranks.get, self.pairs, self.single, len(piece)
        shift = n.bit_length()
        twice, mask = 2 * shift, (1 << shift) - 1
        stop, back = range(1, n + 1), range(-1, n)
        stop, back = (list(stop), list(back)) if n <= MERGED else (array("q", stop), array("q", back))
        stop.append(0)  # where the piece that starts here ends; 0: none starts here
        # `back` is where the piece before starts, `ids` the token that starts here; -1: none.
        ids = [single[byte] for byte in piece]
        heap = []
        for i, pair in enumerate(zip(piece, piece[1:])):
            rank = pairs[pair[0] << 8 | pair[1]]
            if rank >= 0:
                heap.append(rank << twice | i << shift | i + 2)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            end, i = entry & mask, entry >> shift & mask
            j = stop[i]
            if not j or stop[j] != end:  # one of the two has merged since
                continue
            stop[i], stop[j] = end, 0
            ids[i], ids[j] = entry >> twice, -1
            if end < n:
                back[end] = i
                after = stop[end]
                rank = get(piece[i:after])
                if rank is not None:
                    push(heap, rank << twice | i << shift | after)
            if i:
                h = back[i]
                rank = get(piece[h:end])
                if rank is not None:
                    push(heap, rank << twice | h << shift | end)
        return [rank for rank in ids if rank != -1]

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, and the texts' offsets among them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.classes is None:
            self.classes = character_classes()
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            starts = split_places(points, offsets, self.classes)
        else:
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            places = np.searchsorted(lead, offsets)
            starts = lead[split_places(points, places, self.classes)]
        ends = np.append(starts[1:], len(data))
        whole = self.find(data, starts, ends)
        found = whole >= 0
        count = np.ones(len(starts), np.int64)
        missing = np.flatnonzero(~found)
        flat = np.zeros(0, np.uint32)
        if len(missing):
            text, merged, pieces = data.tobytes(), self.merged, []
            for a, b in zip(starts[missing].tolist(), ends[missing].tolist()):
                piece = text[a:b]
                ids = merged.get(piece)
                if ids is None:
                    ids = self.older.pop(piece, None) or self.merge(piece).tobytes()
                    size = ENTRY + len(piece) + len(ids)
                    if self.held + size > REMEMBERED // 2:
                        self.older, self.merged, self.held = merged, {}, 0
                        merged = self.merged
                    self.held += size
                    merged[piece] = ids
                pieces.append(ids)
            flat = np.frombuffer(b"".join(pieces), np.uint32)
            count[missing] = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        out[at[found]] = whole[found]
        if len(missing):
            sizes = count[missing]
            out[np.repeat(at[missing] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
        at = np.append(at, len(out))
        return out, at[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        size = self.lengths[ids]
        first = np.cumsum(size) - size
        return self.bytes[np.repeat(self.starts[ids] - first, size) + np.arange(int(size.sum()))]


def _binary(parts: list[np.ndarray], offsets: list[np.ndarray]) -> pa.Array:
    """A binary array of runs of bytes, each with its offsets."""
    ends, base = [np.zeros(1, np.int64)], 0
    for part, at in zip(parts, offsets):
        ends.append(at[1:] + base)
        base += len(part)
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    ends = np.concatenate(ends)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def load(spark: SparkSession, path: str):
    """Read a rank file on the driver, for use in `encode` and `decode`. Vocabularies have a fixed size."""
    small_batches(spark)
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


_CODERS: dict[bytes, BytePairs] = {}


def _coder(ranks) -> BytePairs:
    """The coder of a broadcast rank file, built once in each Python process."""
    lines = ranks.value
    if lines not in _CODERS:
        _CODERS.clear()
        _CODERS[lines] = BytePairs.from_file(lines)
    return _CODERS[lines]


def encode(text: Column, ranks) -> Column:
    """Ids of a text: binary, each id a little-endian unsigned 32-bit integer. Null counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        coder, parts, size = _coder(ranks), [], np.zeros(len(texts) + 1, np.int64)
        for i, j, data, at, _ in textbytes.blocks(texts, cuts=coder.boundaries):
            ids, ends = coder.encode_run(data, at)
            parts.append(ids.astype("<u4").view(np.uint8))
            size[i + 1 : j + 1] += 4 * np.diff(ends)
        out = _binary([np.concatenate(parts)] if parts else [], [np.cumsum(size)] if parts else [])
        textbytes.release()
        return out

    return F.arrow_udf(run, "binary")(F.coalesce(text, F.lit("")))


def decode(ids: Column, ranks) -> Column:
    """The bytes of ids as `encode` gives them; null for null, an error for ids that aren't of the vocabulary."""

    def run(packed: pa.Array) -> pa.Array:
        coder = _coder(ranks)
        packed = packed.cast(pa.large_binary())
        _, at, data = packed.buffers()
        at = np.frombuffer(at, np.int64)[packed.offset : packed.offset + len(packed) + 1]
        values = np.frombuffer(data, "<u4") if data is not None and data.size else np.zeros(0, np.uint32)
        values, at = values[at[0] // 4 : at[-1] // 4], (at - at[0]) // 4
        parts, offsets = [], []
        step = max(1, len(at) // max(1, int(at[-1]) // (1 << 19) + 1))
        for i in range(0, len(at) - 1, step):
            own = at[i : i + step + 1]
            part = values[own[0] : own[-1]]
            size = np.r_[0, np.cumsum(coder.lengths[part])]
            parts.append(coder.decode(part))
            offsets.append(size[own - own[0]])
        out = _binary(parts, offsets)
        return pc.if_else(packed.is_valid(), out, pa.scalar(None, pa.binary())) if packed.null_count else out

    return F.arrow_udf(run, "binary")(ids)


def encode_documents(df: DataFrame, ranks, text: str = "text") -> DataFrame:
    """Add `ids` (see `encode`) and `n_tokens`. Null and empty texts have no ids (an empty binary) and 0 tokens.

    A text of any length is worked on in parts that end where a pre-token does; a pre-token of any length (a script
    without blanks or punctuation, a run of one character) is looked up at once, in about fifteen times its bytes.
    Repeated rows are encoded each; an empty table gives no rows. Columns `ids` and `n_tokens` of the input are
    replaced, other columns pass through.
    """
    return df.withColumn("ids", encode(F.col(text), ranks)).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_documents(df: DataFrame, ranks, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the bytes of the ids: null for null, empty for no ids.

    Repeated rows are decoded each; an empty table gives no rows. A column `decoded` of the input is replaced,
    other columns pass through.
    """
    return df.withColumn("decoded", decode(F.col(ids), ranks))
