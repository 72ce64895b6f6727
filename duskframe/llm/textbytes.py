"""Texts as NumPy byte arrays: words, hashes and code points of many texts at once.

Arrow hands a batch of texts over as one run of UTF-8 bytes. The helpers here work on such runs, a few
megabytes at a time, so that no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text comes in parts.
BLOCK = 1 << 18

GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ends(data: np.ndarray, size: int, words: bool, cuts: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[int]:
    """Where the parts of one text end: before a blank that follows a printable ASCII character, or at any
    character. Stretches without such a blank are asked for other places by `cuts`; a run without either is one part."""
    at = 0
    while len(data) - at > size:
        end = at + size
        if words:
            end, start, step = 0, at + size // 2, size - size // 2
            while not end and start < len(data) - 1:
                part = data[start : start + step + 1]
                found = 1 + np.flatnonzero((part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
                if cuts is not None and not len(found):
                    found = cuts(part)
                end = start + int(found[-1]) if len(found) else 0
                start += step
            if not end:
                break
        else:
            while end > at + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
        yield end
        at = end
    yield len(data)


def blocks(texts: pa.Array, size: int = BLOCK, lead: int | None = None, cuts: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first, last + 1, bytes, offsets, 0) of runs of texts; nulls are empty texts.

    A text of more than `size` bytes comes in parts, each as a run of this one text. They are cut between
    words or, if `lead` is given, at any character; a later part then repeats the `lead` characters before it,
    whose number of bytes is the last value. For a later part without a lead it is -1. `cuts` gives, for a stretch
    of bytes that may begin and end within a character, further places (in bytes, after the first) to cut at.
    """
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, len(texts))
        run = data[at[i] : at[j]]
        if len(run) <= size:
            yield i, j, run, at[i : j + 1] - at[i], 0
        else:
            begin = 0
            for end in _ends(run, size, lead is None, cuts):
                back = begin
                for _ in range(lead or 0):
                    back = max(back - 1, 0)
                    while back and run[back] & 0xC0 == 0x80:
                        back -= 1
                yield i, j, run[back:end], np.array([0, end - back]), begin - back if lead is not None or not begin else -1
                begin = end
        i = j


def characters(part: np.ndarray) -> tuple[str, np.ndarray]:
    """The whole characters of a stretch of bytes but the last, which may be cut off, and where each begins."""
    lead = np.flatnonzero((part & 0xC0) != 0x80)
    if len(lead) < 2:
        return "", np.zeros(0, np.int64)
    return part[lead[0] : lead[-1]].tobytes().decode("utf-8"), lead[:-1]


def word_blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, hashes of the lower-case words, their texts) of runs of whole texts."""
    parts: list[np.ndarray] = []
    held = (0, 0)
    for i, j, data, offsets, part in blocks(texts, size):
        start, end, text_of = words(data, offsets)
        hashes = span_hashes(LOWER[data], start, end)
        if part == -1:
            parts.append(hashes)
            continue
        if parts:
            yield *held, np.concatenate(parts), np.zeros(sum(map(len, parts)), np.int64)
            parts = []
        if len(data) and j == i + 1:  # more may follow
            parts, held = [hashes], (i, j)
        else:
            yield i, j, hashes, text_of
    if parts:
        yield *held, np.concatenate(parts), np.zeros(sum(map(len, parts)), np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each word's text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1] | edge[1:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:] | edge[1:-1]
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


# For 0 to 8 bytes that are left, what of a number they fill.
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of spans, eight to a number, zeros after the last; each number's place in its span; each span's first.

    Spans hold a byte at least.
    """
    count = (end - start + 7) >> 3
    first = np.cumsum(count) - count
    within = np.arange(int(count.sum())) - np.repeat(first, count)
    at = np.repeat(start, count) + 8 * within
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    return eights[at] & _FILLED[np.minimum(np.repeat(end, count) - at, 8)], within, first


def lane_hashes(values: np.ndarray, within: np.ndarray, first: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of `lanes`. Every eight bytes are scrambled with their place before they are
    summed, so no sum of powers is there to be met by other bytes."""
    if not len(length):
        return np.zeros(0, np.uint64)
    salt = np.uint64((seed + 1) * int(_STEP) & (2**64 - 1))
    parts = mix(values ^ mix(within.astype(np.uint64) * _STEP + salt))
    return mix(np.add.reduceat(parts, first) + length.astype(np.uint64) * _STEP + salt)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, none of them empty."""
    return lane_hashes(*lanes(data, start, end), end - start, seed)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give memory that NumPy and Arrow have freed back to the system; a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def shingle_hashes(word_hash: np.ndarray, text_of: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and their texts; a text of 1 to k - 1 words is one run."""
    factors = _powers(k, 0xD6E8FEB86659FD93)
    n = len(word_hash)
    parts, owners = [], []
    if n >= k:
        full = np.flatnonzero(text_of[: n - k + 1] == text_of[k - 1 :])
        total = np.zeros(len(full), np.uint64)
        for j in range(k):
            total += word_hash[full + j] * factors[j]
        parts.append(mix(total + np.uint64(k)))
        owners.append(text_of[full])
    counts = np.bincount(text_of, minlength=n_texts) if n else np.zeros(n_texts, np.int64)
    first = np.cumsum(counts) - counts
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for j in range(m):
                total += word_hash[first[short] + j] * factors[j]
            parts.append(mix(total + np.uint64(m)))
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner
