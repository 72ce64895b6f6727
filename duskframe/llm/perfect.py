"""Minimal perfect hashing of 64-bit keys, by levels of bitmaps.

On each level the keys that are left are hashed into GAMMA bits each, or up to twice as many; a key that is alone on its bit stays
there, the others go to the next level. A key's number is the rank of its bit over all levels, so n keys get
the numbers 0 to n - 1. Look-ups of arrays of keys are a few gathers a level.
"""

from __future__ import annotations

import numpy as np

from .textbytes import mix

GAMMA = 4
_MASK = 2**64 - 1


class PerfectHash:
    """Numbers for a set of distinct keys; `find` gives -1 for any other key."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, before = keys, 0
        while len(left):
            bits = max(64, 1 << (GAMMA * len(left) - 1).bit_length())
            at = self._place(left, len(self.levels), bits)
            count = np.bincount(at, minlength=bits)
            alone = count == 1
            packed = np.packbits(alone, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)
            ranks = before + np.cumsum(np.bitwise_count(packed), dtype=np.int64) - np.bitwise_count(packed)
            self.levels.append((bits, packed, ranks.astype(np.int32)))
            before += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.empty(len(keys), np.uint64)
        self.keys[self._number(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & _MASK)) & np.uint64(bits - 1)).view(np.int64)

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, packed, ranks) in enumerate(self.levels):
            at = self._place(keys[todo], level, bits)
            word, bit = packed[at >> 6], (at & 63).astype(np.uint64)
            here = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[here]] = ranks[at[here] >> 6] + below[here]
            todo = todo[~here]
            if not len(todo):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it isn't of the set."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._number(keys)
        out[self.keys[np.maximum(out, 0)] != keys] = -1
        return out  # of the keys themselves, so another key is never taken for one of them
