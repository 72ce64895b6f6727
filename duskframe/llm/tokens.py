"""Token counts of a unigram tokenizer, without making the tokens.

The best segmentation of a text is the one whose pieces have the greatest sum of scores. An Aho-Corasick
automaton gives, for each place, the pieces that end there; dynamic programming carries the best sum and its
number of pieces. Ties go as the tokenizer breaks them: of equal sums the piece that begins first. A character
that no piece covers alone may also stand as unknown, at UNKNOWN_PENALTY below the least score, and counts as
its bytes.

No piece has a blank after another character, so a text falls into segments, each the blanks before a word
and the word, and its best segmentation is that of its segments. A segment that is met again is not scored
again while it is remembered. Sums are exact here; the tokenizer's own are of single precision.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes
from .columns import small_batches

#: The tokenizer's constant: what an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Bytes of segments (and ENTRY more for each) that a worker remembers; beyond them all are forgotten.
REMEMBERED = 32 << 20
ENTRY = 150
BLANK = "▁"


class UnigramCounter:
    """Counts pieces under a vocabulary of (piece, score)."""

    def __init__(self, pieces: Iterable[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        self.single, least, self.split, self.longest = set(), 0.0, True, 1
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
            least = min(least, score)
            self.longest = max(self.longest, len(piece))
            if len(piece) == 1:
                self.single.add(piece)
            if BLANK in piece.lstrip(BLANK):
                self.split = False
        self.automaton.make_automaton()
        self.unknown, self.byte_fallback = least - UNKNOWN_PENALTY, byte_fallback
        self.counts: dict[bytes, int] = {}
        self.held = 0

    def count(self, text: str) -> int:
        """Pieces of a text in which blanks are already marked."""
        n = len(text)
        # No piece reaches further back than the longest, so the places behind it are used again.
        mask = (1 << min(self.longest, n).bit_length()) - 1
        best, pieces = [0.0] * (mask + 1), [0] * (mask + 1)
        single, at = self.single, 0
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end in range(1, n + 1):
            score, count, known = 0.0, 0, False
            while match is not None and match[0] == end - 1:  # the longest piece first
                length, own = match[1]
                at = (end - length) & mask
                own += best[at]
                if not known or own > score:
                    score, count, known = own, pieces[at] + 1, True
                match = next(matches, None)
            char = text[end - 1]
            if char not in single:
                at = (end - 1) & mask
                own = best[at] + self.unknown
                if not known or own > score:
                    score, count = own, pieces[at] + (len(char.encode()) if self.byte_fallback else 1)
            at = end & mask
            best[at], pieces[at] = score, count
        return pieces[n & mask]

    def boundaries(self, part: np.ndarray) -> np.ndarray:
        """The last place in a stretch of bytes that no piece lies across, if any: segmentations of both sides are apart."""
        text, lead = textbytes.characters(part)
        text, far = text.replace(" ", BLANK), self.longest
        for place in range(len(text) - far, far, -1):
            if not any(text[a:b] in self.automaton for a in range(place - 1, place - far, -1) for b in range(place + 1, a + far + 1)):
                return lead[place : place + 1]
        return lead[:0]

    def count_run(self, data: np.ndarray, offsets: np.ndarray, later: bool = False) -> np.ndarray:
        """Pieces of each of a run of texts. A blank is put before each text that isn't empty, but not before a
        `later` part of one."""
        n = len(offsets) - 1
        total = np.zeros(n, np.int64)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if not len(filled):
            return total
        blank = data if later else np.insert(data, offsets[filled], 0x20)
        first = offsets[filled] + (0 if later else np.arange(len(filled)))
        start = np.zeros(len(blank), bool)
        if self.split:
            start[1:] = (blank[1:] == 0x20) & (blank[:-1] != 0x20)
        start[first] = True
        start = np.flatnonzero(start)
        end = np.append(start[1:], len(blank))
        values, within, at = textbytes.lanes(blank, start, end)
        _, one, back = np.unique(textbytes.lane_hashes(values, within, at, end - start), return_index=True, return_inverse=True)
        # Hashes only bring equal segments together; a segment that differs from the first of its hash stands alone.
        same = (end - start) == (end - start)[one][back]
        lanes = np.diff(np.append(at, len(values)))
        other = np.repeat(at[one][back], lanes) + within
        same &= np.logical_and.reduceat(values == values[np.minimum(other, len(values) - 1)], at)
        alone = np.flatnonzero(~same)
        back[alone] = len(one) + np.arange(len(alone))
        one = np.append(one, alone)
        raw, known, counts = blank.tobytes(), self.counts, np.empty(len(one), np.int64)
        for k, (a, b) in enumerate(zip(start[one].tolist(), end[one].tolist())):
            segment = raw[a:b]
            found = known.get(segment)
            if found is None:
                found = self.count(segment.decode("utf-8").replace(" ", BLANK))
                self.held += ENTRY + b - a
                if self.held > REMEMBERED:
                    known.clear()
                    self.held = ENTRY + b - a
                known[segment] = found
            counts[k] = found
        owner = filled[np.searchsorted(first, start, "right") - 1]
        return np.bincount(owner, counts[back], n).astype(np.int64)


def read_pieces(model: bytes) -> list[tuple[str, float]]:
    """Pieces that match text, with their scores, of a sentencepiece model file."""
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return [(m.id_to_piece(i), m.get_score(i)) for i in ids]


_COUNTERS: dict[bytes, UnigramCounter] = {}


def load(spark: SparkSession, path: str):
    """Read a model file on the driver, for use in `count_tokens`. Vocabularies have a fixed size."""
    small_batches(spark)
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def count_tokens(text: Column, model) -> Column:
    """Number of tokens of a text; 0 for null and empty texts."""

    def run(texts: pa.Array) -> pa.Array:
        raw = model.value
        if raw not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[raw] = UnigramCounter(read_pieces(raw))
        counter, out = _COUNTERS[raw], np.zeros(len(texts), np.int64)
        for i, j, data, at, part in textbytes.blocks(texts, cuts=counter.boundaries):
            out[i:j] += counter.count_run(data, at, part == -1)
        textbytes.release()
        return pa.array(out)

    return F.arrow_udf(run, "long")(F.coalesce(text, F.lit("")))


def count_documents(df: DataFrame, model, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of every row's text: 0 for null and empty texts.

    A text of any length is counted in parts that no piece lies across. Repeated rows are counted each; an empty table gives no rows. A column `name` of the input is replaced,
    other columns pass through.
    """
    return df.withColumn(name, count_tokens(F.col(text), model))
