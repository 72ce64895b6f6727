"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (1 to 3 characters, hashed to BUCKETS) are summed by language over all training rows on
the executors; what comes to the driver and is broadcast is one float for each bucket and language, whose
number of bytes is fixed by BUCKETS and checked against the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .columns import small_batches

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
#: Pseudo-count of every n-gram in every language.
ALPHA = 0.5
#: The broadcast matrix has BUCKETS x MAX_LANGUAGES floats at most: 128 MB.
MAX_LANGUAGES = 512
UNKNOWN = "und"

# Lower case for the letters below U+0250 that have a lower case of one character.
_LOWER = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a run of UTF-8 texts, and the texts' offsets among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offsets]


def gram_buckets(data: np.ndarray, offsets: np.ndarray, lead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, texts) of the n-grams of a run of texts that end after its first `lead` bytes, in order of text."""
    lead = int(np.count_nonzero((data[:lead] & 0xC0) != 0x80))
    points, offsets = code_points(data, offsets)
    low = points < len(_LOWER)
    points = np.where(low, _LOWER[np.where(low, points, 0)], points).astype(np.uint64)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in GRAMS:
        first = max(0, lead - n + 1)
        stop = len(points) - n + 1
        if stop <= first:
            continue
        total = np.full(stop - first, n, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + points[first + k : stop + k]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        whole = text_of[first:stop] == text_of[first + n - 1 :]
        yield (total >> np.uint64(48)).astype(np.int64)[whole], text_of[first:stop][whole]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])
        for i, j, data, offsets, lead in textbytes.blocks(batch.column("text"), lead=max(GRAMS) - 1):
            for buckets, text_of in gram_buckets(data, offsets, lead):
                found = np.bincount(number[i:j][text_of] * BUCKETS + buckets, minlength=len(names) * BUCKETS)
                for k, name in enumerate(names):
                    counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    counts[name] += found[k * BUCKETS : (k + 1) * BUCKETS]
    textbytes.release()
    for name, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


class LanguageModel:
    """Languages and the matrix of log probabilities, BUCKETS x languages, with log priors."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def likelihood(self, data: np.ndarray, offsets: np.ndarray, lead: int = 0) -> np.ndarray:
        """Log likelihoods of what follows the first `lead` bytes, texts x languages."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for buckets, text_of in gram_buckets(data, offsets, lead):
            if len(buckets):
                first = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]])
                total[text_of[first]] += np.add.reduceat(self.matrix[buckets], first, axis=0, dtype=np.float64)
        return total


def train(rows: DataFrame) -> LanguageModel:
    """Fit to all rows of (text, lang) with both known. No rows give a model without languages."""
    small_batches(rows.sparkSession)
    rows = rows.filter("text is not null and lang is not null").select("text", "lang")
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(priors) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(priors)
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # BUCKETS x languages rows at most
    matrix = np.full((len(languages), BUCKETS), ALPHA)
    if table.num_rows:
        which = {x: i for i, x in enumerate(languages)}
        matrix[[which[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] += table["n"].to_numpy()
    matrix = np.log(matrix) - np.log(matrix.sum(1, keepdims=True))
    prior = np.log(np.array([priors[x] for x in languages], float) / max(1, sum(priors.values())))
    return LanguageModel(languages, np.ascontiguousarray(matrix.T.astype(np.float32)), prior)


def predict(df: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the likeliest language and its posterior probability.

    Null and empty texts, and texts without a letter, are "und" with score 0, as is every text under a model
    without languages. Equal likelihoods go to the language that sorts first.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def guess(texts: pa.Array) -> pa.Array:
        model = shared.value
        total = np.tile(model.prior, (len(texts), 1))
        for i, j, data, offsets, lead in textbytes.blocks(texts, lead=max(GRAMS) - 1):
            total[i:j] += model.likelihood(data, offsets, lead)
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        textbytes.release()
        return pa.StructArray.from_arrays([pa.array(model.languages, pa.string()).take(pa.array(best)), pa.array(score)], ["lang", "score"])

    if not model.languages:
        return df.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    letters: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = F.arrow_udf(guess, "lang string, score double")(F.coalesce(F.col(text), F.lit("")))
    out = df.withColumn("__found", found)
    return out.withColumns({lang: F.when(letters, F.col("__found")["lang"]).otherwise(UNKNOWN), score: F.when(letters, F.col("__found")["score"]).otherwise(0.0)}).drop("__found")
