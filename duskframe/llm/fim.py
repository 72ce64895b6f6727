"""Fill-in-the-middle training texts: cut a text into prefix, middle and suffix at token bounds and turn the parts round.

Tokens are words with the white space before them, and white space at the end of a text. The bounds of all
texts of an Arrow batch are one packed bitvector, a bit for each byte, with a directory of the bits set before
each block. The number of tokens is a difference of two ranks, and a cut is one select. Everything but these
(draws, forms, assembly, restoring) is column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import small_batches
from .textbytes import GAP, release

#: Bytes of text that are turned into bits at once.
CHUNK = 1 << 20
#: Bytes of a block of the bitvector (eight bits each).
BLOCK = 64

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class BitVector:
    """Rank and select over packed bits, the first bit of a byte the highest."""

    def __init__(self, packed: np.ndarray):
        self.rows = np.zeros((len(packed) // BLOCK + 1, BLOCK), np.uint8)
        self.rows.reshape(-1)[: len(packed)] = packed
        self.before = np.zeros(len(self.rows) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.rows).sum(axis=1, dtype=np.int64), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each place."""
        at = np.asarray(at, np.int64)
        byte = at >> 3
        block, within = byte // BLOCK, byte % BLOCK
        masks = np.where(np.arange(BLOCK) < within[:, None], 0xFF, 0).astype(np.uint8)
        masks[np.arange(len(at)), within] = (0xFF00 >> (at & 7)) & 0xFF
        return self.before[block] + np.bitwise_count(self.rows[block] & masks).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th bit set, from 1."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, "left") - 1
        left = k - self.before[block]
        sums = np.cumsum(np.bitwise_count(self.rows[block]), axis=1, dtype=np.int64)
        byte = (sums < left[:, None]).sum(axis=1)
        at = np.arange(len(k))
        left = left - np.where(byte > 0, sums[at, np.maximum(byte - 1, 0)], 0)
        bits = np.cumsum(np.unpackbits(self.rows[block, byte][:, None], axis=1), axis=1, dtype=np.int64)
        return (block * BLOCK + byte) * 8 + (bits < left[:, None]).sum(axis=1)


def token_ends(data: np.ndarray, offsets: np.ndarray) -> BitVector:
    """A bit for the last byte of every token of a run of texts."""
    packed = np.zeros((len(data) + 7) // 8, np.uint8)
    for i in range(0, len(data), CHUNK):
        gap = GAP[data[i : i + CHUNK + 1]]
        ends = np.zeros(min(CHUNK, len(data) - i), bool)
        ends[: len(gap) - 1] = ~gap[:-1][: len(ends)] & gap[1:][: len(ends)]
        bits = np.packbits(ends)
        packed[i // 8 : i // 8 + len(bits)] = bits
    last = offsets[1:][np.diff(offsets) > 0] - 1
    np.bitwise_or.at(packed, last >> 3, (0x80 >> (last & 7)).astype(np.uint8))
    return BitVector(packed)


_CUTS = pa.struct([("n", pa.int64()), ("first", pa.int32()), ("second", pa.int32())])


def cut_texts(texts: pa.Array, one: np.ndarray, two: np.ndarray) -> pa.Array:
    """n tokens of each text, and the bytes before its cuts, after the smaller and the larger of one % (n + 1) and two % (n + 1) tokens."""
    if not len(texts):
        return pa.array([], _CUTS)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    at = at - at[0]
    ends = token_ends(data, at)
    before = ends.rank(at)
    n, before, start = np.diff(before), before[:-1], at[:-1]
    ranks = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    cuts = [np.where(r > 0, ends.select(np.where(r > 0, before + r, 1)) + 1 - start, 0) if before[-1] + n[-1] else np.zeros(len(n), np.int64) for r in ranks]
    return pa.StructArray.from_arrays([pa.array(n), pa.array(cuts[0].astype(np.int32)), pa.array(cuts[1].astype(np.int32))], fields=list(_CUTS))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and a key; a null key is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bytes(text: Column, first: Column, length: Column) -> Column:
    """Part of a text by bytes, from 0; both ends are ends of characters."""
    return F.substr(text.cast("binary"), first + F.lit(1), length).cast("string")


def transform(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output to every row; columns of these names are replaced.

    n counts tokens. `rate` percent of the texts are turned round, `spm_rate` percent of these suffix first. A
    text that is empty, or null, or holds one of the three marks stays as it is (form `plain`, null lengths).
    Draws come from the seed and the key alone: rows that share a key, or have none, share draws, and repeated rows
    give repeated results. Whole texts are cut, however long. An empty table gives no rows.
    """
    small_batches(df.sparkSession)

    def run(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        out = cut_texts(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False))
        release()
        return out

    body = F.coalesce(F.col(text), F.lit(""))
    one, two, three, four = draws(F.col(doc_id), seed)
    cut = F.arrow_udf(run, "struct<n:long,first:int,second:int>")(body, one, two)
    rows = df.withColumn("__cut", cut)
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (three % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(four % 100 < spm_rate, "spm").otherwise("psm"))
    first, second = F.col("__cut.first"), F.col("__cut.second")
    prefix, middle = _bytes(body, F.lit(0), first), _bytes(body, first, second - first)
    suffix = _bytes(body, second, F.octet_length(body) - second)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    turned = F.col("form") != "plain"
    columns = {
        "n": F.col("__cut.n"),
        "prefix_chars": F.when(turned, F.char_length(prefix).cast("long")),
        "middle_chars": F.when(turned, F.char_length(middle).cast("long")),
        "output": F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(body),
    }
    return rows.withColumns(columns).drop("__cut")


def restore(output: Column, form: Column) -> Column:
    """The text that `transform` has made `output` of. A turned text holds each mark once: no mark is in the text,
    and none can begin in one part and end in the next, as `<` only begins a mark."""
    mark = len(PREFIX)
    middle = F.substring_index(output, MIDDLE, -1)
    between = lambda head: _bytes(output, F.octet_length(head) + F.lit(mark), F.octet_length(output) - F.octet_length(middle) - F.octet_length(head) - F.lit(2 * mark))
    strip = lambda head: _bytes(head, F.lit(mark), F.octet_length(head) - F.lit(mark))
    head_spm, head_psm = F.substring_index(output, PREFIX, 1), F.substring_index(output, SUFFIX, 1)
    spm = F.concat(between(head_spm), middle, strip(head_spm))
    psm = F.concat(strip(head_psm), middle, between(head_psm))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)
