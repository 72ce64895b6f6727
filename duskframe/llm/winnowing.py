"""Document fingerprints by winnowing.

The grams are runs of GRAM words (a text of fewer words is one gram). Each gram has a 32-bit hash; of every
WINDOW grams in a row the one with the least hash is kept, the rightmost among equals, with its position.
Two texts that share GRAM + WINDOW - 1 words in a row share a kept gram.

Or they are runs of CHARS code points (`winnow_characters`), for texts of any script, with blanks or without:
texts that share CHARS + WINDOW - 1 code points in a row share a kept gram. Their hash is a rolling one, the cyclic
polynomial: of every code point's hash, turned left by the number of places to the last one, the exclusive or.
It is rolled by doubling, which is what arrays can do: the value of 2 k code points comes from two of k, and
both have other neighbours to serve. Only the upper half of a value is kept, and in runs of up to 32 code points
no turned bit comes round to it, so a shift to the left does what a turn would. A short text has windows
of a quarter or a sixteenth of WINDOW; what a wide window keeps, the narrow ones within it keep too.

A gram is one long: hash in the upper bits, 2^31 - 1 - position below, so the least long of a window is the
least hash and, among equals, the rightmost. Window minima come by doubling: minima over 2 grams, 4, 8, ...
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import GAP

GRAM = 5
WINDOW = 16
#: Code points of a gram of characters, a power of two, at most 32.
CHARS = 8
_LAST = 2**31 - 1


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """Packed (hash, position) of each run of k words."""
    n = F.size(words)
    at = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31) + (F.lit(_LAST) - i)
    grams = F.transform(at, lambda i: pack(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i))
    return F.when(n > 0, grams).otherwise(F.array().cast("array<bigint>"))


def winnow(text: Column, k: int = GRAM, window: int = WINDOW) -> Column:
    """The kept grams of a text in order of position: array<bigint>, hash and position packed.

    Null, empty and blank texts keep none. A text of fewer than `window` grams keeps its least one.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window: a power of two")
    # Each let() binds an array to a lambda variable, so that it is made once.
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def halve(span: int):
        def minima(grams: Column) -> Column:
            if span == window:
                return F.array_distinct(grams)
            pairs = F.transform(grams, lambda g, i: F.least(g, F.get(grams, i + span)))
            # A window must lie within the text; a text that is shorter than one is a window of its own.
            kept = F.slice(pairs, 1, F.greatest(F.size(pairs) - span, F.lit(1)))
            return let(kept, halve(span * 2))

        return minima

    def whole(words: Column) -> Column:
        grams = _grams(words, k)
        return let(grams, lambda g: F.when(F.size(g) >= window, halve(1)(g)).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g))

    return let(_words(text), whole)


def _let(value: Column, *steps) -> Column:
    """The value passed through the steps, each bound to a lambda variable, so that it is made once."""
    return F.element_at(F.transform(F.array(value), lambda x: _let(steps[0](x), *steps[1:])), 1) if steps else value


def _beside(values: Column, span: int, meet) -> Column:
    """Every value with the one `span` places on."""
    return F.zip_with(values, F.slice(values, span + 1, F.size(values)), meet)


def _plain(text: Column) -> Column:
    """The text with a blank for each character of white space: as long as before."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _spans(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1)]


def _pack(value: Column, at: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(value, 32), 31).bitwiseOR(F.lit(_LAST) - at)


def _character_grams(text: Column) -> Column:
    """Packed (hash, position) of the runs of CHARS code points of a text of as many or more."""
    half = CHARS // 2
    double = [lambda h, k=k: _beside(h, k, lambda x, y: F.shiftleft(x, k).bitwiseXOR(y)) for k in _spans(half)]
    # The last step gives the place as well, and leaves out runs that end beyond the text.
    last = lambda h: F.transform(F.slice(h, 1, F.size(h) - (CHARS - 1)), lambda x, i: _pack(F.shiftleft(x, half).bitwiseXOR(F.get(h, i + half)), i))
    return _let(F.transform(F.split(text, ""), lambda c: F.xxhash64(c)), *double, last)


def _least_of(grams: Column, window: int) -> Column:
    """The least of each window, each once."""
    minima = [lambda m, k=k: _beside(m, k, lambda x, y: F.least(x, y)) for k in _spans(window)]
    return _let(grams, *minima, lambda m: F.array_distinct(F.slice(m, 1, F.size(m) - (window - 1))))


def winnow_characters(text: Column) -> Column:
    """As `winnow`, of runs of CHARS code points in windows of WINDOW; every white space counts as a blank.

    Null and empty texts keep none. A text of fewer than CHARS code points is one gram. Of fewer than 4 * WINDOW
    grams the windows are WINDOW / 4, of fewer than WINDOW they are 1, so that a short text fills several.
    """
    short = lambda t: F.array(_pack(F.xxhash64(t), F.lit(0)))
    minima = lambda g: F.when(F.size(g) >= 4 * WINDOW, _least_of(g, WINDOW)).when(F.size(g) >= WINDOW, _least_of(g, WINDOW // 4)).otherwise(g)
    none = F.array().cast("array<bigint>")
    return _let(_plain(text), lambda t: F.when(t == "", none).when(F.char_length(t) < CHARS, short(t)).otherwise(_let(_character_grams(t), minima)))


def winnow_edited(kept: Column, text: Column, same: Column, more: Column) -> Column:
    """`winnow_characters` of the first `same` code points of a text and `more`, from what the text keeps.

    Windows that lie within the first part keep what they kept; only those that reach the rest are made anew.
    """
    full = 4 * WINDOW + CHARS - 1  # code points from which the windows are wide
    reach = CHARS + WINDOW - 2  # of a window that begins here, the code points after the first
    position = lambda g: F.lit(_LAST) - g.bitwiseAND(F.lit(_LAST))

    def first_window(g: Column, before: Column) -> Column:
        """Where the first window begins that keeps g, if the one kept before it is `before`."""
        enters = F.shiftrightunsigned(g, 31) <= F.shiftrightunsigned(before, 31)
        return F.when(enters, position(g) - (WINDOW - 1)).otherwise(position(before) + 1)

    begin = same - reach  # the first window that reaches the rest
    # A gram before `begin` is kept by a window before it; only those just beyond need a look.
    near = lambda g, i: (position(g) < begin + (WINDOW - 1)) & (first_window(g, F.get(kept, i - 1)) < begin)
    old = F.filter(kept, lambda g, i: (i == 0) | (position(g) < begin) | near(g, i))
    rest = F.concat(F.substring(text, begin + 1, F.lit(reach)), more)
    new = F.transform(_let(_character_grams(_plain(rest)), lambda g: _least_of(g, WINDOW)), lambda g: g - begin)
    joined = F.when(F.char_length(more) > 0, F.concat(old, new)).otherwise(old)
    known = (F.char_length(text) >= full) & (begin > 0) & (same + F.char_length(more) >= full)
    return F.when(known, F.array_distinct(joined)).otherwise(winnow_characters(F.concat(F.substring(text, F.lit(1), same), more)))


def gram_hashes(kept: Column) -> Column:
    """Distinct hashes (0 to 2^32 - 1) of kept grams."""
    return F.array_distinct(F.transform(kept, lambda g: F.shiftrightunsigned(g, 31)))


def gram_positions(kept: Column) -> Column:
    """Positions (of words or code points), from 0, of kept grams."""
    return F.transform(kept, lambda g: F.lit(_LAST) - g.bitwiseAND(F.lit(_LAST)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness, 0 to 1, of two arrays of distinct hashes; two empty ones are alike."""
    met = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), F.size(F.array_intersect(a, b)).alias("both"))), lambda x: F.struct((F.size(x["a"]) + F.size(x["b"]) - x["both"]).alias("either"), x["both"].alias("both")))
    met = F.get(met, 0)
    return F.when(met["either"] == 0, F.lit(1.0)).otherwise(met["both"] / met["either"])


def fingerprint_text(kept: Column) -> Column:
    """Kept grams as text: hash in hex, "@", position; in order of position, parted by blanks."""
    return F.array_join(F.transform(kept, lambda g: F.concat(F.lower(F.hex(F.shiftrightunsigned(g, 31))), F.lit("@"), (F.lit(_LAST) - g.bitwiseAND(F.lit(_LAST))).cast("string"))), " ")


def fingerprint(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions of the kept grams of every text."""
    kept = df.select(F.col(doc_id).alias("doc_id"), winnow(F.col(text), k, window).alias("kept"))
    return kept.select("doc_id", F.transform("kept", lambda g: F.shiftrightunsigned(g, 31)).alias("hashes"), gram_positions(F.col("kept")).alias("positions"))


#: Ranges of ids in which the rows are put in order; their bounds and first ids are all that the driver holds.
RANGES = 1024


def _range_of(key: Column, marks: list[float]) -> Column:
    """How many of the sorted marks are at most `key`: first by every step-th of them, then among those that follow."""
    if not marks:
        return F.lit(0)
    step = math.isqrt(len(marks)) + 1
    groups = [marks[i : i + step] for i in range(0, len(marks), step)]
    up_to = lambda values: F.size(F.filter(values, lambda m: m <= key))
    literal = lambda values: F.array(*[F.lit(m) for m in values])
    passed = up_to(literal([g[0] for g in groups]))
    return F.when(passed == 0, 0).otherwise((passed - 1) * step + up_to(F.get(F.array(*[literal(g) for g in groups]), passed - 1)))


def with_next(df: DataFrame, columns: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """Rows of (doc_id long, text) with `columns`, and `next`: a struct of these and of doc_id and text of the row
    that follows by doc_id, then by the hash of the text; the first follows the last. Null ids come first.

    The rows are dealt into ranges by approximate quantiles of (doc_id, hash), so rows that repeat an id, or have
    none, are dealt too, unless their texts are equal as well. Texts are shuffled once. The first row of a range
    goes to the range before it as well, as the last row's next. `columns` are made after that, once for each row.
    """
    # A double in the order of (doc_id, hash): rounding may make ties, never turn the order.
    within = F.col("__hash").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    key = F.when(F.col("doc_id").isNull(), F.lit(-(2.0**64)) + within * F.lit(2.0**62)).otherwise(F.col("doc_id").cast("double") + within)
    rows = df.select("doc_id", "text").withColumn("__hash", F.xxhash64("text"))
    marks = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []  # `ranges` - 1 numbers
    rows = rows.withColumn("__range", _range_of(key, sorted(set(marks))))
    firsts = sorted(rows.groupBy("__range").agg(F.min(F.struct("doc_id", "__hash")).alias("least")).collect(), key=lambda r: r["__range"])  # a row for each range
    if firsts:
        before = {r["__range"]: (r["least"]["doc_id"], r["least"]["__hash"], firsts[i - 1]["__range"]) for i, r in enumerate(firsts)}
        at = lambda k, kind: F.get(F.array(*[F.lit(before.get(r, (None,) * 3)[k]).cast(kind) for r in range(firsts[-1]["__range"] + 1)]), F.col("__range"))
        is_first = F.col("doc_id").eqNullSafe(at(0, "long")) & (F.col("__hash") == at(1, "long"))
        ends = F.when(is_first, F.array(F.struct(F.col("__range").alias("__in"), F.lit(False).alias("__again")), F.struct(at(2, "int").alias("__in"), F.lit(True).alias("__again"))))
        rows = rows.select("doc_id", "text", "__hash", F.inline(F.coalesce(ends, F.array(F.struct(F.col("__range").alias("__in"), F.lit(False).alias("__again"))))))
    else:
        rows = rows.select("doc_id", "text", "__hash", F.col("__range").alias("__in"), F.lit(False).alias("__again"))
    rows = rows.repartition("__in").withColumns(columns)
    order = Window.partitionBy("__in").orderBy("__again", F.col("doc_id").asc_nulls_first(), "__hash")
    return rows.withColumn("next", F.lead(F.struct("doc_id", "text", *columns)).over(order)).filter("not __again").drop("__hash", "__in", "__again")


def compare_with_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = GRAM, window: int = WINDOW, characters: bool = False) -> DataFrame:
    """doc_id, next_id, n_chars, edited_sha256, kept, edited_kept (packed grams), near_edited, near_next.

    A text is edited: its last quarter (its length in code points by 4, rounded down) is replaced by as many, or
    all, of the first code points of the next document, that of the next larger id; after the largest comes the
    least. Null texts count as empty, null ids come first. Rows that repeat an id follow one another. An empty
    table gives no rows. With `characters` the grams are those of `winnow_characters`, else k words in windows of
    `window`. Every text is fingerprinted once.
    """
    kept = winnow_characters if characters else lambda t: winnow(t, k, window)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(docs, {"kept": kept(F.col("text"))})
    n = F.char_length("text")
    rows = rows.withColumn("same", (n - F.floor(n / 4)).cast("int")).withColumn("head", F.substring("next.text", F.lit(1), n - F.col("same")))
    edited = F.concat(F.substring("text", F.lit(1), F.col("same")), "head")
    edited_kept = winnow_edited(F.col("kept"), F.col("text"), F.col("same"), F.col("head")) if characters else kept(edited)
    rows = rows.select("doc_id", F.col("next.doc_id").alias("next_id"), n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), "kept", edited_kept.alias("edited_kept"), gram_hashes(F.col("kept")).alias("own"), gram_hashes(F.col("next.kept")).alias("after"))
    near_edited, near_next = likeness(F.col("own"), gram_hashes(F.col("edited_kept"))), likeness(F.col("own"), F.col("after"))
    return rows.select("doc_id", "next_id", "n_chars", "edited_sha256", "kept", "edited_kept", near_edited.alias("near_edited"), near_next.alias("near_next"))
