"""Toxicity by class-conditional Kneser-Ney language models.

Two character models, one of toxic and one of ordinary documents, are compared by their log likelihoods for
a document, divided by its number of characters (and SHORT more). Characters rather than words, since abuse
is inflected: a stem tells, the form it is met in may be new.

A class's model is of 4-grams: how many of its documents hold each (so a line that one document repeats is no
more evidence than one), over all labelled rows that may be learnt from. It is discounted and backs off to
trigrams, bigrams and characters that both classes share. These are Kneser-Ney continuation counts, of all
documents, labelled or not: a gram counts once for each character that is met before it, however often copies
repeat it. Each level has modified Kneser-Ney discounts of its own.

A gram of up to four characters is one number, 16 bits for each. The tables have a row for each distinct gram
and written, and the MAX_GRAMS rows of each that most documents hold are broadcast, a bound of 100 MB. Places of a text whose
grams are all among them are scored in the task; what any other place is worth comes from the written tables, by joins on
its gram, so scores are those of all grams however many there are. (`ToxicityModel` can also be pruned, as back-off
models are: then only the MAX_GRAMS with most evidence keep rows, and the whole count of any other goes to the lower
order. `train` does not.) A logistic curve, fitted on a sample of labelled documents that gave no counts, turns the
difference into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes
from .columns import small_batches
from .langid import code_points
from .perfect import PerfectHash
from .scratch import Scratch

ORDER = 4
#: One labelled document in FIT is left for the curve, the others give counts. The curve is fitted on at most
#: SAMPLE_DOCS documents of each class, those with the least hashes of their ids.
FIT = 5
SAMPLE_DOCS = 4000
#: Rows of each table that are broadcast at most.
MAX_GRAMS = 1 << 21
#: Distinct grams that a task gathers before it passes them on.
HELD = 1 << 20
#: Differences further than this from the middle of the curve are no stronger evidence.
CLIP = 0.1
#: How much more precision weighs than recall where the curve is placed.
PRECISION = 2.0
#: Characters without evidence that are added to a text's length: a short text proves little.
SHORT = 200

# Lower case for letters and digits below U+0250, blank for the rest.
_FOLD = np.full(0x250, 32, np.uint32)
for _c in range(0x250):
    if chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if len(chr(_c).lower()) == 1 else _c


def characters(data: np.ndarray, offsets: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of a run of texts, with blanks before each; where the texts' own are, but for the first
    `lead` bytes; whose they are. Characters beyond 16 bits share the numbers of the private use area."""
    lead = int(np.count_nonzero((data[:lead] & 0xC0) != 0x80))
    points, offsets = code_points(data, offsets)
    low = points < len(_FOLD)
    points = np.where(low, _FOLD[np.where(low, points, 0)], points)
    points = np.where((points >= 0x2000) & (points < 0x2070), np.uint32(32), points)
    points = np.where(points >= 0x10000, 0xE000 + points % 0x1900, points)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(points)) + (ORDER - 1) * (text_of + 1)
    out = np.full(len(points) + (ORDER - 1) * (len(offsets) - 1), 32, np.uint64)
    out[at] = points
    return out, at[lead:], text_of[lead:]


def grams(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n characters that end at each place, as one number."""
    total = points[at - (n - 1)]
    for k in range(n - 2, -1, -1):
        total = (total << np.uint64(16)) | points[at - k]
    return total


class _Tally:
    """Distinct grams, and how many ordinary and toxic documents hold them."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, keys: np.ndarray, toxic: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take grams that are each distinct within a document; toxic is 1, 0, or -1 for no label."""
        keys, back = np.unique(keys, return_inverse=True)
        self.parts.append((keys, *[np.bincount(back, toxic == c, len(keys)).astype(np.int64) for c in (0, 1)]))
        self.rows += len(keys)
        if self.rows > 2 * HELD:
            self.parts = [self.total()]
            self.rows = len(self.parts[0][0])
            if self.rows > HELD:
                yield from self.out()

    def total(self) -> tuple:
        keys, back = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return keys, *[np.bincount(back, np.concatenate([p[c] for p in self.parts]), len(keys)).astype(np.int64) for c in (1, 2)]

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, n0, n1 = self.total()
            self.parts, self.rows = [], 0
            for a in range(0, len(keys), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(n0[part]), pa.array(n1[part])], ["gram", "n0", "n1"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        long_text: list[np.ndarray] = []  # of the parts of one text
        own = -1
        for i, j, data, offsets, lead in textbytes.blocks(batch.column("text"), lead=ORDER - 1):
            if not lead and long_text:
                keys = np.unique(np.concatenate(long_text))
                yield from tally.add(keys, np.full(len(keys), own))
                long_text = []
            points, at, text_of = characters(data, offsets, lead)
            if not len(at):
                continue
            whole = grams(points, at, ORDER)
            if j == i + 1:
                long_text.append(np.unique(whole))
                own = toxic[i]
                continue
            # One of each gram of each labelled text; texts without a label are as one.
            group = np.where(toxic[i:j] < 0, 0, np.arange(1, j - i + 1)).astype(np.uint64)[text_of]
            order = textbytes.mix(whole ^ textbytes.mix(group)).argsort()
            whole, group, text_of = whole[order], group[order], text_of[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (whole[1:] != whole[:-1]) | (group[1:] != group[:-1])
            yield from tally.add(whole[fresh], toxic[i:j][text_of[fresh]])
        if long_text:
            keys = np.unique(np.concatenate(long_text))
            yield from tally.add(keys, np.full(len(keys), own))
    yield from tally.out()
    textbytes.release()


def gram_counts(rows: DataFrame) -> DataFrame:
    """gram, n0, n1: every distinct 4-gram of the texts of (text, toxic), and how many rows of toxic 0 and 1 hold
    it. Rows of another toxic only make the gram known."""
    found = rows.mapInArrow(_count, "gram long, n0 long, n1 long")
    return found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney: the discounts of counts 1, 2 and more, by the numbers of singletons, pairs, triples and
    quadruples."""
    n = [max(1, x) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.5 * k), 0.95 * k) for k in (1, 2, 3)]


def _discounts_of(table: DataFrame, *columns: str) -> list[list[float]]:
    row = table.agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in columns for k in (1, 2, 3, 4)]).first()
    return [discounts([row[f"{c}{k}"] for k in (1, 2, 3, 4)]) for c in columns]


def _taken(count: Column, d: list[float]) -> Column:
    return F.when(count <= 0, F.lit(0.0)).when(count == 1, F.lit(d[0])).when(count == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def _kept(rows: DataFrame, evidence: Column, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Rows of one gram each, written, with `kept`: whether the gram is among the MAX_GRAMS with most evidence; and
    whether all are."""
    rows = scratch.save(rows)
    if rows.count() <= MAX_GRAMS:
        return rows.withColumn("kept", F.lit(True)), True
    most = scratch.save(rows.select("gram", evidence.alias("evidence")).orderBy(F.desc("evidence"), "gram").limit(MAX_GRAMS).select("gram", F.lit(True).alias("kept")))
    return scratch.save(rows.join(most, "gram", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))), False


def _values(counts: dict[str, list[float]], contexts: dict[str, str]) -> list[Column]:
    """What the model holds of each gram. As a gram: its discounted counts. As a context of others: one by their total
    (0 if there is none), and the share of it that the lower order has (then 1). `counts`: columns and their discounts,
    `contexts`: columns of totals and those of what was taken off them."""
    own = [F.col(c) - _taken(F.col(c), d) for c, d in counts.items()]
    inverse = [F.when(F.col(c) > 0, 1 / F.col(c)).otherwise(F.lit(0.0)) for c in contexts]
    share = [F.when(F.col(c) > 0, F.col(t) / F.col(c)).otherwise(F.lit(1.0)) for c, t in contexts.items()]
    return [v.cast("float").alias(f"v{k}") for k, v in enumerate(own + inverse + share)]


class _Table:
    """`_values` of the kept grams, in memory. Any other gram has the values of one that was never met."""

    def __init__(self, rows: DataFrame, counts: dict[str, list[float]], contexts: dict[str, str]):
        """`rows` of `_kept`."""
        table = rows.filter("kept").select("gram", *_values(counts, contexts)).toArrow()  # MAX_GRAMS rows at most
        keys = table["gram"].to_numpy().view(np.uint64)
        self.hash = PerfectHash(keys)
        self.values = np.zeros((len(keys) + 1, table.num_columns - 1), np.float32)
        self.values[:, self.values.shape[1] - len(contexts) :] = 1
        self.values[self.hash.find(keys)] = np.stack([table[k].to_numpy() for k in range(1, table.num_columns)], 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """A row for each gram."""
        return self.values[self.hash.find(keys)]  # -1: the last row, that of grams that were never met


class ToxicityModel:
    """Tables of both classes and the curve. Class 0 is ordinary, 1 is toxic."""

    def __init__(self, counts: DataFrame, scratch: Scratch, prune: bool = True):
        """From `gram_counts`. Beyond MAX_GRAMS the model is pruned, or, without `prune`, the rows that are not in
        memory are looked up by `differences` in the tables that `scratch` holds."""
        self.rest: dict[int, DataFrame] = {}  # all rows of each order, where some are not in memory
        nothing = lambda names: [F.lit(0.0).alias(c) for c in names]
        # What a gram leaves to the lower order: its discount or, if it is not kept, all of its count.
        left = lambda c, d: F.when(F.col("kept") | F.lit(not prune), _taken(F.col(c), d)).otherwise(F.col(c).cast("double"))
        context = F.shiftrightunsigned("gram", 16).alias("gram")
        top = counts.filter("n0 + n1 > 0")
        d = _discounts_of(top, "n0", "n1")
        # Of both classes, the grams whose shares differ most; the others are much the same in the shared lower orders.
        n0, n1 = (float(x or 0) for x in top.agg(F.sum("n0"), F.sum("n1")).first())
        top, every = _kept(top, F.abs(F.col("n1") * F.lit(n0) - F.col("n0") * F.lit(n1)) if prune else F.col("n0") + F.col("n1"), scratch)
        whole = [every]
        full = {ORDER: top.select("gram", *_values(dict(zip(("n0", "n1"), d)), {}))}
        self.tables = {ORDER: _Table(top, dict(zip(("n0", "n1"), d)), {})}
        above = top.select(context, *[F.col(f"n{c}").cast("double").alias(f"c{c}") for c in (0, 1)], *[left(f"n{c}", d[c]).alias(f"t{c}") for c in (0, 1)])
        contexts = {"c0": "t0", "c1": "t1"}
        types = counts
        for m in range(ORDER - 1, 0, -1):
            types = types.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 16 * m) - 1)).alias("gram")).agg(F.count("*").cast("double").alias("n"))
            names = [*contexts, *contexts.values()]
            rows = types.select("gram", "n", *nothing(names)).unionByName(above.select("gram", *nothing("n"), *names))
            rows = rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
            if m == 1 and not prune:
                rows = scratch.save(rows).withColumn("kept", F.lit(True))  # a row for each of 2^16 characters at most
            else:
                rows, every = _kept(rows, sum((F.col(c) for c in contexts), F.col("n")), scratch)
                whole.append(every)
            types = rows.filter("n > 0")
            (d,) = _discounts_of(types, "n")
            full[m] = rows.select("gram", *_values({"n": d}, contexts))
            self.tables[m] = _Table(rows, {"n": d}, contexts)
            above, contexts = types.select(context, F.col("n").alias("c"), left("n", d).alias("t")), {"c": "t"}
        if not prune and not all(whole):
            self.rest = full
        self.partial = {m for m, every in zip(range(ORDER, 1, -1), whole) if not every} if self.rest else set()
        row = above.agg(F.sum("c"), F.sum("t"), F.count("*")).first()
        # Of characters: one by their number, and what each has of those that were never met.
        self.base = (1.0 / (row[0] or 1), (row[1] or 1.0) / (row[0] or 1) / ((row[2] or 0) + 1))
        # All characters are looked up in one array.
        self.tables[1] = self.tables[1].get(np.arange(1 << 16, dtype=np.uint64))
        self.classes = top.agg(F.max("n0"), F.max("n1")).first()
        self.slope, self.middle = 0.0, 0.0
        self._sent = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_sent", "rest")}

    def sent(self, spark):
        """The model as a broadcast, made once."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    def probabilities(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """P(character | three before it) at each place as ordinary and as toxic, two columns; and at which places a
        row may be among those that are not in memory, None if all are there."""
        every = np.arange(ORDER - 2, len(points))  # all that have two characters before them
        where = at - every[0]
        ctx = self.tables[1][points[every].view(np.int64)]
        p = ctx[where, 0] * self.base[0] + self.base[1]
        unsure = np.zeros(len(at), bool) if self.partial else None
        for m in range(2, ORDER):
            number = self.tables[m].hash.find(grams(points, every, m))
            rows = self.tables[m].values[number]
            if m in self.partial:
                unsure |= (number[where] < 0) | (number[where - 1] < 0)
            up = ctx[where - 1]
            p = rows[where, 0] * up[:, 1] + up[:, 2] * p
            ctx = rows
        number, up = self.tables[ORDER].hash.find(grams(points, at, ORDER)), ctx[where - 1]
        if ORDER in self.partial:
            unsure |= number < 0
        return self.tables[ORDER].values[number] * up[:, 1:3] + up[:, 3:5] * p[:, None], unsure

    def compare(self, data: np.ndarray, offsets: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood as toxic less that as ordinary of each text, and its number of characters, after `lead` bytes."""
        return self.compare_known(data, offsets, lead)[:2]

    def compare_known(self, data: np.ndarray, offsets: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray, tuple]:
        """`compare` over the places whose rows are all in memory; the other places, in order of texts: the text, the
        4-gram, and how often it is met."""
        points, at, text_of = characters(data, offsets, lead)
        n, none = len(offsets) - 1, (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if not len(at):
            return np.zeros(n), np.zeros(n), none
        p, unsure = self.probabilities(points, at)
        value = np.log(p[:, 1] / p[:, 0])
        if unsure is None or not unsure.any():
            return np.bincount(text_of, value, n), np.bincount(text_of, minlength=n), none
        keys, owner = grams(points, at[unsure], ORDER), text_of[unsure]
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        times = np.diff(np.r_[first, len(keys)])
        return np.bincount(text_of, np.where(unsure, 0.0, value), n), np.bincount(text_of, minlength=n), (owner[first], keys[first], times)

    def values_of(self, met: DataFrame) -> DataFrame:
        """gram, value of 4-grams (gram): log P as toxic less that as ordinary of the last character, from the written
        tables, by the rule of `probabilities`."""
        before = F.shiftrightunsigned("gram", 16)
        cut = lambda c, m: c.bitwiseAND(F.lit((1 << 16 * m) - 1))
        rows = met
        # Of each order the gram that ends here, and (but for the highest) the one that ends a character before.
        for m in range(1, ORDER + 1):
            table = self.rest[m]
            keys = {"g": F.col("gram")} if m == ORDER else {"g": cut(F.col("gram"), m), "c": cut(before, m)}
            for kind, key in keys.items():
                wanted = table.select(F.col("gram").alias(f"{kind}{m}"), *[F.col(c).cast("double").alias(f"{kind}{m}_{c}") for c in table.columns[1:]])
                rows = rows.withColumn(f"{kind}{m}", key).join(wanted, f"{kind}{m}", "left")
        v = lambda name, nothing: F.coalesce(F.col(name), F.lit(nothing))
        p = v("g1_v0", 0.0) * F.lit(float(self.base[0])) + F.lit(float(self.base[1]))
        for m in range(2, ORDER):
            p = v(f"g{m}_v0", 0.0) * v(f"c{m - 1}_v1", 0.0) + v(f"c{m - 1}_v2", 1.0) * p
        last = f"c{ORDER - 1}"
        own = [v(f"g{ORDER}_v{k}", 0.0) * v(f"{last}_v{1 + k}", 0.0) + v(f"{last}_v{3 + k}", 1.0) * p for k in (0, 1)]
        return rows.select("gram", F.log(own[1] / own[0]).alias("value"))

    def fit(self, difference: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Put the middle of the curve where precision and recall are best together (F, with precision weighing
        PRECISION times as much), then fit its slope by Newton's method; it never falls."""
        order = np.argsort(-difference, kind="stable")
        x, hit, w = difference[order], toxic[order], weight[order]
        found, all_found = np.cumsum(w * hit), np.cumsum(w)
        score = (1 + PRECISION) * found / (all_found * PRECISION + (w * hit).sum())
        best = int(score.argmax())
        middle = (x[best] + x[min(best + 1, len(x) - 1)]) / 2
        z, a = np.clip(difference - middle, -CLIP, CLIP), 1.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z, -40, 40)))
            step = ((weight * (toxic - p) * z).sum() - 1e-6 * a) / ((weight * p * (1 - p) * z * z).sum() + 1e-6)
            a = max(1.0, a + float(np.clip(step, -20, 20)))
            if abs(step) < 1e-6:
                break
        self.slope, self.middle = a, float(middle)


def train(docs: DataFrame, labels: DataFrame, labelled: Column, sample_docs: int = SAMPLE_DOCS, seed: int = 5) -> ToxicityModel | None:
    """Fit to documents (doc_id, text) and labels (doc_id, toxic); None where a class has no labelled text.

    `labelled` says which documents' labels may be learnt. doc_id is of any type that both tables share. A document
    with several labels is toxic if one of them is. Null ids and null labels teach nothing, null and empty texts
    neither; rows that repeat an id count each.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    small_batches(spark)
    draw = F.xxhash64(F.lit(seed), "doc_id")
    marks = labels.filter("toxic is not null and doc_id is not null").filter(labelled).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    marks = scratch.save(marks.withColumns({"draw": draw, "fits": F.pmod(draw, F.lit(FIT)) == FIT - 1}))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Dealt by id at every size of the labels: a table that grows is no broadcast, and no text is sorted.
    rows = texts.join(marks.filter("not fits").select("doc_id", "toxic").hint("shuffle_hash"), "doc_id", "left").select("text", F.coalesce("toxic", F.lit(-1)).alias("toxic"))
    counts = scratch.save(gram_counts(rows))
    model = ToxicityModel(counts, scratch, prune=False)
    scratch.drop(counts)
    if not all(model.classes):
        return None
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = [marks.filter((F.col("toxic") == c) & F.col("fits")).orderBy("draw", "doc_id").limit(sample_docs) for c in (0, 1)]
    chosen = scratch.save(parts[0].unionByName(parts[1]).select("doc_id", "toxic"))  # 2 x sample_docs rows at most
    sample = texts.filter("text != ''").join(F.broadcast(chosen), "doc_id")
    fitted = differences(sample, model, "text", "difference").select("toxic", "difference").toPandas()
    if fitted["toxic"].nunique() < 2:
        return None
    found = fitted["toxic"].value_counts()
    weight = fitted["toxic"].map({c: sizes[c] / found[c] for c in found.index}).to_numpy(float)
    model.fit(fitted["difference"].to_numpy(float), fitted["toxic"].to_numpy(float), weight / weight.mean())
    return model


def differences(df: DataFrame, model: ToxicityModel, text: str = "text", name: str = "difference") -> DataFrame:
    """Add the log likelihood as toxic less that as ordinary, per character; 0 for null and empty texts.

    Where the model has rows that are not in memory, the table is written with what tasks know of each text; the grams
    that they do not know are joined to the model's tables and summed by row."""
    small_batches(df.sparkSession)
    shared = model.sent(df.sparkSession)

    def compare(texts: pa.Array) -> pa.Array:
        total, length = np.zeros(len(texts)), np.zeros(len(texts))
        for i, j, data, offsets, lead in textbytes.blocks(texts, lead=ORDER - 1):
            more, n = shared.value.compare(data, offsets, lead)
            total[i:j] += more
            length[i:j] += n
        textbytes.release()
        return pa.array(total / (length + SHORT))

    def known(texts: pa.Array) -> pa.Array:
        total, length = np.zeros(len(texts)), np.zeros(len(texts))
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for i, j, data, offsets, lead in textbytes.blocks(texts, lead=ORDER - 1):
            more, n, (owner, keys, times) = shared.value.compare_known(data, offsets, lead)
            total[i:j] += more
            length[i:j] += n
            parts.append((owner + i, keys, times))
        textbytes.release()
        owner, keys, times = (np.concatenate(p) for p in zip(*parts, strict=True))
        at = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))].astype(np.int32)
        met = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "times"])
        return pa.StructArray.from_arrays([pa.array(total), pa.array(length), pa.ListArray.from_arrays(pa.array(at), met)], ["total", "length", "met"])

    texts = F.coalesce(F.col(text), F.lit(""))
    if not model.rest:
        return df.withColumn(name, F.arrow_udf(compare, "double")(texts))
    udf = F.arrow_udf(known, "total double, length double, met array<struct<gram:long,times:long>>")
    rows = Scratch(df.sparkSession, "toxicity-scored").save(df.withColumn("__known", udf(texts)).withColumn("__row", F.monotonically_increasing_id()))
    met = rows.select("__row", F.inline("__known.met"))
    values = model.values_of(met.select("gram").distinct())
    more = met.join(values, "gram").groupBy("__row").agg(F.sum(F.col("times") * F.col("value")).alias("__more"))
    total = F.col("__known.total") + F.coalesce("__more", F.lit(0.0))
    return rows.join(more, "__row", "left").withColumn(name, total / (F.col("__known.length") + F.lit(float(SHORT)))).drop("__known", "__row", "__more")


def score(df: DataFrame, model: ToxicityModel | None, text: str = "text", name: str = "toxic_score") -> DataFrame:
    """Add a score from 0 to 1, higher for likelier toxic texts.

    Null and empty texts score as a text without evidence. Without a model every text scores 0. Repeated rows
    are scored each; an empty table gives no rows. A column `name` of the input is replaced, others pass through.
    """
    if model is None:
        return df.withColumn(name, F.lit(0.0))
    out = differences(df, model, text, "__difference")
    beyond = F.greatest(F.least(F.col("__difference") - F.lit(model.middle), F.lit(CLIP)), F.lit(-CLIP))
    return out.withColumn(name, 1 / (1 + F.exp(-beyond * F.lit(float(model.slope))))).drop("__difference")
