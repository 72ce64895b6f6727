"""Feature vectors, scores and labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def _bound(value: Column, use) -> Column:
    """`use` of a value that is made once, as a lambda variable."""
    return F.get(F.transform(F.array(value), use), 0)


def l1_normalize(values: Column) -> Column:
    """Divided by the sum."""
    return _bound(F.struct(values.alias("v"), total(values).alias("t")), lambda x: F.transform(x["v"], lambda v: v.cast("double") / x["t"]))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(logits: Column) -> Column:
    powers = lambda x: F.transform(x["v"], lambda v: F.exp(v.cast("double") - x["top"]))
    return _bound(F.struct(logits.alias("v"), F.array_max(logits).cast("double").alias("top")), lambda x: _bound(powers(x), l1_normalize))


def argmax(values: Column) -> Column:
    """Place, from 0, of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def best_label(labels: Column, scores: Column) -> Column:
    return F.get(labels, argmax(scores))


def label_or_binary(specific: Column, score: Column, binary: Column, threshold: float) -> Column:
    """The specific label if it has a score, not 0, of `threshold` or more; else the binary one."""
    return F.when(score.isNotNull() & (score != 0) & (score >= threshold), specific).otherwise(binary)


def reported_label(specific: Column, specific_score: Column, binary: Column, binary_score: Column) -> Column:
    """struct(label, score): the specific pair where that label isn't empty, else the binary pair."""
    has = specific.isNotNull() & (specific != "")
    return F.struct(F.when(has, specific).otherwise(binary).alias("label"), F.when(has, specific_score).otherwise(binary_score).alias("score"))


def overlay_label(binary: Column, specific: Column, score: Column, threshold: float, negative: str) -> Column:
    """What is drawn on a box: null (hidden) for the negative class, the label with its score in percent, or blank."""
    percent = F.concat(specific, F.lit(" ("), F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%)"))
    return F.when(binary == negative, F.lit(None)).when(specific.isNotNull() & (score >= threshold), percent).otherwise("")


def kept_boxes(boxes: Column, scores: Column, threshold: float, most: int = 500) -> Column:
    """Boxes that score above the threshold, corners cut to whole numbers, `most` at most (the detectors' rule)."""
    pairs = F.filter(F.arrays_zip(boxes.alias("box"), scores.alias("score")), lambda p: p["score"] > threshold)
    return F.slice(F.transform(pairs, lambda p: F.transform(p["box"], lambda v: v.cast("int"))), 1, most)


def replace_classification(classifications: Column, new: Column) -> Column:
    """The array with the element of the same algorithm replaced by `new`, which comes last."""
    return F.array_append(F.filter(classifications, lambda c: c["algorithm"]["key"] != new["algorithm"]["key"]), new)


def category_map(pairs: Column) -> Column:
    """label -> index inverted to index -> label."""
    return F.map_from_entries(F.transform(F.map_entries(pairs), lambda e: F.struct(e["value"], e["key"])))


def category_rows(index_to_label: Column) -> Column:
    """Labels in order of index."""
    return F.transform(F.array_sort(F.map_entries(index_to_label)), lambda e: e["value"])
