"""The model layer: models as column functions, and the pipeline that joins them.

A model is registered under a key with a factory that gives its Column function. Factories may wrap an
iterator pandas UDF that loads weights once for each task. No weights come with the library: the models here
are stand-ins that derive scores from hashes, for tests and for wiring.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, strings, vectors
from ..schemas import NEGATIVE_LABEL, POSITIVE_LABEL


@dataclass(frozen=True)
class Model:
    """predict takes the crop column of a row and gives its logits, in the order of `labels`."""

    key: str
    name: str
    task: str  # detection, binary or species
    labels: tuple[str, ...]
    predict: Callable[[Column], Column]
    threshold: float = 0.0
    description: str = ""


MODELS: dict[str, Model] = {}


def register(model: Model) -> Model:
    """Add a model; keys must be new, so that none hides another."""
    if model.key in MODELS:
        raise ValueError(f"model {model.key!r} is registered already")
    MODELS[model.key] = model
    return model


def _hashed_logits(salt: int, n: int) -> Callable[[Column], Column]:
    return lambda crop: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pmod(F.xxhash64(F.lit(salt), crop, k), F.lit(10_000)) / 1000.0)


register(Model("stub_binary", "Stand-in binary classifier", "binary", (POSITIVE_LABEL, NEGATIVE_LABEL), _hashed_logits(1, 2)))
register(Model("stub_species", "Stand-in species classifier", "species", tuple(f"species_{k}" for k in range(25)), _hashed_logits(2, 25)))


def detect_stub(images: DataFrame, per_image: int = 4, threshold: float = 0.5) -> DataFrame:
    """Up to `per_image` boxes for each photo, as a detector would give them: filtered by score, whole corners."""
    k = F.sequence(F.lit(1), F.lit(per_image))
    draw = lambda salt, at, n: F.pmod(F.xxhash64(F.lit(salt), F.col("id"), at), F.lit(n)).cast("double")
    boxes = F.transform(k, lambda at: F.array(draw(3, at, 900), draw(4, at, 600), draw(3, at, 900) + 20 + draw(5, at, 200), draw(4, at, 600) + 20 + draw(6, at, 150)))
    scores = F.transform(k, lambda at: draw(7, at, 1000) / 1000.0)
    return images.select("id", F.explode(vectors.kept_boxes(boxes, scores, threshold)).alias("bbox")).withColumnRenamed("id", "source_image_id")


def classify(rows: DataFrame, model: Model, crop: Column, terminal: bool) -> DataFrame:
    """Append a classification by `model` to the array `classifications`, in place of an older one of the same model."""
    logits = model.predict(crop)
    labels = F.array(*[F.lit(x) for x in model.labels])
    rows = rows.withColumn("__logits", logits).withColumn("__scores", vectors.softmax(F.col("__logits")))
    new = F.struct(vectors.best_label(labels, F.col("__scores")).alias("classification"), labels.alias("labels"), F.col("__scores").alias("scores"), F.col("__logits").alias("logits"), F.struct(F.lit(model.name).alias("name"), F.lit(model.key).alias("key")).alias("algorithm"), F.lit(terminal).alias("terminal"))
    if "classifications" in rows.columns:
        value = vectors.replace_classification(F.col("classifications"), new)
    else:
        value = F.array(new)
    return rows.withColumn("classifications", value).drop("__logits", "__scores")


def process(images: DataFrame, species: str = "stub_species", binary: str | None = "stub_binary") -> DataFrame:
    """Detect, tell positive from negative, classify the positive ones.

    Returns source_image_id, bbox, classifications. Boxes without extent are left out. With a binary model
    negative detections keep that one classification, which is terminal for them only.
    """
    rows = detect_stub(images)
    rows = rows.filter(~geometry.is_empty(F.col("bbox")))
    crop = F.concat_ws("/", F.col("source_image_id").cast("string"), geometry.box_text(F.col("bbox")))
    if binary is None:
        return classify(rows, MODELS[species], crop, True)
    seen = classify(rows, MODELS[binary], crop, False)
    first = F.get("classifications", 0)["classification"]
    negative = seen.filter(first == NEGATIVE_LABEL)
    negative = negative.withColumn("classifications", F.transform("classifications", lambda c: c.withField("terminal", F.lit(True))))
    return negative.unionByName(classify(seen.filter(first == POSITIVE_LABEL), MODELS[species], crop, True))


def algorithms(species: str = "stub_species", binary: str | None = "stub_binary") -> list[dict]:
    """The models of a pipeline, as rows: the detector, the binary model if there is one, the classifier."""
    rows = [{"key": "stub_detector", "name": "Stand-in detector", "task": "detection", "categories": 1}]
    return rows + [{"key": m.key, "name": m.name, "task": m.task, "categories": len(m.labels)} for m in (MODELS[k] for k in (binary, species) if k)]


def model_key(name: Column, key: Column) -> Column:
    return strings.model_key(key, name)


def unique_images(requests: DataFrame) -> DataFrame:
    """Request rows (place, id, ...) with one row for each id: the last one sent."""
    from .detections import last_wins

    return last_wins(requests, "id", "place")
