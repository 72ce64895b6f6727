"""Boxes [x1, y1, x2, y2] and places, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(box: Column) -> tuple[Column, Column, Column, Column]:
    return F.get(box, 0), F.get(box, 1), F.get(box, 2), F.get(box, 3)


def area(box: Column) -> Column:
    x1, y1, x2, y2 = corners(box)
    return (y2 - y1) * (x2 - x1)


def pixel_area(box: Column) -> Column:
    """Area with both edges counted."""
    x1, y1, x2, y2 = corners(box)
    return (x2 - x1 + 1) * (y2 - y1 + 1)


def center(box: Column) -> Column:
    x1, y1, x2, y2 = corners(box)
    return F.array((x1 + x2) / 2.0, (y1 + y2) / 2.0)


def relative(box: Column, width: Column, height: Column) -> Column:
    """Corners as shares of the image, to 4 places."""
    x1, y1, x2, y2 = corners(box)
    return F.array(*[F.round(v / side, 4) for v, side in ((x1, width), (y1, height), (x2, width), (y2, height))])


def diagonal(width: Column, height: Column) -> Column:
    return F.ceil(F.sqrt(width * width + height * height))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of pixel areas, to 2 places, halves to even."""
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    width = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1) + 1, F.lit(0.0))
    height = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1) + 1, F.lit(0.0))
    both = width * height
    return F.rint(both / (pixel_area(a) + pixel_area(b) - both) * 100) / 100


def size_ratio(a: Column, b: Column) -> Column:
    return F.least(pixel_area(a), pixel_area(b)) / F.greatest(pixel_area(a), pixel_area(b))


def distance_ratio(a: Column, b: Column, diag: Column) -> Column:
    """Distance of the centres, by the image's diagonal."""
    ac, bc = center(a), center(b)
    dx, dy = F.get(ac, 0) - F.get(bc, 0), F.get(ac, 1) - F.get(bc, 1)
    return F.sqrt(dx * dx + dy * dy) / diag


def is_empty(box: Column) -> Column:
    """A box without extent once its corners are whole numbers."""
    x1, y1, x2, y2 = (c.cast("int") for c in corners(box))
    return (y1 >= y2) | (x1 >= x2)


def box_text(box: Column) -> Column:
    return F.array_join(F.transform(box, lambda v: v.cast("string")), ",")


def degrees_minutes_seconds(value: Column) -> Column:
    """struct(degrees, minutes, seconds) of a decimal coordinate; all three have its sign."""
    degrees = value.cast("int")
    minutes = ((value - degrees) * 60).cast("int")
    return F.struct(degrees.alias("degrees"), minutes.alias("minutes"), ((value - degrees - minutes / 60) * 3600.0).alias("seconds"))


def box_of_json(text: Column) -> Column:
    """A box that is kept as a JSON array; null where the text is none."""
    return F.from_json(text, "array<double>")


def compass(value: Column, positive: str, negative: str) -> Column:
    """The hemisphere's letter; coordinates below 1 count as the negative one."""
    return F.when(F.floor(value) >= 1, positive).otherwise(negative)
