"""Bounding boxes (X17-X20, X22). A box is an array of four doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_corner_and_size(box: Column, width: Column, height: Column) -> Column:
    """X, y, w, h in pixels -> x1, y1, x2, y2 as shares, two decimals; null if a side is not positive or it leaves the image."""
    x, y, w, h = (box[i] for i in range(4))
    ends = F.array(x / width, y / height, (x + w) / width, (y + h) / height)
    ok = (w > 0) & (h > 0) & F.forall(ends, lambda v: (v >= 0) & (v <= 1))
    return F.when(ok, F.transform(ends, lambda v: F.round(v, 2)))


def normalised(box: Column, width: Column, height: Column) -> Column:
    """x1, y1, x2, y2 in pixels as shares, two decimals."""
    return F.array(*(F.round(box[i] / (width if i % 2 == 0 else height), 2) for i in range(4)))


def parsed(text: Column) -> Column:
    """X18: "[x1, y1, x2, y2]" with 0 <= x1 < x2 <= 1 and the same for y, else null."""
    box = F.when(text.rlike(r"^\s*\[[^\[\]]*\]\s*$"), F.from_json(text, "array<double>"))
    ok = (F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & (v >= 0) & (v <= 1))
    return F.when(ok & (F.get(box, 0) < F.get(box, 2)) & (F.get(box, 1) < F.get(box, 3)), box)


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """0 where there is no area."""
    inter = overlap(a, b)
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def clutter(take: Column) -> Column:
    """0 up to 9, 1 up to 16, 2 up to 20, else 3."""
    return F.when(take <= 9, 0).when(take <= 16, 1).when(take <= 20, 2).otherwise(3)
