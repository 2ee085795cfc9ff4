"""Box arithmetic. Boxes are arrays (cx, cy, w, h) in 0..1, or (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def corners(box: Column) -> list[Column]:
    cx, cy, w, h = (part(box, i) for i in range(4))
    return [cx - w * 0.5, cy - h * 0.5, cx + w * 0.5, cy + h * 0.5]


def pixel_corners(box: Column, width: Column, height: Column) -> list[Column]:
    """Corners in pixels. Boxes may pass the image edge; nothing is clipped here."""
    x0, y0, x1, y1 = corners(box)
    return [x0 * width, y0 * height, x1 * width, y1 * height]
