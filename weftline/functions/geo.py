"""Plane geometry in degrees, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres of one degree.
KM_PER_DEGREE = 111.2


def cell_key(latitude: Column, longitude: Column) -> Column:
    """The grid cell of a position: both coordinates times ten, rounded to even."""
    return F.concat_ws("_", F.bround(latitude * 10).cast("long"), F.bround(longitude * 10).cast("long"))


def points_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / F.when(size == 0, 1.0).otherwise(size))))
    return points_distance(x, y, x1 + t * dx, y1 + t * dy)


def metres(degrees: Column) -> Column:
    return degrees * KM_PER_DEGREE * 1000


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a polygon, by the even-odd rule."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        inside = inside != crosses
    return inside
