"""Boxes and points as column expressions. Boxes are x1, y1, x2, y2; points cx, cy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def box_state(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """(xc, yc, area, aspect); aspect is 1 without height."""
    return F.struct(
        ((x1 + x2) / 2).alias("xc"), ((y1 + y2) / 2).alias("yc"), ((x2 - x1) * (y2 - y1)).alias("area"),
        F.when(y2 - y1 > 0, (x2 - x1) / (y2 - y1)).otherwise(1.0).alias("aspect"),
    )


def state_box(xc: Column, yc: Column, area: Column, aspect: Column) -> Column:
    """The box of a state; area at least 0, aspect at least 0.1."""
    area, aspect = F.greatest(area, F.lit(0.0)), F.greatest(aspect, F.lit(0.1))
    h = F.sqrt(area / aspect)
    w = aspect * h
    return F.struct((xc - w / 2).alias("x1"), (yc - h / 2).alias("y1"), (xc + w / 2).alias("x2"), (yc + h / 2).alias("y2"))


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def goal_region_of(x: Column, y: Column, w: Column, h: Column, edge: float = 0.15, width: float = 0.3) -> Column:
    """top, bottom or null; bounds belong to the region, the top is tested first."""
    inside = (x >= w * (0.5 - width / 2)) & (x <= w * (0.5 + width / 2))
    return F.when(inside & (y >= 0) & (y <= h * edge), "top").when(inside & (y >= h * (1 - edge)) & (y <= h), "bottom")


def near_edge(x: Column, y: Column, w: Column, h: Column, margin: float = 0.1) -> Column:
    return (x < w * margin) | (x > w - w * margin) | (y < h * margin) | (y > h - h * margin)


def clock(seconds: Column) -> Column:
    """M:SS."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))


def minutes_text(seconds: Column) -> Column:
    return F.format_string("%.1fs (%.1fmin)", seconds, seconds / 60)
