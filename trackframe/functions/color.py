"""Colours as column expressions: B, G, R from 0 to 255; hue 0 to 180, saturation and value 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bgr_to_hsv(b: Column, g: Column, r: Column) -> Column:
    """Channels are truncated to whole numbers first; results are rounded to whole numbers."""
    b, g, r = (c.cast("int").cast("double") for c in (b, g, r))
    v = F.greatest(b, g, r)
    d = v - F.least(b, g, r)
    hue = F.when(d == 0, 0.0).when(v == r, 60 * (g - b) / d).when(v == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    return F.struct(
        (F.floor(hue / 2 + 0.5) % 180).cast("double").alias("h"),
        F.when(v == 0, 0.0).otherwise(F.floor(255 * d / v + 0.5).cast("double")).alias("s"), v.alias("v"),
    )


def hsv_to_bgr(h: Column, s: Column, v: Column) -> Column:
    h, s, v = (c.cast("int").cast("double") for c in (h, s, v))
    six = h / 30
    part = F.floor(six) % 6
    f, sat = six - F.floor(six), s / 255
    p, q, t = v * (1 - sat), v * (1 - sat * f), v * (1 - sat * (1 - f))

    def pick(*by_sextant: Column) -> Column:
        out = F.when(part == 0, by_sextant[0])
        for k, c in enumerate(by_sextant[1:], 1):
            out = out.when(part == k, c)
        return F.floor(out + 0.5).cast("double")

    return F.struct(pick(p, p, t, v, v, q).alias("b"), pick(t, v, v, q, p, p).alias("g"), pick(v, q, p, p, t, v).alias("r"))


def bgr_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def hsv_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Hue is a circle of 180 and counts twice."""
    d = F.abs(a[0] - b[0])
    d = 2 * F.least(d, 180 - d)
    return F.sqrt(d * d + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))


def similar(distance: Column, threshold: float = 50.0) -> Column:
    return distance < threshold


def hex_to_bgr(text: Column) -> Column:
    """#RRGGBB, the # optional."""
    t = F.regexp_replace(text, "^#+", "")
    part = lambda at: F.conv(F.substring(t, at, 2), 16, 10).cast("int")
    return F.struct(part(5).alias("b"), part(3).alias("g"), part(1).alias("r"))


def sample_rect(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, region: str = "upper") -> Column:
    """Pixels of a box that show the shirt: whole numbers, clipped to the frame; null for an empty box.

    upper: the top 40 % of the unclipped height; center: 30 to 70 % of it; full: the box. Heights count from the clipped
    top and end at the clipped bottom; sides are those of the box.
    """
    a, b, c, d = (x.cast("int") for x in (x1, y1, x2, y2))
    height, width = d - b, c - a
    low_x, low_y = F.greatest(F.lit(0), F.least(a, w - 1)), F.greatest(F.lit(0), F.least(b, h - 1))
    high_x, high_y = F.greatest(F.lit(0), F.least(c, w)), F.greatest(F.lit(0), F.least(d, h))
    if region == "upper":
        high_y = F.least(low_y + (height * 0.4).cast("int"), high_y)
    elif region == "center":
        low_y, high_y = low_y + (height * 0.3).cast("int"), F.least(low_y + (height * 0.7).cast("int"), high_y)
    rect = F.struct(low_x.cast("int").alias("rx1"), low_y.cast("int").alias("ry1"), high_x.cast("int").alias("rx2"), high_y.cast("int").alias("ry2"))
    return F.when((height > 0) & (width > 0), rect)
