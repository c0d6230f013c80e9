"""Boxes: quantising, sizes, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000


def quantise(value: Column, extent: Column | float) -> Column:
    """Pixels to the integers 0 to 999 of an image side."""
    side = extent if isinstance(extent, Column) else F.lit(float(extent))
    return F.least(F.greatest(F.floor(value / (side / F.lit(float(GRID)))), F.lit(0)), F.lit(GRID - 1)).cast("long")


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def short_edge(w: Column, h: Column) -> Column:
    return F.least(w, h)


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.when(h != 0, w / h)


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both boxes are empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


#: Our own cut-offs of the share of the image that a region covers.
SCALES = (("tiny", 0.01), ("small", 0.05), ("medium", 0.2))


def scale_class(share: Column) -> Column:
    out = F.lit("large")
    for name, most in reversed(SCALES):
        out = F.when(share < most, F.lit(name)).otherwise(out)
    return out


def small_input(edge: Column, size: Column, least_edge: float = 96, least_area: float = 25_000) -> Column:
    """Why an input is too small, or null: the balanced preset by default."""
    return F.when(edge < least_edge, F.lit("short_edge")).when(size < least_area, F.lit("area"))


#: Presets of the small-input gate: name, short edge, area.
SMALL_PRESETS = (("loose", 80, 15_000), ("balanced", 96, 25_000), ("strict", 128, 40_000))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* (D65) of sRGB components from 0 to 255."""

    def linear(c: Column) -> Column:
        x = F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)) / 255
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.pow(t, F.lit(1 / 3))).otherwise((t * (24389 / 27) + 16) / 116)

    x, y, z = linear(r), linear(g), linear(b)
    fx = f((x * 0.4124564 + y * 0.3575761 + z * 0.1804375) / 0.95047)
    fy = f(x * 0.2126729 + y * 0.7151522 + z * 0.0721750)
    fz = f((x * 0.0193339 + y * 0.1191920 + z * 0.9503041) / 1.08883)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def ab_bin(x: Column, bins: int = 128) -> Column:
    """The bin of an a* or b* value from -128 to 128."""
    return F.least(F.greatest(F.floor((F.round(x, 9) + 128) * (bins / 256)), F.lit(0)), F.lit(bins - 1)).cast("long")


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """The angle of a colour in the a*b* plane, in degrees from 0 to 360."""
    return F.round(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)), 9)


def hue_distance(x: Column, y: Column) -> Column:
    """Between two hues on the circle: 350 and 10 degrees are 20 apart."""
    d = F.abs(x - y)
    return F.least(d, F.lit(360.0) - d)
