"""Box geometry as Column expressions: normalised centre boxes, pixel corners, overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of a box's corner columns.
CORNERS = ("x1", "y1", "x2", "y2")


def clip(x: Column, low, high) -> Column:
    return F.greatest(low if isinstance(low, Column) else F.lit(low), F.least(x, high if isinstance(high, Column) else F.lit(high)))


def clamp_int(x: Column, low: Column, high: Column) -> Column:
    """Nearest whole number, halves to even, within bounds."""
    return clip(F.rint(x).cast("long"), low, high)


def corners(cx: Column, cy: Column, bw: Column, bh: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel corners of a normalised centre box, clamped to the image."""
    return {
        "x1": clip((cx - bw / 2) * width, 0.0, width),
        "y1": clip((cy - bh / 2) * height, 0.0, height),
        "x2": clip((cx + bw / 2) * width, 0.0, width),
        "y2": clip((cy + bh / 2) * height, 0.0, height),
    }


def whole_corners(cx: Column, cy: Column, bw: Column, bh: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners in whole pixels, at least one pixel a side."""
    w, h = width.cast("long"), height.cast("long")
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    x1, y1 = clamp_int((cx - bw / 2) * width, zero, w - 1), clamp_int((cy - bh / 2) * height, zero, h - 1)
    x2, y2 = clamp_int((cx + bw / 2) * width, one, w), clamp_int((cy + bh / 2) * height, one, h)
    return {"x1": x1, "y1": y1, "x2": F.greatest(x2, x1 + 1), "y2": F.greatest(y2, y1 + 1)}


def outward(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """Smallest whole-pixel box that holds the corners, within the image."""
    w, h, zero = width.cast("long"), height.cast("long"), F.lit(0).cast("long")
    return {
        "x1": clip(F.floor(x1), zero, w),
        "y1": clip(F.floor(y1), zero, h),
        "x2": clip(F.ceil(x2), zero, w),
        "y2": clip(F.ceil(y2), zero, h),
    }


def padded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, ratio: float = 0.10) -> dict[str, Column]:
    """Whole-pixel crop with a share of the box's sides added on each side."""
    w, h, zero = width.cast("long"), height.cast("long"), F.lit(0).cast("long")
    px, py = ratio * (x2 - x1), ratio * (y2 - y1)
    return {"x1": clamp_int(x1 - px, zero, w), "y1": clamp_int(y1 - py, zero, h), "x2": clamp_int(x2 + px, zero, w), "y2": clamp_int(y2 + py, zero, h)}


def expanded(x1: Column, y1: Column, x2: Column, y2: Column, ratio: float) -> dict[str, Column]:
    """Box grown by half of ratio times its sides on each side, unclamped; ratios up to 0 leave it."""
    if ratio <= 0:
        return {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    px, py = 0.5 * ratio * (x2 - x1), 0.5 * ratio * (y2 - y1)
    return {"x1": x1 - px, "y1": y1 - py, "x2": x2 + px, "y2": y2 + py}


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 without an intersection."""
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    ih = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = iw * ih
    area = lambda r: F.greatest(zero, r["x2"] - r["x1"]) * F.greatest(zero, r["y2"] - r["y1"])
    return F.when(both <= 0, zero).otherwise(both / (area(a) + area(b) - both + 1e-12))


def size(w: Column, h: Column) -> Column:
    """Square root of a box's area."""
    return F.sqrt(F.greatest(w * h, F.lit(0.0)))


def grid_cell(c: Column, cells: int = 8) -> Column:
    """Cell of a normalised coordinate, which is clipped first."""
    return F.least(F.floor(clip(c, 0.0, 1.0) * cells), F.lit(cells - 1).cast("long"))


def unit_vector(degrees: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
