"""Boxes and page space as Column functions. Boxes are structs x0, y0, x1, y1 with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(box: Column) -> Column:
    """Finite, with a positive width and height."""
    inf = F.lit(float("inf"))
    ends = [box[e] for e in ("x0", "y0", "x1", "y1")]
    out = (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])
    for e in ends:
        out = out & ~F.isnan(e) & (F.abs(e) < inf)
    return F.coalesce(out, F.lit(False))


def width(box: Column) -> Column:
    return box["x1"] - box["x0"]


def height(box: Column) -> Column:
    return box["y1"] - box["y0"]


def center_x(box: Column) -> Column:
    return (box["x0"] + box["x1"]) / 2


def center_y(box: Column) -> Column:
    return (box["y0"] + box["y1"]) / 2


def area(box: Column) -> Column:
    return F.greatest(width(box), F.lit(0.0)) * F.greatest(height(box), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    across = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    down = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    shared = intersection(a, b)
    return F.when(area(a) + area(b) - shared > 0, shared / (area(a) + area(b) - shared)).otherwise(F.lit(0.0))


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def to_display(x: Column, y: Column, x0: Column, y0: Column, raw_width: Column, raw_height: Column, rotation: Column) -> Column:
    """A point of the page's own space in display space: moved to the crop's origin and rotated by quarter turns."""
    dx, dy = x - x0, y - y0
    across = F.when(rotation == 90, dy).when(rotation == 180, raw_width - dx).when(rotation == 270, raw_height - dy).otherwise(dx)
    down = F.when(rotation == 90, raw_width - dx).when(rotation == 180, raw_height - dy).when(rotation == 270, dx).otherwise(dy)
    return F.struct(across.alias("x"), down.alias("y"))


def flipped(box: Column, page_height: Column) -> Column:
    """A bottom-left box with its origin at the top left, to 3 places (halves away from zero)."""
    return F.struct(F.round(box["x0"], 3).alias("x0"), F.round(page_height - box["y1"], 3).alias("y0"), F.round(box["x1"], 3).alias("x1"), F.round(page_height - box["y0"], 3).alias("y1"))


def scaled(box: Column, sx: Column, sy: Column) -> Column:
    return F.struct((box["x0"] * sx).alias("x0"), (box["y0"] * sy).alias("y0"), (box["x1"] * sx).alias("x1"), (box["y1"] * sy).alias("y1"))
