"""Half-open integer boxes as four columns or structs (x0, y0, x1, y1), in level-0 coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def is_valid(b: Column, width: Column, height: Column) -> Column:
    """Not empty, inside 0..width, 0..height."""
    return (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]) & (b["x1"] <= width) & (b["y1"] <= height)


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def intersect(a: Column, b: Column) -> Column:
    """The common box, or null."""
    c = box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    return F.when((c["x0"] < c["x1"]) & (c["y0"] < c["y1"]), c)


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def gap(a: Column, b: Column) -> Column:
    """Euclidean distance of two boxes; touching or overlapping is 0."""
    zero = F.lit(0)
    dx = F.greatest(zero, a["x0"] - b["x1"], b["x0"] - a["x1"])
    dy = F.greatest(zero, a["y0"] - b["y1"], b["y0"] - a["y1"])
    return F.hypot(dx.cast("double"), dy.cast("double"))


def preview_to_native(b: Column, step: Column, origin: Column, limit: Column) -> Column:
    """A preview box scaled by the preview's step, shifted to its view, clipped to the view."""
    return box(origin["x0"] + b["x0"] * step, origin["y0"] + b["y0"] * step, F.least(origin["x0"] + b["x1"] * step, limit["x1"]), F.least(origin["y0"] + b["y1"] * step, limit["y1"]))


def to_parent(b: Column, origin_x: Column, origin_y: Column) -> Column:
    return box(b["x0"] + origin_x, b["y0"] + origin_y, b["x1"] + origin_x, b["y1"] + origin_y)


def cell_to_native(b: Column, step: int, width: Column, height: Column) -> Column:
    return box(b["x0"] * step, b["y0"] * step, F.least(b["x1"] * step, width), F.least(b["y1"] * step, height))


def angle_distance(a: Column, b: Column) -> Column:
    """Of directions modulo 180 degrees."""
    return F.abs(F.pmod(a - b + 90, F.lit(180)) - 90)


def overlap_fraction(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length of two intervals over the shorter one; null if either is empty."""
    common = F.greatest(F.lit(0.0), (F.least(a1, b1) - F.greatest(a0, b0)).cast("double"))
    return common / F.nullif(F.least(a1 - a0, b1 - b0).cast("double"), F.lit(0.0))


def in_central_ellipse(x: Column, y: Column, width: Column, height: Column, border: int = 40, radius: float = 0.7) -> Column:
    """At least `border` from every side, within `radius` of the plane's half axes."""
    inside = (x >= border) & (y >= border) & (x <= width - border) & (y <= height - border)
    return inside & (F.pow((x - width / 2) / (width / 2), F.lit(2)) + F.pow((y - height / 2) / (height / 2), F.lit(2)) <= radius * radius)
