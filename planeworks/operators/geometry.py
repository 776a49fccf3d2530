"""Lines and interpolation: clipping, rotated frames, as-of pairs, even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rotate_point(u: Column, v: Column, degrees: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Level-0 (x, y) of a point of a frame turned about (cx, cy)."""
    t = F.radians(degrees)
    return cx + u * F.cos(t) - v * F.sin(t), cy + u * F.sin(t) + v * F.cos(t)


def clip_line(x: Column, y: Column, dx: Column, dy: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """(from, to): the parameters between which the line (x + t dx, y + t dy) is inside the box; null if never. A zero
    direction on an axis asks only whether the line is between that axis' sides."""
    big = F.lit(1e300)

    def axis(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        a, b = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        inside = (p >= lo) & (p <= hi)
        return F.when(d == 0, F.when(inside, -big).otherwise(big)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, big).otherwise(-big)).otherwise(F.greatest(a, b))

    (ax, bx), (ay, by) = axis(x, dx, x0, x1), axis(y, dy, y0, y1)
    lo, hi = F.greatest(ax, ay), F.least(bx, by)
    return F.when(lo <= hi, lo), F.when(lo <= hi, hi)


def interpolate(points: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """keys, x, value at each asked x: linear between the neighbouring points, held at the ends. points: keys, x, y;
    asked: keys, x. One sort of both together finds each asked place's neighbours: an as-of join without a join."""
    both = points.select(*keys, "x", "y", F.lit(0).alias("side")).unionByName(asked.select(*keys, "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("side")))
    w = Window.partitionBy(*keys).orderBy("x", "side")
    before, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    point = F.when(F.col("side") == 0, F.struct("x", "y"))
    near = both.withColumn("p", F.last(point, ignorenulls=True).over(before)).withColumn("q", F.first(point, ignorenulls=True).over(after)).where("side = 1")
    p, q = F.col("p"), F.col("q")
    slope = (q["y"] - p["y"]) / F.nullif(q["x"] - p["x"], F.lit(0.0))
    value = F.when(p.isNull(), q["y"]).when(q.isNull(), p["y"]).otherwise(p["y"] + F.coalesce(slope, F.lit(0.0)) * (F.col("x") - p["x"]))
    return near.select(*keys, "x", value.alias("value"))


def even_samples(rows: DataFrame, index: str, total: Column, most: int = 12) -> DataFrame:
    """At most `most` rows evenly over 0 .. total - 1, both ends included."""
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (total - 1) / (most - 1)).cast("long")))
    return rows.where((total <= most) | F.array_contains(picks, F.col(index).cast("long")))
