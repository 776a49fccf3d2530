"""Spatial joins and plans: tile grids, label overlaps, region sums, parallel pairs, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeworks.functions import boxes as B
from planeworks.functions.policy import SCOPES, scope
from planeworks.operators.aggregates import union_area

#: Sectors of angles are so many times as wide as the angle of a pair at least: a sixth of the bands at most is copied if
#: angles are even.
SECTOR = 6


def anchors(length: Column, size: int, stride: int) -> Column:
    """Starts of tiles along an axis: multiples of the stride, the last one held at the far edge."""
    last = F.greatest(F.lit(0), length - size)
    count = F.floor(last / stride) + 1 + F.when(last % stride != 0, 1).otherwise(0)
    return F.transform(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")), lambda i: F.least(i * stride, last))


def tile_plan(shapes: DataFrame, size: int, stride: int, *keys: str) -> DataFrame:
    """keys, grid_index (row major), x0, y0, x1, y1. shapes: keys, height, width (long)."""
    rows = shapes.select(*keys, "height", "width", F.posexplode(anchors(F.col("height"), size, stride)).alias("iy", "y0"), F.size(anchors(F.col("width"), size, stride)).alias("nx"))
    cells = rows.select(*keys, "height", "width", "iy", "y0", "nx", F.posexplode(anchors(F.col("width"), size, stride)).alias("ix", "x0"))
    return cells.select(*keys, (F.col("iy") * F.col("nx") + F.col("ix")).cast("long").alias("grid_index"), "x0", "y0", F.least(F.col("x0") + size, "width").alias("x1"), F.least(F.col("y0") + size, "height").alias("y1"))


def within_budget(plan: DataFrame, budget: int, *keys: str) -> DataFrame:
    """The plan with status `planned` or `omitted`: all tiles within the budget, else `budget` evenly spread ones, tile
    i * total // budget for each i; total and omitted counts on every row."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.ceil(F.col("grid_index") * budget / F.col("total"))
    chosen = (F.lit(budget) > 0) & ((F.col("total") <= budget) | ((i < budget) & (F.floor(i * F.col("total") / budget) == F.col("grid_index"))))
    out = plan.withColumn("total", total).withColumn("status", F.when(chosen, "planned").otherwise("omitted"))
    return out.withColumn("omitted", F.greatest(F.lit(0), F.col("total") - budget))


def cells_of(boxes: DataFrame, step: int) -> DataFrame:
    """boxes with every label cell they touch (cy, cx) and the overlap in samples: an equi-joinable explosion, bounded by
    the boxes' area over the cells'."""
    rows = boxes.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / step), F.floor((F.col("y1") - 1) / step))))
    both = rows.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / step), F.floor((F.col("x1") - 1) / step))))
    side = lambda lo, hi, c: F.least(F.col(hi), (F.col(c) + 1) * step) - F.greatest(F.col(lo), F.col(c) * step)
    return both.withColumn("overlap", side("x0", "x1", "cx") * side("y0", "y1", "cy"))


def label_overlap(boxes: DataFrame, labels: DataFrame, step: int) -> DataFrame:
    """box_id, code, area: exact samples of each label in each box. boxes: box_id, x0, y0, x1, y1; labels: cy, cx, code."""
    return cells_of(boxes, step).join(labels, ["cy", "cx"]).groupBy("box_id", "code").agg(F.sum("overlap").alias("area"))


def attribute(candidates: DataFrame, labels: DataFrame, step: int, margin: int, width: int, height: int) -> DataFrame:
    """box_id, shares of the box and of its surroundings (box grown by `margin`, clipped), scope. The grown box is listed
    in the cells it touches once, with its own overlap and the box's, so that labels are met and areas summed once."""
    sides = {"x0": "bx0", "y0": "by0", "x1": "bx1", "y1": "by1"}
    low, high = lambda c: F.greatest(F.lit(0), F.col(c) - margin), lambda c, n: F.least(F.lit(n), F.col(c) + margin)
    grown = candidates.select("box_id", *[F.col(c).alias(b) for c, b in sides.items()], low("x0").alias("x0"), low("y0").alias("y0"), high("x1", width).alias("x1"), high("y1", height).alias("y1"))
    met = cells_of(grown, step).withColumnRenamed("overlap", "context").join(labels, ["cy", "cx"])
    side = lambda lo, hi, c: F.greatest(F.lit(0), F.least(F.col(hi), (F.col(c) + 1) * step) - F.greatest(F.col(lo), F.col(c) * step))
    own = met.withColumn("own", side("bx0", "bx1", "cx") * side("by0", "by1", "cy"))
    part = lambda code, area: F.coalesce(F.sum(F.when(F.col("code") == code, F.col(area))), F.lit(0)) / F.nullif(F.sum(area), F.lit(0))
    out = own.groupBy("box_id").agg(
        F.sum("own").alias("area"), part(1, "own").alias("core"), part(4, "own").alias("neighbour"), part(3, "own").alias("background"), part(1, "context").alias("core_context"), part(4, "context").alias("neighbour_context")
    ).where("area > 0").drop("area")
    return out.withColumn("scope", scope(F.col("core"), F.col("core_context"), F.col("neighbour"), F.col("neighbour_context"), F.col("background")))


def scope_counts(attributed: DataFrame) -> DataFrame:
    """scope, cnt, with zero for scopes that don't occur."""
    every = attributed.sparkSession.createDataFrame([(s,) for s in SCOPES], "scope string")
    return every.join(attributed.groupBy("scope").agg(F.count(F.lit(1)).alias("cnt")), "scope", "left").select("scope", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def region_intensity(pixels: DataFrame, labels: DataFrame, step: int, regions: dict[str, list[int]]) -> DataFrame:
    """region, pixels, total, zero_pixels, mean over the label codes of each region; regions may share codes. Pixels are
    summed by cell first, so only cells meet the labels."""
    cells = pixels.groupBy(F.floor(F.col("y") / step).alias("cy"), F.floor(F.col("x") / step).alias("cx")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum((F.col("v") == 0).cast("int")).alias("z"))
    named = pixels.sparkSession.createDataFrame([(r, c) for r, codes in regions.items() for c in codes], "region string, code int")
    out = cells.join(labels, ["cy", "cx"]).join(F.broadcast(named), "code").groupBy("region").agg(F.sum("n").alias("pixels"), F.sum("s").alias("total"), F.sum("z").alias("zero_pixels"))
    return out.withColumn("mean", F.col("total") / F.col("pixels"))


def parallel_pairs(bands: DataFrame, key: str, angle: float = 3.0, overlap: float = 0.5) -> DataFrame:
    """a, b, spacing: pairs (a < b) within a key with near angles, overlapping spans and a spacing over the sum of the
    widths, however far apart. bands: key, id, angle, s0, s1, normal, width. The half turn is dealt into sectors at least
    `SECTOR` times as wide as `angle`; a band within `angle` of its sector's upper end visits the next one too, and two
    visitors don't meet, so each pair meets once. Both sides are the same rows, which cross one exchange; a broadcast
    would leave all pairs to the few tasks that read the table. Bands meet in order of angle and place, so that the
    partners of one band are much like the last one's, and files of pairs are smaller."""
    n = max(1, int(180 / (SECTOR * max(angle, 1))))
    turn = F.pmod(F.col("angle"), F.lit(180.0))
    home = F.least(F.lit(n - 1), F.floor(turn * n / 180)).cast("int")
    near_end = turn >= (home + 1) * (180 / n) - angle - 1e-6  # a visit too many does no harm
    at = lambda sector, visit: F.struct(sector.alias("sector"), F.lit(visit).alias("visit"))
    sectors = F.array(at(home, False)) if n == 1 else F.when(near_end, F.array(at(home, False), at(F.pmod(home + 1, F.lit(n)), True))).otherwise(F.array(at(home, False)))
    dealt = bands.select(key, "id", "angle", "s0", "s1", "normal", "width", F.inline(sectors))
    place = F.row_number().over(Window.partitionBy(key, "sector").orderBy("angle", "s0", "s1"))
    # every row has a place > 0: the window stands for a sort, which Spark drops below a join
    ordered = dealt.withColumn("place", place).where("place > 0").drop("place").withColumn("turn", turn)
    left, right = ordered.alias("l"), ordered.alias("r").hint("merge")
    spacing, apart = F.abs(F.col("l.normal") - F.col("r.normal")), F.abs(F.col("l.turn") - F.col("r.turn"))
    rule = (
        (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.sector") == F.col("r.sector")) & (F.col("l.id") < F.col("r.id")) & ~(F.col("l.visit") & F.col("r.visit"))
        & ((apart <= angle + 1e-6) | (apart >= 180 - angle - 1e-6))  # cheap, keeps all that the distance below does
        & (spacing > F.col("l.width") + F.col("r.width"))
        & (B.overlap_fraction(F.col("l.s0"), F.col("l.s1"), F.col("r.s0"), F.col("r.s1")) >= overlap)
        & (B.angle_distance(F.col("l.angle"), F.col("r.angle")) <= angle)
    )
    return left.join(right, rule).select(F.col(f"l.{key}"), F.col("l.id").alias("a"), F.col("r.id").alias("b"), spacing.alias("spacing"))


def straight_pairs(bands: DataFrame, straight: Column, key: str, angle: float = 3.0, overlap: float = 0.5) -> DataFrame:
    """parallel_pairs whose both bands are straight (a rule on a band): bands are sifted before they are paired, so that no
    pair crosses an exchange, of which there are far more than bands."""
    return parallel_pairs(bands.where(straight), key, angle, overlap)


def coverage(views: DataFrame, target: Column, *keys: str) -> DataFrame:
    """keys, native_area, preview_area, views: union areas of full-resolution crops and of all step-1 views, clipped to
    the target. views: keys, x0, y0, x1, y1, step, native."""
    box = F.struct("x0", "y0", "x1", "y1")
    clipped = views.withColumn("c", B.intersect(box, target)).where("c is not null").select(*keys, "c.*", "step", "native")
    native = union_area(clipped.where("native").drop("step", "native"), *keys).withColumnRenamed("area", "native_area")
    full = union_area(clipped.where("step = 1").drop("step", "native"), *keys).withColumnRenamed("area", "full_area")
    n = views.groupBy(*keys).agg(F.count(F.lit(1)).alias("views"))
    out = n.join(native, list(keys), "left").join(full, list(keys), "left")
    return out.select(*keys, "views", F.coalesce("native_area", F.lit(0)).cast("long").alias("native_area"), F.coalesce("full_area", F.lit(0)).cast("long").alias("full_area"))
