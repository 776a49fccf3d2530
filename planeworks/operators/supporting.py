"""Supporting metrics of planes, as plans over rows of samples (plane_id, y, x, v): exact statistics, detail of patches
within a provisional foreground, and the span of the background. They are measurements; none is a verdict.

The foreground is Otsu's on a point-sampled overview of at most `most` cells a side, closed by a 5 x 5 square; a sample
belongs to it as its cell does. Missing support is a null value, never a zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeworks.functions.display import render
from planeworks.operators.aggregates import histogram, linspace_cell, otsu, raw_statistics

PLANE = "plane_id"


def overview(pixels: DataFrame, most: int = 1024) -> DataFrame:
    """plane_id, step, cy, cx, v, height, width (of the overview): every step-th sample of every step-th row."""
    size = pixels.groupBy(PLANE).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    step = F.greatest(F.lit(1), F.ceil(F.greatest("h", "w") / most)).cast("long")
    cells = lambda n: F.ceil(F.col(n) / F.col("step")).cast("long")
    found = pixels.join(F.broadcast(size.withColumn("step", step)), PLANE)  # a row a plane
    return found.where("y % step = 0 and x % step = 0").select(PLANE, "step", F.expr("y div step").alias("cy"), F.expr("x div step").alias("cx"), "v", cells("h").alias("height"), cells("w").alias("width"))


def _over_square(cells: DataFrame, mark: str, agg, reach: int) -> DataFrame:
    """mark over the (2 reach + 1) square around each cell; what lies outside the plane doesn't count. Rows first."""
    for line, along in (("cy", "cx"), ("cx", "cy")):
        near = Window.partitionBy(PLANE, line).orderBy(along).rowsBetween(-reach, reach)
        cells = cells.withColumn(mark, agg(mark).over(near))
    return cells


def foreground(sampled: DataFrame, reach: int = 2) -> DataFrame:
    """The overview with fg (0 or 1), low and high (percentiles 1 and 99.5) and threshold (0 to 255; null, and no
    foreground, if low is high)."""
    ends = sampled.groupBy(PLANE).agg(F.percentile("v", F.lit(0.01)).alias("low"), F.percentile("v", F.lit(0.995)).alias("high"))
    shown = sampled.join(F.broadcast(ends), PLANE).withColumn("g", F.when(F.col("high") > F.col("low"), render(F.col("v"), F.col("low"), F.nullif(F.col("high"), F.col("low")))))
    counted = shown.where("g is not null").groupBy(PLANE, "g").agg(F.count(F.lit(1)).alias("cnt"))
    marked = shown.join(F.broadcast(otsu(counted, PLANE).select(PLANE, "threshold")), PLANE, "left")
    marked = marked.withColumn("fg", F.coalesce((F.col("g") > F.col("threshold")).cast("int"), F.lit(0)))
    return _over_square(_over_square(marked, "fg", F.max, reach), "fg", F.min, reach).drop("g")


def patch_detail(pixels: DataFrame, cells: DataFrame, size: int = 1024) -> DataFrame:
    """plane_id, py, px, n, fg_n, fg_share, variance (of the foreground's values), support (foreground samples whose four
    neighbours are foreground of the same patch), energy (mean squared 5-point Laplacian there), detail (energy over
    variance)."""
    step = cells.groupBy(PLANE).agg(F.first("step").alias("step"))
    placed = pixels.join(F.broadcast(step), PLANE).select(PLANE, "y", "x", "v", F.expr("y div step").alias("cy"), F.expr("x div step").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("py"), F.floor(F.col("x") / size).cast("long").alias("px"))
    both = placed.join(cells.select(PLANE, "cy", "cx", "fg"), [PLANE, "cy", "cx"])
    row, col = Window.partitionBy(PLANE, "py", "px", "y").orderBy("x"), Window.partitionBy(PLANE, "py", "px", "x").orderBy("y")
    own = F.when(F.col("fg") == 1, F.col("v"))
    near = [k(own).over(w) for w in (row, col) for k in (F.lag, F.lead)]
    lap = (near[0] + near[1] + near[2] + near[3] - 4 * own).cast("double")  # null unless all five are foreground
    out = both.withColumn("lap", lap).withColumn("own", own).groupBy(PLANE, "py", "px").agg(
        F.count(F.lit(1)).alias("n"), F.count("own").alias("fg_n"), F.var_pop("own").alias("variance"), F.count("lap").alias("support"), F.avg(F.col("lap") * F.col("lap")).alias("energy")
    )
    return out.withColumn("fg_share", F.col("fg_n") / F.col("n")).withColumn("detail", F.col("energy") / F.nullif(F.col("variance"), F.lit(0.0)))


def background_span(cells: DataFrame, parts: int = 8, least: int = 32, share: float = 0.8, enough: int = 4) -> DataFrame:
    """plane_id, background_cells, eligible_cells (with `least` background samples that are `share` of them), p10 and p90 of
    the eligible cells' medians, span (their difference) and span_share (of the overview's range), from `enough`
    eligible cells on. Axes of fewer samples than `parts` have a cell a sample."""
    side = lambda c, n: linspace_cell(c, F.col(n), F.least(F.lit(parts), F.col(n)))
    ground = F.when(F.col("fg") == 0, F.col("v"))
    per = cells.withColumn("by", side("cy", "height")).withColumn("bx", side("cx", "width")).groupBy(PLANE, "by", "bx").agg(
        F.count(ground).alias("ground"), F.count(F.lit(1)).alias("n"), F.percentile(ground, F.lit(0.5)).alias("median"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    ok = (F.col("ground") >= least) & (F.col("ground") / F.col("n") >= share)
    told = per.withColumn("median", F.when(ok, F.col("median"))).groupBy(PLANE).agg(
        F.count(F.lit(1)).alias("background_cells"), F.count("median").alias("eligible_cells"), F.percentile("median", F.lit(0.1)).alias("p10"), F.percentile("median", F.lit(0.9)).alias("p90"), (F.first("high") - F.first("low")).alias("range")
    )
    held = lambda c: F.when(F.col("eligible_cells") >= enough, c)
    span = F.col("p90") - F.col("p10")
    return told.select(PLANE, "background_cells", "eligible_cells", held(F.col("p10")).alias("p10_median"), held(F.col("p90")).alias("p90_median"), held(span).alias("span"), held(span / F.nullif(F.col("range"), F.lit(0.0))).alias("span_share"))


def supporting_metrics(pixels: DataFrame, patch: int = 1024, most: int = 1024, parts: int = 8) -> DataFrame:
    """One record a plane: exact statistics (as raw_statistics), patches, valid_patches and median_detail, foreground samples
    and their share, threshold, step, and the background's span."""
    cells = foreground(overview(pixels, most))
    patches = patch_detail(pixels, cells, patch).groupBy(PLANE).agg(F.count(F.lit(1)).alias("patches"), F.count("detail").alias("valid_patches"), F.percentile("detail", F.lit(0.5)).alias("median_detail"), F.sum("fg_n").alias("foreground"))
    scale = cells.groupBy(PLANE).agg(F.first("step").alias("step"), F.first("threshold").alias("threshold"))
    out = raw_statistics(histogram(pixels, PLANE), PLANE).join(patches, PLANE).join(scale, PLANE).join(background_span(cells, parts), PLANE)
    return out.withColumn("foreground_share", F.col("foreground") / F.col("n")).withColumn("quality_decision", F.lit(None).cast("string"))


def fraction_mask(cells: DataFrame, mask: Column, step: int, *keys: str, least: float = 0.99) -> DataFrame:
    """keys, cy, cx, share, inside: blocks of step x step cells of which at least `least` are in the mask."""
    block = lambda c: F.floor(F.col(c) / step).cast("long").alias(f"c{c}")
    out = cells.groupBy(*keys, block("y"), block("x")).agg(F.avg(mask.cast("int")).alias("share"))
    return out.withColumn("inside", F.col("share") >= least)
