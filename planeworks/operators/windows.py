"""Neighbourhood operators as window frames: two-sided means, runs, closing, sliding support, rings, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_sided(signal: DataFrame, k: int, *keys: str, value: str = "value", support: float = 0.8) -> DataFrame:
    """left and right means of k samples either side of each position and their difference; null below `support`."""
    w = Window.partitionBy(*keys).orderBy("pos")
    left, right = w.rowsBetween(-k, -1), w.rowsBetween(0, k - 1)
    mean = lambda frame: F.when(F.count(value).over(frame) >= support * k, F.avg(value).over(frame))
    return signal.withColumn("left", mean(left)).withColumn("right", mean(right)).withColumn("contrast", F.col("right") - F.col("left"))


def runs(marks: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end (exclusive), length of contiguous positions. marks: keys, pos (distinct)."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return marks.withColumn("island", island).groupBy(*keys, "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("length")).drop("island")


def gap_runs(marks: DataFrame, gap: int, *keys: str, pos: str = "pos", least: int = 1, cover: float = 0.0) -> DataFrame:
    """keys, run, start, end (inclusive), n of positions whose neighbours are at most `gap` apart; short or sparse runs
    are dropped."""
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.coalesce((F.col(pos) - F.lag(pos).over(w) > gap).cast("int"), F.lit(0))
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = marks.withColumn("new", new).withColumn("run", run).groupBy(*keys, "run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n"))
    span = F.col("end") - F.col("start") + 1
    return out.where((span >= least) & (F.col("n") >= cover * span))


def closing(marks: DataFrame, gap: int, *keys: str) -> DataFrame:
    """closed: 1-d dilation then erosion by +-gap positions (rows) of the 0/1 column mark; outside counts as not set in
    the dilation and as set in the erosion."""
    near = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-gap, gap)
    return marks.withColumn("wide", F.max("mark").over(near)).withColumn("closed", F.min("wide").over(near)).drop("wide")


def sliding_support(signal: DataFrame, k: int, *keys: str, value: str = "value", support: float = 0.8) -> DataFrame:
    """count and mean of the k rows from k/2 before to k/2 - 1 after; the mean is null below `support` of k. Wide frames
    are differences of running sums, so the cost doesn't grow with k."""
    w = Window.partitionBy(*keys).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = signal.withColumn("rs", F.sum(F.coalesce(value, F.lit(0.0))).over(upto)).withColumn("rn", F.count(value).over(upto))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.lead(c, k // 2 - 1).over(w), F.last(c).over(every))
    behind = lambda c: F.coalesce(F.lag(c, k // 2 + 1).over(w), F.lit(0))
    out = ran.withColumn("k_n", ahead("rn") - behind("rn")).withColumn("k_sum", ahead("rs") - behind("rs")).drop("rs", "rn")
    return out.withColumn("k_mean", F.when(F.col("k_n") >= support * k, F.col("k_sum") / F.col("k_n"))).drop("k_sum")


def ring_contrast(cells: DataFrame, inner: int, outer: int, *keys: str, value: str = "mean") -> DataFrame:
    """inner mean, ring mean (outer box less inner box, floored at 0), contrast log1p(ring) - log1p(inner) at every cell
    whose outer box is inside. Box sums are separable: rows, then columns."""
    row, col = Window.partitionBy(*keys, "cy").orderBy("cx"), Window.partitionBy(*keys, "cx").orderBy("cy")
    out = cells
    for name, size in (("i", inner), ("o", outer)):
        r = size // 2
        out = out.withColumn(f"{name}_row", F.sum(value).over(row.rowsBetween(-r, r))).withColumn(f"{name}_n", F.count(value).over(row.rowsBetween(-r, r)))
    for name, size in (("i", inner), ("o", outer)):
        r = size // 2
        out = out.withColumn(f"{name}_sum", F.sum(f"{name}_row").over(col.rowsBetween(-r, r))).withColumn(f"{name}_n", F.sum(f"{name}_n").over(col.rowsBetween(-r, r)))
    whole = out.where((F.col("o_n") == outer * outer) & (F.col("i_n") == inner * inner))
    ring = F.greatest(F.lit(0.0), (F.col("o_sum") - F.col("i_sum")) / (outer * outer - inner * inner))
    told = whole.select(*keys, "cy", "cx", (F.col("i_sum") / (inner * inner)).alias("inner"), ring.alias("ring"))
    return told.withColumn("contrast", F.log1p("ring") - F.log1p("inner"))


def laplacian_detail(pixels: DataFrame, size: int, *keys: str) -> DataFrame:
    """py, px, n (samples with four neighbours in the patch), detail: mean squared 5-point Laplacian over the patch's
    variance; null where the variance is 0 or nothing has four neighbours."""
    patched = pixels.withColumn("py", F.floor(F.col("y") / size).cast("long")).withColumn("px", F.floor(F.col("x") / size).cast("long"))
    row, col = Window.partitionBy(*keys, "py", "px", "y").orderBy("x"), Window.partitionBy(*keys, "py", "px", "x").orderBy("y")
    near = [F.lag("v").over(row), F.lead("v").over(row), F.lag("v").over(col), F.lead("v").over(col)]
    lap = near[0] + near[1] + near[2] + near[3] - 4 * F.col("v")
    out = patched.withColumn("lap", lap.cast("double")).groupBy(*keys, "py", "px").agg(F.count("lap").alias("n"), F.avg(F.col("lap") * F.col("lap")).alias("energy"), F.var_pop(F.when(F.col("lap").isNotNull(), F.col("v"))).alias("variance"))
    return out.select(*keys, "py", "px", "n", (F.col("energy") / F.nullif(F.col("variance"), F.lit(0.0))).alias("detail"))


def three_rows(pixels: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """pixels with m: the mean of each sample and those above and below it; at the edges the one neighbour counts twice."""
    down = Window.partitionBy(*keys, "x").orderBy("y")
    up, own, low = F.lag(value).over(down), F.col(value), F.lead(value).over(down)
    return pixels.withColumn("m", (F.coalesce(up, low, own) + own + F.coalesce(low, up, own)) / 3)


def argmax_first(cells: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """key, pos, value of the greatest value; the first position wins ties. One partial aggregate, no sort."""
    best = F.max(F.struct(F.col(value).alias("value"), (-F.col(pos)).alias("neg")))
    return cells.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.neg")).alias("pos"), F.col("b.value").alias("value"))


def mode_first(values: DataFrame, value: str) -> DataFrame:
    """The most frequent value; the least wins ties."""
    counted = values.groupBy(value).agg(F.count(F.lit(1)).alias("cnt"))
    best = F.max(F.struct("cnt", (-F.col(value)).alias("neg")))
    return counted.agg(best.alias("b")).select((-F.col("b.neg")).alias(value), F.col("b.cnt").alias("cnt"))


def quarter_support(signal: DataFrame, mark: Column, *keys: str) -> DataFrame:
    """keys, quarter 1..4 (near-equal runs, the first take the remainder), n, support."""
    q = F.ntile(4).over(Window.partitionBy(*keys).orderBy("pos"))
    return signal.select(*keys, mark.cast("int").alias("mark"), q.alias("quarter")).groupBy(*keys, "quarter").agg(F.count(F.lit(1)).alias("n"), F.avg("mark").alias("support"))
