"""Exact histograms and what follows from them, block means, profiles, folds, unions of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeworks.sources.shared import bounded, kept

#: Keys up to which a table of a row a key is broadcast, and shares of a key's rows that a sketch tells apart.
FEW = 10_000
ACCURACY = 10_000


def histogram(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, v, cnt: sparse, exact, merged from partial counts."""
    return pixels.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("cnt"))


def _quantile(q: float) -> Column:
    return F.percentile(F.col("v"), F.lit(q), F.col("cnt"))


def raw_statistics(hist: DataFrame, *keys: str, ceiling: int = 65535) -> DataFrame:
    """n, min, max, mean, population deviation, p1, median, p99.5, zero and ceiling counts and shares, all from the
    histogram, which is the sufficient statistic: percentiles are of at most 65 536 values, whatever the plane."""
    v, c = F.col("v").cast("double"), F.col("cnt")
    n = F.sum("cnt")
    mean = F.sum(v * c) / n
    out = hist.groupBy(*keys).agg(
        n.alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v * c) / n - mean * mean)).alias("std"),
        _quantile(0.01).alias("p1"), _quantile(0.5).alias("median"), _quantile(0.995).alias("p995"),
        F.coalesce(F.sum(F.when(F.col("v") == 0, c)), F.lit(0)).alias("zero_count"), F.coalesce(F.sum(F.when(F.col("v") == ceiling, c)), F.lit(0)).alias("ceiling_count"),
    )
    return out.withColumn("zero_fraction", F.col("zero_count") / F.col("n")).withColumn("ceiling_fraction", F.col("ceiling_count") / F.col("n"))


def display_window(hist: DataFrame, *keys: str, q: float = 0.999) -> DataFrame:
    """low 0, high: the largest key's percentile, rounded up, at least 1: one window shared by all keys."""
    return hist.groupBy(*keys).agg(_quantile(q).alias("p")).agg(F.lit(0).cast("long").alias("low"), F.greatest(F.lit(1), F.ceil(F.max("p"))).cast("long").alias("high"))


def clipping(hist: DataFrame, low: Column, high: Column) -> list[Column]:
    """Percentages strictly outside a window."""
    n = F.sum("cnt")
    part = lambda rule: (100 * F.coalesce(F.sum(F.when(rule, F.col("cnt"))), F.lit(0)) / n)
    return [part(F.col("v") < low).alias("below_pct"), part(F.col("v") > high).alias("above_pct")]


def cell(c: str, step: int) -> Column:
    return F.floor(F.col(c) / step).cast("long")


def block_mean(pixels: DataFrame, step: int, *keys: str, floor_shape: tuple[Column, Column] | None = None) -> DataFrame:
    """keys, cy, cx, sum, n, mean. Edge cells keep their true count; with floor_shape (height, width) cells that aren't
    complete are dropped."""
    if floor_shape is not None:
        h, w = floor_shape
        pixels = pixels.where((F.col("y") < F.floor(h / step) * step) & (F.col("x") < F.floor(w / step) * step))
    out = pixels.groupBy(*keys, cell("y", step).alias("cy"), cell("x", step).alias("cx")).agg(F.sum("v").alias("sum"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("mean", F.col("sum") / F.col("n"))


def patch_statistics(pixels: DataFrame, size: int, *keys: str) -> DataFrame:
    patched = pixels.select(*keys, cell("y", size).alias("py"), cell("x", size).alias("px"), "v")
    return raw_statistics(histogram(patched, *keys, "py", "px"), *keys, "py", "px")


def otsu(hist8: DataFrame, *keys: str) -> DataFrame:
    """keys, threshold, between of histograms of 256 bins (keys, g, cnt): the least one of greatest variance between the
    classes g <= threshold and g > threshold. The windows run over at most 256 rows a key; a key of one bin has no row."""
    run = Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    g = F.col("g").cast("double")
    w, m = F.sum("cnt").over(run), F.sum(g * F.col("cnt")).over(run)
    n, total = F.sum("cnt").over(every), F.sum(g * F.col("cnt")).over(every)
    share = w / n
    between = F.pow(total / n * share - m / n, F.lit(2)) / F.nullif(share * (1 - share), F.lit(0.0))
    scored = hist8.select(*keys, F.round(between, 6).alias("between"), (-F.col("g")).alias("minus")).where("between is not null")
    best = scored.groupBy(*keys).agg(F.max(F.struct("between", "minus")).alias("b")).where("b is not null")
    return best.select(*keys, (-F.col("b.minus")).alias("threshold"), F.col("b.between").alias("between"))


def linspace_cell(c: str, size: Column, cells: int | Column) -> Column:
    """The cell whose integer bounds floor(i * size / cells) hold the coordinate."""
    i = F.floor(F.col(c) * cells / size)
    return F.when(F.floor((i + 1) * size / cells) <= F.col(c), i + 1).otherwise(i).cast("long")


def background_cells(pixels: DataFrame, background: Column, height: Column, width: Column, cells: int = 8, least: int = 32, share: float = 0.8) -> DataFrame:
    """by, bx, n, background_share, eligible, median of background values (null unless eligible)."""
    out = pixels.groupBy(linspace_cell("y", height, cells).alias("by"), linspace_cell("x", width, cells).alias("bx")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(background.cast("int")).alias("background_share"), F.percentile(F.when(background, F.col("v")), F.lit(0.5)).alias("m")
    )
    ok = (F.col("n") >= least) & (F.col("background_share") >= share)
    return out.select("by", "bx", "n", "background_share", ok.alias("eligible"), F.when(ok, F.col("m")).alias("median"))


def axis_profile(cells: DataFrame, axis: str, mask: Column, value: str = "v", least: float = 0.15) -> DataFrame:
    """pos, value (median of masked samples), valid (masked share at least `least`)."""
    share = F.avg(mask.cast("int"))
    return cells.groupBy(F.col(axis).alias("pos")).agg(F.percentile(F.when(mask, F.col(value)), F.lit(0.5)).alias("value"), share.alias("share")).select("pos", "value", "share", (F.col("share") >= least).alias("valid"))


def fold(signal: DataFrame, *keys: str) -> DataFrame:
    """keys, amplitude (greatest less least phase mean), r2 of predicting each cycle from the others' phase means
    against the others' overall mean; null where there is nothing to predict. signal: keys, cycle, phase, v."""
    per = signal.groupBy(*keys, "cycle", "phase").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * F.col("v")).alias("q"))
    over = lambda *by: Window.partitionBy(*keys, *by)
    sp, np_ = F.sum("s").over(over("phase")) - F.col("s"), F.sum("n").over(over("phase")) - F.col("n")
    st, nt = F.sum("s").over(over()), F.sum("n").over(over())
    sc, nc = F.sum("s").over(over("cycle")), F.sum("n").over(over("cycle"))
    train = (st - sc) / F.nullif(nt - nc, F.lit(0))
    p = F.when(np_ > 0, sp / F.nullif(np_, F.lit(0))).otherwise(train)
    told = per.withColumn("m", train).withColumn("p", p).where("m is not null")
    # sums of squares about a constant, from the sums kept for each (cycle, phase)
    about = lambda c: F.col("q") - 2 * F.col(c) * F.col("s") + F.col("n") * F.col(c) * F.col(c)
    r2 = told.groupBy(*keys).agg(F.sum(about("p")).alias("sse"), F.sum(about("m")).alias("sst")).select(*keys, F.when(F.col("sst") > 1e-10, 1 - F.col("sse") / F.col("sst")).alias("r2"))
    means = per.groupBy(*keys, "phase").agg((F.sum("s") / F.sum("n")).alias("mean"))
    amplitude = means.groupBy(*keys).agg((F.max("mean") - F.min("mean")).alias("amplitude"), F.count(F.lit(1)).alias("phases"))
    return amplitude.join(r2, list(keys), "left") if keys else amplitude.crossJoin(r2)  # one row each


def union_area(boxes: DataFrame, *keys: str, step: int = 64) -> DataFrame:
    """keys, area: exact area of the union of half-open boxes with integer sides; empty boxes count for nothing. Boxes are
    cut at multiples of `step` in x, so a key's boxes are dealt out by cell; a cell has at most `step` + 1 edges, between
    which are its slabs, and a piece is listed in the slabs that it spans. In a slab only the highest of the boxes that
    start together matters; ends run up over them in order."""
    cell = F.explode(F.sequence(F.floor(F.col("x0") / step), F.floor((F.col("x1") - 1) / step)))
    dealt = boxes.where("x1 > x0 and y1 > y0").withColumn("cell", cell)
    pieces = dealt.select(*keys, "cell", F.greatest("x0", F.col("cell") * step).alias("x0"), F.least("x1", (F.col("cell") + 1) * step).alias("x1"), "y0", "y1")
    edges = F.sort_array(F.array_union(F.collect_set("x0"), F.collect_set("x1")))
    slabs = pieces.groupBy(*keys, "cell").agg(edges.alias("e")).select(*keys, "cell", F.transform(F.slice("e", F.lit(1), F.size("e") - 1), lambda x, i: F.struct(x.alias("x"), (F.get("e", i + 1) - x).alias("w"))).alias("slabs"))
    inside = F.filter("slabs", lambda s: (s["x"] >= F.col("x0")) & (s["x"] < F.col("x1")))
    strips = pieces.join(slabs, [*keys, "cell"]).select(*keys, F.explode(inside).alias("s"), "y0", "y1").select(*keys, "s.x", "s.w", "y0", "y1")
    tops = strips.groupBy(*keys, "x", "w", "y0").agg(F.max("y1").alias("y1"))
    before = F.max("y1").over(Window.partitionBy(*keys, "x").orderBy("y0").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(before, F.col("y0"))))
    return tops.withColumn("fresh", fresh * F.col("w")).groupBy(*keys).agg(F.sum("fresh").alias("area"))


def _between(place: Column, lower: Column, higher: Column) -> Column:
    """The value at a place between two ranks, as F.percentile has it."""
    return F.when(lower == higher, lower).otherwise((F.ceil(place) - place) * lower + (place - F.floor(place)) * higher)


def _ordered_percentile(values: DataFrame, keys: list[str], name: str, places: DataFrame) -> DataFrame:
    """keys, all: the value at each key's place (from 0), by ordering all distinct values of the key."""
    counted = values.where(F.col(name).isNotNull()).join(places, keys).groupBy(*keys, "place", F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    run = F.sum("cnt").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = lambda rank: F.min(F.when(F.col("run") > rank("place"), F.col("v")))
    return counted.withColumn("run", run).groupBy(*keys, "place").agg(at(F.floor).alias("a"), at(F.ceil).alias("b")).select(*keys, _between(F.col("place"), F.col("a"), F.col("b")).alias("all"))


def percentiles(points: DataFrame, known: DataFrame, keys: list[str], **wanted: tuple[Column, float]) -> DataFrame:
    """keys (not null), the other columns of `known` (a kept row a key) and a column name for each name=(value, share), a
    value being of columns of both: the exact percentile, null for a key without values. F.percentile holds all distinct
    values of a key in one task; here a sketch of bounded size gives two values around the place, rows below and at each
    are counted, and only those strictly between are collected: at most some 6 in `ACCURACY`, since equal values don't add
    to them. Where the counts tell that a sketch missed the place, the key's rows are ordered."""
    exprs = [value.cast("double").alias(name) for name, (value, _) in wanted.items()]
    values = points.join(bounded(known, FEW), keys).select(*keys, *exprs)
    ends = lambda q: F.array(*[F.lit(min(1.0, max(0.0, q + d / ACCURACY))) for d in (-2, 2)])
    sketch = [c for name, (_, q) in wanted.items() for c in (F.count(name).alias(f"{name}_n"), F.percentile_approx(name, ends(q), ACCURACY).alias(f"{name}_e"))]
    found = kept(values.groupBy(*keys).agg(*sketch).join(known, keys), "brackets")  # kept, since another run of a sketch may give other ends
    ends_of = [(name, i, end) for name in wanted for i, end in enumerate(("low", "high"))]
    brackets = bounded(found.select(*known.columns, *[F.get(f"{name}_e", F.lit(i)).alias(f"{name}_{end}") for name, i, end in ends_of]), FEW)
    met_values = points.join(brackets, keys).select(*keys, *exprs, *[f"{name}_{end}" for name, _, end in ends_of])
    counts = []
    for name in wanted:
        v, low, high = F.col(name), F.col(f"{name}_low"), F.col(f"{name}_high")
        counts += [F.count(F.when(rule, 1)).alias(f"{name}_{k}") for k, rule in {"lt_low": v < low, "le_low": v <= low, "lt_high": v < high, "le_high": v <= high}.items()]
        counts.append(F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))).alias(f"{name}_inside"))
    told = kept(met_values.groupBy(*keys).agg(*counts).join(found, keys), "ranks")
    out = told.select(*known.columns)
    for name, (_, q) in wanted.items():
        c = lambda k, name=name: F.col(f"{name}_{k}")
        place = (c("n") - 1) * F.lit(q)
        at = lambda rank, c=c: F.when(rank < c("le_low"), c("e")[0]).when(rank < c("lt_high"), F.get(c("inside"), (rank - c("le_low")).cast("int"))).otherwise(c("e")[1])
        met = (c("lt_low") <= F.floor(place)) & (c("le_high") > F.ceil(place))
        one = told.where(met).select(*keys, _between(place, at(F.floor(place)), at(F.ceil(place))).alias(name))
        missed = told.where(~met & (c("n") > 0)).select(*keys, place.alias("place"))
        if not missed.isEmpty():
            one = one.unionByName(_ordered_percentile(values, keys, name, bounded(missed, FEW)).withColumnRenamed("all", name))
        out = out.join(one, keys, "left")
    return out


def line_fit(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """keys, n, slope, intercept, p90_abs (90th percentile of the absolute residuals), mad (median absolute deviation of
    the residuals about their median)."""
    on = list(keys)
    fit = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    line = kept(fit, "line")  # kept, since another order of sums would move the residuals
    res = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    ends = kept(percentiles(points, line, on, middle=(res, 0.5), p90_abs=(F.abs(res), 0.9)), "ends")
    return percentiles(points, ends, on, mad=(F.abs(res - F.col("middle")), 0.5)).select(*keys, "n", "slope", "intercept", "p90_abs", "mad")
