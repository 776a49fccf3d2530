"""Pattern searches over tables of tiles. A tile is a task's unit in the local scan; searches that need a whole plane
(at most 512 MiB) group its tiles. Candidates carry statuses and omission counts; none is ever a verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeworks.kernels import detect as K
from planeworks.kernels.raster import block_mean, components, step_for
from planeworks.operators.spatial import tile_plan, within_budget
from planeworks.sources.tiff import assemble

LOCAL = "plane_id string, grid_index long, kind string, axis string, x0 int, y0 int, x1 int, y1 int, width int, contrast double, boundary int, support double, zero_fraction double, omitted int, unresolved array<int>, quality_decision string"


def overlapping_tiles(stored: DataFrame, size: int, stride: int, budget: int) -> DataFrame:
    """plane_id, grid_index, box and samples of each planned scan tile, cut from the stored tiles that it touches: an
    equi-join on the stored grid (each scan tile lists the few stored tiles it needs)."""
    sizes = stored.groupBy("plane_id").agg(F.max(F.greatest("h", "w")).cast("long").alias("grid"))  # the stored tiles' side
    shapes = stored.select("plane_id", F.col("height").cast("long"), F.col("width").cast("long")).distinct()
    grid = F.col("grid")
    plan = within_budget(tile_plan(shapes, size, stride, "plane_id"), budget, "plane_id").where("status = 'planned'").withColumnRenamed("x0", "px0").withColumnRenamed("y0", "py0")
    needs = plan.join(sizes, "plane_id").withColumn("ty", F.explode(F.sequence(F.floor(F.col("py0") / grid), F.floor((F.col("y1") - 1) / grid)))).withColumn("tx", F.explode(F.sequence(F.floor(F.col("px0") / grid), F.floor((F.col("x1") - 1) / grid))))
    keyed = stored.join(sizes, "plane_id").withColumn("ty", F.floor(F.col("y0") / grid)).withColumn("tx", F.floor(F.col("x0") / grid))
    return needs.drop("grid").join(keyed.drop("height", "width", "grid"), ["plane_id", "ty", "tx"])


def local_scan(stored: DataFrame, config: K.LocalConfig = K.LocalConfig()) -> DataFrame:
    """Dark regions and steps of every planned tile; a tile without candidates has one row with kind null."""
    joined = overlapping_tiles(stored, config.tile, config.stride, config.max_tiles)

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        x0, y0, x1, y1 = (int(group[c].iloc[0]) for c in ("px0", "py0", "x1", "y1"))
        raw = np.zeros((y1 - y0, x1 - x0), np.uint16)
        for r in group.itertuples(index=False):
            part = np.frombuffer(r.data, "<u2").reshape(r.h, r.w)
            a, b = max(y0, r.y0), max(x0, r.x0)
            c, d = min(y1, r.y0 + r.h), min(x1, r.x0 + r.w)
            raw[a - y0 : c - y0, b - x0 : d - x0] = part[a - r.y0 : c - r.y0, b - r.x0 : d - r.x0]
        found, omitted, unresolved = K.local_scan(raw, x0, y0, config)
        base = {"plane_id": group["plane_id"].iloc[0], "grid_index": group["grid_index"].iloc[0], "omitted": omitted, "unresolved": unresolved, "quality_decision": None}
        rows = [{**base, "kind": c["kind"], "axis": c.get("axis"), **dict(zip(("x0", "y0", "x1", "y1"), c["box"], strict=True)), "width": c["width"], "contrast": c["contrast"], "boundary": c.get("boundary"), "support": c.get("support"), "zero_fraction": c.get("zero_fraction")} for c in found] or [base]
        names = [f.split()[0] for f in LOCAL.split(", ")]
        return pd.DataFrame([{**dict.fromkeys(names), **r} for r in rows], columns=names, dtype=object)

    return joined.groupBy("plane_id", "grid_index").applyInPandas(scan, LOCAL)


def per_plane(tiles: DataFrame, work: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    """work(plane) for each plane's samples; schema without plane_id."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = work(assemble(group))
        return pd.DataFrame([{"plane_id": group["plane_id"].iloc[0], **r} for r in rows], columns=["plane_id", *names], dtype=object)

    return tiles.groupBy("plane_id").applyInPandas(run, f"plane_id string, {schema}")


LINES = "line int, orientation string, source string, pos int, start int, end int, low double, contrast double"


def axial_screen(tiles: DataFrame) -> DataFrame:
    """Lines that an overview of each plane suggests, each held against the original samples around it. tiles: stored
    tiles, read once for the overview and once for the samples near lines."""
    checked = verify_lines(tiles, per_plane(tiles, K.axial_proposals, LINES))
    schema = "plane_id string, orientation string, source string, pos int, start int, end int, exact_rows int, median_jump double, native_line int, verified boolean, unique boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, "native_line": None if pd.isna(r["native_line"]) else int(r["native_line"])} for r in group.to_dict("records")]
        return pd.DataFrame(K.mark_unique(rows), columns=names, dtype=object)

    return checked.groupBy("plane_id").applyInPandas(choose, schema)


def line_samples(tiles: DataFrame, lines: DataFrame) -> DataFrame:
    """plane_id, line, place, samples: for each row (column, if horizontal) of samples along a line those across it,
    from `place` on, of the strip HALF to either side. A tile serves the lines whose strips it touches; a strip's rows are
    put together from its tiles."""
    across = lambda size: (F.greatest(F.lit(0), F.col("pos") * K.BLOCK - K.HALF), F.least(F.col(size), F.col("pos") * K.BLOCK + K.HALF))
    along = lambda size: (F.col("start") * K.BLOCK, F.least(F.col(size), F.col("end") * K.BLOCK))
    upright = F.col("orientation") == "vertical"
    side = lambda k, size_v, size_h: F.when(upright, k(size_v)).otherwise(k(size_h))
    shapes = tiles.select("plane_id", "height", "width").distinct()
    strips = lines.join(shapes, "plane_id").select(
        "plane_id", "line", upright.alias("upright"),
        side(lambda s: across(s)[0], "width", "height").alias("c0"), side(lambda s: across(s)[1], "width", "height").alias("c1"),
        side(lambda s: along(s)[0], "height", "width").alias("r0"), side(lambda s: along(s)[1], "height", "width").alias("r1"),
    )
    ends = lambda c, n: F.when(F.col("upright"), F.col(c)).otherwise(F.col(n))
    met = tiles.select("plane_id", "y0", "x0", "h", "w", "data").join(strips, "plane_id").where(
        (ends("x0", "y0") < F.col("c1")) & (ends("x0", "y0") + ends("w", "h") > F.col("c0")) & (ends("y0", "x0") < F.col("r1")) & (ends("y0", "x0") + ends("h", "w") > F.col("r0"))
    )

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                part = np.frombuffer(r.data, "<u2").reshape(r.h, r.w)
                part, row, col = (part, r.y0, r.x0) if r.upright else (part.T, r.x0, r.y0)
                a, b, c, d = max(r.r0, row), min(r.r1, row + part.shape[0]), max(r.c0, col), min(r.c1, col + part.shape[1])
                piece = part[a - row : b - row, c - col : d - col].astype(np.float64)
                yield pd.DataFrame({"plane_id": r.plane_id, "line": r.line, "row": np.arange(a, b), "place": c, "samples": list(piece)})

    pieces = met.mapInPandas(cut, "plane_id string, line int, row long, place long, samples array<double>")
    whole = pieces.groupBy("plane_id", "line", "row").agg(F.sort_array(F.collect_list(F.struct("place", "samples"))).alias("p"))
    return whole.select("plane_id", "line", "row", F.col("p")[0]["place"].alias("place"), F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"))


def sharpest_jump(samples: Column, contrast: Column) -> Column:
    """Of the places with WIDE_SIDE samples on either side the one with the greatest difference between the means of
    NEAR_SIDE samples on either side (the first of equal ones): struct of near, minus the place, bright (the greater of
    those means), far (the difference of the means of WIDE_SIDE samples). Differences are in units of the contrast."""

    def mean(p: Column, offset: int, n: int) -> Column:
        return F.aggregate(F.slice(samples, p + offset + 1, F.lit(n)), F.lit(0.0), lambda acc, v: acc + v) / n

    def at(p: Column) -> Column:
        before, after = mean(p, -K.NEAR_SIDE, K.NEAR_SIDE), mean(p, 0, K.NEAR_SIDE)
        far = F.abs(mean(p, 0, K.WIDE_SIDE) - mean(p, -K.WIDE_SIDE, K.WIDE_SIDE)) / contrast
        return F.struct((F.abs(after - before) / contrast).alias("near"), (-p).alias("minus"), F.greatest(before, after).alias("bright"), far.alias("far"))

    n = F.size(samples)
    places = F.when(n > 2 * K.WIDE_SIDE, F.sequence(F.lit(K.WIDE_SIDE), n - K.WIDE_SIDE))
    return F.array_max(F.transform(places, at))


def verify_lines(tiles: DataFrame, lines: DataFrame, least: int = 20) -> DataFrame:
    """lines with exact_rows, median_jump, native_line, verified. A row of samples supports a line if its sharpest jump is
    one on either scale, beside bright samples; the line's place is where most supporting rows have theirs (the first of
    equal ones), and the rows within TOLERANCE of it are exact. Fewer than `least` supporting rows are none. Rows are
    means of themselves and both neighbours, mirrored at the strip's ends."""
    own, on = Window.partitionBy("plane_id", "line").orderBy("row"), ["plane_id", "line"]
    rows = line_samples(tiles, lines).join(lines.select(*on, "low", "contrast"), on)
    up, down = F.lag("samples").over(own), F.lead("samples").over(own)
    three = rows.withColumn("up", F.coalesce(up, down, "samples")).withColumn("down", F.coalesce(down, up, "samples"))
    mean = F.transform(F.arrays_zip("up", "samples", "down"), lambda x: (x["up"] + x["samples"] + x["down"]) / 3)
    jumps = three.select(*on, "place", "low", "contrast", mean.alias("m")).select(*on, "place", "low", sharpest_jump(F.col("m"), F.col("contrast")).alias("j"))
    support = jumps.where((F.col("j.near") > K.NEAR_JUMP) & (F.col("j.bright") > F.col("low")) & (F.col("j.far") > K.WIDE_JUMP)).select(*on, (F.col("place") - F.col("j.minus")).alias("at"), F.col("j.near").alias("near"))
    per = support.groupBy(*on, "at").agg(F.count(F.lit(1)).alias("n"))
    modes = per.groupBy(*on).agg(F.sum("n").alias("rows"), (-F.max(F.struct("n", (-F.col("at")).alias("minus")))["minus"]).alias("native_line")).where(F.col("rows") >= least)
    exact = support.join(modes, on).where(F.abs(F.col("at") - F.col("native_line")) <= K.TOLERANCE).groupBy(*on, "native_line").agg(F.count(F.lit(1)).alias("exact_rows"), F.percentile("near", F.lit(0.5)).alias("median_jump"))
    out = lines.join(exact, on, "left").withColumn("exact_rows", F.coalesce("exact_rows", F.lit(0)).cast("int")).withColumn("median_jump", F.coalesce("median_jump", F.lit(0.0)))
    return out.withColumn("native_line", F.col("native_line").cast("int")).withColumn("verified", F.col("exact_rows") >= K.CONFIRM_ROWS)


def alternating_bands(tiles: DataFrame, config: K.BandConfig = K.BandConfig()) -> DataFrame:
    def work(plane: np.ndarray) -> list[dict]:
        bands, truncated, _ = K.band_proposals(plane, config)
        return [{"band": i, **K.verify_band(plane, b, config), "truncated": truncated} for i, b in enumerate(bands)]

    return per_plane(tiles, work, "band int, angle double, width int, score double, normal double, s0 double, s1 double, status string, support double, drop double, zero_fraction double, slope_deg double, mean double, straight boolean, truncated boolean")


def band_pairs(tiles: DataFrame, config: K.BandConfig = K.BandConfig()) -> DataFrame:
    """Pairs of verified bands; a and b count them from the deepest. straight: both have straight edges."""
    return per_plane(tiles, lambda plane: K.alternating_pairs(plane, K.verified_bands(plane, config), config), "a int, b int, spacing double, straight boolean")


def hysteresis_mask(tiles: DataFrame, raster: int = 512) -> DataFrame:
    """Cells of the overview that the mask holds."""

    def work(plane: np.ndarray) -> list[dict]:
        mask, _, _ = K.tissue(block_mean(plane, step_for(plane.shape, raster)))
        return [{"cy": int(y), "cx": int(x)} for y, x in zip(*np.nonzero(mask), strict=True)]

    return per_plane(tiles, work, "cy int, cx int")


def core_proposals(tiles: DataFrame) -> DataFrame:
    def work(plane: np.ndarray) -> list[dict]:
        p = K.core_proposal(plane)
        codes, n = np.unique(p["labels"], return_counts=True)
        return [{"state": p["state"], "reasons": ",".join(p["reasons"]), "objects": p["objects"], "code": int(c), "cells": int(k)} for c, k in zip(codes, n, strict=True)]

    return per_plane(tiles, work, "state string, reasons string, objects int, code int, cells int")


def connected(tiles: DataFrame, threshold: int) -> DataFrame:
    """label, cells of 8-connected samples over a threshold, labels in row-major order of first cells."""

    def work(plane: np.ndarray) -> list[dict]:
        labels, n = components(plane > threshold)
        return [{"label": k + 1, "cells": int(c)} for k, c in enumerate(np.bincount(labels.ravel(), minlength=n + 1)[1:])]

    return per_plane(tiles, work, "label int, cells int")


def tiles_of(pixels: DataFrame, size: int = 1024) -> DataFrame:
    """Tiles from rows of samples (plane_id, y, x, v)."""
    shape = pixels.groupBy("plane_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    keyed = pixels.withColumn("ty", F.floor(F.col("y") / size)).withColumn("tx", F.floor(F.col("x") / size)).join(shape, "plane_id")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(group["ty"].iloc[0]) * size, int(group["tx"].iloc[0]) * size
        h, w = int(group["height"].iloc[0]), int(group["width"].iloc[0])
        part = np.zeros((min(size, h - y0), min(size, w - x0)), "<u2")
        part[group["y"].to_numpy() - y0, group["x"].to_numpy() - x0] = group["v"].to_numpy()
        return pd.DataFrame([{"plane_id": group["plane_id"].iloc[0], "height": h, "width": w, "y0": y0, "x0": x0, "h": part.shape[0], "w": part.shape[1], "data": part.tobytes()}])

    from planeworks.sources.tiff import TILE_SCHEMA

    return keyed.groupBy("plane_id", "ty", "tx").applyInPandas(build, TILE_SCHEMA)




def local_violations(candidates: DataFrame, recorded: DataFrame, planned: DataFrame) -> DataFrame:
    """grid_index, violation where a local scan's record disagrees with its plan: tiles missing, unplanned or moved,
    candidates outside their tile or of no tile, counts that don't add up. recorded: grid_index, x0, y0, x1, y1,
    candidates; planned: grid_index, x0, y0, x1, y1. An intact record gives no rows."""
    sides = ("x0", "y0", "x1", "y1")
    want = planned.select("grid_index", *[F.col(c).alias(f"p_{c}") for c in sides], F.lit(True).alias("planned"))
    have = recorded.select("grid_index", *sides, "candidates", F.lit(True).alias("recorded"))
    both = want.join(have, "grid_index", "full_outer")
    moved = F.lit(False)
    for c in sides:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"p_{c}"))
    tiles = both.select("grid_index", F.when(F.col("recorded").isNull(), "tile_missing").when(F.col("planned").isNull(), "tile_unplanned").when(moved, "tile_moved").alias("violation")).where("violation is not null")
    own = candidates.select("grid_index", *[F.col(c).alias(f"c_{c}") for c in sides])
    met = own.join(have, "grid_index", "left")
    outside = (F.col("c_x0") < F.col("x0")) | (F.col("c_y0") < F.col("y0")) | (F.col("c_x1") > F.col("x1")) | (F.col("c_y1") > F.col("y1"))
    stray = met.select("grid_index", F.when(F.col("recorded").isNull(), "candidate_without_tile").when(outside, "candidate_outside_tile").alias("violation")).where("violation is not null").distinct()
    n = own.groupBy("grid_index").agg(F.count(F.lit(1)).alias("n"))
    counts = have.join(n, "grid_index", "left").where(F.col("candidates") != F.coalesce("n", F.lit(0))).select("grid_index", F.lit("count_differs").alias("violation"))
    return tiles.unionByName(stray).unionByName(counts)
