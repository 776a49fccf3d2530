"""Whole measurements of planes: supporting metrics, brightness patterns, and one record a plane. Missing support is a
status with null values, never a zero; quality_decision is always null."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeworks.functions.policy import reasons
from planeworks.kernels import detect as K
from planeworks.kernels.raster import block_mean, disk, erode, gaussian, otsu, step_for
from planeworks.operators.aggregates import histogram, raw_statistics
from planeworks.operators.detectors import alternating_bands, axial_screen, band_pairs, local_scan, per_plane
from planeworks.operators.supporting import supporting_metrics
from planeworks.sources.tiff import pixels


@dataclass(frozen=True)
class BrightnessConfig:
    raster: int = 1024
    foreground: str = "hysteresis"  # or "all"
    erosion: int = 0
    coverage: float = 0.15
    windows: tuple[int, ...] = (32, 128, 512)
    period: int | None = None
    phase_bins: int = 24
    factors: tuple[float, ...] = (0.71, 0.83, 1.19, 1.37)

    def __post_init__(self) -> None:
        if self.foreground not in ("hysteresis", "all", "otsu") or self.raster < 1 or not 0 < self.coverage <= 1 or self.phase_bins < 4 or (self.period is not None and self.period <= 0):
            raise ValueError("brightness settings out of range")


def profile(values: np.ndarray, mask: np.ndarray, axis: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(median over the masked samples of each line, is the line covered)."""
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            line = np.nanmedian(np.where(mask, values, np.nan), axis=axis)
    return line, mask.mean(axis=axis) >= least


def fold(line: np.ndarray, valid: np.ndarray, period: float, bins: int) -> tuple[float | None, float | None, str]:
    """(amplitude, leave-one-cycle-out r2, status) of a line of samples."""
    if period < 2 * bins:
        return None, None, "period_below_resolution"
    pos = np.arange(len(line))
    cycle, phase = (pos // period).astype(int), (pos % period * bins / period).astype(int).clip(max=bins - 1)
    use = valid & np.isfinite(line)
    keep = [c for c in np.unique(cycle) if (use & (cycle == c)).sum() >= 24 and len(np.unique(phase[use & (cycle == c)])) >= bins / 2]
    if len(keep) < 3:
        return None, None, "too_few_cycles"
    use &= np.isin(cycle, keep)
    v, c, p = line[use], cycle[use], phase[use]
    sse = sst = 0.0
    for k in keep:
        own, rest = c == k, c != k
        mean = v[rest].mean()
        n = np.bincount(p[rest], minlength=bins)
        told = np.where(n > 0, np.bincount(p[rest], v[rest], bins) / np.maximum(n, 1), mean)
        sse += ((v[own] - told[p[own]]) ** 2).sum()
        sst += ((v[own] - mean) ** 2).sum()
    n = np.bincount(p, minlength=bins)
    means = (np.bincount(p, v, bins) / np.maximum(n, 1))[n > 0]
    return float(means.max() - means.min()), (float(1 - sse / sst) if sst > 1e-10 else None), "measured"


def brightness(plane: np.ndarray, config: BrightnessConfig = BrightnessConfig()) -> list[dict]:
    """One row an axis: broad span, largest two-sided difference, and, for an explicit period, its fold against control
    periods."""
    step = step_for(plane.shape, config.raster)
    levels = np.log1p(block_mean(plane, step))
    if config.foreground == "all":
        mask = np.ones(levels.shape, bool)
    elif config.foreground == "otsu":
        cut = otsu(levels)
        mask = levels > cut if cut is not None else np.zeros(levels.shape, bool)
    else:
        mask = K.tissue(np.expm1(levels))[0]
    if config.erosion:
        mask = erode(mask, disk(config.erosion))
    out = []
    for axis, name in ((0, "x"), (1, "y")):
        line, valid = profile(levels, mask, axis, config.coverage)
        row = {"axis": name, "status": "measured", "span": None, "window": None, "window_contrast": None, "window_position": None, "period_status": "not_requested", "amplitude": None, "r2": None, "best_control_r2": None}
        if valid.sum() < 8:
            out.append({**row, "status": "unassessed"})
            continue
        own = line[valid]
        row["span"] = float(np.percentile(own, 90) - np.percentile(own, 10))
        for window in config.windows:
            k = max(1, window // step)
            if 2 * k > len(line):
                continue
            n, s = np.pad(valid.astype(float), (1, 0)).cumsum(), np.pad(np.where(valid, line, 0.0), (1, 0)).cumsum()
            x = np.arange(k, len(line) - k + 1)
            nl, nr = n[x] - n[x - k], n[x + k] - n[x]
            diff = np.where((nl >= 0.8 * k) & (nr >= 0.8 * k), np.abs((s[x + k] - s[x]) / np.maximum(nr, 1) - (s[x] - s[x - k]) / np.maximum(nl, 1)), -1.0)
            best = int(diff.argmax())
            if diff[best] >= 0 and (row["window_contrast"] is None or diff[best] > row["window_contrast"]):
                row |= {"window": window, "window_contrast": float(diff[best]), "window_position": int(x[best] * step)}
        if config.period is not None:
            period = config.period / step
            weight = gaussian(mask.astype(float), period / 2)
            flat = np.where(mask, levels - gaussian(np.where(mask, levels, 0.0), period / 2) / np.maximum(weight, 1e-6), np.nan)
            line, valid = profile(flat, mask, axis, config.coverage)
            amplitude, r2, status = fold(line, valid, period, config.phase_bins)
            controls = [fold(line, valid, period * f, config.phase_bins)[1] for f in config.factors]
            row |= {"period_status": status, "amplitude": amplitude, "r2": r2, "best_control_r2": max((c for c in controls if c is not None), default=None)}
        out.append(row)
    return out


BRIGHTNESS = "axis string, status string, span double, window int, window_contrast double, window_position int, period_status string, amplitude double, r2 double, best_control_r2 double"


def brightness_patterns(tiles: DataFrame, config: BrightnessConfig = BrightnessConfig()) -> DataFrame:
    return per_plane(tiles, lambda plane: brightness(plane, config), BRIGHTNESS)


def supporting(pixels: DataFrame) -> DataFrame:
    """plane_id and the exact statistics of its samples (plane_id, y, x, v)."""
    return raw_statistics(histogram(pixels, "plane_id"), "plane_id")


def identity(file_sha: str, modality: str, *configs) -> str:
    """sha256 of file, modality and methods: a setting changes it, a copy doesn't."""
    methods = json.dumps([{"name": type(c).__name__, **asdict(c)} for c in configs], sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(f"{file_sha}:{modality}:{hashlib.sha256(methods.encode()).hexdigest()}".encode()).hexdigest()


def measure(tiles: DataFrame, histograms: DataFrame, local: K.LocalConfig = K.LocalConfig()) -> DataFrame:
    """One record a plane: statistics, verified lines, candidates and omissions, route with reasons. histograms:
    plane_id, v, cnt (tile_histogram of the same tiles)."""
    lines = axial_screen(tiles).groupBy("plane_id").agg(F.sum(F.col("verified").cast("int")).alias("verified_lines"), F.sum(F.col("unique").cast("int")).alias("unique_lines"))
    found = local_scan(tiles, local)
    scanned = found.groupBy("plane_id", "grid_index").agg(F.count("kind").alias("candidates"), F.max("omitted").alias("omitted"))
    local_ = scanned.groupBy("plane_id").agg(F.sum("candidates").alias("candidates"), F.sum("omitted").alias("omitted"), F.count(F.lit(1)).alias("tiles_scanned"))
    out = raw_statistics(histograms, "plane_id").join(lines, "plane_id", "left").join(local_, "plane_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("verified_lines", "unique_lines")})
    why = reasons(
        (F.col("verified_lines") > 0, "verified_lines"), (F.col("candidates") > 0, "local_candidates"), (F.col("omitted") > 0, "budget_omissions"), (F.col("tiles_scanned").isNull(), "local_scan_unassessed"), (F.col("ceiling_fraction") > 0.01, "saturated_samples")
    )
    return out.withColumn("reasons", why).withColumn("route", F.when(F.size(why) == 0, "routine").otherwise("review")).withColumn("quality_decision", F.lit(None).cast("string"))


MODALITIES = ("autofluorescence", "fluorescence")


def methods_json(modality: str, **configs) -> str:
    """What a record was measured with, as canonical JSON; methods that weren't asked for are left out."""
    if modality not in MODALITIES:
        raise ValueError(f"modality must be one of {', '.join(MODALITIES)}")
    return json.dumps({k: {"name": type(c).__name__, **asdict(c)} for k, c in configs.items() if c is not None}, sort_keys=True, separators=(",", ":"))


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """plane_id, all of a plane's rows as one sorted array."""
    return rows.groupBy("plane_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "plane_id"]))).alias(name))


def measurement_record(tiles: DataFrame, files: DataFrame, modality: str = "autofluorescence", brightness: BrightnessConfig = BrightnessConfig(), bands: K.BandConfig | None = None, local: K.LocalConfig | None = None) -> DataFrame:
    """The whole record of each plane: identity of file, samples, methods and run; supporting metrics; checked lines;
    brightness patterns; bands and their pairs and the local scan where their settings are given (else null); reasons for a
    review. files: plane_id, name, file_sha256, pixel_sha256; a plane without a file has no record."""
    methods = methods_json(modality, brightness=brightness, bands=bands, local=local)
    shape = tiles.groupBy("plane_id").agg(F.first("height").alias("height"), F.first("width").alias("width"))
    metrics = supporting_metrics(pixels(tiles))
    told = metrics.select("plane_id", F.struct(*[c for c in metrics.columns if c not in ("plane_id", "quality_decision")]).alias("metrics"))
    out = files.select("plane_id", "name", "file_sha256", "pixel_sha256").join(shape, "plane_id").join(told, "plane_id", "left")
    out = out.join(_gathered(axial_screen(tiles), "lines"), "plane_id", "left").join(_gathered(brightness_patterns(tiles, brightness), "brightness"), "plane_id", "left")
    kinds = (("bands", bands, alternating_bands), ("pairs", bands, band_pairs), ("local", local, local_scan))
    for name, config, work in kinds:
        rows = work(tiles, config or K.BandConfig()) if name != "local" else work(tiles, config or K.LocalConfig())
        columns = rows.drop("quality_decision")
        if config is None:
            out = out.withColumn(name, F.lit(None).cast(_gathered(columns, name).schema[name].dataType))
        else:
            out = out.join(_gathered(columns, name), "plane_id", "left").withColumn(name, F.coalesce(name, F.array().cast(_gathered(columns, name).schema[name].dataType)))
    out = out.withColumn("lines", F.coalesce("lines", F.array().cast(out.schema["lines"].dataType)))
    found = F.filter("local", lambda x: x["kind"].isNotNull())
    why = reasons(
        (F.exists("lines", lambda x: x["unique"]), "verified_lines"), (F.size("pairs") > 0, "band_pairs"), (F.size(found) > 0, "local_candidates"), (F.exists("local", lambda x: x["omitted"] > 0), "budget_omissions"),
        (F.col("local").isNull(), "local_scan_unassessed"), (F.col("bands").isNull(), "bands_unassessed"), (F.col("metrics.ceiling_fraction") > 0.01, "saturated_samples"),
    )
    named = out.withColumn("methods", F.lit(methods)).withColumn("methods_sha256", F.sha2("methods", 256)).withColumn("modality", F.lit(modality))
    named = named.withColumn("asset_id", F.substring(F.sha2(F.concat_ws(":", "name", "file_sha256"), 256), 1, 16)).withColumn("run_identity", F.sha2(F.concat_ws(":", "file_sha256", "modality", "methods_sha256"), 256))
    return named.withColumn("reasons", why).withColumn("confirmed_lines", F.size(F.filter("lines", lambda x: x["unique"]))).withColumn("quality_decision", F.lit(None).cast("string"))
