import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planeworks import streaming
from planeworks.kernels import detect as K
from planeworks.operators import ledger as L
from planeworks.operators import measure as M
from planeworks.operators import supporting as U
from planeworks.sources import tiff as T


def frame(spark, plane, size=256):
    return spark.createDataFrame(pd.DataFrame(list(T.cut("p", plane, size))), T.TILE_SCHEMA)


def test_period_is_found():
    rng = np.random.default_rng(19)
    x = np.arange(1024)
    plane = np.clip(1600 * np.exp(0.3 * np.sin(2 * np.pi * x / 128))[None, :] + rng.normal(0, 8, (128, 1024)), 0, 65535).astype(np.uint16)
    config = M.BrightnessConfig(foreground="all", period=128)
    row = M.brightness(plane, config)[0]
    assert row["period_status"] == "measured" and row["r2"] > 0.8 and row["amplitude"] > 0.4 and row["r2"] - row["best_control_r2"] > 0.3
    turned = M.brightness(np.ascontiguousarray(plane.T), config)[1]
    assert turned["r2"] == pytest.approx(row["r2"])
    noise = np.clip(1600 * np.exp(rng.normal(0, 0.15, 1024))[None, :].repeat(128, 0), 0, 65535).astype(np.uint16)
    assert (M.brightness(noise, config)[0]["r2"] or 0) < 0.1
    assert M.brightness(plane, M.BrightnessConfig(foreground="all", period=20))[0]["period_status"] == "period_below_resolution"


def test_broad_and_window():
    half = np.full((128, 1024), 1000, np.uint16)
    half[:, 512:] = 2000
    row = M.brightness(half, M.BrightnessConfig(foreground="all"))[0]
    assert row["window_position"] == 512 and row["span"] > 0.4 and row["period_status"] == "not_requested"
    assert M.brightness(np.zeros((64, 64), np.uint16), M.BrightnessConfig())[0]["status"] == "unassessed"
    with pytest.raises(ValueError):
        M.BrightnessConfig(coverage=0)


def test_identity_follows_settings():
    a, b = M.BrightnessConfig(), M.BrightnessConfig(period=128)
    assert M.identity("f", "x", a) == M.identity("f", "x", M.BrightnessConfig()) != M.identity("f", "x", b)


def test_record(spark):
    plane = np.full((700, 700), 1000, np.uint16)
    plane[200:280, 180:260] = 0
    tiles = frame(spark, plane)
    r = M.measure(tiles, T.tile_histogram(tiles)).first()
    assert r.n == 490000 and r.zero_count == 6400 and r.candidates > 0 and "local_candidates" in r.reasons and r.route == "review" and r.quality_decision is None


def test_whole_record(spark):
    plane = np.full((600, 640), 1000, np.uint16)
    plane[:, 320:] = 3000
    tiles = frame(spark, plane)
    files = spark.createDataFrame([("p", "a.tif", "f" * 64, T.pixel_sha(plane)), ("q", "b.tif", "0" * 64, "")], "plane_id string, name string, file_sha256 string, pixel_sha256 string")
    rows = M.measurement_record(tiles, files, local=K.LocalConfig(tile=512, stride=384)).collect()
    assert [r.plane_id for r in rows] == ["p"]
    r = rows[0]
    assert (r.height, r.width, r.metrics.n, r.metrics.min, r.metrics.max) == (600, 640, 600 * 640, 1000, 3000)
    assert r.confirmed_lines == 1 and "verified_lines" in r.reasons and "bands_unassessed" in r.reasons and r.bands is None and r.pairs is None
    assert any(x.kind == "step" for x in r.local) and "local_candidates" in r.reasons and len(r.brightness) == 2 and r.quality_decision is None
    assert r.asset_id == hashlib.sha256(f"a.tif:{'f' * 64}".encode()).hexdigest()[:16]
    assert r.run_identity == hashlib.sha256(f"{'f' * 64}:autofluorescence:{r.methods_sha256}".encode()).hexdigest()
    with pytest.raises(ValueError):
        M.methods_json("x")


def blobs(h, w):
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(4)
    plane = np.where((y - h / 2) ** 2 + (x - w / 3) ** 2 < (h / 4) ** 2, 4000, 300) + rng.integers(0, 200, (h, w))
    return plane.astype(np.uint16)


def test_supporting_metrics_are_numpys(spark):
    plane, size, most, parts = blobs(150, 210), 64, 70, 8
    y, x = np.mgrid[: plane.shape[0], : plane.shape[1]]
    rows = spark.createDataFrame(pd.DataFrame({"plane_id": "p", "y": y.ravel(), "x": x.ravel(), "v": plane.ravel().astype(np.int64)}))
    step = -(-max(plane.shape) // most)
    view = plane[::step, ::step].astype(float)
    low, high = np.percentile(view, [1, 99.5])
    gray = np.floor(np.clip((view - low) / (high - low), 0, 1) * 255 + 0.5).astype(int)
    score = {}
    for t in range(255):
        a, b = gray[gray <= t], gray[gray > t]
        if len(a) and len(b):
            score[t] = round(len(a) * len(b) / gray.size**2 * (a.mean() - b.mean()) ** 2, 6)
    threshold = min(t for t in score if score[t] == max(score.values()))

    def square(mask, f, fill):
        wide = np.pad(mask, 2, constant_values=fill)
        return f([wide[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(5) for j in range(5)], axis=0)

    fg = square(square(gray > threshold, np.any, False), np.all, True)
    full = fg[np.ix_(np.arange(plane.shape[0]) // step, np.arange(plane.shape[1]) // step)]
    details = []
    for py in range(0, plane.shape[0], size):
        for px in range(0, plane.shape[1], size):
            v, m = plane[py : py + size, px : px + size].astype(float), full[py : py + size, px : px + size]
            inner = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
            lap = (v[:-2, 1:-1] + v[2:, 1:-1] + v[1:-1, :-2] + v[1:-1, 2:] - 4 * v[1:-1, 1:-1])[inner]
            if len(lap) and v[m].var() > 0:
                details.append((lap**2).mean() / v[m].var())
    medians = []
    ys, xs = (np.linspace(0, n, min(parts, n) + 1).astype(int) for n in view.shape)
    for a, b in zip(ys[:-1], ys[1:]):
        for c, d in zip(xs[:-1], xs[1:]):
            ground = ~fg[a:b, c:d]
            if ground.sum() >= 32 and ground.mean() >= 0.8:
                medians.append(np.median(view[a:b, c:d][ground]))
    r = U.supporting_metrics(rows, size, most, parts).first()
    p10, p90 = np.percentile(medians, [10, 90])
    assert 0 < full.sum() < full.size and (r.step, r.threshold, r.foreground, r.valid_patches, r.eligible_cells) == (step, threshold, full.sum(), len(details), len(medians))
    assert np.allclose([r.median_detail, r.foreground_share, r.span, r.span_share], [np.median(details), full.mean(), p90 - p10, (p90 - p10) / (high - low)])
    flat = U.supporting_metrics(rows.withColumn("v", F.lit(7).cast("long")), size, most, parts).first()
    assert flat.foreground == 0 and flat.median_detail is None and flat.threshold is None and flat.span == 0 and flat.span_share is None


def test_requests(spark):
    rows = [(1, 1, "a", 1), (1, 1, "a", 2), (1, 1, "b", 3), (1, 2, "a", 4), (1, 3, "a", 5), (1, 3, "a", 6), (2, 1, None, 1), (2, 1, None, 2)]
    got = {(r.session, r.seq): r.status for r in L.settle_requests(spark.createDataFrame(rows, "session long, request_id long, args string, seq long"), 2).collect()}
    assert got == {(1, 1): "committed", (1, 2): "replayed", (1, 3): "conflict", (1, 4): "committed", (1, 5): "over_budget", (1, 6): "over_budget", (2, 1): "committed", (2, 2): "replayed"}


def test_request_stream_is_the_batch(spark, tmp_path):
    rows = [(s, (7 * i) % 5, "ab"[i % 3 == 0], i) for s in (1, 2) for i in range(20)]
    schema = "session long, request_id long, args string, seq long"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[3] // 10 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = streaming.settle_stream(stream, 3).writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM settled").count() == len(rows)


def test_placement_is_stable(spark):
    sha = "0" * 64
    jobs = [(f"image-{i:04d}", f"p/{i}", sha, 10) for i in range(30)]
    schema = "asset_id string, relative_path string, source_file_sha256 string, size_bytes long"
    few = {r.asset_id: r.node for r in L.place_jobs(spark.createDataFrame(jobs[:10], schema), 7).collect()}
    many = {r.asset_id: r.node for r in L.place_jobs(spark.createDataFrame(jobs, schema), 7).collect()}
    import hashlib

    assert all(many[k] == v for k, v in few.items()) and many["image-0007"] == int(hashlib.sha256(b"image-0007").hexdigest(), 16) % 7
    bad = L.place_jobs(spark.createDataFrame([("-x", "../a", "zz", 0), (None, None, None, None)], schema), 2).collect()
    assert all(r.node is None and len(r.reasons) == 4 for r in bad)
    with pytest.raises(ValueError):
        L.place_jobs(spark.createDataFrame(jobs, schema), 0)


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    plane = np.arange(600, dtype=np.uint16).reshape(20, 30) % 7
    (tmp_path / "in" / "a.tif").write_bytes(T.encode(plane))
    q = streaming.arriving_histograms(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("hist").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.v: r.cnt for r in spark.sql("SELECT * FROM hist").collect()} == dict(zip(*(x.tolist() for x in np.unique(plane, return_counts=True)), strict=True))
