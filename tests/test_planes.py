"""Known-geometry planes, raster oracles and file round trips."""

import numpy as np
import pandas as pd
import pytest

from planeworks.kernels import detect as K
from planeworks.kernels import raster as R
from planeworks.operators import aggregates as A
from planeworks.operators import detectors as D
from planeworks.operators import selection as S
from planeworks.sources import tiff as T


def frame(spark, plane, size=64, name="p"):
    return spark.createDataFrame(pd.DataFrame(list(T.cut(name, plane, size))), T.TILE_SCHEMA)


@pytest.mark.parametrize("options", [{}, {"deflate": True}, {"order": ">"}, {"tile": 16}, {"tile": 16, "deflate": True, "order": ">"}, {"compression": T.LZW}, {"compression": T.PACKBITS, "tile": 16}, {"compression": T.LZW, "predictor": 2, "order": ">"}, {"deflate": True, "predictor": 2, "tile": 16}])
@pytest.mark.parametrize("shape", [(32, 48), (35, 50), (19, 37)])
def test_tiff_layouts(shape, options):
    plane = (np.arange(shape[0] * shape[1]) * 17 % 65536).astype(np.uint16).reshape(shape)
    assert (T.decode(T.encode(plane, **options)) == plane).all()


def test_tiff_guards():
    good = T.encode(np.ones((16, 16), np.uint16))
    with pytest.raises(T.BadTiff):
        T.decode(b"no")
    with pytest.raises(T.BadTiff):
        T.decode(good[:-30])
    with pytest.raises(T.BadTiff, match="too large"):
        T.decode(good, max_pixels=100)
    with pytest.raises(T.BadTiff, match="page"):
        T.decode(good[:-4] + b"\x08\0\0\0")


def test_tiles_from_files_and_back(spark, tmp_path):
    plane = np.random.default_rng(104).integers(0, 65536, (70, 93)).astype(np.uint16)
    (tmp_path / "a.tif").write_bytes(T.encode(plane, deflate=True))
    (tmp_path / "b.tif").write_bytes(b"broken")
    tiles = T.read_tiles(T.files(spark, str(tmp_path)), 32)
    rows = tiles.collect()
    assert {r.status for r in rows} == {"ok", "rejected"} and [r.reason for r in rows if r.status == "rejected"] == ["not a TIFF"]
    ok = tiles.where("status = 'ok'")
    assert {r.pixel_sha256 for r in ok.collect()} == {T.pixel_sha(plane)}
    back = T.to_files(ok.select("plane_id", "height", "width", "y0", "x0", "h", "w", "data")).collect()
    assert (T.decode(back[0].content) == plane).all()
    px = T.pixels(ok).toPandas()
    got = np.zeros_like(plane)
    got[px["y"], px["x"]] = px["v"]
    assert (got == plane).all()
    assert T.crop(ok, 0, 0, 32, 32).count() == 1


def test_statistics_equal_numpy(spark):
    plane = np.random.default_rng(5).integers(0, 65536, (103, 57)).astype(np.uint16)
    hist = T.tile_histogram(frame(spark, plane))
    r = A.raw_statistics(hist, "plane_id").first()
    flat = plane.ravel()
    assert (r.n, r.min, r.max) == (flat.size, flat.min(), flat.max())
    assert np.allclose([r.mean, r["std"], r.p1, r.median, r.p995], [flat.mean(), flat.std(), *np.percentile(flat, [1, 50, 99.5])])


def test_union_area_is_the_raster(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(12):
        raster = np.zeros((29, 37), bool)
        for _ in range(16):
            x0, y0 = int(rng.integers(0, 36)), int(rng.integers(0, 28))
            x1, y1 = int(rng.integers(x0 + 1, 38)), int(rng.integers(y0 + 1, 30))
            raster[y0:y1, x0:x1] = True
            rows.append((k, x0, y0, x1, y1))
        want[k] = int(raster.sum())
    got = A.union_area(spark.createDataFrame(rows, "k int, x0 int, y0 int, x1 int, y1 int"), "k").collect()
    assert {r.k: r.area for r in got} == want


def test_axial_step(spark):
    plane = np.full((800, 800), 100, np.uint16)
    plane[:, 400:] = 1000
    for p, orientation in ((plane, "vertical"), (plane.T, "horizontal")):
        rows = [r for r in D.axial_screen(frame(spark, np.ascontiguousarray(p), 256)).collect() if r.verified]
        assert rows and {r.orientation for r in rows} == {orientation} and sum(r.unique for r in rows) == 1
        assert all(abs(r.native_line - 400) <= 4 for r in rows)


@pytest.mark.parametrize("plane", [np.full((512, 512), 1000), np.zeros((512, 512)), np.linspace(500, 2000, 512)[None, :].repeat(512, 0), np.random.default_rng(3).normal(1000, 10, (512, 512))])
def test_local_negatives(plane):
    assert K.local_scan(plane.astype(np.uint16), 0, 0)[0] == []


def test_local_hole_step_and_budget(spark):
    plane = np.full((701, 803), 1000, np.uint16)
    plane[600:680, 700:780] = 0
    found = D.local_scan(frame(spark, plane, 256), K.LocalConfig(tile=512, stride=384)).collect()
    dark = [r for r in found if r.kind == "dark"]
    assert dark and all(r.x1 > 700 and r.y1 > 600 and r.zero_fraction > 0.9 and r.quality_decision is None for r in dark)
    step = np.full((512, 512), 1000, np.uint16)
    step[:, 256:] = 250
    for p, axis in ((step, "x"), (np.ascontiguousarray(step.T), "y")):
        out = [c for c in K.local_scan(p, 0, 0)[0] if c["kind"] == "step"]
        assert out and {c["axis"] for c in out} == {axis} and all(abs(c["boundary"] - 256) <= 2 for c in out)
    assert D.local_scan(frame(spark, plane, 256), K.LocalConfig(max_tiles=0)).count() == 0
    with pytest.raises(ValueError):
        K.LocalConfig(stride=2000)


@pytest.mark.parametrize("angle", [0, 15, 90])
def test_bands(angle):
    y, x = np.mgrid[:1200, :1200]
    t = np.deg2rad(angle)
    normal = -(x - 599.5) * np.sin(t) + (y - 599.5) * np.cos(t)
    plane = np.where((np.abs(normal - 200) < 8) | (np.abs(normal + 200) < 8), 0, 4000).astype(np.uint16)
    bands, _, _ = K.band_proposals(plane, K.BandConfig(angles=(0, 15, 90), widths=(16,)))
    pairs = K.band_pairs(bands)
    assert len(pairs) == 1 and abs(pairs[0]["spacing"] - 400) <= 10
    for b in bands:
        v = K.verify_band(plane, b)
        assert v["status"] == "verified" and v["zero_fraction"] > 0.9 and abs(v["slope_deg"]) < 0.5
    assert K.verify_band(np.full((1200, 1200), 4000, np.uint16), bands[0])["status"] == "unverified"


def test_core():
    y, x = np.mgrid[:512, :512]
    plane = np.full((512, 512), 50, np.uint16)
    plane[(y - 256) ** 2 + (x - 256) ** 2 < 130**2] = 1500
    found = K.core_proposal(plane)
    assert found["state"] == "proposed" and found["labels"][256, 256] == 2 and np.hypot(found["center"][0] - 256, found["center"][1] - 256) < 4
    plane[220:250, 220:250] = 0
    assert K.core_proposal(plane)["labels"][235, 235] in (1, 2)
    for empty in (np.zeros((512, 512), np.uint16), np.full((512, 512), 7, np.uint16)):
        assert K.core_proposal(empty)["state"] == "unresolved"


def test_components_against_flood():
    rng = np.random.default_rng(0)
    for _ in range(5):
        mask = rng.random((23, 31)) < 0.45
        labels, n = R.components(mask)
        seen, count = np.zeros(mask.shape, bool), 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            count += 1
            stack, cells = [(y, x)], []
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                cells.append((a, b))
                for i in range(max(0, a - 1), min(23, a + 2)):
                    for j in range(max(0, b - 1), min(31, b + 2)):
                        if mask[i, j] and not seen[i, j]:
                            seen[i, j] = True
                            stack.append((i, j))
            assert len({labels[c] for c in cells}) == 1
        assert n == count


def test_greedy_lines_are_the_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 3)), i, int(rng.integers(0, 60)), s := int(rng.integers(0, 50)), s + int(rng.integers(1, 40))) for i in range(300)]
    got = {r.id: (r.keep, r.duplicate_of) for r in S.greedy_lines(spark.createDataFrame(rows, "k int, id int, pos int, start int, end int"), "k").collect()}
    kept = []
    for k, i, p, s, e in sorted(rows, key=lambda r: (r[3] - r[4], r[2], r[3], r[1])):
        hit = any(q[0] == k and abs(q[2] - p) <= 3 and s < q[4] and q[3] < e for q in kept)
        assert got[i][0] is (not hit)
        if not hit:
            kept.append((k, i, p, s, e))


def test_fragments_join():
    y, x = np.mgrid[:512, :512]
    plane = np.full((512, 512), 50, np.uint16)
    disk = (y - 256) ** 2 + (x - 256) ** 2 < 130**2
    plane[disk & (np.abs(x - 256) > 12)] = 1500
    found = K.core_proposal(plane)
    assert found["objects"] == 1 and found["state"] == "proposed"


def test_local_record_is_checked(spark):
    sides = "grid_index long, x0 long, y0 long, x1 long, y1 long"
    planned = spark.createDataFrame([(0, 0, 0, 9, 9), (1, 5, 0, 14, 9), (2, 9, 0, 18, 9)], sides)
    good = spark.createDataFrame([(0, 0, 0, 9, 9, 1), (1, 5, 0, 14, 9, 0), (2, 9, 0, 18, 9, 0)], sides + ", candidates long")
    one = spark.createDataFrame([(0, 1, 1, 3, 3)], sides)
    assert D.local_violations(one, good, planned).count() == 0
    bad = spark.createDataFrame([(0, 0, 0, 9, 9, 2), (1, 6, 0, 14, 9, 0), (7, 0, 0, 1, 1, 0)], sides + ", candidates long")
    moved = spark.createDataFrame([(0, 1, 1, 30, 3), (9, 0, 0, 1, 1)], sides)
    got = {(r.grid_index, r.violation) for r in D.local_violations(moved, bad, planned).collect()}
    assert got == {(0, "count_differs"), (0, "candidate_outside_tile"), (1, "tile_moved"), (2, "tile_missing"), (7, "tile_unplanned"), (9, "candidate_without_tile")}


def test_overlay():
    out = R.draw_lines(np.zeros((40, 40), np.uint8), [{"orientation": "vertical", "pos": 2, "start": 0, "end": 5, "verified": True}, {"orientation": "horizontal", "pos": 3, "start": 1, "end": 2}], 8)
    assert out[10, 15] == 255 and out[23, 8] == 128 and out[0, 0] == 0
