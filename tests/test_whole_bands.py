"""Band and region searches with the reference's default grids, on planes of known geometry."""

import numpy as np
import pytest

from planeworks.kernels import detect as K
from planeworks.operators import measure as M


def banded(size, angle, *bands, level=4000):
    """A plane with dark bands (offset of the normal from the centre, width)."""
    y, x = np.mgrid[:size, :size] - (size - 1) / 2
    t = np.deg2rad(angle)
    normal = -x * np.sin(t) + y * np.cos(t)
    return np.where(np.any([np.abs(normal - at) < width / 2 for at, width in bands], axis=0), 0, level).astype(np.uint16)


def test_default_grids():
    assert K.BandConfig().widths == (4, 16, 64, 256, 768) and K.BandConfig().gap == 64
    assert set(K.BandConfig().angles) == {0, -1, 1, -3, 3, -15, 15, -45, 45, 90}
    assert K.LocalConfig().widths == (16, 64, 256) and M.BrightnessConfig().windows == (32, 128, 512)


@pytest.mark.parametrize("angle", [-45, -15, 3])
def test_narrow_bands_off_the_axes(angle):
    best = K.band_proposals(banded(900, angle, (60, 12)))[0][0]
    assert abs((best["angle"] - angle + 90) % 180 - 90) <= 1 and abs(best["normal"] - (60 + 449.5 * (np.cos(np.deg2rad(angle)) - np.sin(np.deg2rad(angle))))) <= 16


def test_wide_band_and_broken_band():
    wide = np.full((4096, 4096), 4000, np.uint16)
    wide[1664:2432] = 0
    assert any(b["width"] == 768 and b["angle"] == 0 and abs(b["normal"] - 2048) <= 100 for b in K.band_proposals(wide)[0])
    broken = banded(1000, 0, (0, 16))
    for x in range(100, 1000, 180):
        broken[:, x : x + 60] = 4000
    assert any(b["width"] == 16 and b["s1"] - b["s0"] > 900 for b in K.band_proposals(broken)[0] if b["angle"] == 0)


def test_wide_region():
    plane = np.full((1024, 1024), 4000, np.uint16)
    plane[384:640, 384:640] = 0
    assert 256 in {c["width"] for c in K.dark_regions(plane)[0]}


SMALL = K.BandConfig(angles=(0, 90), widths=(16,))


def pairs(plane):
    bands = K.verified_bands(plane, SMALL)
    return bands, K.alternating_pairs(plane, bands, SMALL)


def test_pairs_are_verified_and_brighter_between(spark):
    good = banded(1000, 0, (-200, 16), (200, 16))
    bands, found = pairs(good)
    assert len(bands) == 2 and len(found) == 1 and abs(found[0]["spacing"] - 400) <= 4 and found[0]["straight"]
    dark = good.copy()
    dark[330:670] = 0  # as dark as the bands, but for a rim beside each
    bands, found = pairs(dark)
    assert len(bands) == 2 and len(K.band_pairs(bands)) == 1 and found == []
    from planeworks.operators import detectors as D
    from test_planes import frame

    assert [D.band_pairs(frame(spark, p, 512), SMALL).count() for p in (good, dark)] == [1, 0]


def test_pairs_keep_their_distance():
    band = {"width": 16, "mean": 0.0, "straight": True, "angle": 0.0, "normal": 300.0, "s0": 100.0, "s1": 900.0}
    plane = np.full((1000, 1000), 4000, np.uint16)
    level, tilted = {**band, "normal": 400.0}, {**band, "angle": 2.9, "normal": 375.0}
    assert len(K.alternating_pairs(plane, [band, level])) == 1
    assert len(K.band_pairs([band, tilted])) == 1 and K.alternating_pairs(plane, [band, tilted]) == []


def test_edges():
    plane = banded(1000, 0, (0, 24))
    assert K.verified_bands(plane, SMALL)[0]["straight"]
    y, x = np.mgrid[:1000, :1000] - 499.5
    wavy = np.where(np.abs(y) < 12 + 8 * np.sin(x / 25), 0, 4000).astype(np.uint16)
    bands = K.verified_bands(wavy, SMALL)
    assert bands and not bands[0]["straight"]
