"""Block means, blurs, thresholds, morphology, connected components, hulls."""

from __future__ import annotations

import numpy as np


def block_mean(a: np.ndarray, step: int) -> np.ndarray:
    """Means of step x step blocks; edge blocks have their true count."""
    rows, cols = np.arange(0, a.shape[0], step), np.arange(0, a.shape[1], step)
    total = np.add.reduceat(np.add.reduceat(a.astype(np.float64), rows, axis=0), cols, axis=1)
    return total / np.outer(np.diff(np.append(rows, a.shape[0])), np.diff(np.append(cols, a.shape[1])))


def step_for(shape: tuple[int, int], most: int) -> int:
    return max(1, -(-max(shape) // most))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, mirrored at the border without repeating it."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(a, pad, mode="reflect" if a.shape[axis] > r else "edge")
        a = sum(w * np.take(wide, np.arange(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    return a


def otsu(values: np.ndarray, bins: int = 256) -> float | None:
    """The lower edge of the first bin above the split of greatest between-class variance; None if constant."""
    if values.size == 0 or values.min() == values.max():
        return None
    hist, edges = np.histogram(values, bins)
    w = hist.cumsum() / hist.sum()
    m = (hist * np.arange(bins)).cumsum() / hist.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w > 0) & (w < 1), (m[-1] * w - m) ** 2 / (w * (1 - w)), -1.0)
    return float(edges[int(between.argmax()) + 1])


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(labels from 1 on in row-major order of first cells, their number), 8-connected, by unions of row runs."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x0 = np.nonzero(edge == 1)
    _, x1 = np.nonzero(edge == -1)
    up = list(range(len(y)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    at = np.searchsorted(y, np.arange(h + 1))
    for row in range(1, h):
        i, j, ie, je = at[row - 1], at[row], at[row], at[row + 1]
        while i < ie and j < je:
            if x0[i] <= x1[j] and x0[j] <= x1[i]:  # touching corners join
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(y))], np.int64)
    _, number = np.unique(roots, return_inverse=True)
    labels = np.zeros((h, w), np.int32)
    for r, a, b, n in zip(y, x0, x1, number, strict=True):
        labels[r, a:b] = n + 1
    return labels, int(number.max()) + 1 if len(y) else 0


def disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return y * y + x * x <= radius * radius + radius


def dilate(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    r = element.shape[0] // 2
    wide = np.pad(mask, r)
    out = np.zeros_like(mask)
    for dy, dx in zip(*np.nonzero(element), strict=True):
        out |= wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def erode(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    """Outside counts as set."""
    return ~dilate(~mask, element)


def close(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    return erode(dilate(mask, element), element)


def hull(points: np.ndarray) -> np.ndarray:
    """Vertices (x, y) of the convex hull, collinear points dropped, counter-clockwise in x-right, y-up axes."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = half(p.tolist()), half(p[::-1].tolist())
    return np.array(lower[:-1] + upper[:-1])


def fill(vertices: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Cells whose centres lie in or on a convex polygon."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    inside = np.ones(shape, bool)
    n = len(vertices)
    if n < 3:
        out = np.zeros(shape, bool)
        out[vertices[:, 1].astype(int), vertices[:, 0].astype(int)] = True
        return out
    for i in range(n):
        (ax, ay), (bx, by) = vertices[i], vertices[(i + 1) % n]
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9
    return inside


def rotate(a: np.ndarray, degrees: float) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(bilinear resampling on axes turned by `degrees`, weight of real samples, centre x, centre y, half size)."""
    h, w = a.shape
    half = int(np.ceil(np.hypot(h, w) / 2))
    v, u = np.mgrid[-half : half + 1, -half : half + 1].astype(float)
    t = np.deg2rad(degrees)
    cx, cy = (w - 1) / 2, (h - 1) / 2
    x, y = cx + u * np.cos(t) - v * np.sin(t), cy + u * np.sin(t) + v * np.cos(t)
    ok = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    xc, yc = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(xc.astype(int), max(0, w - 2)), np.minimum(yc.astype(int), max(0, h - 2))
    fx, fy = xc - x0, yc - y0
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    return np.where(ok, out, 0.0), ok.astype(float), cx, cy, float(half)


def true_runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, end exclusive) of each run of true values."""
    edge = np.diff(np.pad(mask.astype(np.int8), 1))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def intensity_region(means: np.ndarray, bins: int = 256) -> tuple[np.ndarray, float | None]:
    """(mask, threshold on log levels) of support that may hold two populations: the split of nonzero log levels, held
    between the low mode plus six of its spreads and a share of the range above it; None without two levels."""
    levels = np.log1p(means)
    own = levels[means > 0]
    if own.size < 2 or own.min() == own.max():
        return np.zeros(means.shape, bool), None
    split = otsu(own, bins)
    hist, edges = np.histogram(own, bins)
    smooth = np.convolve(hist, np.ones(5) / 5, "same")
    centres = (edges[:-1] + edges[1:]) / 2
    below = centres <= split
    mode = float(centres[below][smooth[below].argmax()]) if below.any() else float(centres[0])
    low = own[own <= mode]
    spread = float(np.sqrt(((low - mode) ** 2).mean())) if low.size else 0.0
    top = float(np.percentile(own, 99.5))
    threshold = min(max(split, mode + 6 * spread), mode + 0.6 * (top - mode)) if top > mode else split
    return (levels > threshold) & (means > 0), float(threshold)


def draw_lines(gray: np.ndarray, lines: list[dict], step: int) -> np.ndarray:
    """A copy of a preview with verified lines in white and others in mid gray; lines have orientation, pos, start, end
    in overview cells of `step` preview samples."""
    out = gray.copy()
    for a in lines:
        level = 255 if a.get("verified") else 128
        p, s, e = a["pos"] * step, a["start"] * step, a["end"] * step
        if a["orientation"] == "vertical":
            out[s:e, max(0, p - 1) : p + 1] = level
        else:
            out[max(0, p - 1) : p + 1, s:e] = level
    return out
