"""The exact spot detector: kernels and places by hand and by plain loops."""

import math

import numpy as np

from spoorline.operators import detection as d


def test_half_kernel():
    for sigma in (0.4, 0.86, 1.3, 2.0, 3.7, 8.0):
        k = d.half_kernel(sigma)
        assert len(k) == max(2, int(3 * sigma + 0.5) + 1)
        assert abs(k[0] + 2 * k[1:].sum() - 1) < 1e-12 and (np.diff(k) < 0).all()
    # Two values: no tail. sigma 2: seven values, tail by the rule, worked out one by one.
    assert np.allclose(d.half_kernel(0.4), np.array([1, math.exp(-1 / 0.32)]) / (1 + 2 * math.exp(-1 / 0.32)))
    g = [math.exp(-x * x / 8) for x in range(7)]
    ratio = [g[x] / (7 - x) ** 2 for x in range(7)]
    r = 6
    while r > 3 and ratio[r - 1] < ratio[r]:
        r -= 1
    want = np.array([*g[: r + 1], *(ratio[r] * (7 - x) ** 2 for x in range(r + 1, 7))])
    assert np.allclose(d.half_kernel(2.0), want / (want[0] + 2 * want[1:].sum()))


def brute(a, radius, threshold, size):
    """Every pixel by itself."""
    h, w = a.shape
    fold = lambda i, n: 0 if n == 1 else (n - 1) - abs((n - 1) - i % (2 * n - 2))

    def smooth(sigma):
        k = d.half_kernel(sigma)
        n = len(k) - 1
        once = [[sum(k[abs(o)] * a[fold(i + o, h), j] for o in range(-n, n + 1)) for j in range(w)] for i in range(h)]
        return np.array([[sum(k[abs(o)] * once[i][fold(j + o, w)] for o in range(-n, n + 1)) for j in range(w)] for i in range(h)])

    s1 = max(1.0, radius / math.sqrt(2) * 0.9 / size)
    r = smooth(math.sqrt(s1 * s1 - 0.25)) - smooth(math.sqrt((s1 * 1.1 / 0.9) ** 2 - 0.25))
    out = []
    for i in range(h):
        for j in range(w):
            around = [r[fold(i + p, h), fold(j + q, w)] for p in (-1, 0, 1) for q in (-1, 0, 1)]
            if r[i, j] >= max(around) and r[i, j] >= threshold - 0.00012:
                y, x = float(i), float(j)
                if 0 < i < h - 1 and 0 < j < w - 1:
                    y += (r[i - 1, j] - r[i + 1, j]) / (2 * (2 * r[i, j] - r[i - 1, j] - r[i + 1, j]))
                    x += (r[i, j - 1] - r[i, j + 1]) / (2 * (2 * r[i, j] - r[i, j - 1] - r[i, j + 1]))
                out.append((x, y, r[min(h - 1, max(0, round(y))), min(w - 1, max(0, round(x)))]))
    return sorted(out)


def test_detect_exact(spark):
    rng = np.random.default_rng(2)
    frames = [rng.uniform(0, 50, (12, 17)), np.zeros((9, 9)), rng.uniform(0, 9, (1, 8))]
    yy, xx = np.mgrid[0:9, 0:9]
    frames[1] += 40 * np.exp(-((xx - 4.3) ** 2 + (yy - 0.2) ** 2) / 4)
    rows = [(f, j, i, float(a[i, j])) for f, a in enumerate(frames) for i in range(a.shape[0]) for j in range(a.shape[1])]
    pixels = spark.createDataFrame(rows, "frame int, px int, py int, value double").repartition(3)
    got = d.detect_exact(pixels, 2.5, 0.5, (0.5, 0.25)).collect()
    for f, a in enumerate(frames):
        want = brute(a, 2.5, 0.5, 0.5)
        have = sorted((r.x_pixel, r.y_pixel, r.quality) for r in got if r.frame == f)
        assert len(have) == len(want) and np.allclose(np.array(have), np.array(want), atol=1e-9)
    assert all(abs(r.x - 0.25 * r.x_pixel) < 1e-12 and abs(r.y - 0.5 * r.y_pixel) < 1e-12 for r in got)


def test_subpixel_and_border(spark):
    yy, xx = np.mgrid[0:15, 0:15]
    a = np.exp(-((xx - 7) ** 2 + (yy - 7) ** 2) / 4) + np.exp(-((xx - 0) ** 2 + (yy - 13) ** 2) / 4)
    pixels = spark.createDataFrame([(0, int(j), int(i), float(a[i, j])) for i in range(15) for j in range(15)], "frame int, px int, py int, value double")
    places = lambda **more: {(round(r.x, 2), round(r.y, 2)) for r in d.detect(pixels, 2.0, 0.05, **more).collect()}
    assert places() == {(7.0, 7.0)} and places(border=0) == {(7.0, 7.0), (0.0, 13.0)}
    assert places(subpixel=True) == {(7.0, 7.0)}
