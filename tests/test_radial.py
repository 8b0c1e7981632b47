"""Radial basis fields: exact at sources, exact for linear motion, and equal to one solve a grid point."""

import random

import numpy as np
import pytest

from spoorline.operators import matching, radial


def scattered(n, seed=5):
    r = np.random.default_rng(seed)
    return r.uniform(0, 100, (n, 2)), r.uniform(-3, 3, (n, 2))


@pytest.mark.parametrize("kernel", list(radial.KERNELS))
def test_solve(kernel):
    p, v = scattered(25)
    assert np.abs(radial.solve(p, v, p, kernel, smoothing=0.0, epsilon=0.05) - v).max() < 1e-4
    if radial.KERNELS[kernel][2] >= 1:
        line = lambda q: np.stack([2 + 0.5 * q[:, 0] - q[:, 1], 3 - 0.1 * q[:, 0]], axis=1)
        q = np.random.default_rng(1).uniform(-20, 120, (30, 2))
        assert np.abs(radial.solve(p, line(p), q, kernel, smoothing=10.0) - line(q)).max() < 1e-6


def test_no_solution():
    """Sources on one line: inverse squared distances."""
    p, v = np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]), np.array([[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]])
    out = radial.solve(p, v, np.array([[1.0, 0.0], [1.0, 5.0]]))
    assert abs(out[0, 0] - 2) < 1e-4 and abs(out[1, 0] - 2) < 1e-9


def test_field(spark):
    r = random.Random(2)
    src = []
    for frame, n in ((0, 150), (1, 40), (2, 2), (3, 130)):
        p, v = scattered(n, frame)
        if frame == 3:
            p[:120] = p[:120] / 50  # a crowd in one corner, some far away
        src += [(i, frame, *map(float, p[i]), *((None, None) if r.random() < 0.1 and frame == 0 else map(float, v[i]))) for i in range(n)]
    grid = [(f, i, j, i * 20.0, j * 30.0) for f in range(5) for i in range(6) for j in range(4)]
    sources, cells = spark.createDataFrame(src, "s_id long, frame int, px double, py double, dx double, dy double"), spark.createDataFrame(grid, "frame int, gx int, gy int, x double, y double")
    got = {(g.frame, g.gx, g.gy): (g.vx, g.vy) for g in radial.radial_field(sources, cells, 4.0).collect()}
    assert len(got) == len(grid)
    for f, i, j, x, y in grid:
        own = [s for s in src if s[1] == f and s[4] is not None]
        n = sum(s[1] == f for s in src)
        if len(own) < 3:
            assert got[f, i, j] == (0.0, 0.0)
            continue
        own.sort(key=lambda s: (np.hypot(s[2] - x, s[3] - y), s[0]))
        a = np.array([s[2:] for s in (own[:32] if n > 100 else own)])
        assert np.allclose(got[f, i, j], radial.solve(a[:, :2], a[:, 2:], np.array([[x, y]]))[0], atol=1e-6)


def test_nearest_k_of_few(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0), (1, 2, 0.0, 0.0), (9, 3, 0.0, 0.0)], "frame int, q int, x double, y double")
    b = spark.createDataFrame([(0, 7, 900.0, 0.0), (0, 8, 3.0, 4.0), (0, 6, 3.0, -4.0), (1, 5, 1.0, 1.0)], "frame int, s_id long, px double, py double")
    got = {(r.q, r.rank): (r.s_id, r.d) for r in matching.nearest_k(a, b, ["q"], "s_id", 3, 2.0).collect()}
    assert got == {(1, 1): (6, 5.0), (1, 2): (8, 5.0), (1, 3): (7, 900.0), (2, 1): (5, 2**0.5)}
    assert matching.nearest_k(a.limit(0), b, ["q"], "s_id", 3, 2.0).count() == 0
