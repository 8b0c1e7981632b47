"""Propagation step by step against plain loops."""

import math
import random

import numpy as np

from spoorline.operators import blobs, stepwise
from spoorline.sources import tiles

T, W, H = 9, 90, 70


def half_even(v):
    return int(np.rint(v))


def field(rng, cells=(5, 4), t=T):
    return {(f, i, j): (rng.uniform(-4, 4), rng.uniform(-4, 4)) for f in range(t - 1) for i in range(cells[0]) for j in range(cells[1]) if rng.random() < 0.9}


def flow_frame(spark, flow):
    return spark.createDataFrame([(f, i, j, dx, dy) for (f, i, j), (dx, dy) in flow.items()], "frame int, gx int, gy int, dx double, dy double")


def moved_by_motion(x, y, t, vectors, flow, radius, cells):
    gx, gy = max(0, min(cells[0] - 1, half_even(x / 20))), max(0, min(cells[1] - 1, half_even(y / 20)))
    fx, fy = flow.get((t, gx, gy), (0.0, 0.0))
    w = wx = wy = 0.0
    for _, px, py, mx, my in sorted(vectors.get(t, [])):
        d = math.hypot(x - px, y - py)
        if d < 1e-6:
            return mx, my
        if d <= radius:
            w, wx, wy = w + d**-2.0, wx + mx * d**-2.0, wy + my * d**-2.0
    return (0.9 * wx / w + 0.1 * fx, 0.9 * wy / w + 0.1 * fy) if w else (fx, fy)


def test_optimise_motion(spark):
    rng = random.Random(3)
    completed = {k: {f: (rng.uniform(0, 90) if f == 0 else None, rng.uniform(0, 70)) for f in range(T) if not (k == 2 and f == 4)} for k in range(6)}
    for p in completed.values():
        x, y = rng.uniform(0, 90), rng.uniform(0, 70)
        for f in p:
            x, y = x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)
            p[f] = (x, y)
    open_ = {10: {f: (rng.uniform(0, 90), rng.uniform(0, 70)) for f in range(3, 8)}, 11: {0: completed[0][0], 1: (1.0, 1.0), 5: (2.0, 2.0)}, 12: {4: (5.0, 5.0)}, 13: {f: (500.0, 500.0) for f in range(2, T)}, 14: {T - 2: (3.0, 60.0), T - 1: (0.0, 0.0)}}
    flow, cells = field(rng), (5, 4)
    vectors = {}
    for k, p in completed.items():
        for f in p:
            if f + 1 in p:
                vectors.setdefault(f, []).append((k, *p[f], p[f + 1][0] - p[f][0], p[f + 1][1] - p[f][1]))
    expected = {}
    for k, p in open_.items():
        a, b = min(p), max(p)
        expected[k, a] = x, y = p[a]
        for t in range(a, b):
            dx, dy = moved_by_motion(x, y, t, vectors, flow, 30.0, cells)
            x, y = x + dx, y + dy
            expected[k, t + 1] = (x, y)
        x, y = p[a]
        for t in range(a - 1, -1, -1) if b > a else ():
            dx, dy = moved_by_motion(x, y, t, vectors, flow, 30.0, cells)
            x, y = x - dx, y - dy
            expected[k, t] = (x, y)
    rows = lambda tracks: spark.createDataFrame([(k, f, float(x), float(y)) for k, p in tracks.items() for f, (x, y) in p.items()], "track_id long, frame int, x double, y double")
    out = stepwise.optimise_motion(rows(open_), rows(completed), flow_frame(spark, flow), 20.0, 20.0, 30.0, cells=cells)
    got = {(r.track_id, r.frame): (r.x, r.y) for r in out.collect()}
    assert got.keys() == expected.keys() and out.count() == len(expected)
    for k, (x, y) in expected.items():
        assert math.hypot(got[k][0] - x, got[k][1] - y) < 1e-6, k
    moves = {r.track_id: r for r in stepwise.improvement(rows(open_), out).collect()}
    assert moves[12].mean_move == 0 and moves[10].frames == 5
    # Nothing completed: nothing changes. Nothing open: nothing comes back.
    none = rows(completed).limit(0)
    assert stepwise.optimise_motion(rows(open_), none, flow_frame(spark, flow), 20.0, 20.0).count() == sum(map(len, open_.values()))
    assert stepwise.optimise_motion(none, rows(completed), flow_frame(spark, flow), 20.0, 20.0).count() == 0


def video(rng, places):
    """Frames with a round spot at each place of a frame."""
    yy, xx = np.mgrid[0:H, 0:W]
    out = []
    for spots in places:
        a = np.zeros((H, W))
        for x, y in spots:
            a += np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * 3.0**2))
        out.append((a + 0.001 * np.array([rng.random() for _ in range(H * W)]).reshape(H, W)).astype(np.float32))
    return out


def blob_place(image, x, y, search, radius):
    r = int(search)
    x0, x1, y0, y1 = max(0, int(x) - r), min(W, int(x) + r + 1), max(0, int(y) - r), min(H, int(y) + r + 1)
    at = blobs.nearest_blob(image[y0:y1, x0:x1].astype(float), y - y0, x - x0, radius)
    return (x0 + at[1], y0 + at[0]) if at else (x, y)


def step(images, flow, t, x, y, ahead, search=15, radius=5.0):
    look = lambda t, a, b: flow.get((t, half_even(a / 20), half_even(b / 20)), (0.0, 0.0))
    keep = lambda a, b: (max(0.0, min(W - 1.0, a)), max(0.0, min(H - 1.0, b)))
    if ahead:
        dx, dy = look(t, x, y)
        return blob_place(images[t + 1], *keep(x + dx, y + dy), search, radius)
    a, b = x, y
    for _ in range(3):
        dx, dy = look(t - 1, a, b)
        a, b = keep(x - dx, y - dy)
    return blob_place(images[t - 1], a, b, search, radius)


def setup(spark):
    rng = random.Random(8)
    path = [(30 + 5 * f, 20 + 3 * f + (f % 2)) for f in range(T)]
    images = video(rng, [[p, (80 - 4 * f, 60 - 2 * f)] for f, p in enumerate(path)])
    images[5] = np.zeros((H, W), np.float32)  # nothing to be found: the prediction stays
    flow = field(rng)
    pixels = spark.createDataFrame([(f, j, i, float(a[i, j])) for f, a in enumerate(images) for i in range(H) for j in range(W) if a[i, j]], "frame int, px int, py int, value float").repartition(4)
    return images, flow, pixels, path


def test_propagate_blobs(spark):
    images, flow, pixels, path = setup(spark)
    seeds = {1: (3, *map(float, path[3])), 2: (0, 79.6, 60.4), 3: (T - 1, 1.0, 68.0)}
    expected = {}
    for k, (f, x, y) in seeds.items():
        whole = lambda a, b: (max(0, min(W - 1, half_even(a))), max(0, min(H - 1, half_even(b))))
        expected[k, f] = whole(x, y)
        a, b = x, y
        for t in range(f, T - 1):
            a, b = step(images, flow, t, a, b, True)
            expected[k, t + 1] = whole(a, b)
        a, b = x, y
        for t in range(f, 0, -1):
            a, b = step(images, flow, t, a, b, False)
            expected[k, t - 1] = whole(a, b)
    frame = spark.createDataFrame([(k, *s) for k, s in seeds.items()], "track_id long, frame int, x double, y double")
    out = blobs.propagate_blobs(frame, flow_frame(spark, flow), pixels, 20.0, 20.0, W, H, T - 1).collect()
    assert {(r.track_id, r.frame): (r.x, r.y) for r in out} == expected and len(out) == 3 * T
    on = {r.frame: (r.x, r.y) for r in out if r.track_id == 1}
    assert all(math.hypot(on[f][0] - path[f][0], on[f][1] - path[f][1]) <= 1.5 for f in (0, 1, 2, 4))


def test_blend_blobs(spark):
    images, flow, pixels, path = setup(spark)
    anchors = [(2, 40.0, 26.0), (5, 55.0, 36.0), (7, 65.0, 42.0)]
    expected = {f: (x, y) for f, x, y in anchors}
    for (t0, x0, y0), (t1, x1, y1) in zip(anchors, anchors[1:]):
        mid = (t0 + t1) // 2
        a, b = x0, y0
        for t in range(t0, mid):
            a, b = step(images, flow, t, a, b, True)
            expected[t + 1] = (a, b)
        a, b = x1, y1
        for t in range(t1, mid + 1, -1):
            a, b = step(images, flow, t, a, b, False)
            expected[t - 1] = (a, b)
    f, a, b = anchors[0]
    for t in range(f, 0, -1):
        a, b = step(images, flow, t, a, b, False)
        expected[t - 1] = (a, b)
    f, a, b = anchors[-1]
    for t in range(f, T - 1):
        a, b = step(images, flow, t, a, b, True)
        expected[t + 1] = (a, b)
    frame = spark.createDataFrame([(7, *p) for p in anchors], "track_id long, frame int, x double, y double")
    got = {r.frame: (r.x, r.y) for r in blobs.blend_blobs(frame, flow_frame(spark, flow), pixels, 20.0, 20.0, W, H, T - 1).collect()}
    assert got.keys() == expected.keys() == set(range(T))
    assert all(math.hypot(got[f][0] - x, got[f][1] - y) < 1e-9 for f, (x, y) in expected.items())


def test_nearest_blob():
    yy, xx = np.mgrid[0:31, 0:31]
    spot = lambda x, y, s=3.0: np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * s * s))
    assert blobs.nearest_blob(spot(20, 12) + spot(5, 25), 14, 18, 5.0) == (12.0, 20.0)
    assert blobs.nearest_blob(np.zeros((31, 31)), 3, 4, 5.0) is None
    assert blobs.nearest_blob(np.zeros((0, 5)), 0, 0, 5.0) is None
    # Two discs: one in the other, apart, and half way.
    assert blobs._shared(0.5, 1, 3) == 1 and blobs._shared(5, 1, 3) == 0 and abs(blobs._shared(1.0, 1, 1) - 0.39100) < 1e-4
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 4] = True
    assert sorted(blobs.regions(mask)) == [(0.5, 0.5, 2), (4.0, 4.0, 1)]


def test_tiles_are_pruned(spark, tmp_path):
    rng = random.Random(1)
    pixels = [(f, x, y, float(rng.randint(1, 9))) for f in range(4) for x in range(70) for y in range(40)]
    tiles.write_tiles(spark.createDataFrame(pixels, "frame int, px int, py int, value float"), str(tmp_path / "tiles"))
    kept = tiles.read_tiles(spark, str(tmp_path / "tiles"))
    one = kept.where("frame = 2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(frame" in plan and one.count() == 6
    wanted = spark.createDataFrame([(1, 2, 25, 60, 20, 40), (2, 3, 0, 5, 0, 5)], "id int, frame int, x0 int, x1 int, y0 int, y1 int")
    value = {(f, x, y): v for f, x, y, v in pixels}
    for r in tiles.patches(wanted, kept, ["id"]).collect():
        patch = tiles.assembled(r.parts, r.x0, r.x1, r.y0, r.y1)
        assert all(patch[y - r.y0, x - r.x0] == value[r.frame, x, y] for x in range(r.x0, r.x1) for y in range(r.y0, r.y1))
