"""Operators on crowded frames: right against plain loops, and no step that grows with the square of a frame's points."""

import math
import random

import numpy as np

from spoorline.operators import interpolation, matching, mesh, places, propagation, sequences
from spoorline.plans import images


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_windows_make_no_table_of_windows(spark):
    rng = random.Random(1)
    points = [(t, f, rng.random() < 0.4) for t in range(6) for f in range(t, t + 5 + 7 * t) if rng.random() < 0.8]
    frame = spark.createDataFrame(points + points[:9], "track_id long, frame int, occluded boolean")
    for length, stride in ((6, 2), (5, 7), (1, 1)):
        expected = []
        for t in range(6):
            own = [f for k, f, _ in points if k == t]
            for start in range(min(own), max(own) - length + 2, stride):
                n = len({f for k, f, o in points if k == t and not o and start <= f < start + length})
                if n and n >= 0.5 * length:
                    expected.append((t, start, n))
        got = sequences.training_windows(frame, length, stride)
        assert sorted(map(tuple, got.collect())) == sorted(expected)
        assert "Join" not in plan(got)


SMALL = "/root/testdata/sf0.001"


def test_subpixel_joins_items_and_orders_once(spark):
    assert "lineitem" not in plan(images.QUERIES["subpixel"][0](spark, SMALL))


def test_optimal_frames_joins_items_and_orders_once(spark, monkeypatch):
    calls, pixels = [], images.v.pixels
    monkeypatch.setattr(images.v, "pixels", lambda *a: calls.append(a) or pixels(*a))
    monkeypatch.setattr(images.sa, "diverse", lambda vectors, n: vectors.select("frame").limit(n))
    assert "lineitem" not in plan(images.QUERIES["optimal_frames"][0](spark, SMALL))
    assert len(calls) == 1


def crowd(rng, n, step=0.5):
    """Places on a grid, many of which coincide or lie at equal distances."""
    return np.array([(rng.randrange(0, 60) * step, rng.randrange(0, 40) * step) for _ in range(n)])


def test_nearest_against_all_pairs():
    rng = random.Random(5)
    for n, m, radius in ((0, 3, 1.0), (3, 0, 1.0), (1, 1, 5.0), (80, 60, 2.0), (300, 40, 20.0), (40, 400, 0.4)):
        a, b, ids = crowd(rng, n), crowd(rng, m) * 1.1, np.array(rng.sample(range(1000), m), dtype=np.int64)
        i, j, d = (c.tolist() for c in places.nearest(*(a.T if n else a.reshape(2, 0)), *(b.T if m else b.reshape(2, 0)), ids, radius))
        got = {p: (e, q) for p, q, e in zip(i, j, d, strict=True) if e <= radius}
        want = {p: min((float(np.sqrt((x - u) * (x - u) + (y - v) * (y - v))), int(k)) for (u, v), k in zip(b, ids, strict=True)) for p, (x, y) in enumerate(a)} if m else {}
        assert got == {p: w for p, w in want.items() if w[0] <= radius}


def test_nearest_in_keeps_tiles_apart(spark):
    rng = random.Random(6)
    a, b = ([(f, i, x, y) for f in range(2) for i, (x, y) in enumerate(crowd(rng, 60, 1.7) - 30)] for _ in range(2))
    frame = lambda r, *c: spark.createDataFrame([(f, i, float(x), float(y)) for f, i, x, y in r], "frame int, {} long, {} double, {} double".format(*c))
    left, right = frame(a, "a_id", "x", "y"), frame(b, "b_id", "px", "py")
    best = lambda p, others: min(((float(np.sqrt((p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3]))), q[1]) for q in others if q[0] == p[0]), default=(99.0, -1))
    there, back = {(p[0], p[1]): best(p, b) for p in a}, {(q[0], q[1]): best(q, a) for q in b}
    got = {(r.frame, r.a_id): (r.d, r.b_id) for r in matching.nearest_in(left, right, 3.0).collect()}
    assert got == {k: w for k, w in there.items() if w[0] <= 3.0}
    mutual = matching.mutual_nearest(left, right, 3.0)
    assert {tuple(r)[:3] for r in mutual.collect()} == {(f, i, q) for (f, i), (d, q) in there.items() if d < 3.0 and back[f, q][1] == i}
    assert "Generate explode(array(" not in plan(mutual) and "HashAggregate" not in plan(mutual)


def test_greedy_match_against_a_loop_over_pairs(spark):
    rng = random.Random(7)
    t = [(f, f // 2, i, *p) for f in range(4) for i, p in enumerate(crowd(rng, 50).tolist())]
    q = [(f, i, *p) for f in range(4) for i, p in enumerate(crowd(rng, 45).tolist())]
    want = []
    for v in (0, 1):
        used = set()
        for a in range(50):
            near = sorted((math.sqrt((x - u) ** 2 + (y - w) ** 2), b) for f, k, i, x, y in t if k == v and i == a for g, b, u, w in q if g == f)
            near = [(d, b) for d, b in near if d < 4.0 and b not in used]
            if near:
                used.add(near[0][1])
                want.append((v, a, near[0][1], near[0][0]))
    got = matching.greedy_match(spark.createDataFrame(t, "frame int, video long, a_id long, x double, y double"), spark.createDataFrame(q, "frame int, b_id long, px double, py double"), 4.0)
    assert sorted(map(tuple, got.collect())) == want
    assert "FlatMapGroupsInPandas" not in plan(got)  # which read all pairs


def test_sums_within_a_radius_against_all_pairs(spark):
    rng = random.Random(8)
    a = [(i, f, x, y) for f in range(2) for i, (x, y) in enumerate((crowd(rng, 50, 1.5) - 20).tolist())]
    b = [(i, f, x, y, rng.uniform(-2, 2), rng.uniform(-2, 2)) for f in range(2) for i, (x, y) in enumerate((crowd(rng, 40, 1.5) - 20).tolist())]
    points = spark.createDataFrame(a, "track_id long, frame int, x double, y double")
    sources = spark.createDataFrame(b, "s_id long, frame int, px double, py double, mx double, my double")
    none = spark.createDataFrame([], "frame int, gx int, gy int, dx double, dy double")
    pulled = propagation.mesh_pull(points, sources.select("frame", "px", "py"), 9.0)
    assert "Join" not in plan(pulled)
    blended = interpolation.blended_motion(points, sources, none, 10.0, 10.0, 9.0)
    assert "explode(array(" not in plan(blended)
    pulled, blended = ({(r[0], r[1]): tuple(r)[2:] for r in df.collect()} for df in (pulled, blended))
    for i, f, x, y in a:
        near = [(math.hypot(x - u, y - v), s, u, v, mx, my) for s, g, u, v, mx, my in b if g == f and math.hypot(x - u, y - v) <= 9.0]
        w = [math.exp(-n[0] ** 2 / 18) if n[0] < 9.0 else 0.0 for n in near]
        want = [c + (0.1 * sum(k * (n[at] - c) for k, n in zip(w, near)) / sum(w) if sum(w) else 0.0) for c, at in ((x, 2), (y, 3))]
        assert np.allclose(pulled[i, f], want, atol=6e-5)
        on, far = sorted((n[1], n[4], n[5]) for n in near if n[0] < 1e-6), [n for n in near if n[0] >= 1e-6]
        total = sum(n[0] ** -2 for n in far)
        want = on[0][1:] if on else [0.9 * sum(n[0] ** -2 * n[at] for n in far) / total if far else 0.0 for at in (4, 5)]
        assert np.allclose(blended[i, f], want)


def test_points_that_coincide_are_one_before_a_frame_is_meshed(spark):
    corners = [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (5.0, 6.0)]
    points = spark.createDataFrame([(0, 10 * copy + i, x, y) for copy in (2, 0, 1) for i, (x, y) in enumerate(corners)], "frame int, track_id long, x double, y double")
    tri = mesh.triangles(points)
    assert sorted(map(tuple, tri.collect())) == [(0, 0, 1, 2), (0, 1, 2, 3)]
    assert "HashAggregate" in plan(tri)


def test_copies_of_a_segment_are_one(spark):
    """A hundred tracks on the same way: the corridor search sees one segment."""
    from spoorline.operators import folds

    s = spark.range(100).selectExpr("id AS track_id", "0 AS t0", "2D AS x0", "2D AS y0", "2 AS t1", "4D AS x1", "3D AS y1")
    flow = spark.createDataFrame([(0, 2.0, 2.0, 1.0, 0.0), (1, 3.0, 2.0, 1.0, 1.0)], "frame int, x double, y double, dx double, dy double")
    solve = folds.corridor_paths(s, flow, 2, least=4)
    got = {}
    for r in solve.collect():
        got.setdefault(r.track_id, []).append((r.frame, r.x, r.y))
    assert len(got) == 100 and all(sorted(p) == [(0, 2.0, 2.0), (1, 3.0, 2.0), (2, 4.0, 3.0)] for p in got.values())
    plan = solve._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapCoGroupsInPandas") < plan.index("Aggregate")


def test_nearest_rows_copy_the_few(spark):
    """One row looks among 1000: cells are copied for that row, not for the others."""
    from spoorline.operators import matching

    a = spark.createDataFrame([(0, 1, 5.0, 5.0)], "frame int, q int, x double, y double")
    b = spark.range(1000).selectExpr("0 AS frame", "id AS s_id", "id * 0.1D AS px", "5D AS py")
    plan = matching.near(a, b, 3.0, copied="a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LogicalRDD")
    assert {r.s_id for r in matching.near(a, b, 3.0, copied="a").collect()} == {r.s_id for r in matching.near(a, b, 3.0).collect()}


def test_seeds_of_one_way_are_carried_once(spark, monkeypatch):
    from spoorline.operators import blobs

    seen = []
    was = blobs.waves
    monkeypatch.setattr(blobs, "waves", lambda seeds, *rest: seen.append(seeds.count()) or was(seeds, *rest))
    seeds = spark.range(50).selectExpr("id", "true AS ahead", "0 AS frame", "3D AS x", "2D AS y", "2 AS until")
    flow = spark.createDataFrame([(0, 0, 0, 1.0, 0.5)], "frame int, gx int, gy int, dx double, dy double")
    pixels = spark.createDataFrame([(f, 0, 0, 0.0) for f in range(3)], "frame int, px int, py int, value double")
    got = blobs.blob_waves(seeds, flow, pixels, 20.0, 20.0, 12, 12, 3.0, 1.5).collect()
    assert seen == [1] and sorted((r.id, r.frame) for r in got) == [(i, f) for i in range(50) for f in (1, 2)]
    assert {(r.frame, r.x, r.y) for r in got} == {(1, 4.0, 2.5), (2, 4.0, 2.5)}
