"""Track operators on small cases worked out by hand, invariants, and round trips of files."""

import itertools
import json
import math
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoorline.functions import scalars as sc
from spoorline.operators import detection, filters, folds, interpolation, matching, mesh, metrics, propagation, sampling, sequences
from spoorline.sources import tracks as io

POINT = "track_id long, frame int, x double, y double"


def rows(df, *by):
    return sorted(map(tuple, df.collect()), key=str) if not by else [tuple(r) for r in df.orderBy(*by).collect()]


def test_point_precision(spark):
    truth = spark.createDataFrame([(1, t, 0.0, 0.0) for t in range(4)], POINT)
    near = spark.createDataFrame([(1, t, d, 0.0) for t, d in enumerate([0.5, 1.0, 3.0, 20.0])], POINT)
    assert rows(metrics.app_pooled(truth, near)) == [(4, 50.0, 50.0, 75.0, 75.0, 75.0, 65.0)]
    more = truth.unionByName(spark.createDataFrame([(1, 4, 0.0, 0.0)], POINT))
    assert rows(metrics.app_fixed_frames(more, near, 5))[0][1] == 0.4
    assert metrics.app_visible(more, near).first().app_1 == 0.4
    occ = lambda d: d.withColumn("occluded", F.lit(False))
    query_before = truth.unionByName(spark.createDataFrame([(1, -1, 0.0, 0.0)], POINT))
    assert metrics.point_tracking(occ(query_before), occ(near.unionByName(spark.createDataFrame([(1, -1, 0.0, 0.0)], POINT)))).first().within_1 == 0.25


def test_segments(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 4, 8.0, 4.0)], POINT)
    assert (1, 2, 4.0, 2.0) in rows(interpolation.linear_segments(a))
    anchors = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 4, 8.0, 0.0)], POINT)
    flow = spark.createDataFrame([(t, x, 0, 1.0, 0.0) for t in range(6) for x in range(-2, 12)], "frame int, gx int, gy int, dx double, dy double")
    blend = rows(propagation.blend_segments(anchors, flow, 1.0, 1.0, 4), "frame")
    assert [r[2] for r in blend] == [0, 2, 4, 6, 8]
    assert [r[2] for r in rows(propagation.blend_segments(anchors, flow, 1.0, 1.0, 4, 4), "frame")] == [0, 2, 4, 6, 8]
    seed = spark.createDataFrame([(1, 2, 5.0, 0.0)], POINT)
    assert rows(propagation.propagate(seed, flow, 1.0, 1.0, 2), "frame") == [(1, 2, 5.0, 0.0), (1, 3, 6.0, 0.0), (1, 4, 7.0, 0.0)]
    assert rows(propagation.propagate(seed, flow, 1.0, 1.0, 2, True), "frame") == [(1, 0, 3.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 5.0, 0.0)]
    still = flow.withColumn("dx", F.lit(0.0))
    assert {r[2] for r in rows(propagation.propagate(seed, still, 1.0, 1.0, 3))} == {5.0}
    path = rows(folds.corridor_paths(matching.anchor_segments(anchors), flow.select("frame", F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"), "dx", "dy"), radius=3, least=4), "frame")
    assert path[0][2:] == (0.0, 0.0) and path[-1][2:] == (8.0, 0.0) and len(path) == 5


def test_filters(spark):
    d = spark.createDataFrame([("A", 0), ("A", 1), ("A", 2), ("B", 0), ("B", 2)], "track_id string, frame int")
    assert {r.track_id for r in filters.persistent(d).collect()} == {"A"}
    v = spark.createDataFrame([(i, 0, 1.0 if i < 10 else 100.0) for i in range(11)], "track_id long, frame int, speed double")
    assert filters.velocity_outliers(v).count() == 10
    t = spark.createDataFrame([(1, f, f in (2, 3, 7)) for f in range(9)], "track_id long, frame int, occluded boolean")
    assert rows(filters.segments(t)) == [(1, 2, 3), (1, 7, 7)]


def test_weighted_motion(spark):
    q = spark.createDataFrame([(9, 0, 1.0, 0.0)], POINT)
    s = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 0.0), (2, 0, 4.0, 0.0, 3.0, 0.0)], "s_id long, frame int, px double, py double, mx double, my double")
    none = spark.createDataFrame([], "frame int, gx int, gy int, dx double, dy double")
    assert math.isclose(interpolation.blended_motion(q, s, none, 1.0, 1.0, 100.0).first().mx, 1.08)
    on = spark.createDataFrame([(9, 0, 4.0, 0.0)], POINT)
    assert interpolation.blended_motion(on, s, none, 1.0, 1.0, 100.0).first().mx == 3.0


def test_near_finds_all_pairs(spark):
    r = np.random.default_rng(0)
    a = [(int(i % 3), i, *map(float, r.uniform(-30, 30, 2))) for i in range(120)]
    p, q = spark.createDataFrame(a, "frame int, a_id long, x double, y double"), spark.createDataFrame(a, "frame int, b_id long, px double, py double")
    got = {(x.a_id, x.b_id) for x in matching.near(p, q, 7.0).collect()}
    assert got == {(s[1], t[1]) for s in a for t in a if s[0] == t[0] and math.dist(s[2:], t[2:]) <= 7.0}


def test_subpixel(spark):
    px = spark.createDataFrame([(0, x, y, [[0, 0, 0], [1, 4, 3], [0, 0, 0]][y][x] * 1.0) for x in range(3) for y in range(3)], "frame int, px int, py int, value double")
    top = detection.local_maxima(px, 1.0)
    assert detection.subpixel(top, px).first().x == 0.75
    assert detection.subpixel(top, px, as_coded=False).first().x == 1.25


def test_greedy_match(spark):
    t = spark.createDataFrame([(0, 0, 1, 0.0, 0.0), (0, 0, 2, 5.0, 0.0)], "video long, frame int, a_id long, x double, y double")
    p = spark.createDataFrame([(0, 1, 4.0, 0.0), (0, 2, 50.0, 0.0)], "frame int, b_id long, px double, py double")
    assert [(r.a_id, r.b_id) for r in matching.greedy_match(t, p, 20.0).collect()] == [(1, 1)]


def test_curves(spark):
    c = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 3, 0.9)], "track_id long, k int, score double")
    assert metrics.auc_trapezoid(c).first().auc == 2.2
    assert tuple(metrics.crossings(c, (0.6, 0.95)).first()) == (1, 1, None)
    ks = spark.createDataFrame([(2,), (3,), (9,)], "k int")
    assert [r[2] for r in rows(metrics.curve_statistics(c, ks, full=1.0), "k")] == [0.8, 0.9, 1.0]


def test_interventions(spark):
    n = spark.createDataFrame([(1, f, k) for f, k in enumerate([7, 7, None, 7, 8])], "track_id long, frame int, near_id long")
    assert tuple(folds.interventions(n).first()) == (1, 1, 1, 1, 3)


def test_series():
    t = np.arange(40)
    line = 2.0 * t + 1
    known = t % 5 != 2
    assert np.allclose(folds.spectral(line, known), line)
    r = np.random.default_rng(1)
    wave = np.sin(t / 6) * 10
    rough = wave + r.normal(0, 1, 40)
    filled = folds.spectral(rough, known)
    assert np.allclose(filled[known], rough[known])
    smooth = folds.cosine(rough)
    assert np.std(np.diff(smooth, 2)) < np.std(np.diff(rough, 2)) and np.isclose(smooth.mean(), rough.mean())
    assert (folds.cosine(np.array([1.0, 5.0, 2.0])) == [1.0, 5.0, 2.0]).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_best(n, m, seed):
    r = np.random.default_rng(seed)
    cost = r.uniform(0, 10, (n, m))
    cost[r.random((n, m)) < 0.3] = np.inf
    got = folds.assign(cost)
    best = (0, 0.0)
    for k in range(min(n, m), 0, -1):
        for a in itertools.combinations(range(n), k):
            for b in itertools.permutations(range(m), k):
                c = sum(cost[i, j] for i, j in zip(a, b))
                if np.isfinite(c) and (best[0] < k or c < best[1]):
                    best = (k, c)
        if best[0] == k:
            break
    assert len(got) == best[0] and math.isclose(sum(cost[i, j] for i, j in got), best[1], abs_tol=1e-9)


@settings(max_examples=25, deadline=None)
@given(st.integers(3, 25), st.integers(0, 10_000))
def test_delaunay_circles_are_empty(n, seed):
    p = np.random.default_rng(seed).uniform(0, 100, (n, 2))
    t = mesh.delaunay(p)
    for tri in t:
        mid, r2 = mesh._circle(p, tri)
        d = ((p - mid) ** 2).sum(1)
        d[tri] = np.inf
        assert (d >= r2 * (1 - 1e-6)).all()
    assert len(t) <= 2 * n - 5 + 3 and len(t) >= 1


def test_linking(spark):
    d = [(0, t, 10 * k, k * 20.0 + t, 5.0) for t in range(6) for k in range(3) if not (k == 1 and t == 3)]
    got = folds.link(spark.createDataFrame(d, "video long, frame int, det_id long, x double, y double"), 5.0, 1)
    assert got.groupBy("det_id").agg(F.countDistinct("particle").alias("c")).where("c > 1").count() == 0
    apart = folds.link(spark.createDataFrame(d, "video long, frame int, det_id long, x double, y double"), 5.0, 0)
    assert apart.select("particle").distinct().count() == 4


def test_peaks_and_snippets(spark):
    v = [0, 3, 0, 0, 5, 4.9, 5, 0, 0, 9, 0, 0]
    t = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "track_id long, frame int, x double")
    assert [r.frame for r in sequences.find_peaks(t, "x", 2.0, 3, 1.0).orderBy("frame").collect()] == [1, 6, 9] or [r.frame for r in sequences.find_peaks(t, "x", 2.0, 3, 1.0).orderBy("frame").collect()] == [1, 4, 9]
    e = spark.createDataFrame([(1, 0), (1, 4)], "track_id long, frame int")
    assert {r.event for r in sequences.event_snippets(t, e, "x", 2, 3).collect()} == {4}


def test_scalars(spark):
    d = spark.createDataFrame([("auto", "yes"), (" 12.5 ", "off"), ("", "None")], "w string, b string")
    assert [tuple(r) for r in d.select(sc.corridor_width(F.col("w")), sc.three_state(F.col("b"))).collect()] == [(None, True), (12.5, False), (None, None)]
    with pytest.raises(Exception, match="not a corridor width"):
        spark.createDataFrame([("wide",)], "w string").select(sc.corridor_width(F.col("w"))).collect()
    f = spark.createDataFrame([("flow_r2.5_s1.npz",)], "n string")
    assert f.select(sc.agrees(F.col("n"), "r", 2.6, 0.15), sc.agrees(F.col("n"), "q", 1, 0.1), sc.agrees(F.col("n"), "s", 2, 0.1)).first()[:] == (True, True, False)
    assert spark.createDataFrame([(2.5,)], "v double").select(sc.clamp_pixel(F.col("v"), 9)).first()[0] == 2


def test_sampling(spark):
    s = spark.createDataFrame([(0, f, float((f * 37) % 50)) for f in range(60)], "video long, frame int, score double")
    got = sorted(r.frame for r in sampling.spaced_top(s, 5, False).collect())
    assert len(got) == 5 and all(b - a >= 4 for a, b in zip(got, got[1:]))
    best, kept = sorted(s.collect(), key=lambda r: (-r.score, r.frame)), []
    for r in best:
        if len(kept) < 5 and all(abs(r.frame - k) >= 4 for k in kept):
            kept.append(r.frame)
    assert sorted(kept) == got


def test_track_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"total_frames": 9}, "tracks": [{"track_id": "t1", "annotations": [{"frame": 0, "x": 1.5, "y": 2}], "visible_segments": [{"start": 0, "end": 3}]}, {"id": "t2", "positions": [{"t": 4, "x": 2.5, "y": 3}]}]}))
    t = io.read_tracks(spark, str(tmp_path / "a.json"))
    assert sorted(tuple(r)[1:] for r in io.points(t).collect()) == [("t1", 0, 1.5, 2.0), ("t2", 4, 2.5, 3.0)]
    io.write_tracks(io.points(t), str(tmp_path / "out"), scale_x=1.0)
    assert sorted(map(tuple, io.read_written_tracks(spark, str(tmp_path / "out")).collect())) == [("t1", 0, 2, 2), ("t2", 4, 2, 3)]
    (tmp_path / "p.xml").write_text('<?xml version="1.0"?><Tracks><particle nSpots="2"><detection t="0" x="1.0" y="2.0" z="0"/><detection t="1" x="1.5" y="2.5" z="0"/></particle></Tracks>')
    assert sorted(tuple(r)[2:] for r in io.read_particles(spark, str(tmp_path / "p.xml")).collect()) == [(0, 1.0, 2.0), (1, 1.5, 2.5)]
    (tmp_path / "c.csv").write_text("# total: 3\nvideo,track_id,frame,x,y\nv,a,0,1.0,2.0\n")
    assert [tuple(r) for r in io.read_tracker_csv(spark, str(tmp_path / "c.csv")).collect()] == [("v", "a", 0, 1.0, 2.0)]
    tr = spark.createDataFrame([(0, "a", 1.23456789), (1, "a", 2.0), (1, "b", 5.0)], "frame int, track_id string, value double")
    io.write_traces(tr, "value", str(tmp_path / "wide"), ["a", "b"])
    assert sorted(map(tuple, io.read_traces(spark, str(tmp_path / "wide")).collect())) == [(0, "a", 1.23457), (1, "a", 2.0), (1, "b", 5.0)]
    fl = spark.createDataFrame([(0, 1, 2, 0.5, 0.25)], "frame int, gx int, gy int, dx double, dy double")
    io.write_flow(fl, str(tmp_path / "flow"), "v1", "dis", "r=2")
    assert [tuple(r) for r in io.read_flow(spark, str(tmp_path / "flow"), "v1", "dis", "r=2").collect()] == [(0, 1, 2, 0.5, 0.25)]
    assert io.read_flow(spark, str(tmp_path / "flow"), "v1", "dis", "r=3").count() == 0
    assert io.markdown(fl).splitlines()[2] == "| 0 | 1 | 2 | 0.5 | 0.25 |"


def test_binary_files(spark, tmp_path):
    a = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    np.save(tmp_path / "v.npy", a)
    assert io.read_arrays(spark, str(tmp_path / "v.npy")).where("frame = 1 and py = 2 and px = 3").first().value == 23
    np.savez(tmp_path / "f.npz", flows=np.ones((1, 2, 2, 2)), flow_to_input_scale=2)
    assert io.read_flow_arrays(spark, str(tmp_path / "f.npz")).agg(F.sum("dx")).first()[0] == 8.0
    page = a[0].astype("<u2").tobytes()
    tags = [(256, 4, 4), (257, 4, 3), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(page))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    (tmp_path / "i.tif").write_bytes(b"II*\0" + struct.pack("<I", 8 + len(page)) + page + ifd)
    assert io.read_tiff(spark, str(tmp_path / "i.tif")).agg(F.sum("value")).first()[0] == a[0].sum()
    m = np.zeros((3, 3, 2), dtype=np.uint8)
    m[1, 1, 0] = m[2, 1, 0] = m[0, 2, 1] = 1
    (tmp_path / "m.nrrd").write_bytes(b"NRRD0004\ntype: uint8\ndimension: 3\nsizes: 3 3 2\nencoding: raw\n\n" + m.tobytes(order="F"))
    masks = io.read_masks(spark, str(tmp_path / "m.nrrd"))
    assert sorted(tuple(r)[1:] for r in io.centroids(masks).collect()) == [(0, 1.5, 1.0), (1, 0.0, 2.0)]
    assert sorted(tuple(r)[1:] for r in io.first_voxels(masks).collect()) == [(0, 1, 1), (1, 0, 2)]


def test_streams(spark, tmp_path):
    from spoorline.streaming import online

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate(([(1, 0, 7), (1, 1, 7)], [(1, 2, None), (1, 3, 7), (1, 4, 8)])):
        pd.DataFrame(part, columns=["track_id", "frame", "near_id"]).astype({"near_id": "Int64"}).to_parquet(src / f"{i}.parquet")
    s = spark.readStream.schema("track_id long, frame long, near_id long").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = online.interventions(s).writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert max(r.total for r in spark.table("counts").collect()) == 3


def test_mesh_and_corridor_queries_see_the_whole_table(spark):
    """Every frame has its mesh points, and every track that has segments has them in the corridor search."""
    from spoorline.operators import matching
    from spoorline.plans import images, views

    sf = "/root/testdata/sf0.001"
    points, tracks = images._mesh_points(spark, sf), views.tracks(spark, sf)
    assert points.count() == tracks.count()
    assert points.select("frame").distinct().count() == tracks.select("frame").distinct().count() > 6
    small = "/root/testdata/sf0.01"
    ids = lambda df: {r.track_id for r in df.select("track_id").distinct().collect()}
    got = ids(images._cell_anchors(spark, small))
    assert got == ids(matching.anchor_segments(views.anchors(spark, small))) and max(got) >= 40


def test_flow_beyond_anchors(spark):
    """One anchor at frame 2, flow one pixel a frame: the whole track follows."""
    anchor = spark.createDataFrame([(1, 2, 5.0, 0.0)], POINT)
    flow = spark.createDataFrame([(t, x, 0, 1.0, 0.0) for t in range(6) for x in range(-2, 12)], "frame int, gx int, gy int, dx double, dy double")
    span = spark.createDataFrame([(1, 0, 4)], "track_id long, lo int, hi int")
    got = rows(propagation.blend_tracks(anchor, flow, 1.0, 1.0, span, 4), "frame")
    assert [r[2] for r in got] == [3, 4, 5, 6, 7]


def test_mesh_pull_moves_a_tenth(spark):
    p = spark.createDataFrame([(9, 0, 0.0, 0.0), (8, 0, 500.0, 0.0)], POINT)
    done = spark.createDataFrame([(0, 10.0, 0.0), (0, 0.0, 20.0)], "frame int, px double, py double")
    a, b = (math.exp(-d * d / 200) for d in (10, 20))
    got = {r.track_id: (r.x, r.y) for r in propagation.mesh_pull(p, done, 30.0).collect()}
    assert got[8] == (500.0, 0.0)
    assert got[9] == (round(0.1 * 10 * a / (a + b), 4), round(0.1 * 20 * b / (a + b), 4))


def test_series_by_hand():
    """Damping of single frequencies: above the cutoff by exp(-((f - cutoff) / 0.1)**2), in cosines by exp(-3 r**2)."""
    n = 40
    t = np.arange(n)
    everything = np.ones(n, dtype=bool)
    for k in (4, 14):
        wave = np.cos(2 * np.pi * k * t / n)
        fit = np.polyval(np.polyfit(t, wave, 1), t)
        gain = math.exp(-((max(0.0, k / n - 0.25) / 0.1) ** 2))
        assert np.abs(folds.spectral(wave, everything) - fit - (wave - fit) * gain).max() < 0.1
    for k, gain in ((5, 1.0), (10, 1.0), (25, math.exp(-3 * 0.5**2)), (39, math.exp(-3 * (29 / 30) ** 2))):
        wave = np.cos(np.pi * (t + 0.5) * k / n)
        assert np.allclose(folds.cosine(wave), wave * gain)


def test_images_by_hand(spark):
    values = [[0, 1, 3, 3], [0, 2, 3, 7], [5, 5, 5, 5]]
    px = spark.createDataFrame([(0, x, y, float(values[y][x])) for x in range(4) for y in range(3)], "frame int, px int, py int, value double")
    v = np.array(values, dtype=float)
    gx, gy = v[:-1, 1:] - v[:-1, :-1], v[1:, :-1] - v[:-1, :-1]
    assert math.isclose(detection.complexity(px).first().complexity, np.hypot(gx, gy).mean(), abs_tol=1e-4)  # cells of one pixel have no deviation
    two = np.mean([v[i : i + 1, j : j + 2].std() for i in (0, 1) for j in (0, 2)])
    assert math.isclose(detection.complexity(px, 2).first().complexity, np.hypot(gx, gy).mean() + two, abs_tol=1e-4)
    f = {r.feature: r.value for r in detection.features(px, 7, 2).collect()}
    density, _ = np.histogram(v, bins=7, density=True)
    assert all(math.isclose(f.get(f"h{i}", 0.0), d * 1e6, abs_tol=1e-3) for i, d in enumerate(density))
    assert (f["m0_0"], f["s0_1"]) == (0.5, 0.0) and f["gx"] == round(np.abs(np.diff(v, axis=1)).mean(), 2)
    flow = spark.createDataFrame([(0, 0, 0, 1.0, 0.0), (1, 0, 0, 0.0, 2.0)], "frame int, gx int, gy int, dx double, dy double")
    assert [r[-3:] for r in map(tuple, sc.coloured(flow).orderBy("frame").collect())] == [(90, 255, 127), (135, 255, 255)]


def test_path_is_cheapest(spark):
    """Against all paths of a small corridor."""
    r = np.random.default_rng(5)
    flow = {(t, x, y): r.integers(-1, 2, 2).tolist() for t in range(3) for x in range(-3, 6) for y in range(-3, 4)}
    tile = pd.DataFrame([(t, x, y, *d) for (t, x, y), d in flow.items()], columns=["frame", "x", "y", "dx", "dy"])
    got = folds.path(1, 0, 3, (0, 0), (2, 1), tile, 2, 2, 0.3)
    cost = lambda p: sum(abs(b[0] - a[0] - flow.get((t, *a), (0, 0))[0]) + abs(b[1] - a[1] - flow.get((t, *a), (0, 0))[1]) for t, (a, b) in enumerate(zip(p, p[1:])))
    found = [tuple(map(int, x)) for x in got[["x", "y"]].to_numpy().tolist()]
    assert found[0] == (0, 0) and found[-1] == (2, 1)
    cells = list(itertools.product(range(-2, 5), range(-2, 4)))
    least = min(cost([(0, 0), a, b, (2, 1)]) for a in cells for b in cells if all(max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= 2 for p, q in (((0, 0), a), (a, b), (b, (2, 1)))))
    assert cost(found) >= least and cost(found) <= least + 1


def test_steps_grids_and_clips(spark):
    curve = spark.createDataFrame([(1, 20, 1.0), (1, 30, 2.0), (2, 40, 3.0), (3, 24, None), (3, 27, 5.0)], "track_id long, k int, score double")
    assert rows(metrics.nearest_step(curve, 25, 5)) == [(1, 20, 1.0), (3, 24, None)]
    points = spark.createDataFrame([(1, 10, 100.0, 30.0), (1, 11, None, 60.0)], POINT)
    assert rows(points.select(*sc.rescaled(F.col("x"), F.col("y"), (200, 60), (100, 120)))) == [(50.0, 60.0), (None, 120.0)]
    assert rows(points.select(*sc.in_clip(F.col("frame"), F.col("x"), 10, 120, True))) == [(0, 20.0), (1, None)]
    assert sc.coordinate_scale(points, 50, 40).first().scale == 0.5
    assert sc.coordinate_scale(points.limit(0), 50, 40).first().scale == 50.0
