"""Dispatch of tracks to methods, and the fewest corrections, on tracks small enough to follow."""

import itertools
import math
import random

import pytest

from spoorline.operators import blobs, folds, matching, optimum, propagation, router

FLOW = [(f, i, j, 1.0, 0.5 * (f % 2)) for f in range(9) for i in range(-1, 4) for j in range(-1, 4)]


def flow(spark):
    return spark.createDataFrame(FLOW, "frame int, gx int, gy int, dx double, dy double")


def rows(df):
    return {(r.track_id, r.frame): (round(r.x, 6), round(r.y, 6)) for r in df.collect()}


def test_each_track_by_its_method(spark):
    anchors = spark.createDataFrame([(t, f, float(5 + f + t), 6.0) for t in (1, 2, 3) for f in (2, 4, 7)], "track_id long, frame int, x double, y double")
    spans = spark.createDataFrame([(t, 0, 9) for t in (1, 2, 3, 4)], "track_id long, lo int, hi int")
    pixels = spark.createDataFrame([(f, x, y, float((x * 7 + y * 3 + f) % 11)) for f in range(10) for x in range(24) for y in range(16)], "frame int, px int, py int, value double")
    requests = spark.createDataFrame([(1, None, None), (2, "corridor_dp", None), (3, "blob_assisted", (0, 1.0, 1.0)), (4, "corridor_dp", (3, 8.0, 4.0))], "track_id long, method string, seed struct<frame:int,x:double,y:double>")
    more = dict(pixels=pixels, size=(24, 16), last=9, search=4.0, radius=1.5, corridor=2, least=4)
    got = router.optimise_tracks(requests, anchors, flow(spark), 10.0, 10.0, spans, 20, **more)
    found = rows(got)
    assert got.count() == len(found) == 40
    one = lambda t: anchors.where(f"track_id = {t}")
    want = rows(propagation.blend_tracks(one(1), flow(spark), 10.0, 10.0, spans, 20)) | rows(blobs.blend_blobs(one(3), flow(spark), pixels, 10.0, 10.0, 24, 16, 9, 4.0, 1.5))
    assert {k: v for k, v in found.items() if k[0] in (1, 3)} == want
    near = flow(spark).selectExpr("frame", "gx * 10D AS x", "gy * 10D AS y", "dx", "dy")
    paths = rows(folds.corridor_paths(matching.anchor_segments(one(2)), near, 2, least=4))
    assert all(found[k] == v for k, v in paths.items())
    # Without anchors: carried from the seed, forward by (1, 0 or .5) a frame, and back.
    assert [found[4, f] for f in range(10)] == [(5.0 + f, 4.0 + 0.5 * (f // 2 - 1)) for f in range(10)]


def test_bad_requests(spark):
    anchors = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 4, 1.0, 1.0)], "track_id long, frame int, x double, y double")
    spans = spark.createDataFrame([(1, 0, 4), (2, 0, 4)], "track_id long, lo int, hi int")
    for request, words in (((1, "guess"), "no method guess"), ((2, "full_blend"), "neither anchors nor seed for track 2"), ((1, "blob_assisted"), "needs pixels")):
        with pytest.raises(Exception, match=words):
            router.optimise_tracks(spark.createDataFrame([request], "track_id long, method string"), anchors, flow(spark), 10.0, 10.0, spans, 9).collect()


def test_optimise_set_keeps_completed(spark):
    tracks = spark.createDataFrame([(t, f, t * 3.0 + f, 2.0) for t in (1, 2, 3) for f in range(4)], "track_id long, frame int, x double, y double")
    out = rows(router.optimise_set(tracks, spark.createDataFrame([(1,), (3,)], "track_id long"), flow(spark), 10.0, 10.0))
    assert {k: v for k, v in out.items() if k[0] != 2} == {k: v for k, v in rows(tracks).items() if k[0] != 2} and len(out) == 12


def blend(anchors, last, look):
    """A whole track from its anchors, the plain way."""
    out = dict(anchors)
    frames = sorted(anchors)
    for a, b in itertools.pairwise(frames):
        ahead, back = {a: anchors[a]}, {b: anchors[b]}
        for t in range(a, b):
            dx, dy = look(t, *ahead[t])
            ahead[t + 1] = (ahead[t][0] + dx, ahead[t][1] + dy)
        for t in range(b, a, -1):
            dx, dy = look(t - 1, *back[t])
            back[t - 1] = (back[t][0] - dx, back[t][1] - dy)
        for t in range(a + 1, b):
            w = (t - a) / (b - a)
            out[t] = tuple((1 - w) * p + w * q for p, q in zip(ahead[t], back[t]))
    for t in range(frames[-1], last):
        dx, dy = look(t, *out[t])
        out[t + 1] = (out[t][0] + dx, out[t][1] + dy)
    return out


def test_fewest_corrections(spark):
    r = random.Random(6)
    motion = {(f, i, j): (r.uniform(-2, 2), r.uniform(-2, 2)) for f in range(25) for i in range(-3, 6) for j in range(-3, 6)}
    look = lambda t, x, y: motion.get((t, round(x / 10), round(y / 10)), (0.0, 0.0))
    truth = {}
    for k, frames in ((1, range(2, 26)), (2, [0, 1, 5, 6, 13]), (3, [4]), (4, range(3))):
        x, y = 20.0, 20.0
        truth[k] = {}
        for f in frames:
            x, y = x + r.uniform(-2.5, 2.5), y + r.uniform(-2.5, 2.5)
            truth[k][f] = (x, y)
    t = spark.createDataFrame([(k, f, *p) for k, v in truth.items() for f, p in v.items()], "track_id long, frame int, x double, y double")
    field = spark.createDataFrame([(*k, *v) for k, v in motion.items()], "frame int, gx int, gy int, dx double, dy double")
    scores = optimum.rebuild_scores(t, field, 10.0, 10.0, 3, 40)
    order = {(o.track_id, o.trial, o.place): o.frame for o in optimum.correction_orders(t.join(t.groupBy("track_id").agg({"frame": "min"}), "track_id").where("frame > `min(frame)`").select("track_id", "frame"), 3).collect()}
    got = {(s.track_id, s.trial, s.k): s.app for s in scores.collect()}
    want, app = {}, lambda k, p: sum(math.hypot(p[f][0] - x, p[f][1] - y) <= tau for f, (x, y) in truth[k].items() for tau in (1, 2, 4, 8, 16)) / (5 * len(truth[k]))
    for k, places in truth.items():
        first, n = min(places), len(places) - 1
        for trial in range(3):
            for c in sorted({0, *range(1, min(11, n + 1)), *range(10, n + 1, 5), n}) if n else ():
                chosen = {first: places[first]} | {order[k, trial, i]: places[order[k, trial, i]] for i in range(1, c + 1)}
                want[k, trial, c] = app(k, blend(chosen, max(places), look))
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    best = {(o.track_id, o.target): o for o in optimum.optimum(scores, (0.8, 1.5)).collect()}
    assert len(best) == 6
    for k in (1, 2, 4):
        own = {c: v for c, v in want.items() if c[0] == k and c[2] > 0}
        reach = min((c, -v, trial) for (_, trial, c), v in own.items() if v >= 0.8)
        o = best[k, 0.8]
        assert (o.optimal_k, round(-reach[1], 6), o.optimal_trial) == (reach[0], o.optimal_app, reach[2])
        # A target out of reach: the best area's trial, at its best count.
        area = {}
        for trial in range(3):
            ks = sorted(c for _, u, c in want if _ == k and u == trial)
            area[trial] = round(sum((b - a) * (want[k, trial, a] + want[k, trial, b]) / 2 for a, b in itertools.pairwise(ks)), 9)
        trial = max(area, key=lambda u: (area[u], -u))
        top = max((v, -c) for (_, u, c), v in own.items() if u == trial)
        o = best[k, 1.5]
        assert (o.optimal_trial, o.best_auc_trial, o.optimal_k) == (trial, trial, -top[1]) and abs(o.optimal_app - top[0]) < 1e-6


def test_pairs_share_their_anchors_ways(spark, monkeypatch):
    """Each anchor is carried once forward and once back, whatever the number of pairs that it is in."""
    seen, fold = [], propagation._fold
    monkeypatch.setattr(propagation, "_fold", lambda flow, seeds, *a: (seen.append(seeds.groupBy("id.track_id", "frame").count().agg({"count": "max"}).first()[0]), fold(flow, seeds, *a))[1])
    t = spark.createDataFrame([(1, f, float(f), 0.0) for f in range(9)], "track_id long, frame int, x double, y double")
    field = spark.createDataFrame([(0, 0, 0, 1.0, 0.0)], "frame int, gx int, gy int, dx double, dy double")
    optimum.rebuild_scores(t, field, 10.0, 10.0, 3, 20)
    assert seen and max(seen) == 1
