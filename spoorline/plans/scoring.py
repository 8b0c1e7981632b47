"""Queries over metric operators, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import metrics as m
from ..operators import sequences as s
from . import views as v
from .views import ANCHORS, PRED, TRACKS, with_

TAUS = m.THRESHOLDS
_PAIRS = "pairs AS (SELECT t.*, p.x AS px, p.y AS py, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) AS d FROM tracks t {how} JOIN pred p ON t.track_id = p.track_id AND t.frame = p.frame)"
PAIRS, LEFT = _PAIRS.format(how="INNER"), _PAIRS.format(how="LEFT")


def _app(scale: str, of: str, digits: int = 4) -> str:
    each = [f"sum(CASE WHEN d <= {t} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * CAST({scale} AS DOUBLE) / {of}" for t in TAUS]
    return ", ".join(f"round({e}, {digits}) AS app_{t}" for e, t in zip(each, TAUS, strict=True)) + f", round(({' + '.join(each)}) / 5, {digits}) AS app_avg"


OCC = "predo AS (SELECT p.*, (p.frame * 5 + p.track_id) % 11 = 0 AS po, CASE WHEN (p.frame * 5 + p.track_id) % 11 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(-1.5 AS DOUBLE) END AS logit FROM pred p)"


def occluded_predictions(spark, sf):
    f = (F.col("frame") * 5 + F.col("track_id")) % 11 == 0
    return v.predictions(spark, sf).withColumn("occluded", f).withColumn("logit", F.when(f, 2.0).otherwise(-1.5))


def _tracking_sql(queries: str, rule: str) -> str:
    cols = ["count(*) AS n", "round(avg(CAST(occluded = po AS DOUBLE)), 6) AS occlusion_accuracy"]
    w, j = [], []
    for t in TAUS:
        near = f"d2 < {t * t}"
        w.append(f"sum(CAST(NOT occluded AND {near} AS DOUBLE)) / sum(CAST(NOT occluded AS DOUBLE))")
        j.append(f"sum(CAST(NOT occluded AND {near} AND NOT po AS DOUBLE)) / (sum(CAST(NOT occluded AS DOUBLE)) + sum(CAST(NOT po AND (occluded OR NOT {near}) AS DOUBLE)))")
        cols += [f"round({w[-1]}, 6) AS within_{t}", f"round({j[-1]}, 6) AS jaccard_{t}"]
    cols += [f"round(({' + '.join(w)}) / 5, 6) AS within_avg", f"round(({' + '.join(j)}) / 5, 6) AS jaccard_avg"]
    return with_(TRACKS, PRED, OCC, f"q AS ({queries})", f"r AS (SELECT t.*, p.po, power(t.x - p.x, 2) + power(t.y - p.y, 2) AS d2 FROM tracks t JOIN predo p ON t.track_id = p.track_id AND t.frame = p.frame JOIN q ON q.track_id = t.track_id WHERE {rule})") + f"SELECT {', '.join(cols)} FROM r"


def curves(spark, sf):
    """A score curve per track: running hit share (percent) at every fifth frame."""
    p = m.paired(v.tracks(spark, sf), v.predictions(spark, sf), "left").withColumn("hit", F.when(F.col("d") <= 4, 100.0).otherwise(0.0))
    run = F.avg("hit").over(s.by_frame().rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("score", F.round(run, 6)).where("frame % 5 = 0").select("track_id", F.col("frame").alias("k"), "score")


CURVES = "curves AS (SELECT track_id, k, score FROM (SELECT track_id, frame AS k, round(avg(CASE WHEN d <= 4 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY track_id ORDER BY frame), 6) AS score FROM pairs) WHERE k % 5 = 0)"


def _results(spark, sf):
    t = v.tracks(spark, sf)
    return t.select(F.concat(F.lit("set"), (F.col("track_id") % 4).cast("string")).alias("dataset"), "event_type", "frame", "x").where("not (event_type = 'error' and dataset = 'set3')")


RESULTS = "results AS (SELECT concat('set', CAST(track_id % 4 AS VARCHAR)) AS dataset, event_type, x FROM tracks WHERE NOT (event_type = 'error' AND track_id % 4 = 3))"

QUERIES = {
    "app_pooled": (lambda sp, sf: m.app_pooled(v.tracks(sp, sf), v.predictions(sp, sf)), with_(TRACKS, PRED, PAIRS) + f"SELECT count(*) AS n, {_app('100', 'count(*)')} FROM pairs"),
    "app_fixed_frames": (lambda sp, sf: m.app_fixed_frames(v.tracks(sp, sf), v.predictions(sp, sf), 40), with_(TRACKS, PRED, LEFT) + f"SELECT count(DISTINCT track_id) * 40 AS n, {_app('1', '(count(DISTINCT track_id) * 40)', 6)} FROM pairs WHERE frame < 40"),
    "app_per_track": (lambda sp, sf: m.app_pooled(v.tracks(sp, sf), v.predictions(sp, sf), ("track_id",)), with_(TRACKS, PRED, PAIRS) + f"SELECT track_id, count(*) AS n, {_app('100', 'count(*)')} FROM pairs GROUP BY track_id"),
    "app_visible": (lambda sp, sf: m.app_visible(v.tracks(sp, sf), v.predictions(sp, sf)), with_(TRACKS, PRED, LEFT) + f"SELECT track_id, count(*) AS n, {_app('1', 'count(*)', 6)} FROM pairs GROUP BY track_id"),
    "track_error": (lambda sp, sf: m.track_error(v.tracks(sp, sf), v.predictions(sp, sf)), with_(TRACKS, PRED, LEFT) + "SELECT track_id, count(d) AS n, round(coalesce(avg(d), CAST('inf' AS DOUBLE)), 4) AS mean_error, round(coalesce(max(d), CAST('inf' AS DOUBLE)), 4) AS max_error, round(coalesce(sqrt(avg(d * d)), CAST('inf' AS DOUBLE)), 4) AS rmse FROM pairs GROUP BY track_id"),
    "tapvid_first": (lambda sp, sf: m.point_tracking(v.occluded(sp, sf), occluded_predictions(sp, sf), "first"), _tracking_sql("SELECT track_id, min(frame) AS q FROM tracks WHERE NOT occluded GROUP BY track_id", "t.frame > q.q")),
    "tapvid_strided": (lambda sp, sf: m.point_tracking(v.occluded(sp, sf), occluded_predictions(sp, sf), "strided", 20), _tracking_sql("SELECT track_id, frame AS q FROM tracks WHERE NOT occluded AND frame % 20 = 0", "t.frame <> q.q")),
    "training_metrics": (
        lambda sp, sf: m.training_metrics(v.occluded(sp, sf), occluded_predictions(sp, sf)),
        with_(TRACKS, PRED, OCC, "r AS (SELECT t.occluded, p.po, CASE WHEN NOT t.occluded THEN sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) END AS d FROM tracks t JOIN predo p ON t.track_id = p.track_id AND t.frame = p.frame)")
        + "SELECT round(avg(CAST(occluded = po AS DOUBLE)), 6) AS occlusion_accuracy, round(avg(d), 4) AS mean_error, " + ", ".join(f"round(avg(CAST(d < {t} AS DOUBLE)), 6) AS within_{t}" for t in (*TAUS, 5)) + " FROM r",
    ),
    "jitter": (
        lambda sp, sf: m.jitter(v.tracks(sp, sf), v.predictions(sp, sf)),
        with_(TRACKS, PRED, *(f"{a} AS (SELECT track_id, stddev_pop(d) AS s FROM (SELECT track_id, unnest([ddx, ddy]) AS d FROM (SELECT track_id, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS ddx, lead(y, 2) OVER w - 2 * lead(y) OVER w + y AS ddy FROM {b} WINDOW w AS (PARTITION BY track_id ORDER BY frame)) WHERE ddx IS NOT NULL) GROUP BY track_id)" for a, b in (("ja", "tracks"), ("jb", "pred"))))
        + "SELECT track_id, round(ja.s, 4) AS jitter_before, round(jb.s, 4) AS jitter_after, round(CASE WHEN ja.s > 0 THEN (1 - jb.s / ja.s) * 100 ELSE 0 END, 3) AS reduction FROM ja JOIN jb USING (track_id)",
    ),
    "app_delta": (
        lambda sp, sf: m.app_delta(v.tracks(sp, sf), v.predictions(sp, sf), v.predictions(sp, sf).withColumn("x", F.col("x") - 1.5)),
        with_(TRACKS, PRED, PAIRS, f"a AS (SELECT track_id, {_app('100', 'count(*)')} FROM pairs GROUP BY track_id)", "pairs2 AS (SELECT t.track_id, sqrt((t.x - (p.x - 1.5)) * (t.x - (p.x - 1.5)) + (t.y - p.y) * (t.y - p.y)) AS d FROM tracks t JOIN pred p ON t.track_id = p.track_id AND t.frame = p.frame)", f"b AS (SELECT track_id, {_app('100', 'count(*)')} FROM pairs2 GROUP BY track_id)")
        + "SELECT track_id, a.app_avg AS app_before, b.app_avg AS app_after, round(b.app_avg - a.app_avg, 4) AS delta FROM a JOIN b USING (track_id)",
    ),
    "correction_magnitude": (lambda sp, sf: m.correction_magnitude(v.tracks(sp, sf), v.predictions(sp, sf)), with_(TRACKS, PRED, PAIRS) + "SELECT track_id, count(*) AS n, round(avg(d), 4) AS mean_shift, round(max(d), 4) AS max_shift FROM pairs GROUP BY track_id"),
    "auc_trapezoid": (lambda sp, sf: m.auc_trapezoid(curves(sp, sf)), with_(TRACKS, PRED, LEFT, CURVES) + "SELECT track_id, round(coalesce(sum(area), 0), 4) AS auc, count(*) AS points FROM (SELECT track_id, (lead(k) OVER w - k) * (lead(score) OVER w + score) / 2 AS area FROM curves WINDOW w AS (PARTITION BY track_id ORDER BY k)) GROUP BY track_id"),
    "target_crossings": (lambda sp, sf: m.crossings(curves(sp, sf), (40.0, 60.0, 90.0)), with_(TRACKS, PRED, LEFT, CURVES) + "SELECT track_id, " + ", ".join(f"min(CASE WHEN score >= {t} THEN k END) AS k_{t}" for t in (40, 60, 90)) + " FROM curves GROUP BY track_id"),
    "curve_statistics": (
        lambda sp, sf: m.curve_statistics(curves(sp, sf), sp.range(0, 100, 7).select(F.col("id").cast("int").alias("k"))),
        with_(TRACKS, PRED, LEFT, CURVES, "ks AS (SELECT CAST(unnest(range(0, 100, 7)) AS INTEGER) AS kk)", "seg AS (SELECT track_id, k AS k0, score AS s0, lead(k) OVER w AS k1, lead(score) OVER w AS s1 FROM curves WINDOW w AS (PARTITION BY track_id ORDER BY k))")
        + "SELECT kk AS k, count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS least, round(max(v), 4) AS greatest FROM (SELECT kk, CASE WHEN k1 IS NULL THEN CASE WHEN kk > k0 THEN CAST(100 AS DOUBLE) ELSE s0 END ELSE s0 + (s1 - s0) * (kk - k0) / (k1 - k0) END AS v FROM ks JOIN seg ON kk >= k0 AND (k1 IS NULL OR kk < k1)) GROUP BY kk",
    ),
    "best_by_median": (
        lambda sp, sf: m.best_by_median(_results(sp, sf), "dataset", "event_type", "x", 4),
        with_(TRACKS, RESULTS, "med AS (SELECT event_type, dataset, CAST(floor(quantile_cont(x, 0.5)) AS BIGINT) AS median FROM results GROUP BY ALL)", "b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY median, event_type) = 1 AS best FROM med)")
        + "SELECT event_type, count(*) AS groups, CAST(sum(CAST(best AS INTEGER)) AS BIGINT) AS best_in, CASE WHEN count(*) = 4 THEN CAST(floor(avg(median) + 0.5) AS BIGINT) END AS overall, coalesce(CASE WHEN count(*) = 4 THEN CAST(floor(avg(median) + 0.5) AS BIGINT) END, 9999) AS rank_key FROM b GROUP BY event_type",
    ),
    "population_mean": (lambda sp, sf: m.event_statistics(v.tracks(sp, sf), "frame", "x"), with_(TRACKS) + "SELECT frame, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x) / sqrt(count(x)), 4) AS sem FROM tracks GROUP BY frame"),
    "nearest_step": (lambda sp, sf: m.nearest_step(curves(sp, sf), 27, 5), with_(TRACKS, PRED, LEFT, CURVES) + "SELECT track_id, k, score FROM curves WHERE abs(k - 27) <= 5 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY abs(k - 27), k) = 1"),
    "event_mean": (
        lambda sp, sf: m.event_statistics(s.event_snippets(v.tracks(sp, sf), v.tracks(sp, sf).where("event_type = 'purchase'"), "x", 5, 10), "offset", "x"),
        with_(TRACKS, "span AS (SELECT track_id, min(frame) AS lo, max(frame) AS hi FROM tracks GROUP BY track_id)", "e AS (SELECT t.track_id, frame AS event FROM tracks t JOIN span s ON t.track_id = s.track_id WHERE event_type = 'purchase' AND frame - 5 >= lo AND frame + 10 <= hi)") + "SELECT t.frame - event AS \"offset\", count(x) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x) / sqrt(count(x)), 4) AS sem FROM e JOIN tracks t ON t.track_id = e.track_id AND t.frame BETWEEN event - 5 AND event + 10 GROUP BY 1",
    ),
    "grid_rescale": (lambda sp, sf: v.tracks(sp, sf).select("track_id", "frame", *sc.rescaled(F.col("x"), F.col("y"), (512, 384), (256, 256))).withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in "xy"}), with_(TRACKS) + "SELECT track_id, frame, round(x * 256 / 512 + 1e-9, 4) AS x, round(y * 256 / 384 + 1e-9, 4) AS y FROM tracks"),
    "clip_flip": (lambda sp, sf: v.tracks(sp, sf).select("track_id", *sc.in_clip(F.col("frame"), F.col("x"), 8, 512, True), "y").withColumn("x", F.round(F.col("x") + 1e-9, 4)), with_(TRACKS) + "SELECT track_id, frame - 8 AS frame, round(512 - x + 1e-9, 4) AS x, y FROM tracks"),
    "coordinate_scale": (lambda sp, sf: sc.coordinate_scale(v.tracks(sp, sf), 512, 384).select(F.round("scale", 9).alias("scale")), with_(TRACKS) + "SELECT round(512 / greatest(coalesce(max(x), 1), coalesce(max(y), 1)), 9) AS scale FROM tracks"),
    "trajectory_statistics": (lambda sp, sf: m.trajectory_statistics(v.detections(sp, sf)), with_(TRACKS) + "SELECT track_id, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM tracks WHERE NOT occluded GROUP BY track_id"),
    "linking_summary": (lambda sp, sf: m.linking_summary(v.detections(sp, sf)), with_(TRACKS, v.DETECTIONS, "a AS (SELECT count(*) AS tracks, min(c) AS shortest, max(c) AS longest, quantile_cont(CAST(c AS DOUBLE), 0.5) AS median_length FROM (SELECT count(*) AS c FROM det GROUP BY track_id))", "b AS (SELECT count(*) AS frames, round(avg(c), 4) AS per_frame, CAST(sum(c) AS BIGINT) AS detections FROM (SELECT count(*) AS c FROM det GROUP BY frame))") + "SELECT * FROM a, b"),
    "losses": (
        lambda sp, sf: m.losses(v.occluded(sp, sf), occluded_predictions(sp, sf)),
        with_(TRACKS, PRED, OCC, "r AS (SELECT t.track_id, t.occluded, p.logit, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) AS d FROM tracks t JOIN predo p ON t.track_id = p.track_id AND t.frame = p.frame)")
        + "SELECT track_id, round(avg(CASE WHEN NOT occluded THEN CASE WHEN d <= 4 THEN d * d / 2 ELSE 4 * (d - 2) END ELSE 0 END), 4) AS huber, round(avg(greatest(logit, 0) - logit * CAST(occluded AS DOUBLE) + ln(1 + exp(-abs(logit)))), 6) AS occlusion_loss FROM r GROUP BY track_id",
    ),
    # Sequences
    "velocity": (lambda sp, sf: s.velocity(v.tracks(sp, sf)).select("track_id", "frame", F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"), F.round("speed", 4).alias("speed"), F.round("angle", 6).alias("angle")), with_(TRACKS, v.FLOW) + "SELECT track_id, frame, round(mx, 4) AS vx, round(my, 4) AS vy, round(sqrt(mx * mx + my * my), 4) AS speed, round(atan2(my, mx), 6) AS angle FROM moves WHERE mx IS NOT NULL"),
    "motion_vectors": (lambda sp, sf: s.motion_vectors(v.detections(sp, sf)).withColumns({c: F.round(c, 4) for c in ("dx", "dy")}), with_(TRACKS) + "SELECT track_id, frame, x, y, round(nx - x, 4) AS dx, round(ny - y, 4) AS dy FROM (SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tracks WHERE NOT occluded WINDOW w AS (PARTITION BY track_id ORDER BY frame)) WHERE nf = frame + 1"),
    "first_valid": (lambda sp, sf: s.first_valid(v.occluded(sp, sf)), with_(TRACKS) + "SELECT track_id, frame, x, y FROM tracks WHERE NOT occluded QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame) = 1"),
    "strided_queries": (lambda sp, sf: s.strided_queries(v.occluded(sp, sf)), with_(TRACKS) + "SELECT track_id, frame, y, x FROM tracks WHERE NOT occluded AND frame % 5 = 0"),
    "empirical_cdf": (lambda sp, sf: s.empirical_cdf(v.tracks(sp, sf), "x", "track_id").withColumn("cdf", F.round("cdf", 6)), with_(TRACKS) + "SELECT track_id, frame, x, round(row_number() OVER (PARTITION BY track_id ORDER BY x, frame) / CAST(count(*) OVER (PARTITION BY track_id) AS DOUBLE), 6) AS cdf FROM tracks"),
    "baseline_zscore": (
        lambda sp, sf: s.baseline_scores(v.tracks(sp, sf), "x").select("track_id", "frame", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("f0", "dff", "z"))),
        with_(TRACKS, "b AS (SELECT track_id, frame, x, avg(CASE WHEN frame < 11 THEN x END) OVER (PARTITION BY track_id) AS f0 FROM tracks)", "d AS (SELECT *, (x - f0) / f0 AS dff FROM b)") + "SELECT track_id, frame, round(f0 + 1e-9, 4) AS f0, round(dff + 1e-9, 4) AS dff, round(CASE WHEN stddev_pop(dff) OVER w > 0 THEN (dff - avg(dff) OVER w) / stddev_pop(dff) OVER w END + 1e-9, 4) AS z FROM d WINDOW w AS (PARTITION BY track_id)",
    ),
    "peak_candidates": (lambda sp, sf: s.peak_candidates(v.tracks(sp, sf), "x", 40.0).select("track_id", "frame", "x"), with_(TRACKS) + "SELECT track_id, frame, x FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame)) WHERE x > a AND x > b AND x >= 40"),
    "find_peaks": (lambda sp, sf: s.find_peaks(v.tracks(sp, sf), "x", 40.0, 6, 10.0), None),
    "event_snippets": (
        lambda sp, sf: s.event_snippets(v.tracks(sp, sf), v.tracks(sp, sf).where("event_type = 'purchase'"), "x", 5, 10),
        with_(TRACKS, "span AS (SELECT track_id, min(frame) AS lo, max(frame) AS hi FROM tracks GROUP BY track_id)", "e AS (SELECT t.track_id, frame AS event FROM tracks t JOIN span s ON t.track_id = s.track_id WHERE event_type = 'purchase' AND frame - 5 >= lo AND frame + 10 <= hi)") + "SELECT t.track_id, event, t.frame - event AS \"offset\", x FROM e JOIN tracks t ON t.track_id = e.track_id AND t.frame BETWEEN event - 5 AND event + 10",
    ),
    "spread_duplicates": (
        lambda sp, sf: s.spread_duplicates(v.tracks(sp, sf).withColumn("x", F.rint("x")), 2.0).withColumns({c: F.round(c, 4) for c in "xy"}),
        with_(TRACKS, "p AS (SELECT track_id, frame, round_even(x, 0) AS x, y FROM tracks)", "c AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY round(x, 6), round(y, 6) ORDER BY track_id, frame) - 1 AS r FROM p WINDOW w AS (PARTITION BY round(x, 6), round(y, 6)))") + "SELECT track_id, frame, n, round(CASE WHEN n > 1 THEN x + 2 * cos(2 * pi() * r / n) ELSE x END, 4) AS x, round(CASE WHEN n > 1 THEN y + 2 * sin(2 * pi() * r / n) ELSE y END, 4) AS y FROM c",
    ),
    "training_windows": (lambda sp, sf: s.training_windows(v.occluded(sp, sf), 12, 4), with_(TRACKS, "span AS (SELECT track_id, max(frame) AS hi FROM tracks GROUP BY track_id HAVING max(frame) + 1 >= 12)", "st AS (SELECT track_id, CAST(unnest(range(0, hi - 10, 4)) AS INTEGER) AS start FROM span)") + "SELECT st.track_id, start, count(*) AS annotated FROM st JOIN tracks t ON t.track_id = st.track_id AND t.frame BETWEEN start AND start + 11 AND NOT occluded GROUP BY ALL HAVING count(*) >= 6"),
    "spectrogram": (lambda sp, sf: s.spectrogram(v.tracks(sp, sf), "x", 32, 8), None),
}
