"""Queries over detection, folds, meshes and sampling, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.lineage import written
from ..operators import blobs as bl
from ..operators import detection as d
from ..operators import folds as fo
from ..operators import matching as j
from ..operators import mesh as me
from ..operators import metrics as m
from ..operators import sampling as sa
from . import views as v
from .geometry import SEG, rounded
from .views import ANCHORS, FLOW, PIXELS, PRED, TRACKS, with_

NB = "nb AS (SELECT p.frame, p.px, p.py, p.value, max(q.value) AS top FROM pixels p JOIN pixels q ON p.frame = q.frame AND abs(p.px - q.px) <= 1 AND abs(p.py - q.py) <= 1 GROUP BY ALL), sz AS (SELECT frame, max(px) AS wx, max(py) AS wy FROM pixels GROUP BY frame), mx AS (SELECT nb.frame, px, py, value FROM nb JOIN sz ON nb.frame = sz.frame WHERE value >= top AND value >= 60000 AND px >= 1 AND py >= 1 AND px < wx AND py < wy)"
#: Forward differences, and deviations of the cells of an 8 by 8 grid.
STEPS = "gr AS (SELECT frame, px, py, value, CASE WHEN lead(px) OVER a = px + 1 THEN lead(value) OVER a - value END AS gx, CASE WHEN lead(py) OVER b = py + 1 THEN lead(value) OVER b - value END AS gy FROM pixels WINDOW a AS (PARTITION BY frame, py ORDER BY px), b AS (PARTITION BY frame, px ORDER BY py))"


def _cells_sql(name: str, grid: int) -> str:
    """Pixels by cell of a grid: frame, a, b, value."""
    size = "SELECT frame, max(px) + 1 AS w, max(py) + 1 AS h FROM pixels GROUP BY frame"
    return f"{name} AS (SELECT frame, a, b, value FROM (SELECT p.frame, value, w, h, px // (w // least({grid}, w)) AS a, py // (h // least({grid}, h)) AS b FROM pixels p JOIN ({size}) s ON p.frame = s.frame) WHERE a < least({grid}, w) AND b < least({grid}, h))"


SLOPES = STEPS + ", " + _cells_sql("ce", 8) + ", cx AS (SELECT frame, avg(s) AS s FROM (SELECT frame, stddev_pop(value) AS s FROM ce GROUP BY frame, a, b) GROUP BY frame)"
COMPLEXITY = "round(coalesce(avg(sqrt(gx * gx + gy * gy)), 0) + any_value(s) + 1e-9, 4)"


def _shift(a: str, c: str) -> str:
    return f"coalesce(greatest(-0.5, least(0.5, CASE WHEN abs(2 * (2 * m.value - {a}.value - {c}.value)) > 1e-10 THEN ({a}.value - {c}.value) / (2 * (2 * m.value - {a}.value - {c}.value)) ELSE 0 END)), 0)"


def _detections(sp, sf):
    t = v.detections(sp, sf)
    return t.select((F.col("track_id") % 3).alias("video"), "frame", F.col("track_id").alias("det_id"), "x", "y")


def _motion_scores(pixels):
    return d.motion(pixels).select(F.lit(0).cast("long").alias("video"), "frame", F.col("motion").alias("score"))


def _known(sp, sf):
    return v.occluded(sp, sf).withColumn("known", ~F.col("occluded"))


def _mesh_points(sp, sf):
    return v.tracks(sp, sf).select("frame", "track_id", "x", "y")


def _nearest(sp, sf):
    t = v.occluded(sp, sf).where("not occluded").select("frame", F.col("track_id").alias("a_id"), "x", "y")
    p = v.predictions(sp, sf).select("frame", F.col("track_id").alias("b_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    best = j.nearest_in(t, p, 12.0, strict=True)
    return t.join(best, ["frame", "a_id"], "left").select(F.col("a_id").alias("track_id"), "frame", F.col("b_id").alias("near_id"))


def _dense_flow(sp, sf):
    """Flow cells as pixels of a small image: x and y in cells."""
    return v.flow(sp, sf).select("frame", F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"), (F.col("dx") / 100).alias("dx"), (F.col("dy") / 25).alias("dy"))


def _cell_anchors(sp, sf):
    return j.anchor_segments(v.anchors(sp, sf)).select("track_id", "t0", (F.col("x0") / 100).alias("x0"), (F.col("y0") / 25).alias("y0"), "t1", (F.col("x1") / 100).alias("x1"), (F.col("y1") / 25).alias("y1"))


def _corridors(sp, sf):
    return fo.corridor_paths(_cell_anchors(sp, sf), _dense_flow(sp, sf), radius=3, least=4)


def _image_places(sp, sf):
    """Track places as places of the monthly images: a track's frame is a month."""
    t = v.tracks(sp, sf)
    return t.where("frame < 80").select("track_id", F.col("frame").cast("int").alias("frame"), (F.col("x") / 10).alias("x"), (F.col("y") / 15).alias("y"))


def _image_pixels(sp, sf):
    return v.pixels(sp, sf).withColumn("frame", F.col("frame") - 23941).where("frame BETWEEN 0 AND 79")


def _image_flow(sp, sf):
    """Flow of the tracks, slowed down, in cells of the images."""
    return v.flow(sp, sf).where("frame < 80").select("frame", "gx", "gy", (F.col("dx") / 100).alias("dx"), (F.col("dy") / 150).alias("dy"))


def _blobs(sp, sf, of, **more):
    """The operator over the images, 50 by 7, with cells of 10 by 1.75 pixels."""
    return rounded(of(flow=_image_flow(sp, sf), pixels=_image_pixels(sp, sf), sx=10.0, sy=1.75, width=50, height=7, last=79, search=5.0, radius=1.5, **more), 3)


def _pixels_once(sp, sf):
    """Pixels that a query reads several times: items and orders are joined once, and some thousand pixels a month are kept."""
    return written(v.pixels(sp, sf))


def _optimal(sp, sf, n=8):
    """Votes of diverse, moving and complex months."""
    pixels = _pixels_once(sp, sf)
    found = d.features(pixels).groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("f"))
    names = [*(f"h{i}" for i in range(32)), *(f"{k}{a}_{b}" for k in "ms" for a in range(4) for b in range(4)), "gx", "gy", "g"]
    vectors = found.select("frame", F.array(*(F.coalesce(F.element_at("f", F.lit(x)), F.lit(0.0)) for x in names)).alias("vector"))
    video = F.lit(0).cast("long").alias("video")
    complex_ = d.complexity(pixels).select(video, "frame", F.col("complexity").alias("score"))
    candidates = {"diversity": sa.diverse(vectors, 2 * n).select(video, "frame"), "motion": sa.spaced_top(_motion_scores(pixels), 2 * n, True), "complexity": sa.spaced_top(complex_, 2 * n, False)}
    return sa.optimal_frames(pixels.select(video, "frame").distinct(), candidates, n)


def _subpixel(sp, sf):
    pixels = _pixels_once(sp, sf)
    return d.subpixel(d.local_maxima(pixels, 60000.0), pixels)


PEAKS = with_(TRACKS, PRED, "pr AS (SELECT t.frame, t.track_id, p.track_id AS near_id, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) AS d FROM tracks t JOIN pred p ON t.frame = p.frame WHERE NOT t.occluded)", "be AS (SELECT frame, track_id, near_id FROM pr WHERE d < 12 QUALIFY row_number() OVER (PARTITION BY frame, track_id ORDER BY d, near_id) = 1)", "ne AS (SELECT t.track_id, t.frame, near_id FROM tracks t LEFT JOIN be ON be.track_id = t.track_id AND be.frame = t.frame WHERE NOT t.occluded)", "pv AS (SELECT *, lag(near_id) OVER (PARTITION BY track_id ORDER BY frame) AS was FROM ne WHERE near_id IS NOT NULL)")

QUERIES = {
    "percentile_stretch": (lambda sp, sf: d.stretch(v.pixels(sp, sf)), with_(TRACKS, PIXELS, "q AS (SELECT frame, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM pixels GROUP BY frame)") + "SELECT p.frame, px, py, round(greatest(0, least(1, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END)), 5) AS value FROM pixels p JOIN q ON p.frame = q.frame"),
    "local_maxima": (lambda sp, sf: d.local_maxima(v.pixels(sp, sf), 60000.0), with_(TRACKS, PIXELS, NB) + "SELECT * FROM mx"),
    "subpixel": (
        _subpixel,
        with_(TRACKS, PIXELS, NB) + f"SELECT m.frame, round(m.px + {_shift('l', 'r')}, 5) AS x, round(m.py + {_shift('u', 'd')}, 5) AS y, m.value AS quality FROM mx m " + " ".join(f"LEFT JOIN pixels {n} ON {n}.frame = m.frame AND {n}.px = m.px + {a} AND {n}.py = m.py + {b}" for n, a, b in (("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("d", 0, 1))),
    ),
    "top_by_quality": (lambda sp, sf: d.top_by_quality(d.local_maxima(v.pixels(sp, sf), 60000.0).select("frame", F.col("px").alias("x"), F.col("py").alias("y"), F.col("value").alias("quality")), 3), with_(TRACKS, PIXELS, NB) + "SELECT frame, px AS x, py AS y, value AS quality FROM mx QUALIFY row_number() OVER (PARTITION BY frame ORDER BY value DESC, py, px) <= 3"),
    "frame_motion": (lambda sp, sf: rounded(d.motion(v.pixels(sp, sf)), 3, "motion"), with_(TRACKS, PIXELS) + "SELECT p.frame, round(coalesce(avg(abs(p.value - q.value)), 0) + 1e-9, 3) AS motion FROM pixels p LEFT JOIN pixels q ON q.frame = p.frame - 1 AND q.px = p.px AND q.py = p.py GROUP BY p.frame"),
    "frame_complexity": (lambda sp, sf: d.complexity(v.pixels(sp, sf)), with_(TRACKS, PIXELS, SLOPES) + "SELECT g.frame, " + COMPLEXITY + " AS complexity FROM gr g JOIN cx ON g.frame = cx.frame GROUP BY g.frame"),
    "frame_features": (
        lambda sp, sf: d.features(v.pixels(sp, sf)),
        with_(
            TRACKS, PIXELS, STEPS, _cells_sql("ce", 4), "sp AS (SELECT frame, min(value) AS lo, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) / 32 ELSE CAST(1 AS DOUBLE) / 32 END AS width, count(*) AS n FROM pixels GROUP BY frame)",
            "hi AS (SELECT p.frame, least(31, CAST(floor((value - lo) / width) AS INTEGER)) AS b, width, n FROM pixels p JOIN sp ON p.frame = sp.frame)", "st AS (SELECT frame, a, b, avg(value) AS m, stddev_pop(value) AS s FROM ce GROUP BY ALL)", "ed AS (SELECT frame, coalesce(avg(abs(gx)), 0) AS gx, coalesce(avg(abs(gy)), 0) AS gy FROM gr GROUP BY frame)",
        )
        + "SELECT frame, 'h' || b AS feature, round(count(*) / CAST(any_value(n) AS DOUBLE) / any_value(width) * 1e6 + 1e-9, 4) AS value FROM hi GROUP BY frame, b UNION ALL SELECT frame, 'm' || b || '_' || a, round(m + 1e-9, 2) FROM st UNION ALL SELECT frame, 's' || b || '_' || a, round(s + 1e-9, 2) FROM st UNION ALL SELECT frame, 'gx', round(gx + 1e-9, 2) FROM ed UNION ALL SELECT frame, 'gy', round(gy + 1e-9, 2) FROM ed UNION ALL SELECT frame, 'g', round(sqrt(gx * gx + gy * gy) + 1e-9, 2) FROM ed",
    ),
    "detect_dog": (lambda sp, sf: d.detect(v.pixels(sp, sf), 1.5, 0.02), None),
    "detect_exact": (lambda sp, sf: d.detect_exact(v.pixels(sp, sf), 1.5, 500.0), None),
    "detect_subpixel": (lambda sp, sf: d.detect(v.pixels(sp, sf), 1.5, 0.02, subpixel=True, border=0), None),
    "detect_nms": (lambda sp, sf: d.detect(v.pixels(sp, sf), 1.5, 0.02, distance=4.0, most=10), None),
    "detect_multiscale": (lambda sp, sf: d.detect(v.pixels(sp, sf), 1.2, 0.02, distance=3.0, scales=(1.0, 1.6, 2.56)), None),
    "link": (lambda sp, sf: fo.link(_detections(sp, sf), 40.0, 1), None),
    "adaptive_link": (lambda sp, sf: fo.adaptive_link(_detections(sp, sf), 40.0, 1, whole=True), None),
    "spectral_fill": (lambda sp, sf: rounded(fo.spectral_fill(_known(sp, sf))), None),
    "dct_smooth": (lambda sp, sf: rounded(fo.cosine_smooth(_known(sp, sf))), None),
    "corridor_dp": (_corridors, None),
    "intervention_cost": (
        lambda sp, sf: fo.interventions(_nearest(sp, sf)),
        PEAKS + "SELECT n.track_id, CAST(CASE WHEN count(n.near_id) > 0 THEN 1 ELSE 0 END AS BIGINT) AS picks, CAST(coalesce(any_value(r), 0) AS BIGINT) AS relinks, count(*) - count(n.near_id) AS manual, CAST(CASE WHEN count(n.near_id) > 0 THEN 1 ELSE 0 END + coalesce(any_value(r), 0) + count(*) - count(n.near_id) AS BIGINT) AS total FROM ne n LEFT JOIN (SELECT track_id, count(*) FILTER (was IS NOT NULL AND was <> near_id) AS r FROM pv GROUP BY track_id) x ON x.track_id = n.track_id GROUP BY n.track_id",
    ),
    "mesh_triangles": (lambda sp, sf: me.triangles(_mesh_points(sp, sf)), None),
    "mesh_edges": (lambda sp, sf: me.edges(me.triangles(_mesh_points(sp, sf))), None),
    "mesh_quality": (lambda sp, sf: me.quality(me.triangles(_mesh_points(sp, sf)), _mesh_points(sp, sf)), None),
    "mesh_barycentric": (lambda sp, sf: me.barycentric(v.predictions(sp, sf).select(F.col("track_id").alias("query_id"), "frame", F.col("x").alias("px"), F.col("y").alias("py")), me.triangles(_mesh_points(sp, sf)), _mesh_points(sp, sf), 60.0), None),
    "mesh_laplacian": (lambda sp, sf: me.laplacian(me.edges(me.triangles(_mesh_points(sp, sf))), _mesh_points(sp, sf)), None),
    "propagate_blobs": (lambda sp, sf: _blobs(sp, sf, bl.propagate_blobs, seeds=_image_places(sp, sf).where("frame = track_id % 80")), None),
    "blob_segments": (lambda sp, sf: _blobs(sp, sf, bl.blend_blobs, anchors=_image_places(sp, sf).where("frame % 10 = 5")), None),
    "gap_topk": (lambda sp, sf: sa.spaced_top(_motion_scores(_pixels_once(sp, sf)), 8, True), None),
    "complexity_topk": (lambda sp, sf: sa.spaced_top(d.complexity(v.pixels(sp, sf)).select(F.lit(0).cast("long").alias("video"), "frame", F.col("complexity").alias("score")), 8, False), None),
    "weighted_votes": (
        lambda sp, sf: sa.votes({"motion": (d.motion(v.pixels(sp, sf)).where("motion > 25000"), 1.0), "complex": (d.complexity(v.pixels(sp, sf)).where("complexity > 35000"), 1.5)}),
        with_(TRACKS, PIXELS, SLOPES, "a AS (SELECT p.frame, round(coalesce(avg(abs(p.value - q.value)), 0) + 1e-9, 3) AS m FROM pixels p LEFT JOIN pixels q ON q.frame = p.frame - 1 AND q.px = p.px AND q.py = p.py GROUP BY p.frame)", "b AS (SELECT g.frame, " + COMPLEXITY + " AS c FROM gr g JOIN cx ON g.frame = cx.frame GROUP BY g.frame)")
        + "SELECT frame, sum(w) AS score FROM (SELECT frame, CAST(1 AS DOUBLE) AS w FROM a WHERE m > 25000 UNION ALL SELECT frame, CAST(1.5 AS DOUBLE) FROM b WHERE c > 35000) GROUP BY frame",
    ),
    "uniform_sample": (lambda sp, sf: sa.uniform_frames(v.tracks(sp, sf), 9), with_(TRACKS) + "SELECT DISTINCT CAST(lo + floor(i * (hi - lo) / CAST(8 AS DOUBLE)) AS INTEGER) AS frame FROM (SELECT min(frame) AS lo, max(frame) AS hi FROM tracks), (SELECT unnest(range(0, 9)) AS i)"),
    "annotation_advice": (
        lambda sp, sf: d.advice(v.pixels(sp, sf).select(F.floor(F.col("frame") / 12).alias("video"), "frame", "px", "py", (F.col("value") / 400).alias("value"))),
        with_(TRACKS, PIXELS.replace("pixels AS", "raw AS", 1), "pixels AS (SELECT frame // 12 AS video, frame, px, py, value / 400 AS value FROM raw)", SLOPES, "mo AS (SELECT p.video, p.frame, coalesce(avg(abs(p.value - q.value)), 0) AS m FROM pixels p LEFT JOIN pixels q ON q.video = p.video AND q.frame = p.frame - 1 AND q.px = p.px AND q.py = p.py GROUP BY ALL)", "co AS (SELECT g.frame, " + COMPLEXITY + " AS c FROM gr g JOIN cx ON g.frame = cx.frame GROUP BY g.frame)", "vi AS (SELECT video, count(*) AS total, avg(m) AS motion, max(m) AS most_motion, (least(1, avg(m) / 50) + least(1, avg(c) / 100)) / 2 AS overall FROM mo JOIN co ON mo.frame = co.frame GROUP BY video)", "ad AS (SELECT *, CAST(greatest(3, least(CASE WHEN overall < 0.2 THEN 5 WHEN overall < 0.4 THEN 8 WHEN overall < 0.6 THEN 12 ELSE 20 END, total // 5)) AS BIGINT) AS frames, CAST(CASE WHEN overall < 0.2 THEN 5 WHEN overall < 0.4 THEN 8 WHEN overall < 0.6 THEN 10 ELSE 15 END AS BIGINT) AS points FROM vi)")
        + "SELECT CAST(video AS BIGINT) AS video, frames, points, frames * points AS annotations, round(frames * points / CAST(120 AS DOUBLE) + 1e-9, 1) AS minutes, round(overall + 1e-9, 3) AS overall, CASE WHEN overall < 0.2 THEN 'simple' WHEN overall < 0.4 THEN 'moderate' WHEN overall < 0.6 THEN 'complex' ELSE 'challenging' END AS category, round(motion + 1e-9, 2) AS motion, round(most_motion + 1e-9, 2) AS most_motion FROM ad",
    ),
    "correction_counts": (lambda sp, sf: sa.correction_counts(v.tracks(sp, sf).groupBy("track_id").agg((F.count("*") * 2).cast("int").alias("most"))), with_(TRACKS, "mo AS (SELECT track_id, CAST(count(*) * 2 AS INTEGER) AS most FROM tracks GROUP BY track_id)", "ks AS (SELECT unnest(list_concat(list_concat(range(1, 11), range(10, 51, 5)), list_concat(range(50, 101, 10), range(100, 1001, 25)))) AS k)") + "SELECT track_id, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT track_id, k FROM mo, ks WHERE k <= most UNION SELECT track_id, most FROM mo)"),
    "rank_nulls_last": (lambda sp, sf: sa.ranked(v.tracks(sp, sf).groupBy("track_id").agg(F.when(F.count("*") > 60, F.count("*")).alias("score")), "score").withColumn("rank", F.col("rank").cast("long")), with_(TRACKS) + "SELECT track_id, score, rank() OVER (ORDER BY score NULLS LAST) AS rank FROM (SELECT track_id, CASE WHEN count(*) > 60 THEN count(*) END AS score FROM tracks GROUP BY track_id)"),
    "train_test_split": (lambda sp, sf: sa.split(v.tracks(sp, sf).select("track_id").distinct(), "track_id"), None),
    "permutation_trials": (lambda sp, sf: sa.permutations(v.anchors(sp, sf).select("track_id", "frame"), "track_id", 3), None),
    "optimal_frames": (_optimal, None),
    "diverse_frames": (lambda sp, sf: sa.diverse(sp.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("frame") if "vec_id" in sp.read.parquet(f"{sf}/embeddings.parquet").columns else F.col(sp.read.parquet(f"{sf}/embeddings.parquet").columns[0]).alias("frame"), F.col(next(f.name for f in sp.read.parquet(f"{sf}/embeddings.parquet").schema if f.dataType.typeName() == "array")).cast("array<double>").alias("vector")), 10), None),
    "combined_occlusion": (lambda sp, sf: v.tracks(sp, sf).select("track_id", "frame", sc.combined_occlusion(F.col("x") / 100 - 2, F.col("y") / 50 - 1.5).alias("occluded")), with_(TRACKS) + "SELECT track_id, frame, 1 - (1 - 1 / (1 + exp(-(x / 100 - 2)))) * (1 - 1 / (1 + exp(-(y / 50 - 1.5)))) > 0.5 AS occluded FROM tracks"),
    "scalar_functions": (
        lambda sp, sf: sp.read.parquet(f"{sf}/customer.parquet").select("c_custkey", sc.digits_only(F.col("c_name")).alias("digits"), sc.snapped(F.col("c_acctbal") / 7).alias("snapped"), sc.clamp_pixel(F.col("c_acctbal") / 10, 500).alias("pixel"), F.round(sc.matching_memory(F.abs("c_acctbal") * 100), 5).alias("gb")),
        "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, round(round_even(c_acctbal / 7 / 0.25, 0) * 0.25, 4) AS snapped, CAST(greatest(0, least(499, round_even(c_acctbal / 10, 0))) AS INTEGER) AS pixel, round(0.046 + 1.94e-7 * (abs(c_acctbal) * 100) + 1.52e-12 * (abs(c_acctbal) * 100) * (abs(c_acctbal) * 100), 5) AS gb FROM customer",
    ),
    "flow_colours": (
        lambda sp, sf: sc.coloured(v.flow(sp, sf)).select("frame", "gx", "gy", "hue", "saturation", "brightness"),
        with_(TRACKS, FLOW) + "SELECT frame, gx, gy, CAST(floor((atan2(dy, dx) + pi()) * 90 / pi()) AS INTEGER) AS hue, 255 AS saturation, CAST(floor(CASE WHEN most > 0 THEN sqrt(dx * dx + dy * dy) / most * 255 ELSE 0 END) AS INTEGER) AS brightness FROM flow, (SELECT max(sqrt(dx * dx + dy * dy)) AS most FROM flow)",
    ),
    "particle_flow": (lambda sp, sf: _particle_flow(sp, sf), None),
    "event_windows": (lambda sp, sf: sp.read.parquet(f"{sf}/events.parquet").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 3).alias("value")), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 3) AS value FROM events GROUP BY ALL"),
}


def _particle_flow(sp, sf):
    """Detections, linked, filtered, filled, differentiated, and spread over a grid."""
    from ..operators import filters, interpolation, sequences

    linked = fo.link(_detections(sp, sf), 60.0, 1).withColumn("track_id", F.concat_ws("/", "video", "particle"))
    long = filters.persistent(linked, 3)
    span = long.groupBy("track_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).select("track_id", F.explode(F.sequence("lo", "hi")).alias("frame"))
    dense = span.join(long.select("track_id", "frame", "x", "y"), ["track_id", "frame"], "left").withColumn("known", F.col("x").isNotNull())
    vel = sequences.velocity(j.fill_between(dense))
    src = vel.select(F.col("track_id").alias("s_id"), "frame", F.col("x").alias("px"), F.col("y").alias("py"), F.col("vx").alias("dx"), F.col("vy").alias("dy"))
    from .geometry import grid

    return interpolation.dense_field(src, grid(sp, sf), "gaussian", 30.0)
