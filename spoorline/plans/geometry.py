"""Queries over filters, joins, interpolation and propagation, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import interpolation as i
from ..operators import matching as j
from ..operators import metrics as m
from ..operators import optimum as op
from ..operators import propagation as p
from ..operators import radial as r
from ..operators import router as ro
from ..operators import sequences as s
from ..operators import stepwise as st
from . import views as v
from .views import ANCHORS, CELL_X, CELL_Y, DETECTIONS, FLOW, PIXELS, PRED, STEADY, TRACKS, with_

SPANS = "runs AS (SELECT track_id, frame, frame - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS run FROM tracks WHERE occluded), spans AS (SELECT track_id, min(frame) AS start, max(frame) AS stop FROM runs GROUP BY track_id, run)"
SEG = "seg AS (SELECT * FROM (SELECT track_id, frame AS t0, x AS x0, y AS y0, lead(frame) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM anchors WINDOW w AS (PARTITION BY track_id ORDER BY frame)) WHERE t1 IS NOT NULL)"
LINEAR = """stretched AS (SELECT seg.*, CAST(unnest(range(t0, t1 + 1)) AS INTEGER) AS frame FROM seg), ends AS (SELECT track_id, max(t1) AS last FROM seg GROUP BY track_id),
lin AS (SELECT s.track_id, frame, x0 + (frame - t0) / CAST(t1 - t0 AS DOUBLE) * (x1 - x0) AS x, y0 + (frame - t0) / CAST(t1 - t0 AS DOUBLE) * (y1 - y0) AS y FROM stretched s JOIN ends e ON s.track_id = e.track_id WHERE frame < t1 OR frame = last)"""
HIT = "f.frame = {t} AND f.gx = CAST(round_even({x} / 100, 0) AS INTEGER) AND f.gy = CAST(round_even({y} / 25, 0) AS INTEGER)"
#: Grid points of the dense fields: 8 by 5 over 0..490 and 0..100, in all frames.
GRID = "grid AS (SELECT frame, gx, gy, CAST(gx * 70 AS DOUBLE) AS x, CAST(gy * 25 AS DOUBLE) AS y FROM (SELECT DISTINCT frame FROM tracks), (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS gx), (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS gy))"
SOURCES = "src AS (SELECT track_id AS s_id, frame, x AS px, y AS py, mx AS dx, my AS dy FROM moves WHERE mx IS NOT NULL)"


def grid(sp, sf):
    g = v.tracks(sp, sf).select("frame").distinct()
    g = g.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return g.withColumn("x", F.col("gx") * F.lit(70.0)).withColumn("y", F.col("gy") * F.lit(25.0))


def sources(sp, sf):
    vel = s.velocity(v.tracks(sp, sf))
    return vel.select(F.col("track_id").alias("s_id"), "frame", F.col("x").alias("px"), F.col("y").alias("py"), F.col("vx").alias("dx"), F.col("vy").alias("dy"))


def rounded(df, digits=4, *cols):
    """Rounded a hair above ties, which two engines may sum to either side of."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in cols or ("x", "y")})


def _greedy_sql(radius: float) -> str:
    """From t (video, a_id, x, y) and q (video, b_id, px, py), in one frame each: truths in order, each taking the nearest that none before it has."""
    d = "sqrt((x - px) * (x - px) + (y - py) * (y - py))"
    return (
        f"pr AS (SELECT t.video, a_id, b_id, {d} AS d FROM t JOIN q ON t.video = q.video WHERE {d} < {radius})",
        "ca AS (SELECT video, a_id, list({'d': d, 'b': b_id} ORDER BY d, b_id) AS near, row_number() OVER (PARTITION BY video ORDER BY a_id) AS i FROM pr GROUP BY video, a_id)",
        "go(video, i, a_id, took, used) AS (SELECT DISTINCT video, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRUCT(d DOUBLE, b BIGINT)), CAST([] AS BIGINT[]) FROM ca"
        " UNION ALL SELECT video, i, a_id, took, CASE WHEN took IS NULL THEN used ELSE list_append(used, took.b) END FROM (SELECT g.video, c.i, c.a_id, g.used, list_filter(c.near, lambda e: NOT list_contains(g.used, e.b))[1] AS took FROM go g JOIN ca c ON c.video = g.video AND c.i = g.i + 1))",
    )


def _field_sql(weight: str, reach: float | None) -> str:
    d = "sqrt((g.x - s.px) * (g.x - s.px) + (g.y - s.py) * (g.y - s.py))"
    return (
        with_(TRACKS, FLOW, GRID, SOURCES, f"pr AS (SELECT g.frame, gx, gy, {d} AS d, dx, dy FROM grid g JOIN src s ON g.frame = s.frame{f' AND {d} <= {reach}' if reach else ''})", f"mn AS (SELECT frame, gx, gy, sum({weight}) AS w, sum({weight} * dx) AS sx, sum({weight} * dy) AS sy FROM pr GROUP BY ALL)", "en AS (SELECT frame, count(*) AS n FROM src GROUP BY frame)")
        + ", ".join(["SELECT g.frame, g.gx, g.gy", *(f"round(CASE WHEN n >= 3 THEN coalesce({c} / (w + 1e-8), 0) ELSE CAST(0 AS DOUBLE) END, 5) AS {o}" for c, o in (("sx", "vx"), ("sy", "vy")))])
        + " FROM grid g LEFT JOIN mn ON g.frame = mn.frame AND g.gx = mn.gx AND g.gy = mn.gy LEFT JOIN en ON g.frame = en.frame"
    )


def _pull_points(sp, sf):
    t = v.tracks(sp, sf)
    done, open_ = t.where("track_id % 4 = 0"), t.where("track_id % 4 <> 0")
    return open_.select("track_id", "frame", "x", "y"), done.select("frame", F.col("x").alias("px"), F.col("y").alias("py"))


def _late_anchors(sp, sf):
    """Anchors that leave frames before the first and after the last."""
    return v.tracks(sp, sf).where("frame % 10 = 5").select("track_id", "frame", "x", "y")


def _motion_points(sp, sf):
    t = v.tracks(sp, sf)
    vec = s.motion_vectors(t.where("track_id % 4 = 0"))
    return t.where("track_id % 4 <> 0").select("track_id", "frame", "x", "y"), vec.select(F.col("track_id").alias("s_id"), "frame", F.col("x").alias("px"), F.col("y").alias("py"), F.col("dx").alias("mx"), F.col("dy").alias("my"))


def _open_tracks(sp, sf):
    """Three quarters of the tracks, each begun some frames late, so that there are frames before its first place."""
    return v.steady(sp, sf).where("track_id % 4 <> 0 AND frame >= track_id % 7").select("track_id", "frame", "x", "y")


def _completed(sp, sf):
    return v.steady(sp, sf).where("track_id % 4 = 0").select("track_id", "frame", "x", "y")


def _optimised_sql() -> str:
    """Forward and back, each step with the motion of completed tracks around the place just computed."""
    d = "sqrt((p.x - s.px) * (p.x - s.px) + (p.y - s.py) * (p.y - s.py))"
    cell = "f.gx = greatest(0, least(5, CAST(round_even(p.x / 100, 0) AS INTEGER))) AND f.gy = greatest(0, least(4, CAST(round_even(p.y / 25, 0) AS INTEGER)))"

    def wave(name: str, at: str, sign: str, first: str, stop: str) -> str:
        near = f"SELECT p.track_id, p.frame, p.x, p.y, p.until, s_id, mx, my, {d} AS d FROM {name} p LEFT JOIN sr s ON s.frame = {at} AND {d} <= 100 WHERE {stop}"
        sums = f"SELECT track_id, frame, x, y, until, arg_min({{'x': mx, 'y': my}}, s_id) FILTER (d < 1e-6) AS e, sum(1 / (d * d)) FILTER (d >= 1e-6) AS w, sum(mx / (d * d)) FILTER (d >= 1e-6) AS wx, sum(my / (d * d)) FILTER (d >= 1e-6) AS wy FROM ({near}) GROUP BY ALL"
        move = lambda c: f"p.{c} {sign} CASE WHEN e IS NOT NULL THEN e.{c} WHEN w > 0 THEN 0.9 * w{c} / w + 0.1 * coalesce(f.d{c}, 0) ELSE coalesce(f.d{c}, 0) END"
        return f"{name}(track_id, frame, x, y, until) AS ({first} UNION ALL SELECT p.track_id, p.frame {sign} 1, {move('x')}, {move('y')}, p.until FROM ({sums}) p LEFT JOIN flow f ON f.frame = {at} AND {cell})"

    return (
        with_(
            STEADY, FLOW, "op AS (SELECT track_id, frame, x, y FROM tracks WHERE track_id % 4 <> 0 AND frame >= track_id % 7)", "sr AS (SELECT track_id AS s_id, frame, x AS px, y AS py, mx, my FROM moves WHERE mx IS NOT NULL AND track_id % 4 = 0)",
            "sp AS (SELECT track_id, min(frame) AS a, max(frame) AS b FROM op GROUP BY track_id)", "st AS (SELECT op.*, b FROM op JOIN sp ON op.track_id = sp.track_id AND op.frame = a)",
            wave("fw", "p.frame", "+", "SELECT track_id, frame, x, y, b FROM st", "p.frame < p.until"),
            wave("bk", "p.frame - 1", "-", "SELECT track_id, frame, x, y, 0 FROM st WHERE b > frame", "p.frame > 0"),
        )
        + "SELECT track_id, frame, round(x + 1e-9, 2) AS x, round(y + 1e-9, 2) AS y FROM fw UNION ALL SELECT b.track_id, b.frame, round(b.x + 1e-9, 2), round(b.y + 1e-9, 2) FROM bk b JOIN sp ON b.track_id = sp.track_id AND b.frame < a"
    )


def _optimum_sql() -> str:
    """Two trials: every pair of neighbouring anchors propagated once, then summed up by rebuild."""
    hits = ", ".join(f"count(*) FILTER (d <= {t})" for t in m.THRESHOLDS)
    total = hits.replace(", ", " + ")
    return (
        with_(
            STEADY, FLOW, "sp AS (SELECT track_id, min(frame) AS a, max(frame) AS b, count(*) AS n FROM tracks GROUP BY track_id HAVING count(*) > 1)",
            "od AS (SELECT t.track_id, trial, frame, row_number() OVER (PARTITION BY t.track_id, trial ORDER BY md5('42:' || t.track_id || ':' || trial || ':' || frame), frame) AS place FROM tracks t JOIN sp ON t.track_id = sp.track_id AND frame > a, (SELECT unnest(range(2)) AS trial))",
            "ks AS (SELECT DISTINCT track_id, k FROM (SELECT track_id, n, CAST(unnest(list_concat(list_concat(list_concat(range(0, 11), range(10, 51, 5)), list_concat(range(50, 101, 10), range(100, 1001, 25))), [n - 1])) AS INTEGER) AS k FROM sp) WHERE k <= n - 1)",
            "ch AS (SELECT od.track_id, trial, k, frame FROM od JOIN ks ON od.track_id = ks.track_id AND place <= k UNION ALL SELECT ks.track_id, trial, k, a FROM ks JOIN sp ON ks.track_id = sp.track_id, (SELECT unnest(range(2)) AS trial))",
            "pa AS (SELECT track_id, trial, k, frame AS t0, lead(frame) OVER (PARTITION BY track_id, trial, k ORDER BY frame) AS t1 FROM ch)",
            "seg AS (SELECT w.track_id, t0, t1, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM (SELECT DISTINCT track_id, t0, t1 FROM pa WHERE t1 > t0 + 1) w JOIN tracks a ON a.track_id = w.track_id AND a.frame = t0 JOIN tracks b ON b.track_id = w.track_id AND b.frame = t1)",
            _AHEAD, _BACK,
            "la AS (SELECT w.track_id, t0, b, x, y FROM (SELECT DISTINCT track_id, t0 FROM pa WHERE t1 IS NULL) w JOIN sp ON w.track_id = sp.track_id AND b > t0 JOIN tracks t ON t.track_id = w.track_id AND t.frame = t0)",
            f"ta(track_id, t0, b, frame, x, y) AS (SELECT track_id, t0, b, t0, x, y FROM la UNION ALL SELECT p.track_id, t0, b, p.frame + 1, p.x + coalesce(f.dx, 0), p.y + coalesce(f.dy, 0) FROM ta p LEFT JOIN flow f ON {HIT.format(t='p.frame', x='p.x', y='p.y')} WHERE p.frame < b)",
            "mo AS (SELECT a.track_id, a.t0, a.t1, a.frame, (1 - (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE)) * a.x + (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE) * b.x AS x, (1 - (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE)) * a.y + (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE) * b.y AS y FROM ahead a JOIN back b ON a.track_id = b.track_id AND a.t0 = b.t0 AND a.t1 = b.t1 AND a.frame = b.frame WHERE a.frame > a.t0 AND a.frame < a.t1 UNION ALL SELECT track_id, t0, -1, frame, x, y FROM ta WHERE frame > t0)",
            f"sc AS (SELECT track_id, t0, t1, {total} AS h FROM (SELECT mo.track_id, t0, t1, sqrt((mo.x - t.x) * (mo.x - t.x) + (mo.y - t.y) * (mo.y - t.y)) AS d FROM mo JOIN tracks t ON mo.track_id = t.track_id AND mo.frame = t.frame) GROUP BY ALL)",
            "rs AS (SELECT pa.track_id, trial, k, sum(coalesce(h, 0) + 5) / CAST(any_value(n) * 5 AS DOUBLE) AS app FROM pa JOIN sp ON pa.track_id = sp.track_id LEFT JOIN sc ON pa.track_id = sc.track_id AND pa.t0 = sc.t0 AND coalesce(pa.t1, -1) = sc.t1 GROUP BY ALL)",
            "au AS (SELECT track_id, trial, round(sum(area), 9) AS auc, max({'app': app, 'less': -k}) FILTER (k > 0) AS best FROM (SELECT *, (lead(k) OVER w - k) * (lead(app) OVER w + app) / 2 AS area FROM rs WINDOW w AS (PARTITION BY track_id, trial ORDER BY k)) GROUP BY ALL)",
            "wi AS (SELECT track_id, max({'auc': auc, 'less': -trial, 'best': best}) AS a FROM au GROUP BY track_id)", "tg AS (SELECT CAST(unnest([0.90, 0.95, 0.97, 1.0]) AS DOUBLE) AS target)",
            "re AS (SELECT track_id, target, min({'k': k, 'less': -app, 'trial': trial}) AS c FROM rs JOIN tg ON app >= target WHERE k > 0 GROUP BY ALL)",
        )
        + "SELECT wi.track_id, tg.target, CAST(coalesce(c.k, -a.best.less) AS INTEGER) AS optimal_k, round(coalesce(-c.less, a.best.app), 6) AS optimal_app, CAST(coalesce(c.trial, -a.less) AS INTEGER) AS optimal_trial, round(s.app, 6) AS baseline_app, round(a.auc, 4) AS best_auc, CAST(-a.less AS INTEGER) AS best_auc_trial"
        + " FROM wi CROSS JOIN tg LEFT JOIN re ON re.track_id = wi.track_id AND re.target = tg.target JOIN (SELECT track_id, min(app) AS app FROM rs WHERE k = 0 GROUP BY track_id) s ON s.track_id = wi.track_id"
    )


def _propagated_sql(back: bool) -> str:
    if not back:
        step = f"SELECT p.track_id, p.frame + 1, p.x + coalesce(f.dx, 0), p.y + coalesce(f.dy, 0) FROM p LEFT JOIN flow f ON {HIT.format(t='p.frame', x='p.x', y='p.y')} WHERE p.frame < 15"
        return with_(TRACKS, FLOW, f"p(track_id, frame, x, y) AS (SELECT track_id, frame, x, y FROM tracks WHERE frame = 0 UNION ALL {step})") + "SELECT track_id, frame, round(x + 1e-9, 3) AS x, round(y + 1e-9, 3) AS y FROM p"
    inner = "(SELECT *, x AS qx, y AS qy FROM p WHERE frame > 10)"
    for n in range(3):
        inner = f"(SELECT q{n}.track_id, q{n}.frame, q{n}.x, q{n}.y, q{n}.x - coalesce(f.dx, 0) AS qx, q{n}.y - coalesce(f.dy, 0) AS qy FROM {inner} q{n} LEFT JOIN flow f ON {HIT.format(t=f'q{n}.frame - 1', x=f'q{n}.qx', y=f'q{n}.qy')})"
    return with_(TRACKS, FLOW, f"p(track_id, frame, x, y) AS (SELECT track_id, frame, x, y FROM tracks WHERE frame = 20 UNION ALL SELECT b.track_id, b.frame - 1, b.qx, b.qy FROM {inner} b)") + "SELECT track_id, frame, round(x + 1e-9, 3) AS x, round(y + 1e-9, 3) AS y FROM p"


_AHEAD = f"ahead(track_id, t0, t1, frame, x, y) AS (SELECT track_id, t0, t1, t0, x0, y0 FROM seg UNION ALL SELECT p.track_id, t0, t1, p.frame + 1, p.x + coalesce(f.dx, 0), p.y + coalesce(f.dy, 0) FROM ahead p LEFT JOIN flow f ON {HIT.format(t='p.frame', x='p.x', y='p.y')} WHERE p.frame < t1)"
_BACK = f"back(track_id, t0, t1, frame, x, y) AS (SELECT track_id, t0, t1, t1, x1, y1 FROM seg UNION ALL SELECT p.track_id, t0, t1, p.frame - 1, p.x - coalesce(f.dx, 0), p.y - coalesce(f.dy, 0) FROM back p LEFT JOIN flow f ON {HIT.format(t='p.frame - 1', x='p.x', y='p.y')} WHERE p.frame > t0)"

def _routed(sp, sf):
    """Two thirds of the tracks by anchors, short gaps straight; the others from a seed in their middle."""
    t = v.steady(sp, sf)
    spans = t.groupBy("track_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    anchors = t.where("track_id % 3 <> 0 AND (frame + track_id) % 9 IN (0, 2)").select("track_id", "frame", "x", "y")
    seeds = t.join(spans, "track_id").where("track_id % 3 = 0 AND frame = floor((lo + hi) / 2)").select("track_id", F.struct(F.col("frame").cast("int").alias("frame"), "x", "y").alias("seed"))
    requests = spans.select("track_id", F.lit("full_blend").alias("method")).join(seeds, "track_id", "left")
    return rounded(ro.optimise_tracks(requests, anchors, v.flow(sp, sf, t), CELL_X, CELL_Y, spans, 400, 2), 3)


def _routed_sql() -> str:
    inner = "(SELECT *, x AS qx, y AS qy FROM bs WHERE frame > lo)"
    for n in range(3):
        inner = f"(SELECT q{n}.track_id, q{n}.lo, q{n}.frame, q{n}.x, q{n}.y, q{n}.x - coalesce(f.dx, 0) AS qx, q{n}.y - coalesce(f.dy, 0) AS qy FROM {inner} q{n} LEFT JOIN flow f ON {HIT.format(t=f'q{n}.frame - 1', x=f'q{n}.qx', y=f'q{n}.qy')})"
    go = f"p.x + coalesce(f.dx, 0), p.y + coalesce(f.dy, 0) FROM {{name}} p LEFT JOIN flow f ON {HIT.format(t='p.frame', x='p.x', y='p.y')}"
    return (
        with_(
            STEADY, FLOW, "sp AS (SELECT track_id, min(frame) AS lo, max(frame) AS hi FROM tracks GROUP BY track_id)", "anchors AS (SELECT track_id, frame, x, y FROM tracks WHERE track_id % 3 <> 0 AND (frame + track_id) % 9 IN (0, 2))",
            "every AS (SELECT * FROM (SELECT track_id, frame AS t0, x AS x0, y AS y0, lead(frame) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM anchors WINDOW w AS (PARTITION BY track_id ORDER BY frame)) WHERE t1 IS NOT NULL)",
            "seg AS (SELECT * FROM every WHERE t1 - t0 > 2)", _AHEAD, _BACK,
            "fi AS (SELECT a.*, lo FROM anchors a JOIN sp ON a.track_id = sp.track_id QUALIFY row_number() OVER (PARTITION BY a.track_id ORDER BY frame) = 1)", "la AS (SELECT a.*, hi FROM anchors a JOIN sp ON a.track_id = sp.track_id QUALIFY row_number() OVER (PARTITION BY a.track_id ORDER BY frame DESC) = 1)",
            f"bk(track_id, lo, frame, x, y) AS (SELECT track_id, lo, frame, x, y FROM fi UNION ALL SELECT p.track_id, p.lo, p.frame - 1, p.x - coalesce(f.dx, 0), p.y - coalesce(f.dy, 0) FROM bk p LEFT JOIN flow f ON {HIT.format(t='p.frame - 1', x='p.x', y='p.y')} WHERE p.frame > p.lo)",
            f"fw(track_id, hi, frame, x, y) AS (SELECT track_id, hi, frame, x, y FROM la UNION ALL SELECT p.track_id, p.hi, p.frame + 1, {go.format(name='fw')} WHERE p.frame < p.hi)",
            "sd AS (SELECT t.track_id, lo, hi, frame, x, y FROM tracks t JOIN sp ON t.track_id = sp.track_id WHERE t.track_id % 3 = 0 AND frame = (lo + hi) // 2)",
            f"fs(track_id, hi, frame, x, y) AS (SELECT track_id, hi, frame, x, y FROM sd UNION ALL SELECT p.track_id, p.hi, p.frame + 1, {go.format(name='fs')} WHERE p.frame < p.hi)",
            f"bs(track_id, lo, frame, x, y) AS (SELECT track_id, lo, frame, x, y FROM sd UNION ALL SELECT b.track_id, b.lo, b.frame - 1, b.qx, b.qy FROM {inner} b)",
            "every_row AS (SELECT a.track_id, a.frame, (1 - (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE)) * a.x + (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE) * b.x AS x, (1 - (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE)) * a.y + (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE) * b.y AS y FROM ahead a JOIN back b ON a.track_id = b.track_id AND a.t0 = b.t0 AND a.frame = b.frame WHERE a.frame > a.t0 AND a.frame < a.t1"
            " UNION ALL SELECT track_id, t0 + 1, (x0 + x1) / 2, (y0 + y1) / 2 FROM every WHERE t1 - t0 = 2 UNION ALL SELECT track_id, frame, x, y FROM anchors"
            " UNION ALL SELECT b.track_id, b.frame, b.x, b.y FROM bk b JOIN fi ON b.track_id = fi.track_id AND b.frame < fi.frame UNION ALL SELECT w.track_id, w.frame, w.x, w.y FROM fw w JOIN la ON w.track_id = la.track_id AND w.frame > la.frame"
            " UNION ALL SELECT track_id, frame, x, y FROM fs UNION ALL SELECT b.track_id, b.frame, b.x, b.y FROM bs b JOIN sd ON b.track_id = sd.track_id AND b.frame < sd.frame)",
        )
        + "SELECT track_id, frame, round(x + 1e-9, 3) AS x, round(y + 1e-9, 3) AS y FROM every_row"
    )


QUERIES = {
    # Filters
    "persistent_all": (lambda sp, sf: f.persistent(v.detections(sp, sf).withColumn("frame", F.floor(F.col("frame") / 20).cast("int"))).select("track_id", "frame", "x"), with_(TRACKS, "d AS (SELECT track_id, frame // 20 AS frame, x FROM tracks WHERE NOT occluded)") + "SELECT track_id, frame, x FROM d WHERE track_id IN (SELECT track_id FROM d GROUP BY track_id HAVING count(DISTINCT frame) = (SELECT count(DISTINCT frame) FROM d))"),
    "persistent_min": (lambda sp, sf: f.persistent(v.detections(sp, sf), 45).select("track_id", "frame", "x"), with_(TRACKS, DETECTIONS) + "SELECT track_id, frame, x FROM det WHERE track_id IN (SELECT track_id FROM det GROUP BY track_id HAVING count(DISTINCT frame) >= 45)"),
    "occlusion_filter": (lambda sp, sf: f.rarely_occluded(v.occluded(sp, sf), 0.2).select("track_id", "frame", "x"), with_(TRACKS) + "SELECT track_id, frame, x FROM tracks WHERE track_id IN (SELECT track_id FROM tracks GROUP BY track_id HAVING avg(CAST(occluded AS DOUBLE)) <= 0.2)"),
    "mad_outliers": (
        lambda sp, sf: rounded(f.velocity_outliers(s.velocity(v.tracks(sp, sf))), 4, "speed"),
        with_(TRACKS, FLOW, "v AS (SELECT track_id, frame, sqrt(mx * mx + my * my) AS speed FROM moves WHERE mx IS NOT NULL)", "md AS (SELECT frame, quantile_cont(speed, 0.5) AS median, count(*) AS n FROM v GROUP BY frame)", "ma AS (SELECT v.frame, quantile_cont(abs(speed - median), 0.5) AS mad FROM v JOIN md USING (frame) GROUP BY v.frame)", "o AS (SELECT v.*, n, speed < median + 5 * greatest(mad, 1) AS ok FROM v JOIN md USING (frame) JOIN ma USING (frame))")
        + "SELECT track_id, frame, round(speed, 4) AS speed FROM (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY frame) AS good FROM o) WHERE ok OR n <= 10 OR good < 3",
    ),
    "border_exclusion": (lambda sp, sf: f.inside(v.tracks(sp, sf), 490.0, 100.0, 5.0).select("track_id", "frame", "x", "y"), with_(TRACKS) + "SELECT track_id, frame, x, y FROM tracks WHERE x >= 5 AND x < 485 AND y >= 5 AND y < 95"),
    "drop_tracks": (lambda sp, sf: v.tracks(sp, sf).where(~F.col("track_id").isin(1, 3, 5)).select("track_id", "frame", "x"), with_(TRACKS) + "SELECT track_id, frame, x FROM tracks WHERE track_id NOT IN (1, 3, 5)"),
    "trail": (lambda sp, sf: f.trail(v.tracks(sp, sf), 5, 4), with_(TRACKS, "span AS (SELECT track_id, max(frame) AS hi FROM tracks GROUP BY track_id)", "e AS (SELECT t.track_id, CAST(unnest(range(frame, least(frame + 5, hi) + 1)) AS INTEGER) AS shown, frame, x, y FROM tracks t JOIN span s ON t.track_id = s.track_id)") + "SELECT *, round(0.3 + 0.7 * row_number() OVER (PARTITION BY track_id, shown ORDER BY frame) / count(*) OVER (PARTITION BY track_id, shown), 6) AS alpha FROM e WHERE shown % 4 = 0"),
    "occlusion_segments": (lambda sp, sf: f.segments(v.occluded(sp, sf)), with_(TRACKS, SPANS) + "SELECT * FROM spans"),
    "visible_in_segments": (lambda sp, sf: f.visible_in(v.tracks(sp, sf), f.segments(v.occluded(sp, sf))).select("track_id", "frame", "visible"), with_(TRACKS, SPANS) + "SELECT track_id, frame, CASE WHEN NOT EXISTS (SELECT 1 FROM spans s WHERE s.track_id = t.track_id) THEN true ELSE EXISTS (SELECT 1 FROM spans s WHERE s.track_id = t.track_id AND t.frame BETWEEN start AND stop) END AS visible FROM tracks t"),
    "terminal_cutoff": (lambda sp, sf: f.terminal_cutoff(v.tracks(sp, sf), f.segments(v.occluded(sp, sf))), with_(TRACKS, SPANS, "tt AS (SELECT track_id, max(frame) + 1 AS total FROM tracks GROUP BY track_id)") + "SELECT s.track_id, min(start) AS cutoff FROM spans s JOIN tt ON s.track_id = tt.track_id WHERE stop >= total - 10 GROUP BY s.track_id"),
    # Joins
    "gt_pred_join": (lambda sp, sf: m.paired(v.tracks(sp, sf), v.predictions(sp, sf)).select("track_id", "frame", F.round("d", 4).alias("d")), with_(TRACKS, PRED) + "SELECT t.track_id, t.frame, round(sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)), 4) AS d FROM tracks t JOIN pred p ON t.track_id = p.track_id AND t.frame = p.frame"),
    "nn_match": (
        lambda sp, sf: rounded(j.mutual_nearest(v.tracks(sp, sf).select("frame", F.col("track_id").alias("a_id"), "x", "y"), v.predictions(sp, sf).select("frame", F.col("track_id").alias("b_id"), F.col("x").alias("px"), F.col("y").alias("py")), 20.0), 4, "d"),
        with_(TRACKS, PRED, "pr AS (SELECT t.frame, t.track_id AS a_id, p.track_id AS b_id, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) AS d FROM tracks t JOIN pred p ON t.frame = p.frame)") + "SELECT frame, a_id, b_id, round(d, 4) AS d FROM (SELECT *, row_number() OVER (PARTITION BY frame, a_id ORDER BY d, b_id) AS ra, row_number() OVER (PARTITION BY frame, b_id ORDER BY d, a_id) AS rb FROM pr WHERE d < 20) WHERE ra = 1 AND rb = 1",
    ),
    "greedy_match": (
        lambda sp, sf: rounded(j.greedy_match(v.tracks(sp, sf).select("frame", F.col("frame").cast("long").alias("video"), F.col("track_id").alias("a_id"), "x", "y"), v.predictions(sp, sf).select("frame", F.col("track_id").alias("b_id"), F.col("x").alias("px"), F.col("y").alias("py")), 20.0), 5, "d"),
        with_(TRACKS, PRED, "t AS (SELECT CAST(frame AS BIGINT) AS video, track_id AS a_id, x, y FROM tracks)", "q AS (SELECT CAST(frame AS BIGINT) AS video, track_id AS b_id, x AS px, y AS py FROM pred)", *_greedy_sql(20.0)) + "SELECT video, a_id, took.b AS b_id, round(took.d + 1e-9, 5) AS d FROM go WHERE took IS NOT NULL",
    ),
    "match_tracks": (
        lambda sp, sf: rounded(j.match_tracks(v.occluded(sp, sf).where("NOT occluded").withColumn("video", F.col("track_id") % 5), v.predictions(sp, sf).withColumn("video", F.col("track_id") % 5)), 5, "d"),
        with_(TRACKS, PRED, "t AS (SELECT track_id % 5 AS video, track_id AS a_id, arg_min(x, frame) AS x, arg_min(y, frame) AS y FROM tracks WHERE NOT occluded GROUP BY track_id)", "q AS (SELECT track_id % 5 AS video, track_id AS b_id, x AS px, y AS py FROM pred WHERE frame = 0)", *_greedy_sql(20.0)) + "SELECT video, a_id, took.b AS b_id, round(took.d + 1e-9, 5) AS d FROM go WHERE took IS NOT NULL",
    ),
    "radius_semi": (
        lambda sp, sf: j.nearest_in(v.predictions(sp, sf).withColumnRenamed("track_id", "a_id"), v.tracks(sp, sf).where("track_id % 4 = 0").select("frame", F.col("track_id").alias("b_id"), F.col("x").alias("px"), F.col("y").alias("py")), 15.0).select(F.col("a_id").alias("track_id"), "frame"),
        with_(TRACKS, PRED) + "SELECT track_id, frame FROM pred p WHERE EXISTS (SELECT 1 FROM tracks t WHERE t.track_id % 4 = 0 AND t.frame = p.frame AND sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) <= 15)",
    ),
    "assign_queries": (
        lambda sp, sf: j.assign_queries(v.predictions(sp, sf).select((F.col("track_id") * 1000 + F.col("frame")).alias("query_id"), "frame", "x", "y"), v.tracks(sp, sf)),
        with_(TRACKS, PRED) + "SELECT p.track_id * 1000 + p.frame AS query_id, min(t.track_id) AS track_id FROM pred p JOIN tracks t ON p.frame = t.frame AND abs(p.x - t.x) < 2 AND abs(p.y - t.y) < 2 GROUP BY ALL",
    ),
    "flow_lookup": (lambda sp, sf: j.flow_at(v.predictions(sp, sf), v.flow(sp, sf), CELL_X, CELL_Y).select("track_id", "frame", "dx", "dy"), with_(TRACKS, PRED, FLOW) + f"SELECT p.track_id, p.frame, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy FROM pred p LEFT JOIN flow f ON {HIT.format(t='p.frame', x='p.x', y='p.y')}"),
    "flow_residuals": (lambda sp, sf: j.flow_residuals(s.motion_vectors(v.tracks(sp, sf)), v.flow(sp, sf), CELL_X, CELL_Y), with_(TRACKS, FLOW) + f"SELECT p.track_id, p.frame, round(mx - coalesce(dx, 0) + 1e-9, 4) AS rx, round(my - coalesce(dy, 0) + 1e-9, 4) AS ry FROM moves p LEFT JOIN flow f ON {HIT.format(t='p.frame', x='p.x', y='p.y')} WHERE mx IS NOT NULL"),
    "sample_at_track": (
        lambda sp, sf: j.sample_pixels(v.tracks(sp, sf).select("track_id", (F.col("frame") % 80 + 23941).cast("int").alias("frame"), (F.col("x") / 10).alias("x"), (F.col("y") / 15).alias("y")), v.pixels(sp, sf), 50, 7).select("track_id", "frame", "px", "py", "value"),
        with_(TRACKS, PIXELS) + "SELECT t.track_id, t.frame, t.px, t.py, value FROM (SELECT track_id, CAST(frame % 80 + 23941 AS INTEGER) AS frame, CAST(greatest(0, least(49, round_even(x / 10, 0))) AS INTEGER) AS px, CAST(greatest(0, least(6, round_even(y / 15, 0))) AS INTEGER) AS py FROM tracks) t JOIN pixels p ON t.frame = p.frame AND t.px = p.px AND t.py = p.py",
    ),
    "anchor_segments": (lambda sp, sf: j.anchor_segments(v.anchors(sp, sf)), with_(TRACKS, ANCHORS, SEG) + "SELECT * FROM seg"),
    "asof_fill": (
        lambda sp, sf: rounded(j.fill_between(v.occluded(sp, sf).withColumn("known", ~F.col("occluded")))),
        with_(TRACKS, "k AS (SELECT track_id, frame, NOT occluded AS known, x, y, last_value(CASE WHEN NOT occluded THEN {'f': frame, 'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(CASE WHEN NOT occluded THEN {'f': frame, 'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM tracks)")
        + "SELECT track_id, frame, known, " + ", ".join(f"round(CASE WHEN known THEN {c} WHEN a IS NULL THEN b.{c} WHEN b IS NULL THEN a.{c} ELSE a.{c} + (b.{c} - a.{c}) * (frame - a.f) / (b.f - a.f) END, 4) AS {c}" for c in "xy") + " FROM k",
    ),
    "worst_anchor": (lambda sp, sf: j.worst_anchors(v.anchors(sp, sf), v.predictions(sp, sf)), with_(TRACKS, PRED, ANCHORS) + "SELECT track_id, frame AS worst_frame, round(d, 4) AS dist FROM (SELECT a.track_id, a.frame, sqrt((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y)) AS d FROM anchors a JOIN pred p ON a.track_id = p.track_id AND a.frame = p.frame) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY d DESC, frame) = 1"),
    "anchor_disagreement": (lambda sp, sf: j.disagreement(v.anchors(sp, sf), v.predictions(sp, sf)), with_(TRACKS, PRED, ANCHORS) + "SELECT track_id, count(*) AS n, " + ", ".join(f"round(quantile_cont(d, {q}), 4) AS {n}" for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))) + " FROM (SELECT a.track_id, sqrt((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y)) AS d FROM anchors a JOIN pred p ON a.track_id = p.track_id AND a.frame = p.frame) GROUP BY track_id"),
    "completed_anti": (lambda sp, sf: j.unfinished(v.tracks(sp, sf).select("track_id", "frame"), v.tracks(sp, sf).where("track_id % 4 = 0").select("track_id").distinct(), ["track_id"]), with_(TRACKS) + "SELECT track_id, frame FROM tracks WHERE track_id % 4 <> 0"),
    "merge_corrected": (lambda sp, sf: j.merge_corrected(v.tracks(sp, sf).select("track_id", "frame", "x", "y"), v.predictions(sp, sf).where("track_id % 3 = 0")), with_(TRACKS, PRED) + "SELECT track_id, frame, x, y FROM tracks WHERE track_id % 3 <> 0 UNION ALL SELECT track_id, frame, x, y FROM pred WHERE track_id % 3 = 0"),
    # Interpolation
    "linear_segments": (lambda sp, sf: rounded(i.linear_segments(v.anchors(sp, sf))), with_(TRACKS, ANCHORS, SEG, LINEAR) + "SELECT track_id, frame, round(x, 4) AS x, round(y, 4) AS y FROM lin"),
    "app_linear_segments": (
        lambda sp, sf: m.app_pooled(v.tracks(sp, sf), i.linear_segments(v.anchors(sp, sf)), ("track_id",)),
        with_(TRACKS, ANCHORS, SEG, LINEAR, "pairs AS (SELECT t.track_id, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) AS d FROM tracks t JOIN lin p ON t.track_id = p.track_id AND t.frame = p.frame)")
        + "SELECT track_id, count(*) AS n, " + ", ".join(f"round(sum(CASE WHEN d <= {t} THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 4) AS app_{t}" for t in m.THRESHOLDS) + ", round((" + " + ".join(f"sum(CASE WHEN d <= {t} THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*)" for t in m.THRESHOLDS) + ") / 5, 4) AS app_avg FROM pairs GROUP BY track_id",
    ),
    "field_gaussian": (lambda sp, sf: i.dense_field(sources(sp, sf), grid(sp, sf), "gaussian", 20.0), _field_sql("exp(-d * d / 800)", 172.0)),
    "field_wendland": (lambda sp, sf: i.dense_field(sources(sp, sf), grid(sp, sf), "wendland", 20.0), _field_sql("CASE WHEN d < 60 THEN power(1 - d / 60, 4) * (4 * d / 60 + 1) ELSE 0 END", 60.0)),
    "field_idw": (lambda sp, sf: i.dense_field(sources(sp, sf), grid(sp, sf), "idw", 20.0), _field_sql("1 / (d * d + 400)", None)),
    "field_radial": (lambda sp, sf: rounded(r.radial_field(sources(sp, sf), grid(sp, sf), 40.0), 3, "vx", "vy"), None),
    "field_blurred": (
        lambda sp, sf: rounded(r.blurred(i.dense_field(sources(sp, sf), grid(sp, sf), "gaussian", 20.0), 1.5, 8, 5), 3, "vx", "vy"),
        _field_sql("exp(-d * d / 800)", 172.0).replace("SELECT g.frame, g.gx, g.gy,", ", fi AS (SELECT g.frame, g.gx, g.gy,", 1)
        + "), ta AS (SELECT o, exp(-0.5 * (o / CAST(1.5 AS DOUBLE)) * (o / CAST(1.5 AS DOUBLE))) / sum(exp(-0.5 * (o / CAST(1.5 AS DOUBLE)) * (o / CAST(1.5 AS DOUBLE)))) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS o)),"
        + " mi AS (SELECT n, x, o, w, CAST(least((x + o + 4 * n) % (2 * n), 2 * n - 1 - (x + o + 4 * n) % (2 * n)) AS INTEGER) AS f FROM ta, (SELECT 8 AS n, unnest(range(8)) AS x UNION ALL SELECT 5, unnest(range(5)))),"
        + " ax AS (SELECT frame, CAST(mi.x AS INTEGER) AS gx, gy, sum(w * vx) AS vx, sum(w * vy) AS vy FROM fi JOIN mi ON n = 8 AND f = gx GROUP BY ALL)"
        + " SELECT frame, gx, CAST(mi.x AS INTEGER) AS gy, round(sum(w * vx) + 1e-9, 3) AS vx, round(sum(w * vy) + 1e-9, 3) AS vy FROM ax JOIN mi ON n = 5 AND f = gy GROUP BY ALL",
    ),
    "nearest_sources": (
        lambda sp, sf: rounded(j.nearest_k(grid(sp, sf), sources(sp, sf).where("dx IS NOT NULL"), ["gx", "gy"], "s_id", 32, 40.0).select("frame", "gx", "gy", "s_id", "rank", "d"), 5, "d"),
        with_(TRACKS, FLOW, GRID, SOURCES) + "SELECT * FROM (SELECT g.frame, gx, gy, s_id, CAST(row_number() OVER (PARTITION BY g.frame, gx, gy ORDER BY d, s_id) AS INTEGER) AS rank, round(d + 1e-9, 5) AS d FROM (SELECT g.frame, gx, gy, s_id, sqrt((g.x - s.px) * (g.x - s.px) + (g.y - s.py) * (g.y - s.py)) AS d FROM grid g JOIN src s ON g.frame = s.frame) g) WHERE rank <= 32",
    ),
    "idw_power": (lambda sp, sf: i.idw_power(sources(sp, sf), grid(sp, sf)), with_(TRACKS, FLOW, GRID, SOURCES, "pr AS (SELECT g.frame, gx, gy, 1 / power(sqrt((g.x - s.px) * (g.x - s.px) + (g.y - s.py) * (g.y - s.py)) + 1e-6, 2) AS w, dx, dy FROM grid g JOIN src s ON g.frame = s.frame)") + "SELECT frame, gx, gy, round(sum(w * dx) / sum(w), 5) AS vx, round(sum(w * dy) / sum(w), 5) AS vy FROM pr GROUP BY ALL"),
    "motion_idw_blend": (
        lambda sp, sf: rounded(i.blended_motion(*_motion_points(sp, sf), v.flow(sp, sf), CELL_X, CELL_Y, 60.0), 4, "mx", "my"),
        with_(TRACKS, FLOW, "pt AS (SELECT * FROM tracks WHERE track_id % 4 <> 0)", "sr AS (SELECT track_id AS s_id, frame, x AS px, y AS py, mx, my FROM moves WHERE mx IS NOT NULL AND track_id % 4 = 0)", "pr AS (SELECT pt.track_id, pt.frame, s_id, mx, my, sqrt((pt.x - px) * (pt.x - px) + (pt.y - py) * (pt.y - py)) AS d FROM pt JOIN sr ON pt.frame = sr.frame)", "mo AS (SELECT track_id, frame, count(*) FILTER (d < 1e-6) AS hits, arg_min({'x': mx, 'y': my}, s_id) FILTER (d < 1e-6) AS e, sum(1 / (d * d)) FILTER (d >= 1e-6) AS w, sum(mx / (d * d)) FILTER (d >= 1e-6) AS wx, sum(my / (d * d)) FILTER (d >= 1e-6) AS wy FROM pr WHERE d <= 60 GROUP BY ALL)")
        + "SELECT p.track_id, p.frame, round(CASE WHEN hits > 0 THEN e.x WHEN w > 0 THEN 0.9 * wx / w + 0.1 * coalesce(f.dx, 0) ELSE coalesce(f.dx, 0) END + 1e-9, 4) AS mx, round(CASE WHEN hits > 0 THEN e.y WHEN w > 0 THEN 0.9 * wy / w + 0.1 * coalesce(f.dy, 0) ELSE coalesce(f.dy, 0) END + 1e-9, 4) AS my FROM pt p LEFT JOIN flow f ON " + HIT.format(t="p.frame", x="p.x", y="p.y") + " LEFT JOIN mo ON mo.track_id = p.track_id AND mo.frame = p.frame",
    ),
    "bilinear_sample": (
        lambda sp, sf: rounded(i.bilinear(v.tracks(sp, sf).select((F.col("track_id") * 1000 + F.col("frame")).alias("point_id"), (F.col("frame") % 80 + 23941).cast("int").alias("frame"), (F.col("x") / 10).alias("x"), (F.col("y") / 15).alias("y")), v.pixels(sp, sf)), 4, "value"),
        with_(TRACKS, PIXELS, "sz AS (SELECT frame, max(px) AS wx, max(py) AS wy FROM pixels GROUP BY frame)", "pt AS (SELECT track_id * 1000 + t.frame AS point_id, s.frame, x / 10 AS x, y / 15 AS y, wx, wy FROM tracks t JOIN sz s ON s.frame = t.frame % 80 + 23941)", "c AS (SELECT point_id, frame, (CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w, CAST(greatest(0, least(wx, floor(x) + i)) AS INTEGER) AS px, CAST(greatest(0, least(wy, floor(y) + j)) AS INTEGER) AS py FROM pt, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))")
        + "SELECT point_id, round(sum(w * coalesce(value, 0)) + 1e-9, 4) AS value FROM c LEFT JOIN pixels p ON c.frame = p.frame AND c.px = p.px AND c.py = p.py GROUP BY point_id",
    ),
    # Propagation
    "propagate_forward": (lambda sp, sf: rounded(p.propagate(v.tracks(sp, sf).where("frame = 0"), v.flow(sp, sf), CELL_X, CELL_Y, 15), 3), _propagated_sql(False)),
    "propagate_backward3": (lambda sp, sf: rounded(p.propagate(v.tracks(sp, sf).where("frame = 20"), v.flow(sp, sf), CELL_X, CELL_Y, 10, True), 3), _propagated_sql(True)),
    "segment_flow_blend": (
        lambda sp, sf: rounded(p.blend_segments(v.anchors(sp, sf), v.flow(sp, sf), CELL_X, CELL_Y, 10), 3),
        with_(TRACKS, FLOW, ANCHORS, SEG, _AHEAD, _BACK) + "SELECT a.track_id, a.frame, round((1 - (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE)) * a.x + (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE) * b.x + 1e-9, 3) AS x, round((1 - (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE)) * a.y + (a.frame - a.t0) / CAST(a.t1 - a.t0 AS DOUBLE) * b.y + 1e-9, 3) AS y FROM ahead a JOIN back b ON a.track_id = b.track_id AND a.t0 = b.t0 AND a.frame = b.frame WHERE a.frame > a.t0 AND a.frame < a.t1 UNION ALL SELECT track_id, frame, round(x, 3), round(y, 3) FROM anchors",
    ),
    "segment_linear_threshold": (lambda sp, sf: rounded(p.blend_segments(v.anchors(sp, sf), v.flow(sp, sf), CELL_X, CELL_Y, 10, 10), 3), with_(TRACKS, ANCHORS, SEG, LINEAR) + "SELECT track_id, frame, round(x, 3) AS x, round(y, 3) AS y FROM lin UNION SELECT track_id, frame, round(x, 3), round(y, 3) FROM anchors"),
    "anchor_correction": (lambda sp, sf: p.anchor_corrections(v.anchors(sp, sf), v.flow(sp, sf), CELL_X, CELL_Y, 10), with_(TRACKS, FLOW, ANCHORS, SEG, _AHEAD) + "SELECT s.track_id, s.t1 AS frame, round(s.x1 - a.x, 3) AS cx, round(s.y1 - a.y, 3) AS cy FROM seg s JOIN ahead a ON s.track_id = a.track_id AND s.t0 = a.t0 AND a.frame = s.t1"),
    "mesh_pull": (
        lambda sp, sf: p.mesh_pull(*_pull_points(sp, sf), 30.0),
        with_(TRACKS, "co AS (SELECT frame, x AS px, y AS py FROM tracks WHERE track_id % 4 = 0)", "pt AS (SELECT * FROM tracks WHERE track_id % 4 <> 0)", "pr AS (SELECT track_id, pt.frame, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d, px - x AS cx, py - y AS cy FROM pt JOIN co ON pt.frame = co.frame)", "mm AS (SELECT track_id, frame, sum(exp(-d * d / 200)) AS w, sum(exp(-d * d / 200) * cx) AS sx, sum(exp(-d * d / 200) * cy) AS sy FROM pr WHERE d < 30 GROUP BY ALL)")
        + "SELECT pt.track_id, pt.frame, round(x + coalesce(0.1 * sx / w, 0) + 1e-9, 4) AS x, round(y + coalesce(0.1 * sy / w, 0) + 1e-9, 4) AS y FROM pt LEFT JOIN mm ON pt.track_id = mm.track_id AND pt.frame = mm.frame",
    ),
    "optimise_motion": (lambda sp, sf: rounded(st.optimise_motion(_open_tracks(sp, sf), _completed(sp, sf), v.flow(sp, sf, v.steady(sp, sf)), CELL_X, CELL_Y, cells=(6, 5)), 2), _optimised_sql()),
    "optimise_tracks": (_routed, _routed_sql()),
    "optimum_per_track": (lambda sp, sf: op.optimum(op.rebuild_scores(v.steady(sp, sf), v.flow(sp, sf, v.steady(sp, sf)), CELL_X, CELL_Y, 2, 400)), _optimum_sql()),
    "beyond_anchors": (
        lambda sp, sf: rounded(p.beyond_anchors(_late_anchors(sp, sf), v.flow(sp, sf), CELL_X, CELL_Y, v.tracks(sp, sf).groupBy("track_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")), 10), 3),
        with_(
            TRACKS, FLOW, "an AS (SELECT track_id, frame, x, y FROM tracks WHERE frame % 10 = 5)", "hi AS (SELECT track_id, max(frame) AS hi FROM tracks GROUP BY track_id)",
            "fi AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY frame) = 1)", "la AS (SELECT an.*, hi FROM an JOIN hi ON an.track_id = hi.track_id QUALIFY row_number() OVER (PARTITION BY an.track_id ORDER BY frame DESC) = 1)",
            f"bk(track_id, frame, x, y) AS (SELECT track_id, frame, x, y FROM fi UNION ALL SELECT p.track_id, p.frame - 1, p.x - coalesce(f.dx, 0), p.y - coalesce(f.dy, 0) FROM bk p LEFT JOIN flow f ON {HIT.format(t='p.frame - 1', x='p.x', y='p.y')} WHERE p.frame > 0)",
            f"fw(track_id, hi, frame, x, y) AS (SELECT track_id, hi, frame, x, y FROM la UNION ALL SELECT p.track_id, p.hi, p.frame + 1, p.x + coalesce(f.dx, 0), p.y + coalesce(f.dy, 0) FROM fw p LEFT JOIN flow f ON {HIT.format(t='p.frame', x='p.x', y='p.y')} WHERE p.frame < p.hi)",
        )
        + "SELECT track_id, frame, round(x + 1e-9, 3) AS x, round(y + 1e-9, 3) AS y FROM (SELECT track_id, frame, x, y FROM bk WHERE frame < 5 UNION ALL SELECT fw.track_id, fw.frame, fw.x, fw.y FROM fw JOIN la ON fw.track_id = la.track_id AND fw.frame > la.frame)",
    ),
}
