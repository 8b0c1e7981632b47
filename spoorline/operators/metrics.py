"""Accuracy and summary metrics of tracks, all as aggregates over long rows (track_id, frame, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Radii in pixels at which points count as right.
THRESHOLDS = (1, 2, 4, 8, 16)


def distance(ax="x", ay="y", bx="px", by="py") -> Column:
    return F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by))


def paired(truth: DataFrame, predicted: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of truth with the predicted point of the same track and frame as px, py, and their distance d."""
    p = predicted.select("track_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"))
    return truth.where("x is not null and y is not null").join(p, ["track_id", "frame"], how).withColumn("d", distance())


def _shares(scale: float, of: Column, digits: int = 4) -> list[Column]:
    hit = [F.sum(F.when(F.col("d") <= t, 1.0).otherwise(0.0)) for t in THRESHOLDS]
    each = [F.when(of > 0, h * scale / of).otherwise(0.0) for h in hit]
    return [*(F.round(e, digits).alias(f"app_{t}") for e, t in zip(each, THRESHOLDS, strict=True)), F.round(sum(each[1:], each[0]) / len(each), digits).alias("app_avg")]


def app_pooled(truth: DataFrame, predicted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Average point precision in percent over valid pairs; 0 without any."""
    return paired(truth, predicted).where("d is not null").groupBy(*by).agg(F.count("*").alias("n"), *_shares(100.0, F.count("*")))


def app_fixed_frames(truth: DataFrame, predicted: DataFrame, frames: int, by: tuple[str, ...] = ()) -> DataFrame:
    """As a fraction of a fixed number of frames a track: a missing point is a miss."""
    rows = paired(truth, predicted, "left")
    of = F.countDistinct("track_id") * frames
    return rows.where(F.col("frame") < frames).groupBy(*by).agg(of.alias("n"), *_shares(1.0, of, 6))


def app_visible(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per track over its visible frames: a missing prediction is a miss."""
    return paired(truth, predicted, "left").groupBy("track_id").agg(F.count("*").alias("n"), *_shares(1.0, F.count("*"), 6))


def track_error(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mean, greatest and root-mean-square error per track; infinite without pairs."""
    none = F.lit(float("inf"))
    return paired(truth, predicted, "left").groupBy("track_id").agg(
        F.count("d").alias("n"), F.round(F.coalesce(F.avg("d"), none), 4).alias("mean_error"), F.round(F.coalesce(F.max("d"), none), 4).alias("max_error"), F.round(F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), none), 4).alias("rmse")
    )


def point_tracking(truth: DataFrame, predicted: DataFrame, mode: str = "first", every: int = 5) -> DataFrame:
    """Occlusion accuracy, points within radii (strictly) and Jaccard, averaged over radii.

    Both relations have ``occluded``. ``first``: one query per track, its first visible frame, scored on later frames.
    ``strided``: a query on every ``every``-th visible frame, scored on all other frames.
    """
    visible = truth.where("not occluded")
    queries = visible.groupBy("track_id").agg(F.min("frame").alias("q")) if mode == "first" else visible.where(F.col("frame") % every == 0).select("track_id", F.col("frame").alias("q"))
    p = predicted.select("track_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"), F.col("occluded").alias("po"))
    rows = truth.join(p, ["track_id", "frame"]).join(queries, "track_id").where(F.col("frame") > F.col("q") if mode == "first" else F.col("frame") != F.col("q"))
    d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    seen, said = ~F.col("occluded"), ~F.col("po")
    ratios, out = {"within": [], "jaccard": []}, [F.count("*").alias("n"), F.round(F.avg((F.col("occluded") == F.col("po")).cast("double")), 6).alias("occlusion_accuracy")]
    for t in THRESHOLDS:
        near = d2 < t * t
        positive = F.sum((seen & near & said).cast("double"))
        within = F.sum((seen & near).cast("double")) / F.sum(seen.cast("double"))
        false = F.sum((said & (~seen | ~near)).cast("double"))
        jaccard = positive / (F.sum(seen.cast("double")) + false)
        ratios["within"].append(within)
        ratios["jaccard"].append(jaccard)
        out += [F.round(within, 6).alias(f"within_{t}"), F.round(jaccard, 6).alias(f"jaccard_{t}")]
    out += [F.round(sum(v[1:], v[0]) / len(v), 6).alias(f"{k}_avg") for k, v in ratios.items()]
    return rows.agg(*out)


def training_metrics(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Occlusion accuracy, mean error of visible points, shares strictly within radii and within 5 px."""
    p = predicted.select("track_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"), F.col("occluded").alias("po"))
    rows = truth.join(p, ["track_id", "frame"]).withColumn("d", F.when(~F.col("occluded"), distance()))
    near = [F.round(F.avg((F.col("d") < t).cast("double")), 6).alias(f"within_{t}") for t in (*THRESHOLDS, 5)]
    return rows.agg(F.round(F.avg((F.col("occluded") == F.col("po")).cast("double")), 6).alias("occlusion_accuracy"), F.round(F.avg("d"), 4).alias("mean_error"), *near)


def jitter(tracks: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Population deviation of second differences in both coordinates, before and after, and the reduction in percent."""

    def second(t: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("track_id").orderBy("frame")
        d = [(F.lead(c, 2).over(w) - 2 * F.lead(c).over(w) + F.col(c)).alias(f"d{c}") for c in ("x", "y")]
        return t.select("track_id", *d).where("dx is not null").select("track_id", F.explode(F.array("dx", "dy")).alias("d")).groupBy("track_id").agg(F.stddev_pop("d").alias(name))

    j = second(tracks, "before").join(second(smoothed, "after"), "track_id")
    return j.select("track_id", F.round("before", 4).alias("jitter_before"), F.round("after", 4).alias("jitter_after"), F.round(F.when(F.col("before") > 0, (1 - F.col("after") / F.col("before")) * 100).otherwise(0.0), 3).alias("reduction"))


def app_delta(truth: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = (app_pooled(truth, p, ("track_id",)).select("track_id", F.col("app_avg").alias(n)) for p, n in ((before, "app_before"), (after, "app_after")))
    return a.join(b, "track_id").withColumn("delta", F.round(F.col("app_after") - F.col("app_before"), 4))


def correction_magnitude(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean distance points were moved, per track."""
    return paired(before, after).groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.avg("d"), 4).alias("mean_shift"), F.round(F.max("d"), 4).alias("max_shift"))


def auc_trapezoid(curve: DataFrame, by: str = "track_id", k: str = "k", score: str = "score") -> DataFrame:
    """Area under each curve by trapezoids."""
    w = Window.partitionBy(by).orderBy(k)
    area = (F.lead(k).over(w) - F.col(k)) * (F.lead(score).over(w) + F.col(score)) / 2
    return curve.withColumn("area", area).groupBy(by).agg(F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 4).alias("auc"), F.count("*").alias("points"))


def crossings(curve: DataFrame, targets: tuple[float, ...], by: str = "track_id", k: str = "k", score: str = "score") -> DataFrame:
    """The least k at which each target is reached; null where it never is."""
    return curve.groupBy(by).agg(*(F.min(F.when(F.col(score) >= t, F.col(k))).alias(f"k_{t:g}") for t in targets))


def curve_statistics(curve: DataFrame, ks: DataFrame, by: str = "track_id", k: str = "k", score: str = "score", full: float = 100.0) -> DataFrame:
    """Mean, least and greatest score over tracks at each k; between points by straight lines, beyond a track's last k full marks."""
    w = Window.partitionBy(by).orderBy(k)
    s = curve.select(by, F.col(k).alias("k0"), F.col(score).alias("s0"), F.lead(k).over(w).alias("k1"), F.lead(score).over(w).alias("s1"), F.first(k).over(w).alias("kf"))
    at = ks.select(F.col("k").alias("at"))
    inside = (F.col("at") >= F.col("k0")) & (F.col("k1").isNull() | (F.col("at") < F.col("k1")))
    before = (F.col("at") < F.col("k0")) & (F.col("k0") == F.col("kf"))
    j = s.join(F.broadcast(at), inside | before)  # ks is a short list of evaluation points
    v = F.when(before, F.col("s0")).when(F.col("k1").isNull(), F.when(F.col("at") > F.col("k0"), full).otherwise(F.col("s0"))).otherwise(F.col("s0") + (F.col("s1") - F.col("s0")) * (F.col("at") - F.col("k0")) / (F.col("k1") - F.col("k0")))
    return j.groupBy(F.col("at").alias("k")).agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.min(v), 4).alias("least"), F.round(F.max(v), 4).alias("greatest"))


def best_by_median(results: DataFrame, group: str, name: str, value: str, complete: int) -> DataFrame:
    """Median value of each name per group; over groups a half-up mean where all ``complete`` groups are there; ranked, missing last."""
    m = results.groupBy(name, group).agg(F.floor(F.percentile(value, F.lit(0.5))).alias("median"))
    best = Window.partitionBy(group).orderBy("median", name)
    m = m.withColumn("is_best", F.row_number().over(best) == 1)
    out = m.groupBy(name).agg(F.count("*").alias("groups"), F.sum(F.col("is_best").cast("long")).alias("best_in"), F.when(F.count("*") == complete, F.floor(F.avg("median") + 0.5)).alias("overall"))
    return out.withColumn("rank_key", F.coalesce("overall", F.lit(9999).cast("long")))


def event_statistics(values: DataFrame, at: str, value: str) -> DataFrame:
    """Mean and standard error over tracks at each place."""
    return values.groupBy(at).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value) / F.sqrt(F.count(value)), 4).alias("sem"))


def nearest_step(curves: DataFrame, target: int, tolerance: int, value: str = "score") -> DataFrame:
    """A curve's value at the step nearest to target, the smaller of two; no row for tracks without one within tolerance."""
    away = F.abs(F.col("k") - target)
    near = curves.where(away <= tolerance).groupBy("track_id").agg(F.min_by(F.struct("k", value), F.struct(away, "k")).alias("b"))
    return near.select("track_id", "b.k", f"b.{value}")


def trajectory_statistics(tracks: DataFrame) -> DataFrame:
    """Start, end and length per track."""
    return tracks.groupBy("track_id").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count("*").alias("length"))


def linking_summary(tracks: DataFrame) -> DataFrame:
    per_track, per_frame = tracks.groupBy("track_id").agg(F.count("*").alias("c")), tracks.groupBy("frame").agg(F.count("*").alias("c"))
    return per_track.agg(F.count("*").alias("tracks"), F.min("c").alias("shortest"), F.max("c").alias("longest"), F.percentile("c", F.lit(0.5)).alias("median_length")).join(
        per_frame.agg(F.count("*").alias("frames"), F.round(F.avg("c"), 4).alias("per_frame"), F.sum("c").alias("detections")), F.lit(True)
    )


def losses(truth: DataFrame, predicted: DataFrame, delta: float = 4.0) -> DataFrame:
    """Huber loss of visible points and cross-entropy of occlusion logits: the training losses, for evaluation."""
    p = predicted.select("track_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"), "logit")
    rows = truth.join(p, ["track_id", "frame"])
    d = distance()
    huber = F.when(d <= delta, d * d / 2).otherwise(delta * (d - delta / 2))
    z, label = F.col("logit"), F.col("occluded").cast("double")
    entropy = F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))
    return rows.groupBy("track_id").agg(F.round(F.avg(F.when(~F.col("occluded"), huber).otherwise(0.0)), 4).alias("huber"), F.round(F.avg(entropy), 6).alias("occlusion_loss"))
