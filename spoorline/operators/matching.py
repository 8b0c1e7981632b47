"""Joins between tracks, detections, anchors and flow.

Joins by distance are equi-joins on frame and grid cell: one side is copied to its neighbouring cells, so that work
grows with true neighbours, not with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from .metrics import distance
from .places import Places, nearest_in


def near(a: DataFrame, b: DataFrame, radius: float, strict: bool = False, copied: str = "b") -> DataFrame:
    """Pairs of a frame within a radius. a: frame, x, y, ...; b: frame, px, py, ... Adds d. copied: the side whose rows go to nine cells each."""
    cells = lambda x, y: (F.floor(F.col(x) / radius).alias("__cx"), F.floor(F.col(y) / radius).alias("__cy"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    copies = lambda df: df.withColumn("__o", around).withColumn("__cx", F.col("__cx") + F.col("__o.i")).withColumn("__cy", F.col("__cy") + F.col("__o.j")).drop("__o")
    left, right = a.select("*", *cells("x", "y")), b.select("*", *cells("px", "py"))
    left, right = (copies(left), right) if copied == "a" else (left, copies(right))
    j = left.join(right, ["frame", "__cx", "__cy"]).drop("__cx", "__cy").withColumn("d", distance())
    return j.where(F.col("d") < radius if strict else F.col("d") <= radius)


def nearest_k(a: DataFrame, b: DataFrame, key: list[str], order: str, k: int, size: float) -> DataFrame:
    """The k nearest rows of b in the frame for each row of a, or all if there are fewer: columns of both, d and rank. Ties go to the least ``order``.

    a: frame, x, y and its key; b: frame, px, py, order. Circles of radius ``size`` first; rows of a with fewer than k rows of
    b inside look again in circles twice as wide, until those hold all of the frame. Rows of a go to the cells of their circle, those of b to
    one cell each. What lies in a circle is counted down to
    k before it is shuffled.
    """
    spans = b.groupBy("frame").agg(F.count("*").alias("__n"), *(f(c).alias(f"__{n}{c}") for c in ("px", "py") for n, f in (("lo", F.min), ("hi", F.max))))
    far = lambda c, p: F.greatest(F.abs(F.col(c) - F.col(f"__lo{p}")), F.abs(F.col(c) - F.col(f"__hi{p}")))
    left = written(a.join(spans, "frame").withColumn("__need", F.least(F.lit(k), F.col("__n"))).withColumn("__far", F.hypot(far("x", "px"), far("y", "py"))).drop(*(c for c in spans.columns if c != "frame")))
    widest = left.agg(F.max("__far")).first()[0]
    out, ranked = None, Window.partitionBy("frame", *key).orderBy("d", order)
    while widest is not None:
        best = written(near(left, b, size, copied="a").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
        full = best.groupBy("frame", *key).agg(F.count("*").alias("__have"), F.first("__need").alias("__want")).where("__have >= __want").select("frame", *key)
        done = best.join(full, ["frame", *key], "left_semi").drop("__need", "__far")
        out = done if out is None else out.unionByName(done)
        if size >= widest:
            break
        left = written(left.join(full, ["frame", *key], "left_anti"))
        widest, size = left.agg(F.max("__far")).first()[0], size * 2
    return out if out is not None else near(left, b, size).withColumn("rank", F.lit(1)).drop("__need", "__far")


def mutual_nearest(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs that are each other's nearest within a radius: frame, a_id, b_id, d. Ties go to the least id."""
    there = nearest_in(a, b, radius, strict=True)
    swap = lambda df, to, x, y: df.select("frame", F.col("a_id" if to == "b_id" else "b_id").alias(to), *(F.col(o).alias(n) for o, n in zip(("px", "py") if to == "a_id" else ("x", "y"), (x, y))))
    back = nearest_in(swap(b, "a_id", "x", "y"), swap(a, "b_id", "px", "py"), radius, strict=True).select("frame", F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return there.join(back, ["frame", "a_id", "b_id"]).select("frame", "a_id", "b_id", "d")


def greedy_match(truth: DataFrame, predicted: DataFrame, radius: float, by: str = "video") -> DataFrame:
    """One-to-one matches in order of truth ids, each taking the nearest free prediction strictly within a radius.

    Order matters, so each video's truths are read in turn; its predictions lie in a tree of boxes, from which those that are taken
    are removed. Points are shuffled, pairs are not.
    """
    videos = truth.select(F.col(by).alias("of"), "frame").distinct()
    kept = lambda df, x, y: df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    free = kept(predicted, "px", "py").select("frame", "b_id", "px", "py").join(videos, "frame")
    rows = kept(truth, "x", "y").select(by, "frame", "a_id", "x", "y")

    def take(t, q):
        import pandas as pd

        # Rows of one id in one frame lie in trees of their own.
        q = q.assign(again=q.groupby(["frame", "b_id"]).cumcount())
        trees: dict = {}
        for (frame, _), g in q.groupby(["frame", "again"]):
            trees.setdefault(frame, []).append(Places(g["px"].to_numpy(), g["py"].to_numpy(), g["b_id"].to_numpy()))
        everywhere = [p for some in trees.values() for p in some]
        t, out, done, best = t.sort_values("a_id", kind="stable"), [], None, None
        for a, frame, x, y in [*zip(t["a_id"].tolist(), t["frame"].tolist(), t["x"].tolist(), t["y"].tolist(), strict=True), (None, None, 0.0, 0.0)]:
            if a != done:
                if best:
                    out.append((done, best[1], best[0]))
                    for p in everywhere:
                        p.take(best[1])
                done, best = a, None
            for p in trees.get(frame, ()):
                found = p.nearest(x, y, radius)
                if found and (best is None or found < best):
                    best = found
        return pd.DataFrame({by: t[by].iloc[0] if len(t) else 0, "a_id": [a for a, _, _ in out], "b_id": [b for _, b, _ in out], "d": [d for _, _, d in out]})

    return rows.groupBy(by).cogroup(free.groupBy("of")).applyInPandas(take, f"{by} long, a_id long, b_id long, d double")


def match_tracks(truth: DataFrame, predicted: DataFrame, radius: float = 20.0, by: str = "video") -> DataFrame:
    """Tracks of a video matched one to one: each truth's first place against the predictions' places in frame 0, in order of truth ids.

    truth and predicted: by (a number), track_id, frame, x, y; rows without a place do not count. Result: by, a_id, b_id, d.
    """
    seen = truth.where("x IS NOT NULL AND y IS NOT NULL")
    first = seen.groupBy(by, F.col("track_id").alias("a_id")).agg(F.min_by(F.struct("x", "y"), "frame").alias("p")).select(by, F.col(by).alias("frame"), "a_id", "p.x", "p.y")
    start = predicted.where("frame = 0 AND x IS NOT NULL AND y IS NOT NULL").select(F.col(by).alias("frame"), F.col("track_id").alias("b_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return greedy_match(first, start, radius, by)


def assign_queries(queries: DataFrame, tracks: DataFrame, reach: float = 2.0) -> DataFrame:
    """For each query (query_id, frame, x, y) the first track within reach in both coordinates."""
    t = tracks.select("frame", F.col("track_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    j = near(queries, t, reach * 1.4142135623730951).where((F.abs(F.col("x") - F.col("px")) < reach) & (F.abs(F.col("y") - F.col("py")) < reach))
    return j.groupBy("query_id").agg(F.min("track_id").alias("track_id"))


def cell_of(x: str | Column, y: str | Column, sx: float, sy: float) -> tuple[Column, Column]:
    return F.rint((F.col(x) if isinstance(x, str) else x) / sx).cast("int").alias("gx"), F.rint((F.col(y) if isinstance(y, str) else y) / sy).cast("int").alias("gy")


def flow_at(points: DataFrame, flow: DataFrame, sx: float, sy: float, cells: tuple[int, int] | None = None) -> DataFrame:
    """Points with the flow of their cell; none is no motion. cells: columns and rows of the grid; points outside then have the flow of its border."""
    p = points.select("*", *cell_of("x", "y", sx, sy))
    if cells:
        p = p.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c))) for c, n in zip(("gx", "gy"), cells, strict=True)})
    j = p.join(flow, ["frame", "gx", "gy"], "left")
    return j.withColumn("dx", F.coalesce("dx", F.lit(0.0))).withColumn("dy", F.coalesce("dy", F.lit(0.0)))


def flow_residuals(vectors: DataFrame, flow: DataFrame, sx: float, sy: float) -> DataFrame:
    """Motion minus flow: track_id, frame, rx, ry."""
    v = vectors.withColumnRenamed("dx", "mx").withColumnRenamed("dy", "my")
    f = flow_at(v, flow, sx, sy)
    return f.select("track_id", "frame", F.round(F.col("mx") - F.col("dx") + 1e-9, 4).alias("rx"), F.round(F.col("my") - F.col("dy") + 1e-9, 4).alias("ry"))


def sample_pixels(points: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The value of the nearest pixel, clamped to the image."""
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(c).cast("int")))
    return points.withColumn("px", clamp(F.col("x"), width)).withColumn("py", clamp(F.col("y"), height)).join(pixels, ["frame", "px", "py"])


def anchor_segments(anchors: DataFrame) -> DataFrame:
    """Adjacent anchors of a track; of anchors on one frame the last by place counts: track_id, t0, x0, y0, t1, x1, y1."""
    one = anchors.groupBy("track_id", "frame").agg(F.max(F.struct("x", "y")).alias("p")).select("track_id", "frame", "p.*")
    w = Window.partitionBy("track_id").orderBy("frame")
    s = one.select("track_id", F.col("frame").alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("frame").over(w).alias("t1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return s.where("t1 is not null")


def fill_between(tracks: DataFrame) -> DataFrame:
    """Points where ``known`` is false from the nearest known ones on both sides by straight lines; ends hold."""
    back = Window.partitionBy("track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("track_id").orderBy("frame").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("known"), F.struct("frame", "x", "y"))
    t = tracks.withColumn("a", F.last(at, ignorenulls=True).over(back)).withColumn("b", F.first(at, ignorenulls=True).over(ahead))

    def value(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        line = a + (b - a) * (F.col("frame") - F.col("a.frame")) / (F.col("b.frame") - F.col("a.frame"))
        return F.when(F.col("known"), F.col(c)).when(F.col("a").isNull(), b).when(F.col("b").isNull(), a).otherwise(line)

    return t.select("track_id", "frame", "known", value("x").alias("x"), value("y").alias("y"))


def worst_anchors(anchors: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per track the anchor farthest from the track; the first of equals."""
    p = tracks.select("track_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"))
    d = anchors.join(p, ["track_id", "frame"]).withColumn("d", distance())
    w = Window.partitionBy("track_id").orderBy(F.col("d").desc(), "frame")
    return d.withColumn("n", F.row_number().over(w)).where("n = 1").select("track_id", F.col("frame").alias("worst_frame"), F.round("d", 4).alias("dist"))


def disagreement(anchors: DataFrame, tracks: DataFrame) -> DataFrame:
    """Quartiles of the distance between anchors and a track's points in the same frame, per track."""
    p = tracks.select("track_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"))
    d = anchors.join(p, ["track_id", "frame"]).withColumn("d", distance())
    return d.groupBy("track_id").agg(F.count("*").alias("n"), *(F.round(F.percentile("d", F.lit(q)), 4).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))


def unfinished(all_units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumable run still has to do."""
    return all_units.join(done, keys, "left_anti")


def merge_corrected(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Corrected tracks in place of the originals."""
    return original.join(corrected.select("track_id").distinct(), "track_id", "left_anti").unionByName(corrected)
