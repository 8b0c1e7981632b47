"""Correction of whole sets of tracks, each by the method that its request names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import blend_blobs
from .folds import corridor_paths
from .matching import anchor_segments
from .propagation import beyond_anchors, blend_tracks, there_and_back
from .stepwise import optimise_motion

METHODS = ("full_blend", "corridor_dp", "blob_assisted")
#: Radius within which completed tracks guide open ones when a set of sparse tracks is optimised at once.
SPARSE_RADIUS = 150.0


def optimise_tracks(requests: DataFrame, anchors: DataFrame, flow: DataFrame, sx: float, sy: float, spans: DataFrame, longest: int, linear_below: int = 0, pixels: DataFrame | None = None, size: tuple[int, int] | None = None, last: int | None = None, search: float = 15.0, radius: float = 5.0, corridor: int = 20, least: int = 24) -> DataFrame:
    """Tracks rebuilt from what a user has marked: track_id, frame, x, y.

    requests: track_id, method (of METHODS; null: full_blend) and perhaps a seed (struct frame, x, y). Tracks with anchors
    (track_id, frame, x, y) take the method: a blend of flow from both sides, the cheapest path in a corridor, or flow with
    blob refinement (which needs pixels, the image's width and height, and the last frame). Tracks without
    anchors are carried from their seed to the ends of their span (spans: track_id, lo, hi). Neither anchors nor seed, and
    a method that does not exist, are errors. Each method is one plan over all of its tracks.
    """
    if "seed" not in requests.columns:
        requests = requests.withColumn("seed", F.lit(None).cast("struct<frame:int,x:double,y:double>"))
    known = F.coalesce("method", F.lit(METHODS[0]))
    marked = requests.join(anchors.select("track_id").distinct().withColumn("marked", F.lit(True)), "track_id", "left")
    name = lambda what: F.concat(F.lit(what), F.col("track_id").cast("string"))
    wanted = F.when(~known.isin(*METHODS), F.raise_error(F.concat(F.lit("no method "), known))).when(F.col("marked"), known).when(F.col("seed").isNotNull(), F.lit("seed")).otherwise(F.raise_error(name("neither anchors nor seed for track ")))
    asked = marked.select("track_id", wanted.cast("string").alias("method"), "seed")
    of = lambda m: anchors.join(asked.where(F.col("method") == m), "track_id", "left_semi")
    parts = [blend_tracks(of("full_blend"), flow, sx, sy, spans, longest, linear_below)]
    seeds = asked.where("method = 'seed'").select("track_id", "seed.frame", "seed.x", "seed.y")
    parts.append(there_and_back(seeds, flow, sx, sy, spans, longest))
    narrow = of("corridor_dp")
    paths = corridor_paths(anchor_segments(narrow), flow.select("frame", (F.col("gx") * sx).alias("x"), (F.col("gy") * sy).alias("y"), "dx", "dy"), corridor, least=least)
    beyond = beyond_anchors(narrow, flow, sx, sy, spans, longest)
    # Paths share their ends.
    parts += [paths.groupBy("track_id", "frame").agg(F.min(F.struct("x", "y")).alias("p")).select("track_id", "frame", "p.x", "p.y"), beyond]
    if pixels is not None:
        parts.append(blend_blobs(of("blob_assisted"), flow, pixels, sx, sy, *size, last, search, radius))
    else:
        parts.append(of("blob_assisted").select("track_id", "frame", F.raise_error(F.lit("blob_assisted needs pixels")).cast("double").alias("x"), "y"))
    out = parts[0].select("track_id", "frame", "x", "y")
    for p in parts[1:]:
        out = out.unionByName(p.select("track_id", "frame", "x", "y"))
    return out


def optimise_set(tracks: DataFrame, completed: DataFrame, flow: DataFrame, sx: float, sy: float, radius: float = SPARSE_RADIUS, **more) -> DataFrame:
    """All tracks: completed ones (track_id) as they are, the others rebuilt by the motion around them."""
    done = tracks.join(completed.select("track_id").distinct(), "track_id", "left_semi").select("track_id", "frame", "x", "y")
    rest = tracks.join(completed.select("track_id").distinct(), "track_id", "left_anti").select("track_id", "frame", "x", "y")
    return done.unionByName(optimise_motion(rest, done, flow, sx, sy, radius, **more).select("track_id", "frame", "x", "y"))
