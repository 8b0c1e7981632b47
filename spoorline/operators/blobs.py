"""The blob nearest to a predicted place, and propagation that goes on from it."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import by_frame, new_folder, written
from ..sources.tiles import assembled, patches, tiled
from .matching import anchor_segments
from .stepwise import STATE, waves

#: Scales between 0.7 and 1.3 of the radius's own, the least response, and how much of the smaller disc two blobs may share.
SCALES, LEAST, OVERLAP = 5, 0.02, 0.5
#: Of a patch, the share of pixels that are background, and how far a region's radius may be off.
BACKGROUND, RADIUS_OFF = 70, 0.5
BACK_ROUNDS = 3


@lru_cache(maxsize=256)
def _smoothing(n: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that apply a Gaussian, and its second derivative, to n values mirrored at both ends."""
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    source = np.pad(np.arange(n), r, mode="symmetric")
    out = []
    for k in (g, (x * x / sigma**4 - 1 / sigma**2) * g):
        m = np.zeros((n, n))
        for i in range(n):
            np.add.at(m[i], source[i : i + 2 * r + 1], k)
        out.append(m)
    return out[0], out[1]


def _shared(d: float, r1: float, r2: float) -> float:
    """The part of the smaller of two discs that lies in the other."""
    small, large = min(r1, r2), max(r1, r2)
    if d >= small + large:
        return 0.0
    if d <= large - small or small == 0:
        return 1.0
    a = math.acos((d * d + small * small - large * large) / (2 * d * small))
    b = math.acos((d * d + large * large - small * small) / (2 * d * large))
    lens = small * small * (a - math.sin(2 * a) / 2) + large * large * (b - math.sin(2 * b) / 2)
    return lens / (math.pi * small * small)


def bright_blobs(patch: np.ndarray, radius: float) -> list[tuple[int, int, float]]:
    """Row, column and scale of the maxima, in place and scale, of the scaled Laplacian; of two that overlap too much the smaller goes."""
    middle = radius / math.sqrt(2)
    sigmas = np.linspace(max(0.5, middle * 0.7), middle * 1.3, SCALES)
    cube = []
    for s in sigmas.tolist():
        (gy, hy), (gx, hx) = _smoothing(patch.shape[0], s), _smoothing(patch.shape[1], s)
        cube.append(-(hy @ patch @ gx.T + gy @ patch @ hx.T) * s * s)
    cube = np.stack(cube)
    wide = np.pad(cube, 1, mode="edge")
    top = np.max([wide[k : k + cube.shape[0], i : i + cube.shape[1], j : j + cube.shape[2]] for k in range(3) for i in range(3) for j in range(3)], axis=0)
    peak = cube >= top
    at = np.argwhere(peak & (cube > LEAST)) if not peak.all() else np.zeros((0, 3), int)
    found = [(int(i), int(j), float(sigmas[k])) for k, i, j in sorted(at.tolist(), key=lambda p: (-cube[tuple(p)], p))]
    gone: set[int] = set()
    for a in range(len(found)):
        for b in range(a + 1, len(found)):
            if a not in gone and b not in gone:
                (i, j, s), (p, q, t) = found[a], found[b]
                if _shared(math.hypot(i - p, j - q), s * math.sqrt(2), t * math.sqrt(2)) > OVERLAP:
                    gone.add(b if s > t else a)
    return [f for n, f in enumerate(found) if n not in gone]


def regions(mask: np.ndarray) -> list[tuple[float, float, int]]:
    """Centre row, centre column and size of each patch of set pixels that touch at sides or corners."""
    left = {tuple(p) for p in np.argwhere(mask).tolist()}
    out = []
    while left:
        stack, own = [left.pop()], []
        while stack:
            i, j = stack.pop()
            own.append((i, j))
            for q in [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    stack.append(q)
        out.append((sum(i for i, _ in own) / len(own), sum(j for _, j in own) / len(own), len(own)))
    return out


def nearest_blob(patch: np.ndarray, row: float, column: float, radius: float) -> tuple[float, float] | None:
    """Row and column of the nearest bright blob, else of the nearest bright region of about the radius, else nothing."""
    if not patch.size:
        return None
    low, high = patch.min(), patch.max()
    patch = (patch - low) / (high - low) if high > low else patch * 0.0
    away = lambda i, j: math.hypot(i - row, j - column)
    if found := bright_blobs(patch, radius):
        return min(((float(i), float(j)) for i, j, _ in found), key=lambda p: (away(*p), p))
    fitting = [(away(i, j), i, j) for i, j, n in regions(patch > np.percentile(patch, BACKGROUND)) if abs(math.sqrt(n / math.pi) - radius) <= RADIUS_OFF * radius]
    return min(fitting)[1:] if fitting else None


def refined(points: DataFrame, tiles: DataFrame, width: int, height: int, search: float, radius: float) -> DataFrame:
    """Points (STATE) moved to the nearest blob of their frame within a square around them; without one they stay."""
    r = int(search)
    box = points.withColumns({
        "x0": F.greatest(F.lit(0), F.col("x").cast("int") - r), "x1": F.least(F.lit(width), F.col("x").cast("int") + r + 1),
        "y0": F.greatest(F.lit(0), F.col("y").cast("int") - r), "y1": F.least(F.lit(height), F.col("y").cast("int") + r + 1),
    })

    def look(batches):
        for batch in batches:
            rows = batch.select(["x", "y", "x0", "x1", "y0", "y1", "parts"]).to_pylist()
            xs, ys = [], []
            for p in rows:
                patch = assembled(p["parts"], p["x0"], p["x1"], p["y0"], p["y1"])
                at = nearest_blob(patch, p["y"] - p["y0"], p["x"] - p["x0"], radius)
                xs.append(p["x0"] + at[1] if at else p["x"])
                ys.append(p["y0"] + at[0] if at else p["y"])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["ahead"], batch["frame"], pa.array(xs, pa.float64()), pa.array(ys, pa.float64()), batch["until"]], names=list(STATE))

    kinds = dict(points.dtypes)
    return patches(box, tiles, [c for c in STATE if c != "frame"]).mapInArrow(look, ", ".join(f"{c} {kinds[c]}" for c in STATE))


def blob_waves(seeds: DataFrame, flow: DataFrame, pixels: DataFrame, sx: float, sy: float, width: int, height: int, search: float = 15.0, radius: float = 5.0) -> DataFrame:
    """Seeds (STATE) carried by the flow at their place, kept in the image, and moved to the nearest blob, at every step.

    Seeds of one place, frame and way are one, which is carried once. Forward, the flow of the cell a point is in; back, the place whose flow leads here, by BACK_ROUNDS rounds from here.
    """
    folder = new_folder(seeds.sparkSession)
    members = written(seeds.select("id", F.struct(*STATE[1:]).alias("way")))
    ways = members.select("way").distinct().select(F.col("way").alias("id"), "way.*")
    tiles = by_frame(tiled(pixels), f"{folder}/tiles")
    field = by_frame(flow.select("frame", "gx", "gy", "dx", "dy"), f"{folder}/flow")

    def moved(c: str, size: int, n: int) -> str:
        """A place moved by the flow just looked up, kept in the image. Points that go forward are done after the first round."""
        to = f"greatest(0D, least({size - 1}D, {c} + IF(ahead, 1, -1) * coalesce(d{c}, 0D)))"
        return f"{to} AS q{c}" if n == 0 else f"IF(ahead, q{c}, {to}) AS q{c}"

    rounds = "(SELECT id, ahead, IF(ahead, frame, frame - 1) AS at, IF(ahead, frame + 1, frame - 1) AS frame, x, y, until, x AS qx, y AS qy FROM {points})"
    here = f"f.frame = p.at AND f.gx = CAST(rint(qx / {sx}D) AS INT) AND f.gy = CAST(rint(qy / {sy}D) AS INT)"
    for n in range(BACK_ROUNDS):
        rounds = f"(SELECT id, ahead, at, p.frame, x, y, until, {moved('x', width, n)}, {moved('y', height, n)} FROM {rounds} p LEFT JOIN {{field}} f ON {here})"
    step = f"SELECT id, ahead, frame, qx AS x, qy AS y, until FROM {rounds}"

    def advance(points: DataFrame, there: Column) -> DataFrame:
        predicted = points.sparkSession.sql(step, points=points, field=field.where(there))
        return refined(predicted, tiles.where(there), width, height, search, radius)

    moved = waves(ways, advance, folder).withColumnRenamed("id", "of")
    return members.join(moved, F.col("way").eqNullSafe(F.col("of"))).select(*STATE)


def propagate_blobs(seeds: DataFrame, flow: DataFrame, pixels: DataFrame, sx: float, sy: float, width: int, height: int, last: int, search: float = 15.0, radius: float = 5.0) -> DataFrame:
    """Seeds (track_id, frame, x, y) carried to frame ``last`` and back to 0, refined by blobs: whole pixels within the image."""
    s = lambda ahead, until: seeds.select(F.col("track_id").alias("id"), F.lit(ahead).alias("ahead"), "frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(until).alias("until"))
    moved = blob_waves(s(True, last).unionByName(s(False, 0)), flow, pixels, sx, sy, width, height, search, radius)
    whole = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(c).cast("int"))).alias(c)
    every = seeds.select(F.col("track_id").alias("id"), "frame", "x", "y").unionByName(moved.select("id", "frame", "x", "y"))
    return every.select(F.col("id").alias("track_id"), "frame", whole("x", width), whole("y", height))


def blend_blobs(anchors: DataFrame, flow: DataFrame, pixels: DataFrame, sx: float, sy: float, width: int, height: int, last: int, search: float = 15.0, radius: float = 5.0) -> DataFrame:
    """Whole tracks from anchors: of each gap the first half forward from the left, the second half back from the right; flow and blobs beyond both ends."""
    one = anchors.groupBy("track_id", "frame").agg(F.max(F.struct("x", "y")).alias("p")).select("track_id", "frame", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    s = anchor_segments(one)
    middle = F.floor((F.col("t0") + F.col("t1")) / 2)
    part = lambda df, ahead, frame, x, y, until: df.select(F.struct("track_id", F.lit(frame).alias("side"), F.col(frame).cast("int").alias("of")).alias("id"), F.lit(ahead).alias("ahead"), F.col(frame).cast("int").alias("frame"), F.col(x).alias("x"), F.col(y).alias("y"), until.cast("int").alias("until"))
    ends = one.groupBy("track_id").agg(F.min(F.struct("frame", "x", "y")).alias("a"), F.max(F.struct("frame", "x", "y")).alias("b")).select("track_id", F.col("a.frame").alias("ta"), F.col("a.x").alias("xa"), F.col("a.y").alias("ya"), F.col("b.frame").alias("tb"), F.col("b.x").alias("xb"), F.col("b.y").alias("yb"))
    seeds = part(s, True, "t0", "x0", "y0", middle).unionByName(part(s, False, "t1", "x1", "y1", middle + 1)).unionByName(part(ends, False, "ta", "xa", "ya", F.lit(0))).unionByName(part(ends, True, "tb", "xb", "yb", F.lit(last)))
    moved = blob_waves(seeds, flow, pixels, sx, sy, width, height, search, radius)
    return one.unionByName(moved.select("id.track_id", "frame", "x", "y"))
