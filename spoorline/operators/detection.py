"""Detection in images kept as pixels (frame, px, py, value). A frame's image is the unit of the numeric filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "frame int, x double, y double, quality double"


def local_maxima(pixels: DataFrame, threshold: float) -> DataFrame:
    """Pixels at or above a threshold and all their neighbours (plateaus stay); border pixels are left out.

    Every pixel is sent to its eight neighbours and the greatest arrival is compared: one shuffle, no self-join.
    """
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sent = pixels.select("frame", "px", "py", "value", around.alias("o")).select("frame", (F.col("px") + F.col("o.i")).alias("px"), (F.col("py") + F.col("o.j")).alias("py"), F.when((F.col("o.i") == 0) & (F.col("o.j") == 0), F.col("value")).alias("own"), "value")
    size = pixels.groupBy("frame").agg(F.max("px").alias("wx"), F.max("py").alias("wy"))
    top = sent.groupBy("frame", "px", "py").agg(F.max("own").alias("value"), F.max("value").alias("top")).where("value >= top").where(F.col("value") >= threshold)
    return top.join(size, "frame").where((F.col("px") >= 1) & (F.col("py") >= 1) & (F.col("px") < F.col("wx")) & (F.col("py") < F.col("wy"))).select("frame", "px", "py", "value")


def subpixel(maxima: DataFrame, pixels: DataFrame, as_coded: bool = True) -> DataFrame:
    """Shift maxima by a parabola through their neighbours on each axis, at most half a pixel.

    as_coded: the reference's sign, (a-c)/(2(2b-a-c)); otherwise the parabola's vertex.
    """
    p = lambda name, i, j: pixels.select("frame", (F.col("px") - i).alias("px"), (F.col("py") - j).alias("py"), F.col("value").alias(name))
    m = maxima
    for name, i, j in (("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("d", 0, 1)):
        m = m.join(p(name, i, j), ["frame", "px", "py"], "left")

    def shift(a: str, c: str):
        den = 2 * (2 * F.col("value") - F.col(a) - F.col(c))
        v = F.when(F.abs(den) > 1e-10, (F.col(a) - F.col(c)) / den).otherwise(0.0) * (1 if as_coded else -1)
        return F.coalesce(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), v)), F.lit(0.0))

    return m.select("frame", F.round(F.col("px") + shift("l", "r"), 5).alias("x"), F.round(F.col("py") + shift("u", "d"), 5).alias("y"), F.col("value").alias("quality"))


def image(p: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(p["py"].max()) + 1, int(p["px"].max()) + 1))
    out[p["py"], p["px"]] = p["value"]
    return out


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, mirrored at the border."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(a, pad, mode="symmetric")
        a = sum(w * np.take(wide, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    return a


def difference_of_gaussians(a: np.ndarray, radius: float) -> np.ndarray:
    """Response at sigmas of radius/sqrt(2) times 0.9 and 1.1, less the blur a pixel has already."""
    one, two = (np.sqrt(max((radius / np.sqrt(2) * f) ** 2 - 0.25, 0.01)) for f in (0.9, 1.1))
    return blur(a, one) - blur(a, two)


def peaks(r: np.ndarray, threshold: float, border: int = 1) -> np.ndarray:
    """Rows and columns of local maxima of a response."""
    wide = np.pad(r, 1, mode="reflect") if min(r.shape) > 1 else np.pad(r, 1, mode="edge")
    top = np.max([wide[i : i + r.shape[0], j : j + r.shape[1]] for i in range(3) for j in range(3)], axis=0)
    at = np.argwhere((r >= threshold) & (r >= top))
    return at[(at >= border).all(1) & (at < np.array(r.shape) - border).all(1)]


def suppress(at: np.ndarray, quality: np.ndarray, distance: float, most: int | None = None) -> list[int]:
    """Greedy: the best first, none within a distance of one kept."""
    keep: list[int] = []
    for i in np.lexsort((at[:, 1], at[:, 0], -quality)) if len(at) else []:
        if all(((at[i] - at[k]) ** 2).sum() > distance * distance for k in keep):
            keep.append(int(i))
            if most and len(keep) == most:
                break
    return keep


def detect(pixels: DataFrame, radius: float, threshold: float, distance: float = 0.0, most: int | None = None, scales: tuple[float, ...] = (1.0,), invert: bool = False, median: bool = False, subpixel: bool = False, border: int = 1) -> DataFrame:
    """Blobs of every frame: frame, x, y, quality. With several scales, the best response over them counts.

    subpixel: places are moved by a parabola on each axis, at most half a pixel. border: pixels at the edge that are left out.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        a = image(p)
        span = a.max() - a.min()
        a = (a - a.min()) / span if span else a * 0
        if invert:
            a = 1 - a
        if median:
            w = np.pad(a, 1)
            a = np.median([w[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)
        r = np.max([difference_of_gaussians(a, radius * s) for s in scales], axis=0)
        at = peaks(r, threshold, border)
        q = r[at[:, 0], at[:, 1]] if len(at) else np.zeros(0)
        k = suppress(at, q, distance, most)
        place = vertex(r, at[k], 0.5) if subpixel and k else at[k].astype(float)
        return pd.DataFrame({"frame": p["frame"].iloc[0], "x": place[:, 1], "y": place[:, 0], "quality": q[k]}) if k else pd.DataFrame(columns=["frame", "x", "y", "quality"])

    return pixels.groupBy("frame").applyInPandas(one, FOUND)


def vertex(r: np.ndarray, at: np.ndarray, most: float | None = None) -> np.ndarray:
    """Rows and columns of peaks moved by (a - c) / (2(2b - a - c)) on each axis, at most ``most``; peaks at the edge stay."""
    out = at.astype(float)
    inner = ((at >= 1) & (at < np.array(r.shape) - 1)).all(1)
    i, j = at[inner].T
    for axis, (di, dj) in enumerate(((1, 0), (0, 1))):
        a, b, c = r[i - di, j - dj], r[i, j], r[i + di, j + dj]
        bend = 2.0 * b - a - c
        shift = np.where(np.abs(bend) > 1e-10, (a - c) / np.where(np.abs(bend) > 1e-10, 2.0 * bend, 1.0), 0.0)
        out[inner, axis] += shift if most is None else np.clip(shift, -most, most)
    return out


#: Blur that an image has already, least scale in pixels as a multiple of it, and what thresholds above 0 are lowered by.
IMAGE_SIGMA, LEAST_FACTOR, THRESHOLD_CORRECTION = 0.5, 2.0, 0.00012


def half_kernel(sigma: float) -> np.ndarray:
    """A Gaussian from its middle outwards, of max(2, int(3 sigma + 0.5) + 1) values, that meets zero in a parabola; the whole kernel sums to 1."""
    size = max(2, int(3 * sigma + 0.5) + 1)
    x = np.arange(size)
    k = np.exp(-(x * x) / (2.0 * sigma * sigma))
    if size > 2:
        # The parabola slope * (size - x)**2 touches the kernel where its slope stops falling on the way in; not beyond the middle.
        slope = (k / (size - x) ** 2)[size // 2 :][::-1]
        falls = slope[1:] < slope[:-1]
        run = len(falls) if falls.all() else int(np.argmin(falls))
        touch = size - 1 - run
        k[touch + 1 :] = slope[run] * (size - x[touch + 1 :]) ** 2
    return k / (2.0 * (0.5 * k[0] + k[1:].sum()))


def _convolved(a: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Both axes by a symmetric kernel, mirrored at the border pixels' middles."""
    n = len(half) - 1
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (n, n)
        wide = np.pad(a, pad, mode="reflect" if a.shape[axis] > 1 else "edge")
        a = sum(half[abs(i)] * np.take(wide, range(n + i, n + i + a.shape[axis]), axis=axis) for i in range(-n, n + 1))
    return a


def exact_response(a: np.ndarray, radius: float, pixel_size: float) -> np.ndarray:
    """Difference of Gaussians at radius / sqrt(2) times 0.9 and 1.1 in units of the pixel size, no scale below a pixel."""
    least = LEAST_FACTOR * IMAGE_SIGMA
    one = max(least, radius / np.sqrt(2) * 0.9 / pixel_size)
    return np.subtract(*(_convolved(a, half_kernel(np.sqrt(s * s - IMAGE_SIGMA**2))) for s in (one, one * 1.1 / 0.9)))


def detect_exact(pixels: DataFrame, radius: float, threshold: float = 0.0, pixel_size: tuple[float, float] = (1.0, 1.0), median: bool = False, subpixel: bool = True) -> DataFrame:
    """Spots of every frame as a preview detector finds them: frame, x, y (in units of pixel_size: height, width), x_pixel, y_pixel, quality.

    Raw values; radius in the same units as pixel_size, whose height sets the scale of both axes; no pixel is left out at the border; refined
    places may leave their pixel, and quality is read at the pixel they come to lie in.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        a = image(p)
        if median:
            w = np.pad(a, 1)
            a = np.median([w[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)
        r = exact_response(a, radius, pixel_size[0])
        at = peaks(r, threshold - THRESHOLD_CORRECTION if threshold > 0 else threshold, 0)
        place = vertex(r, at) if subpixel else at.astype(float)
        in_pixel = np.clip(np.rint(place).astype(int), 0, np.array(r.shape) - 1)
        return pd.DataFrame({"frame": np.full(len(at), p["frame"].iloc[0]), "x": place[:, 1] * pixel_size[1], "y": place[:, 0] * pixel_size[0], "x_pixel": place[:, 1], "y_pixel": place[:, 0], "quality": r[in_pixel[:, 0], in_pixel[:, 1]]})

    return pixels.groupBy("frame").applyInPandas(one, "frame int, x double, y double, x_pixel double, y_pixel double, quality double")


def top_by_quality(found: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("frame").orderBy(F.col("quality").desc(), "y", "x")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def stretch(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values between two percentiles of their frame, scaled to 0..1."""
    q = pixels.groupBy("frame").agg(F.percentile("value", F.lit(low)).alias("lo"), F.percentile("value", F.lit(high)).alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return pixels.join(q, "frame").select("frame", "px", "py", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 5).alias("value"))


def motion(pixels: DataFrame) -> DataFrame:
    """Mean absolute difference to the frame before; 0 for the first."""
    before = pixels.select((F.col("frame") + 1).alias("frame"), "px", "py", F.col("value").alias("was"))
    return pixels.join(before, ["frame", "px", "py"], "left").groupBy("frame").agg(F.coalesce(F.avg(F.abs(F.col("value") - F.col("was"))), F.lit(0.0)).alias("motion"))


def _steps(pixels: DataFrame) -> DataFrame:
    """Pixels with the differences to the next pixel to the right (gx) and below (gy); null at the border."""
    wx, wy = (Window.partitionBy("frame", a).orderBy(b) for a, b in (("py", "px"), ("px", "py")))
    ahead = lambda w, c: F.when(F.lead(c).over(w) == F.col(c) + 1, F.lead("value").over(w) - F.col("value"))
    return pixels.withColumn("gx", ahead(wx, "px")).withColumn("gy", ahead(wy, "py"))


def _cells(pixels: DataFrame, grid: int) -> DataFrame:
    """Pixels in a grid of equal cells: a and b (column and row). Images smaller than the grid have a cell a pixel; what is left over at the far border is dropped."""
    size = pixels.groupBy("frame").agg((F.max("px") + 1).alias("w"), (F.max("py") + 1).alias("h"))
    p = pixels.join(size, "frame")
    across, down = F.least(F.lit(grid), F.col("w")), F.least(F.lit(grid), F.col("h"))
    p = p.withColumn("a", F.floor(F.col("px") / F.floor(F.col("w") / across))).withColumn("b", F.floor(F.col("py") / F.floor(F.col("h") / down)))
    return p.where((F.col("a") < across) & (F.col("b") < down))


def complexity(pixels: DataFrame, grid: int = 8) -> DataFrame:
    """Mean length of forward differences, where there are both, plus the mean deviation of the cells of a grid."""
    g = _steps(pixels).groupBy("frame").agg(F.coalesce(F.avg(F.hypot("gx", "gy")), F.lit(0.0)).alias("g"))
    c = _cells(pixels, grid).groupBy("frame", "a", "b").agg(F.stddev_pop("value").alias("s")).groupBy("frame").agg(F.avg("s").alias("s"))
    return g.join(c, "frame").select("frame", F.round(F.col("g") + F.col("s") + 1e-9, 4).alias("complexity"))


def features(pixels: DataFrame, bins: int = 32, grid: int = 4) -> DataFrame:
    """Per frame, as rows frame, feature, value: histogram densities (h0..), means and deviations of a grid of cells (m and s by row and column), and mean steps (gx, gy, g). Bins without pixels are left out."""
    span = pixels.groupBy("frame").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    b = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width)).cast("int")
    hist = pixels.join(span, "frame").groupBy("frame", b.alias("b")).agg(F.round(F.count("*") / F.first("n") / F.first(width) * 1e6 + 1e-9, 4).alias("value")).select("frame", F.concat(F.lit("h"), "b").alias("feature"), "value")
    cells = _cells(pixels, grid).groupBy("frame", "a", "b").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    name = lambda k: F.concat(F.lit(k), F.col("b").cast("int"), F.lit("_"), F.col("a").cast("int"))
    edge = _steps(pixels).groupBy("frame").agg(F.coalesce(F.avg(F.abs("gx")), F.lit(0.0)).alias("gx"), F.coalesce(F.avg(F.abs("gy")), F.lit(0.0)).alias("gy"))
    pick = lambda df, *of: df.select("frame", F.explode(F.array(*(F.struct(n.alias("feature"), F.round(c + 1e-9, 2).alias("value")) for n, c in of))).alias("x")).select("frame", "x.*")
    return hist.unionByName(pick(cells, (name("m"), F.col("m")), (name("s"), F.col("s")))).unionByName(pick(edge, *((F.lit(n), c) for n, c in (("gx", F.col("gx")), ("gy", F.col("gy")), ("g", F.hypot("gx", "gy"))))))


def advice(pixels: DataFrame, target: float = 0.95) -> DataFrame:
    """How much of each video to annotate. pixels: video, frame, px, py, value (0..255); frames are distinct across videos.

    Overall complexity is the mean of mean motion / 50 and mean complexity / 100, at most 1 each; it decides frames, points a
    frame and the category. A target above 0.98 asks for more; at most a fifth of the frames, at least three.
    """
    before = pixels.select("video", (F.col("frame") + 1).alias("frame"), "px", "py", F.col("value").alias("was"))
    m = pixels.join(before, ["video", "frame", "px", "py"], "left").groupBy("video", "frame").agg(F.coalesce(F.avg(F.abs(F.col("value") - F.col("was"))), F.lit(0.0)).alias("motion"))
    v = m.join(complexity(pixels.select("frame", "px", "py", "value")), "frame").groupBy("video").agg(F.count("*").alias("total"), F.avg("motion").alias("motion"), F.max("motion").alias("most_motion"), F.avg("complexity").alias("complexity"))
    v = v.withColumn("overall", (F.least(F.lit(1.0), F.col("motion") / 50) + F.least(F.lit(1.0), F.col("complexity") / 100)) / 2)
    step = lambda *of: F.when(F.col("overall") < 0.2, of[0]).when(F.col("overall") < 0.4, of[1]).when(F.col("overall") < 0.6, of[2]).otherwise(of[3])
    more = (1.5, 1.2) if target > 0.98 else (1.0, 1.0)
    frames = F.greatest(F.lit(3), F.least(F.floor(step(5, 8, 12, 20) * more[0]), F.floor(F.col("total") / 5))).cast("long")
    points = F.floor(step(5, 8, 10, 15) * more[1]).cast("long")
    v = v.withColumn("frames", frames).withColumn("points", points).withColumn("category", step("simple", "moderate", "complex", "challenging"))
    return v.select("video", "frames", "points", (F.col("frames") * F.col("points")).alias("annotations"), F.round(F.col("frames") * F.col("points") / 120 + 1e-9, 1).alias("minutes"), F.round(F.col("overall") + 1e-9, 3).alias("overall"), "category", F.round(F.col("motion") + 1e-9, 2).alias("motion"), F.round(F.col("most_motion") + 1e-9, 2).alias("most_motion"))
