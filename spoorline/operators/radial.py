"""Fields from scattered motion by solving for radial basis functions, and smoothing of fields."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from .matching import nearest_k

#: Sources of a frame up to which all of them make one system, and the neighbours of a system beyond.
WHOLE, NEIGHBOURS = 100, 32
#: Grid columns and rows that are evaluated together.
BLOCK = 64
#: Kernel: its value at scaled distances, whether distances are scaled by epsilon, and the degree of the polynomial beside it.
KERNELS = {
    "thin_plate_spline": (lambda r: np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1)), 0.0), False, 1),
    "linear": (lambda r: -r, False, 0),
    "cubic": (lambda r: r**3, False, 1),
    "quintic": (lambda r: -(r**5), False, 2),
    "multiquadric": (lambda r: -np.sqrt(1 + r * r), True, 0),
    "inverse_multiquadric": (lambda r: 1 / np.sqrt(1 + r * r), True, 0),
    "inverse_quadratic": (lambda r: 1 / (1 + r * r), True, 0),
    "gaussian": (lambda r: np.exp(-r * r), True, 0),
}


def _monomials(p: np.ndarray, degree: int) -> np.ndarray:
    return np.stack([p[:, 0] ** (d - j) * p[:, 1] ** j for d in range(degree + 1) for j in range(d + 1)], axis=1)


def solve(sources: np.ndarray, values: np.ndarray, queries: np.ndarray, kernel: str = "thin_plate_spline", smoothing: float = 10.0, epsilon: float | None = None) -> np.ndarray:
    """Values at queries of the smoothed interpolant through values at sources; inverse squared distances where the system has no solution."""
    phi, scaled, degree = KERNELS[kernel]
    e = (max(smoothing, 1e-6) if epsilon is None else epsilon) if scaled else 1.0
    apart = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    middle, half = (sources.max(0) + sources.min(0)) / 2, (sources.max(0) - sources.min(0)) / 2
    half[half == 0] = 1.0
    poly = lambda p: _monomials((p - middle) / half, degree)
    n, beside = len(sources), poly(sources)
    m = beside.shape[1]
    system = np.zeros((n + m, n + m))
    system[:n, :n] = phi(e * apart(sources, sources)) + smoothing * np.eye(n)
    system[:n, n:], system[n:, :n] = beside, beside.T
    right = np.vstack([values, np.zeros((m, values.shape[1]))])
    d = apart(queries, sources)
    if n >= m and np.linalg.matrix_rank(beside) == m:
        try:
            c = np.linalg.solve(system, right)
            return phi(e * d) @ c[:n] + poly(queries) @ c[n:]
        except np.linalg.LinAlgError:
            pass
    w = (d + 1e-6) ** -2.0
    return w @ values / w.sum(1, keepdims=True)


def radial_field(sources: DataFrame, grid: DataFrame, size: float, kernel: str = "thin_plate_spline", smoothing: float = 10.0, epsilon: float | None = None) -> DataFrame:
    """frame, gx, gy, vx, vy: the interpolant at every grid point (frame, gx, gy, x, y).

    sources: s_id, frame, px, py, dx, dy; null motion is left out. Frames with more than WHOLE sources solve a system of the
    NEIGHBOURS nearest ones for each set of neighbours that grid points have; others solve one of all. Fewer than three
    sources give no motion. size: radius in which neighbours are first looked for. A task holds one system and at most
    BLOCK * BLOCK grid points of it at a time.
    """
    sources = written(sources)  # read by every round of neighbours
    known = sources.where("dx IS NOT NULL AND dy IS NOT NULL AND px IS NOT NULL AND py IS NOT NULL")
    counts = sources.groupBy("frame").agg(F.count("*").alias("n")).join(known.groupBy("frame").agg(F.count("*").alias("valid")), "frame")
    many = counts.where((F.col("n") > WHOLE) & (F.col("valid") >= 3)).select("frame")
    few = counts.where((F.col("n") <= WHOLE) & (F.col("valid") >= 3)).select("frame")
    cells = grid.select("frame", "gx", "gy", "x", "y")
    member = F.struct("s_id", "px", "py", "dx", "dy").alias("member")
    near = nearest_k(cells.join(many, "frame", "left_semi"), known.join(many, "frame", "left_semi"), ["gx", "gy"], "s_id", NEIGHBOURS, size)
    # At most NEIGHBOURS, or WHOLE, members a row.
    own = near.select("frame", "gx", "gy", "x", "y", member).groupBy("frame", "gx", "gy", "x", "y").agg(F.array_sort(F.collect_list("member")).alias("members"))
    every = known.join(few, "frame", "left_semi").select("frame", member).groupBy("frame").agg(F.array_sort(F.collect_list("member")).alias("members"))
    both = own.unionByName(cells.join(every, "frame"))
    block = lambda c: F.floor(F.col(c) / BLOCK).alias(f"b{c}")
    systems = both.groupBy("frame", F.xxhash64("members").alias("key"), block("gx"), block("gy"), "members").agg(F.collect_list(F.struct("gx", "gy", "x", "y")).alias("at"))

    def rows(batches):
        for batch in batches:
            out = []
            for frame, members, at in zip(batch["frame"].to_pylist(), batch["members"].to_pylist(), batch["at"].to_pylist(), strict=True):
                s = np.array([(m["px"], m["py"], m["dx"], m["dy"]) for m in members])
                found = solve(s[:, :2], s[:, 2:], np.array([(q["x"], q["y"]) for q in at]), kernel, smoothing, epsilon)
                out += [(frame, q["gx"], q["gy"], *v) for q, v in zip(at, found.tolist(), strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["frame", "gx", "gy", "vx", "vy"])

    found = systems.select(F.col("frame").cast("int").alias("frame"), "members", "at").mapInArrow(rows, "frame int, gx int, gy int, vx double, vy double")
    return cells.select("frame", "gx", "gy").join(found, ["frame", "gx", "gy"], "left").select("frame", "gx", "gy", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vx", "vy")))


def blurred(field: DataFrame, sigma: float, columns: int, rows: int) -> DataFrame:
    """A field (frame, gx, gy, vx, vy) of a whole grid smoothed by a Gaussian to four deviations, mirrored at the border: one axis after the other."""
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    taps = F.explode(F.array(*(F.struct(F.lit(int(o)).alias("o"), F.lit(float(w)).alias("w")) for o, w in zip(x, g / g.sum(), strict=True)))).alias("tap")
    for axis, other, n in (("gx", "gy", columns), ("gy", "gx", rows)):
        # Folded into 0..2n-1, the second half runs backwards.
        at = F.pmod(F.col("to") + F.col("tap.o"), F.lit(2 * n))
        wanted = field.select("frame", F.col(axis).alias("to"), other, taps).select("frame", "to", other, F.least(at, 2 * n - 1 - at).alias(axis), F.col("tap.w").alias("w"))
        sums = wanted.join(field, ["frame", axis, other]).groupBy("frame", "to", other).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("vx", "vy")))
        field = sums.withColumnRenamed("to", axis)
    return field.select("frame", "gx", "gy", "vx", "vy")
