"""Pixels kept in square tiles by frame, so that a patch reads the few tiles it touches.

A tile is a row of at most SIZE * SIZE numbers; no row holds a whole frame, and folders by frame let Spark leave out all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 32
TILE = "frame int, tx int, ty int, data binary"


def tiled(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """frame, tx, ty and data (size * size float32 by rows; pixels that are not there are 0) from frame, px, py, value."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((size, size), dtype="<f4")
        a[g["py"] % size, g["px"] % size] = g["value"]
        return pd.DataFrame({"frame": [g["frame"].iloc[0]], "tx": [g["tx"].iloc[0]], "ty": [g["ty"].iloc[0]], "data": [a.tobytes()]})

    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    p = pixels.select(F.col("frame").cast("int").alias("frame"), F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.col("value").cast("float").alias("value"))
    return p.withColumn("tx", cell("px")).withColumn("ty", cell("py")).groupBy("frame", "tx", "ty").applyInPandas(one, TILE)


def write_tiles(pixels: DataFrame, path: str, size: int = SIZE) -> None:
    """Tiles in a folder per frame."""
    tiled(pixels, size).repartition("frame", F.pmod(F.xxhash64("tx", "ty"), F.lit(8))).write.partitionBy("frame").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILE).parquet(path).select("frame", "tx", "ty", "data")


def patches(wanted: DataFrame, tiles: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """keys, frame, x0, x1, y0, y1 (end exclusive) with parts: the tiles that the patch touches.

    A patch touches at most ((x1 - x0) / size + 2) * ((y1 - y0) / size + 2) tiles; those are what one row holds.
    """
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / size).cast("int"), F.floor((F.col(f"{c}1") - 1) / size).cast("int")))
    need = wanted.where("x1 > x0 AND y1 > y0").withColumn("tx", span("x")).withColumn("ty", span("y"))
    have = need.join(tiles, ["frame", "tx", "ty"], "left")
    return have.groupBy(*keys, "frame", "x0", "x1", "y0", "y1").agg(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("tx", "ty", "data"))).alias("parts"))


def assembled(parts, x0: int, x1: int, y0: int, y1: int, size: int = SIZE) -> np.ndarray:
    """The patch as an array; what no tile has is 0."""
    out = np.zeros((y1 - y0, x1 - x0))
    for part in parts:
        left, top = part["tx"] * size, part["ty"] * size
        a, b, c, d = max(x0, left), min(x1, left + size), max(y0, top), min(y1, top + size)
        tile = np.frombuffer(part["data"], dtype="<f4").reshape(size, size)
        out[c - y0 : d - y0, a - x0 : b - x0] = tile[c - top : d - top, a - left : b - left]
    return out
