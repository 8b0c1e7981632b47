"""Readers of other tools' logs and exports, and matching of their tracks to given points."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tracks as io


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """file, key and value of the lines ``# key: value`` of text files."""
    form = r"^#\s*([^:]+?)\s*:\s*(.*?)\s*$"
    part = lambda n: F.regexp_extract("value", form, n)
    return spark.read.text(path).where(F.col("value").rlike(form)).select(F.input_file_name().alias("file"), part(1).alias("key"), part(2).alias("value"))


def inference_seconds(spark: SparkSession, path: str) -> DataFrame:
    """file and the total_inference_time_s that its comments give."""
    return read_comments(spark, path).where("key = 'total_inference_time_s'").select("file", F.col("value").cast("double").alias("seconds"))


def read_wide_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Long rows (track_id, frame, x, y, score) of a pose export: frame_idx and, for each track, columns ``name.x``, ``name.y`` and perhaps ``name.score``. Blank places are missing."""
    d = spark.read.option("header", True).csv(path)
    has = set(d.columns)
    names = [c[:-2] for c in d.columns if c.endswith(".x") and f"{c[:-2]}.y" in has]
    number = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).cast("double") if c in has else F.lit(None).cast("double")
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("track_id"), number(f"{n}.x").alias("x"), number(f"{n}.y").alias("y"), number(f"{n}.score").alias("score")) for n in names)))
    if not names:
        raise ValueError("no columns named like track.x and track.y")
    return d.select(F.trim("frame_idx").cast("int").alias("frame"), places.alias("p")).where("p.x IS NOT NULL AND p.y IS NOT NULL").select("p.track_id", "frame", "p.x", "p.y", "p.score")


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """Per log: file, epochs, seconds (train/time and val/time together) and labels, the n=.. in the name of its folder (null if it has none)."""
    d = spark.read.option("header", True).csv(path)
    seconds = sum((F.coalesce(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).cast("double"), F.lit(0.0)) for c in ("train/time", "val/time") if c in d.columns), F.lit(0.0))
    logs = d.select(F.input_file_name().alias("file"), seconds.alias("s")).groupBy("file").agg(F.count("*").alias("epochs"), F.sum("s").alias("seconds"))
    # Names of files come with escapes, %3D for =.
    folder = F.element_at(F.split(F.url_decode("file"), "/"), -2)
    return logs.withColumn("labels", F.nullif(F.regexp_extract(folder, r"n=(\d+)", 1), F.lit("")).cast("int"))


def training_totals(logs: DataFrame) -> DataFrame:
    """One row: seconds and labels of all logs."""
    return logs.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"), F.count("*").alias("logs"))


def read_point_rows(spark: SparkSession, path: str, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """video, track_id, frame, x, y, occluded from lines ``video,x,y,occluded,x,y,occluded,...`` of places in 0..1, scaled to the image.

    A line is a track, named by its hash: equal lines are one track. A line that does not hold whole triples is an error.
    """
    cells = F.split("value", ",")
    d = spark.read.text(path).where(F.length(F.trim("value")) > 0).distinct().select(cells[0].alias("video"), F.md5("value").alias("track_id"), F.slice(cells, F.lit(2), F.size(cells) - 1).alias("v"))
    whole = F.when(F.size("v") % 3 != 0, F.raise_error(F.concat(F.lit("no whole triples for "), "video")).cast("int")).otherwise(F.size("v") / 3).cast("int")
    d = d.withColumn("n", whole).where("n > 0").select("video", "track_id", "v", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame"))
    at = lambda k: F.get("v", 3 * F.col("frame") + k).cast("double")
    return d.select("video", "track_id", "frame", (at(0) * width).alias("x"), (at(1) * height).alias("y"), (at(2) > 0).alias("occluded"))


#: Readers of track files by kind; each gives track_id, frame, x, y and file.
READERS = {
    "json": lambda spark, path: io.points(io.read_tracks(spark, path)),
    "nrrd": lambda spark, path: io.centroids(io.read_masks(spark, path)).withColumn("track_id", F.regexp_extract("file", r"([^/]+)\.nrrd$", 1)),
    "nrrd_first": lambda spark, path: io.first_voxels(io.read_masks(spark, path)).withColumn("track_id", F.regexp_extract("file", r"([^/]+)\.nrrd$", 1)),
    "xml": lambda spark, path: io.read_particles(spark, path).withColumn("track_id", F.col("particle").cast("string")),
    "csv": lambda spark, path: io.read_tracker_csv(spark, path).withColumn("file", F.input_file_name()),
    "wide": lambda spark, path: read_wide_tracks(spark, path).withColumn("file", F.lit(path)),
}


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """file, track_id, frame, x, y of track files of a kind of READERS; without one, by the ending of the path."""
    kind = kind or re.sub(r"^.*\.", "", os.path.basename(path.rstrip("/"))).lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(READERS)}")
    return READERS[kind](spark, path).select("file", F.col("track_id").cast("string").alias("track_id"), F.col("frame").cast("int").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def read_datasets(spark: SparkSession, datasets: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """dataset, file, track_id, frame, x, y of several datasets: name -> (kind, path) of each of its files or folders."""
    parts = [read_any(spark, path, kind).select(F.lit(name).alias("dataset"), "*") for name, files in datasets.items() for kind, path in files]
    if not parts:
        raise ValueError("no datasets")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_to_points(tracks: DataFrame, wanted: DataFrame, by: str = "file") -> DataFrame:
    """For given points in order, the nearest track at frame 0 that no earlier point has taken: by, query_id, track_id, d.

    wanted: query_id, x, y, a short list that goes to every task; tracks: by, track_id, frame, x, y. Of n points each is offered its n nearest tracks: earlier
    points take fewer than that, so the nearest free one is among them, and a group is n * n rows.
    """
    n = wanted.count()
    if n > 1000:
        raise ValueError(f"{n} points to match one after another; give at most 1000")
    first = tracks.where("frame = 0").select(by, "track_id", F.col("x").alias("px"), F.col("y").alias("py"))
    pairs = first.crossJoin(F.broadcast(wanted)).withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    offered = pairs.withColumn("r", F.row_number().over(Window.partitionBy(by, "query_id").orderBy("d", "track_id"))).where(F.col("r") <= n)

    def take(g):
        used, out = set(), []
        for query, own in g.sort_values(["query_id", "r"]).groupby("query_id", sort=True):
            for track, d in zip(own["track_id"], own["d"], strict=True):
                if track not in used:
                    used.add(track)
                    out.append((g[by].iloc[0], query, track, d))
                    break
        import pandas as pd

        return pd.DataFrame(out, columns=[by, "query_id", "track_id", "d"])

    kinds = dict(offered.dtypes)
    return offered.select(by, "query_id", "track_id", "d", "r").groupBy(by).applyInPandas(take, f"{by} {kinds[by]}, query_id {kinds['query_id']}, track_id {kinds['track_id']}, d double")
