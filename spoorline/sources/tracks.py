"""Readers and writers of track files. All go through Spark's own readers, so paths may be in any store."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One permissive schema with every spelling of frames, ids and spans.
_POINT = "array<struct<frame:int,t:int,x:double,y:double>>"
_SPAN = "array<struct<start:int,end:int>>"
TRACK_FILE = f"metadata struct<total_frames:int,source_filename:string>, total_frames int, tracks array<struct<track_id:string,id:string,color:string,annotations:{_POINT},frames:{_POINT},positions:{_POINT},anchors:{_POINT},visible_segments:{_SPAN},occlusion_segments:{_SPAN}>>"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track files (JSON): file, track_id, color, total_frames, points, anchors, visible and occluded spans."""
    d = spark.read.schema(TRACK_FILE).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    t = d.select("file", F.coalesce("metadata.total_frames", "total_frames").alias("total_frames"), F.posexplode("tracks").alias("n", "t"))
    return t.select("file", F.coalesce("t.track_id", "t.id", F.col("n").cast("string")).alias("track_id"), "t.color", "total_frames", F.coalesce("t.annotations", "t.frames", "t.positions").alias("points"), "t.anchors", "t.visible_segments", "t.occlusion_segments")


def points(tracks: DataFrame, column: str = "points") -> DataFrame:
    """Long rows: file, track_id, frame, x, y."""
    p = tracks.select("file", "track_id", F.explode(column).alias("p"))
    return p.select("file", "track_id", F.coalesce("p.frame", "p.t").alias("frame"), "p.x", "p.y")


def write_tracks(points: DataFrame, path: str, scale_x: float = 1.0, scale_y: float = 1.0) -> None:
    """One JSON document a track, points in order, rescaled and rounded half to even."""
    p = F.struct("frame", F.rint(F.col("x") * scale_x).cast("int").alias("x"), F.rint(F.col("y") * scale_y).cast("int").alias("y"))
    points.groupBy("track_id").agg(F.sort_array(F.collect_list(p)).alias("frames")).write.mode("overwrite").json(path)


def read_written_tracks(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("track_id string, frames array<struct<frame:int,x:int,y:int>>").json(path)
    return d.select("track_id", F.explode("frames").alias("p")).select("track_id", "p.*")


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    """Particle files (XML): file, particle, frame, x, y, in order of time. A particle is named by a hash of its file and detections, the same in every run; equal ones of a file are one."""
    schema = "_nSpots long, detection array<struct<_t:int,_x:double,_y:double>>"
    d = spark.read.format("xml").option("rowTag", "particle").schema(schema).load(path)
    d = d.select(F.input_file_name().alias("file"), F.xxhash64(F.input_file_name(), F.to_json("detection")).alias("particle"), "detection").dropDuplicates(["file", "particle"])
    return d.select("file", "particle", F.explode("detection").alias("p")).select("file", "particle", F.col("p._t").alias("frame"), F.col("p._x").alias("x"), F.col("p._y").alias("y"))


def read_tracker_csv(spark: SparkSession, path: str) -> DataFrame:
    """video, track_id, frame, x, y; lines of comment begin with #."""
    return spark.read.option("header", True).option("comment", "#").schema("video string, track_id string, frame int, x double, y double").csv(path)


def write_traces(traces: DataFrame, value: str, path: str, names: list[str]) -> None:
    """A wide CSV: frame and one column a track, six significant digits, blank where missing."""
    wide = traces.groupBy("frame").pivot("track_id", names).agg(F.first(value))
    wide.select("frame", *(F.when(F.col(f"`{n}`").isNotNull(), F.format_string("%.6g", F.col(f"`{n}`"))).alias(n) for n in names)).repartitionByRange("frame").sortWithinPartitions("frame").write.mode("overwrite").option("header", True).csv(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of a wide CSV: frame, track_id, value; blanks are null."""
    d = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return d.unpivot("frame", [c for c in d.columns if c != "frame"], "track_id", "value").where("value is not null")


def write_flow(flow: DataFrame, path: str, video: str, method: str, params: str) -> None:
    """Flow in input pixels, partitioned so that readers prune to one video, method and parameter set."""
    flow.select(F.lit(video).alias("video"), F.lit(method).alias("method"), F.md5(F.lit(params)).alias("params_hash"), "*").write.mode("overwrite").partitionBy("video", "method", "params_hash").parquet(path)


def read_flow(spark: SparkSession, path: str, video: str, method: str, params: str) -> DataFrame:
    import hashlib

    return spark.read.parquet(path).where((F.col("video") == video) & (F.col("method") == method) & (F.col("params_hash") == hashlib.md5(params.encode()).hexdigest())).drop("video", "method", "params_hash")


def _each(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Rows of binary files, one file at a time."""

    def rows(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield from decode(name, bytes(content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


PIXELS = "file string, frame int, py int, px int, value double"


def _pixels(name: str, frame: int, a: np.ndarray) -> pd.DataFrame:
    y, x = np.indices(a.shape)
    return pd.DataFrame({"file": name, "frame": frame, "py": y.ravel(), "px": x.ravel(), "value": a.ravel().astype(float)})


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Videos in npy or npz files (the first array): gray T x H x W, or with a last axis of channels, which is averaged."""

    def decode(name: str, content: bytes):
        a = np.load(io.BytesIO(content), allow_pickle=False)
        if hasattr(a, "files"):
            a = a[a.files[0]]
        if a.ndim == 2:
            a = a[None]
        if a.ndim == 4:
            a = a.mean(-1)
        for t, frame in enumerate(a):
            yield _pixels(name, t, np.nan_to_num(frame))

    return _each(spark, path, decode, PIXELS)


def read_flow_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Flow in npz files: file, frame, gy, gx, dx, dy in input pixels."""

    def decode(name: str, content: bytes):
        z = np.load(io.BytesIO(content), allow_pickle=False)
        f, scale = z["flows"].astype(float), float(z["flow_to_input_scale"]) if "flow_to_input_scale" in z.files else 1.0
        for t in range(len(f)):
            y, x = np.indices(f.shape[1:3])
            yield pd.DataFrame({"file": name, "frame": t, "gy": y.ravel(), "gx": x.ravel(), "dx": f[t, ..., 0].ravel() * scale, "dy": f[t, ..., 1].ravel() * scale})

    return _each(spark, path, decode, "file string, frame int, gy int, gx int, dx double, dy double")


def tiff_pages(content: bytes):
    """Pages of an uncompressed baseline TIFF."""
    end = "<" if content[:2] == b"II" else ">"
    at = struct.unpack_from(end + "I", content, 4)[0]
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
    while at:
        n = struct.unpack_from(end + "H", content, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(end + "HHI", content, at + 2 + 12 * i)
            where = at + 2 + 12 * i + 8
            if sizes.get(kind, 1) * count > 4:
                where = struct.unpack_from(end + "I", content, where)[0]
            if kind in (1, 3, 4, 16):
                tags[tag] = struct.unpack_from(end + f"{count}{ {1: 'B', 3: 'H', 4: 'I', 16: 'Q'}[kind]}", content, where)
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("compressed TIFF pages can't be read here")
        w, h, bits, each = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(277, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
        data = b"".join(content[o : o + s] for o, s in zip(tags[273], tags[279], strict=True))
        a = np.frombuffer(data, dtype=f"{end}{kind}{bits // 8}", count=w * h * each).reshape(h, w, each).astype(float).mean(-1)
        yield a
        at = struct.unpack_from(end + "I", content, at + 2 + 12 * n)[0]


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    def decode(name: str, content: bytes):
        for t, a in enumerate(tiff_pages(content)):
            yield _pixels(name, t, a)

    return _each(spark, path, decode, PIXELS)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Voxels set in NRRD masks of axes (x, y, frame): file, frame, i, j."""

    def decode(name: str, content: bytes):
        head, _, data = content.partition(b"\n\n")
        fields = dict(x.split(": ", 1) for x in head.decode().splitlines() if ": " in x and not x.startswith("#"))
        kind = {"uint8": "u1", "unsigned char": "u1", "uchar": "u1", "int16": "i2", "short": "i2", "uint16": "u2", "float": "f4", "double": "f8", "int": "i4"}[fields["type"]]
        if fields.get("encoding", "raw") in ("gzip", "gz"):
            data = zlib.decompress(data, 31)
        shape = [int(x) for x in fields["sizes"].split()]
        a = np.frombuffer(data, dtype=("<" if fields.get("endian", "little") == "little" else ">") + kind, count=int(np.prod(shape))).reshape(shape, order="F")
        i, j, t = np.nonzero(a)
        yield pd.DataFrame({"file": name, "frame": t, "i": i, "j": j})

    return _each(spark, path, decode, "file string, frame int, i int, j int")


def centroids(masks: DataFrame) -> DataFrame:
    """Mean voxel of each mask and frame, in array order."""
    return masks.groupBy("file", "frame").agg(F.avg("i").alias("x"), F.avg("j").alias("y"))


def first_voxels(masks: DataFrame) -> DataFrame:
    """The first voxel set in each mask and frame, in array order."""
    return masks.groupBy("file", "frame").agg(F.min(F.struct("i", "j")).alias("p")).select("file", "frame", F.col("p.i").alias("x"), F.col("p.j").alias("y"))


def newest(files: DataFrame, by: list[str]) -> DataFrame:
    """Of files with parameters, the newest for each: by, path. files: path, modified, ..."""
    return files.groupBy(*by).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result table as Markdown. For reports: it comes to the driver; a table of more than ``most`` rows is an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in found)])
