"""Cutting lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts into which rows of one frame are dealt when they are kept by frame.
SPREAD = 8
#: Rows of a few numbers that one task reads.
ROWS_A_TASK = 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only on one machine, where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spoorline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame) -> DataFrame:
    """written(), then read by as many tasks as its rows need: many small parts do not stay many tasks. For rows of a few numbers."""
    kept = written(df)
    return kept.coalesce(max(8, -(-kept.count() // ROWS_A_TASK)))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own name below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def by_frame(df: DataFrame, folder: str, *more: str) -> DataFrame:
    """df, computed once and kept in folder by frame (and more columns), so that reading a frame reads nothing else."""
    keys = ("frame", *more)
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD))).write.partitionBy(*keys).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(*df.columns)
