"""Connected components of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact


def _stars(e: DataFrame) -> bool:
    """Whether every node of e (u > v) either points at one node or is pointed at: then each component is its least node's star."""
    ends = e.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").count() == 0


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of links (u, v); any orderable type.

    Each round points every node at its least neighbour, first for greater neighbours, then for smaller ones. Minima are
    summed up before the shuffle and joined back; the links of one node meet in one task there, as rows of two numbers, which
    Spark sorts on disk where need be. Rounds grow with the logarithm of the longest path.
    """
    e = compact(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = compact(large)
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = compact(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
