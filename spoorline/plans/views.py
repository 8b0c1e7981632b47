"""Track relations over the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A flow cell in x and y, and frames between anchors.
CELL_X, CELL_Y, ANCHOR_STEP = 100.0, 25.0, 10


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """One track per user: track_id, frame, x, y, event_type."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frame = (F.row_number().over(w) - 1).alias("frame")
    return e.select(F.col("user_id").alias("track_id"), frame, F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type")


def occluded(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).withColumn("occluded", F.col("event_type") == "error")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).where("event_type <> 'error'")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).where(F.col("frame") % ANCHOR_STEP == 0).select("track_id", "frame", "x", "y")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with fixed errors and gaps, to be scored against tracks."""
    f, t = F.col("frame"), F.col("track_id")
    dx, dy = ((f * 7 + t) % 23 - 11) * 0.5, ((f * 3 + t) % 7 - 3) * 0.5
    return tracks(spark, sf).where((f + t) % 13 != 0).select("track_id", "frame", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))


def steady(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks that move little: their first place, and a hundredth of what they move away from it. Neighbours then stay neighbours for some frames."""
    first = lambda c: F.first(c).over(Window.partitionBy("track_id").orderBy("frame"))
    return tracks(spark, sf).withColumns({c: first(c) + (F.col(c) - first(c)) / 100 for c in ("x", "y")})


def flow(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Mean displacement to the next frame per frame and cell, rounded a hair above ties: frame, gx, gy, dx, dy. of: other tracks than tracks()."""
    t = tracks(spark, sf) if of is None else of
    w = Window.partitionBy("track_id").orderBy("frame")
    t = t.withColumn("dx", F.lead("x").over(w) - F.col("x")).withColumn("dy", F.lead("y").over(w) - F.col("y")).where("dx is not null")
    return t.groupBy("frame", F.rint(F.col("x") / CELL_X).cast("int").alias("gx"), F.rint(F.col("y") / CELL_Y).cast("int").alias("gy")).agg(
        F.round(F.avg("dx") + 1e-9, 6).alias("dx"), F.round(F.avg("dy") + 1e-9, 6).alias("dy")
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """A 50 by 7 image per month of orders: frame, px, py, value."""
    item, order = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    j = item.select("l_orderkey", "l_quantity", "l_linenumber", "l_extendedprice").join(order.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(month.alias("frame"), (F.col("l_quantity").cast("int") - 1).alias("px"), (F.col("l_linenumber") - 1).alias("py")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value"))


TRACKS = "tracks AS (SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type, event_type = 'error' AS occluded FROM events)"
#: In place of TRACKS.
STEADY = TRACKS.replace("tracks AS", "raw AS", 1) + ", tracks AS (SELECT track_id, frame, fx + (x - fx) / 100 AS x, fy + (y - fy) / 100 AS y, event_type, occluded FROM (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM raw WINDOW w AS (PARTITION BY track_id ORDER BY frame)))"
PRED = "pred AS (SELECT track_id, frame, x + ((frame * 7 + track_id) % 23 - 11) * CAST(0.5 AS DOUBLE) AS x, y + ((frame * 3 + track_id) % 7 - 3) * CAST(0.5 AS DOUBLE) AS y FROM tracks WHERE (frame + track_id) % 13 <> 0)"
ANCHORS = f"anchors AS (SELECT track_id, frame, x, y FROM tracks WHERE frame % {ANCHOR_STEP} = 0)"
DETECTIONS = "det AS (SELECT * FROM tracks WHERE NOT occluded)"
FLOW = """moves AS (SELECT *, lead(x) OVER (PARTITION BY track_id ORDER BY frame) - x AS mx, lead(y) OVER (PARTITION BY track_id ORDER BY frame) - y AS my FROM tracks),
flow AS (SELECT frame, CAST(round_even(x / 100, 0) AS INTEGER) AS gx, CAST(round_even(y / 25, 0) AS INTEGER) AS gy, round(avg(mx) + 1e-9, 6) AS dx, round(avg(my) + 1e-9, 6) AS dy FROM moves WHERE mx IS NOT NULL GROUP BY ALL)"""
PIXELS = "pixels AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS frame, CAST(l_quantity AS INTEGER) - 1 AS px, l_linenumber - 1 AS py, round(avg(l_extendedprice), 4) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
