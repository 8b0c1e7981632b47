"""Online forms of two folds over a stream of track points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Interventions(StatefulProcessor):
    """Counts a track's picks, relinks and manual corrections as its frames arrive in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "near long, picks long, relinks long, manual long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        near, picks, relinks, manual = self.state.get() if self.state.exists() else (None, 0, 0, 0)
        for k in pd.concat(rows).sort_values("frame")["near_id"]:
            if pd.isna(k):
                manual += 1
            elif near is None:
                near, picks = int(k), 1
            elif int(k) != near:
                near, relinks = int(k), relinks + 1
        self.state.update((near, picks, relinks, manual))
        yield pd.DataFrame({"track_id": [key[0]], "picks": [picks], "relinks": [relinks], "manual": [manual], "total": [picks + relinks + manual]})

    def close(self) -> None:
        pass


class Velocities(StatefulProcessor):
    """Differences to the last point of the track, over micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "frame int, x double, y double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.state.get() if self.state.exists() else None, []
        for r in pd.concat(rows).sort_values("frame").itertuples(index=False):
            if last is not None and r.frame > last[0]:
                out.append((key[0], last[0], r.x - last[1], r.y - last[2]))
            last = (int(r.frame), float(r.x), float(r.y))
        self.state.update(last)
        yield pd.DataFrame(out, columns=["track_id", "frame", "vx", "vy"]).astype({"track_id": "int64", "frame": "int32", "vx": "float64", "vy": "float64"})

    def close(self) -> None:
        pass


def interventions(stream: DataFrame) -> DataFrame:
    """Running totals per track. stream: track_id, frame, near_id."""
    return stream.groupBy("track_id").transformWithStateInPandas(Interventions(), "track_id long, picks long, relinks long, manual long, total long", "Update", "None")


def velocities(stream: DataFrame) -> DataFrame:
    return stream.groupBy("track_id").transformWithStateInPandas(Velocities(), "track_id long, frame int, vx double, vy double", "Append", "None")


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; rows later than the watermark are left out."""
    from pyspark.sql import functions as F

    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
