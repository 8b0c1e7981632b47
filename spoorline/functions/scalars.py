"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp_pixel(c: Column, size: int) -> Column:
    """Nearest pixel (half to even) inside the image."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.rint(c).cast("int")))


def combined_occlusion(occluded: Column, uncertain: Column, threshold: float = 0.5) -> Column:
    """1 - (1 - s(o)) (1 - s(e)) above a threshold, with s the logistic function."""
    s = lambda z: 1 / (1 + F.exp(-z))
    return 1 - (1 - s(occluded)) * (1 - s(uncertain)) > threshold


def corridor_width(text: Column) -> Column:
    """A width as a number; null for none, empty, auto and adaptive; an error otherwise."""
    t = F.lower(F.trim(text))
    v = t.try_cast("double")
    return F.when(t.isNull() | t.isin("", "auto", "adaptive", "none"), F.lit(None).cast("double")).when(v.isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit("not a corridor width: "), text)).cast("double"))


def three_state(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isNull() | t.isin("", "auto", "none", "null"), F.lit(None).cast("boolean")).when(t.isin("true", "yes", "on", "1"), True).when(t.isin("false", "no", "off", "0"), False)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def snapped(c: Column, step: float = 0.25) -> Column:
    return F.round(F.rint(c / step) * step, 4)


def rescaled(x: Column, y: Column, size_in: tuple[int, int], size_out: tuple[int, int]) -> list[Column]:
    """Places on one grid (width, height) as places on another."""
    return [(x * size_out[0] / size_in[0]).alias("x"), (y * size_out[1] / size_in[1]).alias("y")]


def in_clip(frame: Column, x: Column, start: int, width: int, flip: bool = False) -> list[Column]:
    """Frame and x of a point in a clip that begins at a frame, mirrored left to right if asked."""
    return [(frame - start).alias("frame"), (F.lit(width) - x if flip else x).alias("x")]


def coordinate_scale(points: DataFrame, width: int, height: int) -> DataFrame:
    """One row: the scale that brings the greatest coordinate to the image's longer side; coordinates count as 1 where there are none."""
    most = lambda c: F.coalesce(F.max(c), F.lit(1.0))
    return points.agg((max(width, height) / F.greatest(most("x"), most("y"))).alias("scale"))


def matching_memory(pixels: Column) -> Column:
    """GB that dense matching of a frame of so many pixels takes; fixed values from measurements."""
    return 0.046 + 1.94e-7 * pixels + 1.52e-12 * pixels * pixels


def colour_wheel(dx: Column, dy: Column, most: Column) -> list[Column]:
    """Hue (0..180) from direction, half a turn ahead, saturation full, brightness by length over the greatest."""
    hue = (F.atan2(dy, dx) + math.pi) * 90 / math.pi
    return [F.floor(hue).cast("int").alias("hue"), F.lit(255).alias("saturation"), F.floor(F.when(most > 0, F.hypot(dx, dy) / most * 255).otherwise(0)).cast("int").alias("brightness")]


def coloured(flow: DataFrame) -> DataFrame:
    """Flow (dx, dy) with the colours of colour_wheel, over the greatest length of all frames (one row, sent to all)."""
    most = flow.agg(F.max(F.hypot("dx", "dy")).alias("most"))
    return flow.join(F.broadcast(most)).select("*", *colour_wheel(F.col("dx"), F.col("dy"), F.col("most"))).drop("most")


def parameter(name: Column, key: str) -> Column:
    """A number after a key in a file name, as in ..._r2.5_...; null if absent."""
    return F.regexp_extract(name, rf"_{key}(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def agrees(name: Column, key: str, value: float, tolerance: float) -> Column:
    """Whether a file name has a parameter within tolerance; an absent one agrees."""
    p = parameter(name, key)
    return p.isNull() | (F.abs(p - value) <= tolerance)
