"""Interval expressions over seconds ``[start, end)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, ratio

#: Fixed value: the least union length in a quotient.
LEAST = 1e-6


def pair(a: Column) -> Column:
    """A two-element array as ``struct<start, end>`` in order; anything else is null."""
    lo, hi = F.get(a, 0), F.get(a, 1)
    return F.when((F.size(a) == 2) & lo.isNotNull() & hi.isNotNull(), F.struct(F.least(lo, hi).alias("start"), F.greatest(lo, hi).alias("end")))


def length(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))


def overlap_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap as a share of the second interval."""
    return ratio(overlap(s1, e1, s2, e2), length(s2, e2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    common = overlap(s1, e1, s2, e2)
    union = F.greatest(length(s1, e1) + length(s2, e2) - common, F.lit(LEAST))
    return clamp(common / union, 0.0, 1.0)


def strictly_before(end_frame: Column, start_frame: Column) -> Column:
    return end_frame < start_frame


def frame_seconds(frame: Column, base: Column, fps: Column) -> Column:
    """The second at which a frame starts."""
    return F.round(F.greatest(frame - base, F.lit(0)) / fps, 6)


def frame_window(start: Column, end: Column, base: Column, fps: Column, duration: Column) -> Column:
    """Inclusive frames as seconds, end exclusive, inside the clip."""
    s = F.least(F.greatest((start - base) / fps, F.lit(0.0)), duration)
    e = F.least(F.greatest((end - base + 1) / fps, F.lit(0.0)), duration)
    return F.struct(F.round(s, 6).alias("start"), F.round(e, 6).alias("end"))
