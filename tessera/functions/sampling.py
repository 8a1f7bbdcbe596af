"""Choices of frame indices, as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: frames that a window shows at most.
MAX_FRAMES = 8


def spaced(start: Column, end: Column, n: Column) -> Column:
    """``n`` indices from start to end, evenly spaced, ties to even."""
    gap = (end - start) / F.greatest(n - 1, F.lit(1))
    return F.when(n <= 1, F.array(start.cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.bround(start + i * gap, 0).cast("long")))


def uniform(start: Column, end: Column, n: Column, most: int = MAX_FRAMES) -> Column:
    return spaced(start, end, F.greatest(F.least(n, end - start + 1, F.lit(most)), F.lit(1)))


def strided(start: Column, end: Column, stride: Column, most: int = MAX_FRAMES) -> Column:
    """Every ``stride`` frames, and the last one; too many become evenly spaced."""
    steps = F.array_distinct(F.concat(F.sequence(start.cast("long"), end.cast("long"), F.greatest(stride, F.lit(1)).cast("long")), F.array(end.cast("long"))))
    return F.when(F.size(steps) > most, uniform(start, end, F.lit(most))).otherwise(steps)


def even_subset(items: Column, k: int) -> Column:
    """``k`` evenly spaced items of an array, each place once."""
    n = F.size(items)
    at = F.array(F.lit(0)) if k == 1 else F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1), 0).cast("int")))
    return F.when(n <= k, items).otherwise(F.transform(at, lambda i: F.get(items, i)))


def clip_indices(frames: Column, duration: Column, native_fps: Column, cache_fps: float = 2.0, most: int = 256) -> Column:
    """Frames of a whole clip at ``cache_fps`` (no faster than its own), ``most`` at most, each once; none of an empty clip.

    Without a duration or a rate all frames count.
    """
    fps = F.when(native_fps <= 0, native_fps).otherwise(F.least(F.lit(cache_fps), native_fps))
    n = F.when((duration > 0) & (fps > 0), F.ceil(duration * fps)).otherwise(frames)
    n = F.greatest(F.least(n, frames, F.lit(most)), F.lit(1))
    return F.when(frames > 0, F.array_distinct(spaced(F.lit(0), frames - 1, n))).otherwise(F.array().cast("array<bigint>"))


def preview_count(frames: Column, fps: Column, asked: int = 8, most: int = 8, preview_fps: float | None = None) -> Column:
    """How many frames a preview shows: what is asked for, and no more than there are, than ``most``, or than ``preview_fps`` gives."""
    n = F.least(frames, F.lit(max(1, asked)), F.lit(max(1, most)))
    if preview_fps is not None:
        n = F.when(fps > 0, F.least(n, F.greatest(F.ceil(frames / fps * preview_fps), F.lit(1)))).otherwise(n)
    return F.greatest(n, F.lit(1))
