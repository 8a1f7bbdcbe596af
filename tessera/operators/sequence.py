"""Sequence operators over the ordered turns of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def forward(key: str, order: str) -> WindowSpec:
    """All later rows of the key."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)


def so_far(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def earlier(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def next_where(cond: Column, value: Column, key: str, order: str) -> Column:
    """The value of the first later row that meets the condition."""
    return F.first(F.when(cond, value), ignorenulls=True).over(forward(key, order))


def last_where(cond: Column, value: Column, key: str, order: str) -> Column:
    """The value of the last row up to this one that meets the condition."""
    return F.last(F.when(cond, value), ignorenulls=True).over(so_far(key, order))


def gap_clusters(df: DataFrame, key: str, at: str, gap: Column) -> DataFrame:
    """Add ``cluster``, from 1: a new one starts where the step from the row before exceeds ``gap``."""
    order = Window.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def discounted(credits: Column, gamma: float) -> Column:
    """Suffix returns of an array of credits, by one fold from the right: newest first, then turned round."""
    start = F.struct(F.lit(0.0).alias("g"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, c: Column) -> Column:
        g = c + gamma * acc["g"]
        return F.struct(g.alias("g"), F.array_append(acc["all"], g).alias("all"))

    return F.reverse(F.aggregate(F.reverse(credits), start, step)["all"])


def group_advantage(reward: Column, group: list[Column], clip: float | None = 3.0, eps: float = 1e-6, strict: bool = True) -> Column:
    """z-score inside a group, with population deviation; 0 where the deviation is below ``eps`` (or at it, if not ``strict``)."""
    w = Window.partitionBy(*group)
    mean, std = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    flat = std < eps if strict else std <= eps
    z = (reward - mean) / (std + eps)
    if clip is not None:
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return F.round(F.when(flat, F.lit(0.0)).otherwise(z), 6)
