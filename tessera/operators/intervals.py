"""Interval operators over grouped rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.intervals import LEAST, iou


def merge(df: DataFrame, keys: Sequence[str], start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Merged intervals of each key: overlapping or touching ones become one. One shuffle, by key."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def union_length(df: DataFrame, keys: Sequence[str], start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    merged = merge(df, keys, start, end)
    return merged.groupBy(*keys).agg(F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0.0))).alias("union_sec"), F.min(start).alias("hull_start"), F.max(end).alias("hull_end"))


def coverage(df: DataFrame, keys: Sequence[str], target_start: str, target_end: str, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """The share of each key's target that its intervals cover; the target is the same on all rows of a key."""
    cut = df.withColumn("_s", F.greatest(start, target_start)).withColumn("_e", F.least(end, target_end)).where("_e > _s")
    own = [*keys, target_start, target_end]
    parts = union_length(cut, own, "_s", "_e").withColumn("coverage", F.col("union_sec") / F.greatest(F.col(target_end) - F.col(target_start), F.lit(LEAST)))
    return parts.select(*own, "coverage")


def greedy_matches(predicted: Column, reference: Column, least: float = 0.3) -> Column:
    """Matches of two arrays of ``struct<s, e>``: in order of prediction, each takes the best free reference with an IoU of ``least``; ties go to the first."""
    places = F.sequence(F.lit(1), F.greatest(F.size(reference), F.lit(1)))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        def scored(i: Column) -> Column:
            r = F.get(reference, i - 1)
            return F.struct(iou(p["s"], p["e"], r["s"], r["e"]).alias("iou"), (-i).alias("at"))

        fit = F.filter(F.transform(F.filter(places, lambda i: ~F.array_contains(acc["taken"], i)), scored), lambda x: (x["iou"] >= least) & (x["iou"] > 0))
        best = F.array_max(fit)
        hit = best.isNotNull()
        return F.struct(F.when(hit, F.array_append(acc["taken"], (-best["at"]).cast("int"))).otherwise(acc["taken"]).alias("taken"), F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    return F.when(F.size(reference) > 0, F.aggregate(predicted, start, step)["n"]).otherwise(F.lit(0))
