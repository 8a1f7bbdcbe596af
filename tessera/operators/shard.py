"""Deterministic partitions of ordered rows. Ordinals count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored


def strided(ordinal: Column, n: int) -> Column:
    return F.pmod(ordinal, F.lit(n)).cast("int")


def contiguous(ordinal: Column, total: Column, n: int) -> Column:
    """The shard whose balanced range holds the ordinal."""
    return F.floor(((ordinal + 1) * n - 1) / total).cast("int")


def numbered(df: DataFrame, order: list[str], name: str = "ordinal", totals: dict[str, str] | None = None) -> DataFrame:
    """Number all rows by a total order without gathering them, and run ``totals`` (new name: column) up to each row.

    Sorted ranges are written once, with each row's range and place in it, so that all that follows sees the same
    ranges. Counts and sums of ranges give each its offset: only one row for each range is gathered.
    """
    totals = totals or {}
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = stored(ranged.withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"))
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{t}") for t, c in totals.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sizes.select("_range", offset("_n").alias("_offset"), *[offset(f"_sum_{t}").alias(f"_from_{t}") for t in totals])
    out = held.join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_offset") + F.col("_place")).cast("long"))
    own = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    for t, c in totals.items():
        out = out.withColumn(t, F.col(f"_from_{t}") + F.coalesce(F.sum(c).over(own), F.lit(0)))
    return out.drop("_range", "_place", "_offset", *[f"_from_{t}" for t in totals])


def balanced(candidate: Column, own_ordinal: Column, ordinal: Column, n: int) -> Column:
    """Costly candidates are dealt among themselves, the others by their place."""
    return F.when(candidate, F.pmod(own_ordinal, F.lit(n))).otherwise(F.pmod(ordinal, F.lit(n))).cast("int")
