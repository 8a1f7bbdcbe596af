"""Aggregations with fixed domains, profiles, rankings and cluster reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import ratio

from .shard import numbered


def fixed_domain(df: DataFrame, value: Column, domain: Sequence[str], other: str) -> DataFrame:
    """``value, n, share`` for each value of a domain, those without rows too. One global aggregate, no join."""
    v = F.when(value.isin(*domain), value).otherwise(F.lit(other))
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(v == d).alias(f"_{i}") for i, d in enumerate(domain)])
    rows = F.array(*[F.struct(F.lit(d).alias("value"), F.col(f"_{i}").alias("n")) for i, d in enumerate(domain)])
    return counts.select("_n", F.explode(rows).alias("r")).select("r.value", "r.n", F.round(ratio(F.col("r.n"), F.col("_n")), 6).alias("share"))


def quantiles(df: DataFrame, key: str, value: str, at: Sequence[float]) -> DataFrame:
    """``key, q``: an array of a key's exact quantiles, interpolated between neighbours; null where it has no values.

    All rows are ordered once, in ranges that split hot keys; a key's quantile is then one or two rows by their number, which
    are all that is fetched. So no task holds a key's values.
    """
    rows = numbered(df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL"), ["_key", "_value"])
    spans = rows.groupBy("_key").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
    asked = spans.select("_key", F.posexplode(F.array(*[F.lit(float(q)) for q in at])).alias("i", "q"), "first", "n")
    place = F.col("q") * (F.col("n") - 1)
    asked = asked.select("_key", "i", (place - F.floor(place)).alias("part"), (F.col("first") + F.floor(place)).alias("low"), (F.col("first") + F.ceil(place)).alias("high"))
    # Both ends of every quantile, as numbers of rows: an equi-join of which each row of the table meets few.
    ends = asked.select("_key", "i", "part", F.posexplode(F.array("low", "high")).alias("end", "ordinal"))
    found = ends.join(rows.select("ordinal", "_value"), "ordinal").groupBy("_key", "i").agg(
        F.first("part").alias("part"), F.max(F.when(F.col("end") == 0, F.col("_value"))).alias("low"), F.max(F.when(F.col("end") == 1, F.col("_value"))).alias("high")
    )
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    by_place = F.array_sort(F.collect_list(F.struct("i", between.alias("v"))))
    return found.groupBy("_key").agg(F.transform(by_place, lambda x: x["v"]).alias("q")).withColumnRenamed("_key", key)


def profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, extremes, mean and exact quantiles with linear interpolation, by key."""
    out = df.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    q = quantiles(df, key, value, (0.5, 0.9, 0.95, 0.99)).withColumnRenamed(key, "_of")
    out = out.join(q, F.col(key).eqNullSafe(F.col("_of")), "left")
    names = ("median", "p90", "p95", "p99")
    return out.select(key, "n", "total", "least", "most", F.round("mean", 6).alias("mean"), *[F.round(F.get("q", F.lit(i)), 6).alias(c) for i, c in enumerate(names)])


def ranked(df: DataFrame, value: Column, k: int) -> DataFrame:
    """The ``k`` most frequent values; null and blank count as ``(none)``; ties by value."""
    v = F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("(none)"))
    return df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(max(1, k))


def heaviest(df: DataFrame, k: int, images: str, messages: str, line: str) -> DataFrame:
    """The ``k`` heaviest rows; ties at the cut keep the larger line. The limit is a bounded heap in each task."""
    return df.orderBy(F.desc(images), F.desc(messages), F.desc(line)).limit(k)


def cluster_report(df: DataFrame, a: str, b: str, item: str, value: str, first: int = 5) -> DataFrame:
    """Counts, distinct items, mean value and the ``first`` smallest items for (a), (b) and (a, b): one expansion, pre-aggregated."""
    keys = F.array(
        F.struct(F.lit("a").alias("level"), F.col(a).alias("ka"), F.lit(None).cast("string").alias("kb")),
        F.struct(F.lit("b").alias("level"), F.lit(None).cast("string").alias("ka"), F.col(b).alias("kb")),
        F.struct(F.lit("ab").alias("level"), F.col(a).alias("ka"), F.col(b).alias("kb")),
    )
    each = df.select(F.explode(keys).alias("g"), F.col(item).alias("item"), F.col(value).alias("v")).select("g.*", "item", "v")
    by_item = each.groupBy("level", "ka", "kb", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    stats = by_item.groupBy("level", "ka", "kb").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_items"), (F.sum("s") / F.sum("n")).alias("mean"))
    order = Window.partitionBy("level", "ka", "kb").orderBy("item")
    top = by_item.withColumn("i", F.row_number().over(order)).where(F.col("i") <= first).groupBy("level", "ka", "kb").agg(F.array_join(F.array_sort(F.collect_list("item")).cast("array<string>"), ",").alias("first_items"))
    same = [stats["level"] == top["level"], stats["ka"].eqNullSafe(top["ka"]), stats["kb"].eqNullSafe(top["kb"])]
    return stats.join(top, same).select(stats["level"], stats["ka"], stats["kb"], "n", "n_items", F.round("mean", 6).alias("mean"), "first_items")
