"""Message budgets, response labels and token weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prune_images(df: DataFrame, key: str, order: str, images: str, keep_messages: int, most: int) -> DataFrame:
    """Add ``kept_images``: only the last ``keep_messages`` messages with images keep theirs, and of those the newest ``most`` images."""
    has = F.col(images) > 0
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    rank = F.sum(F.when(has, 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    fresh = df.withColumn("_fresh", F.when(has & (rank <= keep_messages), F.col(images)).otherwise(0))
    after = F.coalesce(F.sum("_fresh").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return fresh.withColumn("kept_images", F.least(F.col("_fresh"), F.greatest(F.lit(most) - after, F.lit(0))).cast("long")).drop("_fresh")


def fit_history(df: DataFrame, key: str, order: str, size: str, prefix: Column, last: int, budget: int) -> DataFrame:
    """Add ``kept``: the prefix always stays; of the rest the last ``last`` messages that fit the budget, newest first."""
    newest = Window.partitionBy(key, prefix).orderBy(F.desc(order))
    rank = F.row_number().over(newest)
    used = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("kept", prefix | ((rank <= last) & (used <= budget)))


def response_labels(ids: Column, n: Column) -> Column:
    """Ids of the last ``n`` tokens; -100 before them."""
    return F.transform(ids, lambda x, i: F.when(i >= F.size(ids) - n, x).otherwise(F.lit(-100).cast("long")))


def token_weights(char_weights: Column, spans: Column) -> Column:
    """The mean weight of each token's characters; 0 for an empty span."""

    def mean(s: Column) -> Column:
        part = F.slice(char_weights, s["start"] + 1, F.greatest(s["end"] - s["start"], F.lit(0)))
        return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda n, x: n + x) / F.size(part)).otherwise(F.lit(0.0))

    return F.transform(spans, mean)
