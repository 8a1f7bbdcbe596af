"""Evaluation metrics as DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import ratio

from .shard import numbered


def average_precision(df: DataFrame, keys: Sequence[str], target: str, score: str, ordinal: str) -> DataFrame:
    """Mean precision at the hits, in order of falling score; ties keep the order of ``ordinal``. 0 without hits.

    Rows are ranked by ranges of the whole order, so a key of any size is spread over many tasks.
    """
    rows = df.select(*keys, (-F.col(score)).alias("_score"), F.col(ordinal).alias("_ordinal"), (F.col(target) == 1).cast("long").alias("_hit"))
    ranked = numbered(rows, [*keys, "_score", "_ordinal"], "_rank", {"_hits": "_hit"})
    first = ranked.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.min("_rank").alias("_from"), F.min(F.col("_hits") - F.col("_hit")).alias("_before"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    at = F.when(F.col("_hit") == 1, (F.col("_hits") - F.col("_before")) / (F.col("_rank") - F.col("_from") + 1))
    out = ranked.join(first, same).groupBy(*keys).agg(F.sum(at).alias("_p"), F.sum("_hit").alias("_n"))
    return out.select(*keys, F.round(F.coalesce(F.try_divide("_p", "_n"), F.lit(0.0)), 6).alias("average_precision"))


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``class, f1, macro_f1``. Counts combine before the shuffle; what is joined has a row for each class."""
    cells = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    true = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("g"))
    f1 = F.when(F.col("tp") > 0, ratio(2 * F.col("tp"), F.col("t") + F.coalesce("g", F.lit(0)))).otherwise(F.lit(0.0))
    each = true.join(said, "class", "left").select("class", f1.alias("f1"), F.lit(1).alias("_one"))
    mean = each.groupBy("_one").agg(F.avg("f1").alias("m"))
    return each.join(F.broadcast(mean), "_one").select("class", F.round("f1", 6).alias("f1"), F.round("m", 6).alias("macro_f1"))


def alert_utility(df: DataFrame, onset: str, offset: str, precursor: str, duration: str, alert: str, anomaly: str) -> DataFrame:
    """Add ``utility, premature, late, false_alert``. The tolerance is half a second or a fiftieth of the clip."""
    t0, a = F.coalesce(onset, F.lit(0.0)), F.col(alert)
    tol = F.greatest(F.lit(0.5), 0.02 * F.col(duration))
    span = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(1.0))
    is_anomaly = F.col(anomaly)
    early, late = a < t0 - tol, a > t0 + tol
    timely = F.when(a.isNull(), 0.0).when(early, -F.least(F.lit(1.0), (t0 - a) / span(F.col(onset) - F.col(precursor)))).otherwise(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), a - t0) / span(F.col(offset) - F.col(onset))))
    utility = F.when(~is_anomaly, F.when(a.isNull(), 1.0).otherwise(-1.0)).otherwise(timely)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns({"utility": F.round(utility, 6), "premature": yes(is_anomaly & early), "late": yes(is_anomaly & late), "false_alert": ~is_anomaly & a.isNotNull()})
