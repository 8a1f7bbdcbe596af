"""Lookups: last-wins references, selectors, membership, best matches, incremental work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row for each key, that of the largest ordinal: an aggregate that combines before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(*keys, "_r.*")


def resolve(ledger: DataFrame, selectors: DataFrame, key: str) -> DataFrame:
    """Ledger entries that selectors name, in order of selector kind, then place; each once.

    ``ledger``: key, ``window_id, evidence_id, moment_id, place``. ``selectors``: key, ``kind`` (0 window, 1
    evidence, 2 moment), ``ref``. A key without selectors takes its whole ledger; one whose selectors match
    nothing takes none.
    """
    refs = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("ref")) for i, c in enumerate(("window_id", "evidence_id", "moment_id"))])
    named = ledger.select(key, "window_id", "place", F.explode(refs).alias("r")).select(key, "window_id", "place", "r.kind", "r.ref")
    hits = named.join(selectors.select(key, "kind", "ref").distinct(), [key, "kind", "ref"]).groupBy(key, "window_id").agg(F.min(F.struct("kind", "place")).alias("at"))
    whole = ledger.join(selectors.select(key).distinct(), key, "left_anti").select(key, "window_id", F.struct(F.lit(-1).alias("kind"), F.col("place")).alias("at"))
    order = Window.partitionBy(key).orderBy("at.kind", "at.place")
    return hits.unionByName(whole).withColumn("position", F.row_number().over(order)).select(key, "window_id", "position")


def known_ids(ids: Column, known: Column) -> Column:
    """Ids in order, without blanks, unknown ones and repeats."""
    return F.array_distinct(F.filter(F.transform(ids, lambda i: F.trim(i)), lambda i: (i != "") & F.array_contains(known, i)))


def alias_place(ref: Column) -> Column:
    """The place in the ledger, from 1, that an older kind of reference names: ``evidence_N`` and ``w_N`` count from 0, ``wN`` from 1."""
    zero = F.regexp_extract(ref, r"^(?:evidence_|w_)(\d{1,6})$", 1)
    one = F.regexp_extract(ref, r"^w(\d{1,3})$", 1)
    return F.when(zero != "", zero.try_cast("int") + 1).when(one != "", one.try_cast("int"))


def best_match(pairs: DataFrame, key: str, score: str, ordinal: str) -> DataFrame:
    """The best-scored row of each key; the earliest of equals."""
    return pairs.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), ordinal))).where("_i = 1").drop("_i")


def to_do(items: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Items that the manifest doesn't hold."""
    return items.join(manifest.select(key), key, "left_anti")
