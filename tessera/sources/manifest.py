"""Caches of derived artefacts: what is left to build, and the build with its status report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConfigMismatch(ValueError):
    """A cache was built with another configuration."""


def require_config(stored: dict, wanted: dict) -> None:
    """Raise unless both hold the same; names what differs."""
    if differing := sorted(k for k in {*stored, *wanted} if k not in stored or k not in wanted or stored[k] != wanted[k]):
        raise ConfigMismatch(f"the cache was built with other {', '.join(differing)}")


def build(items: DataFrame, done: DataFrame, key: str, path: str, make: Callable[[str], bytes | None], overwrite: bool = False) -> DataFrame:
    """Build what ``done`` lacks: ``key, status, payload`` with status built, missing (``make`` gave None) or failed. Items that exist are skipped."""
    todo = items if overwrite else items.join(done.select(key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b["k"], b["p"], strict=True):
                try:
                    got = make(p)
                    out.append((k, "missing" if got is None else "built", got))
                except Exception as e:  # noqa: BLE001  a bad item must not end the build
                    out.append((k, "failed", str(e).encode()))
            yield pd.DataFrame(out, columns=["k", "status", "payload"])

    return todo.select(F.col(key).cast("string").alias("k"), F.col(path).alias("p")).mapInPandas(run, "k string, status string, payload binary").withColumnRenamed("k", key)


def coverage(items: DataFrame, done: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """Cached and missing items, with the first missing ones."""
    j = items.select(key).distinct().join(done.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    miss = F.col("_hit").isNull()
    counts = j.groupBy(miss.alias("missing")).agg(F.count(F.lit(1)).alias("n"))
    first = j.where(miss).orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(key)).alias("first_missing"))
    return counts.join(F.broadcast(first))

