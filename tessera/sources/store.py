"""A content-addressed store of built entries: what an example's content says is its key, and only new content is built.

A build writes its entries first and then their manifest, each as one batch of its own that Spark marks when it is whole.
Entries are read through whole manifest batches only, so a build that dies half way leaves nothing that counts, and the next
one builds the same entries again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import entry_path

from .manifest import require_config
from .sidecar import _path, read_text, write_text

#: Version of the store's own layout.
VERSION = "store.v1"
MANIFEST = "cache_key string, cache_path string, size_bytes long"
ENTRIES = "cache_key string, payload binary"


class Store:
    """Entries under ``root``, all built with one ``config``; opening a store of another config or layout is an error that names what differs."""

    def __init__(self, spark: SparkSession, root: str, config: dict) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        wanted = {"schema_version": VERSION, **{f"config.{k}": v for k, v in config.items()}}
        held = read_text(spark, f"{self.root}/metadata.json")
        if held is None:
            write_text(spark, f"{self.root}/metadata.json", json.dumps(wanted, ensure_ascii=False, sort_keys=True, indent=2))
        else:
            require_config(json.loads(held), json.loads(json.dumps(wanted)))

    def _batches(self, kind: str) -> list[str]:
        """The whole batches of one kind; their number is that of the builds, not of the rows."""
        p, fs = _path(self.spark, f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        names = [f"{self.root}/{kind}/{s.getPath().getName()}" for s in fs.listStatus(p)]
        return sorted(n for n in names if fs.exists(_path(self.spark, f"{n}/_SUCCESS")[0]))

    def manifest(self) -> DataFrame:
        """``cache_key, cache_path, size_bytes`` of all entries that count, each once: of a key that was built again, the last."""
        batches = self._batches("manifest")
        if not batches:
            return self.spark.createDataFrame([], MANIFEST + ", batch string")
        rows = self.spark.read.schema(MANIFEST).parquet(*batches).withColumn("batch", F.regexp_extract("_metadata.file_path", r"/manifest/([^/]+)/", 1))
        return rows.groupBy("cache_key").agg(F.max_by(F.struct("cache_path", "size_bytes", "batch"), "batch").alias("r")).select("cache_key", "r.*")

    def entries(self) -> DataFrame:
        """``cache_key, payload`` of all entries that count."""
        batches = [b.replace("/manifest/", "/entries/") for b in self._batches("manifest")]
        if not batches:
            return self.spark.createDataFrame([], ENTRIES)
        rows = self.spark.read.schema(ENTRIES).parquet(*batches).withColumn("batch", F.regexp_extract("_metadata.file_path", r"/entries/([^/]+)/", 1))
        return rows.join(self.manifest().select("cache_key", "batch"), ["cache_key", "batch"]).select("cache_key", "payload")

    def to_do(self, examples: DataFrame, key: Column, overwrite: bool = False) -> DataFrame:
        """Examples whose content is not built yet, one of each content, with ``cache_key``."""
        keyed = examples.withColumn("cache_key", key)
        keyed = keyed if overwrite else keyed.join(self.manifest().select("cache_key"), "cache_key", "left_anti")
        return keyed.dropDuplicates(["cache_key"])

    def build(self, examples: DataFrame, key: Column, value: str, make: Callable[[str], bytes], overwrite: bool = False) -> dict:
        """Build what is missing from the text in ``value``, and report counts and bytes. A failing ``make`` fails the build, which then leaves nothing."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"cache_key": b["cache_key"], "payload": [make(x) for x in b["value"]]})

        # Batches sort by the order of builds.
        batch = f"{len(self._batches('manifest')):06d}-{uuid.uuid4().hex}"
        todo = self.to_do(examples, key, overwrite).select("cache_key", F.col(value).alias("value"))
        todo.mapInPandas(run, ENTRIES).write.parquet(f"{self.root}/entries/{batch}")
        written = self.spark.read.schema(ENTRIES).parquet(f"{self.root}/entries/{batch}")
        rows = written.select("cache_key", entry_path(F.col("cache_key")).alias("cache_path"), F.octet_length("payload").cast("long").alias("size_bytes"))
        rows.write.parquet(f"{self.root}/manifest/{batch}")
        return self.summary(examples, key, batch)

    def summary(self, examples: DataFrame, key: Column, batch: str) -> dict:
        """Counts of examples, those built in ``batch`` and those that were there, and the bytes of all their entries."""
        asked = examples.select(key.alias("cache_key")).groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))
        held = asked.join(self.manifest(), "cache_key", "left")
        new = F.col("batch") == batch
        r = held.agg(
            F.sum("n").alias("num_examples"), F.count_if(new).alias("num_built"), F.sum(F.col("n") - F.when(new, 1).otherwise(0)).alias("num_skipped_existing"), F.sum("size_bytes").alias("total_bytes")
        ).first()
        return {k: int(r[k] or 0) for k in ("num_examples", "num_built", "num_skipped_existing", "total_bytes")}
