"""Tables in the folder that the driver and all executors share.

Operators that store tables run jobs while their result is built. What a result reads stays until the interpreter ends, or
until the ``scope`` around it does.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, which only a single-machine session may do, a temporary one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the path's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001, S110  the session may have ended before the interpreter
            pass


atexit.register(_sweep)


class Stored:
    """A DataFrame written once to the shared folder and read back, so a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _scratch.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)
        _scratch.remove((self.spark, self.path))


@contextmanager
def scope() -> Iterator[None]:
    """Drop, at the end, all tables that operators stored inside. For callers who have consumed a result: it can't be read afterwards."""
    before = len(_scratch)
    try:
        yield
    finally:
        for spark, path in _scratch[before:]:
            drop_path(spark, path)
        del _scratch[before:]


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df
