"""Metadata beside a table: written with it, required before it is read.

A side-car is one small JSON file in the table's own file system. Readers name the schema version and the settings they rely
on, so a table of another version, or one that was made with other settings, fails before any row is read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SUFFIX = ".meta.json"


class MetadataMismatch(ValueError):
    """A table's metadata is missing, unreadable, of another version, or of other settings."""


def _path(spark: SparkSession, path: str):  # noqa: ANN202  a JVM object
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is no such file."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    jvm, stream = spark.sparkContext._jvm, fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under another name first, which is then renamed."""
    p, fs = _path(spark, path)
    new, _ = _path(spark, f"{path}.new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"{path} could not be written")


def sidecar_path(path: str) -> str:
    return path.rstrip("/") + SUFFIX


def write_metadata(spark: SparkSession, path: str, version: int, settings: dict, **extra: object) -> None:
    """``settings`` by section, and whatever else is worth knowing of the table."""
    write_text(spark, sidecar_path(path), json.dumps({**extra, "schema_version": version, **settings}, ensure_ascii=False, sort_keys=True, indent=2))


def load_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata, or nothing if it is missing or no JSON object."""
    try:
        held = json.loads(read_text(spark, sidecar_path(path)) or "null")
    except ValueError:
        return {}
    return held if isinstance(held, dict) else {}


def require_metadata(spark: SparkSession, path: str, version: int, settings: dict | None = None, sections: Sequence[str] | None = None) -> dict:
    """The metadata of ``path``; an error unless its version, and the ``sections`` of ``settings`` (all of them by default), are the same."""
    held = load_metadata(spark, path)
    if not held:
        raise MetadataMismatch(f"{sidecar_path(path)} is missing or unreadable: write the table anew")
    try:
        found = int(held.get("schema_version") or 0)
    except (TypeError, ValueError):
        found = 0
    if found != version:
        raise MetadataMismatch(f"{path} has schema version {found}, not {version}: write the table anew")
    if settings is not None:
        if differing := [s for s in (settings if sections is None else sections) if held.get(s) != settings.get(s)]:
            raise MetadataMismatch(f"{path} was written with another {', '.join(sorted(differing))}")
    return held


def write_table(df: DataFrame, path: str, version: int, settings: dict, **extra: object) -> None:
    """Write a Parquet table, then its side-car: a table that has none is not whole."""
    spark = df.sparkSession
    p, fs = _path(spark, sidecar_path(path))
    fs.delete(p, False)
    df.write.mode("overwrite").parquet(path)
    write_metadata(spark, path, version, settings, **extra)


def read_table(spark: SparkSession, path: str, version: int, settings: dict | None = None, sections: Sequence[str] | None = None) -> DataFrame:
    require_metadata(spark, path, version, settings, sections)
    return spark.read.parquet(path)
