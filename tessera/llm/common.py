"""Shared helpers: tables, shared scratch space, fixed character sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import Stored, scratch_root, stored

__all__ = ["LOWER", "SPACE", "UPPER", "Stored", "ascii_lower", "col", "fresh", "nested", "scratch_root", "stored", "table", "words"]

# ASCII letters and the white space of the text contracts.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, which may hold dots."""
    return F.col(f"`{name.replace('`', '``')}`")


def nested(df: DataFrame, without: tuple[str, ...] = (), **own: Column) -> DataFrame:
    """All columns of ``df`` but some as one struct ``row``, beside ``own`` ones, whose names then can't clash."""
    held = [col(c) for c in df.columns if c not in without]
    return df.select(F.struct(*held).alias("row"), *[c.alias(k) for k, c in own.items()])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the built-in's byte path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
