"""JSON-lines sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class MalformedLine(ValueError):
    """A line that isn't JSON, with its file, number and the start of its text."""


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType, splits: Sequence[str] | None = None, skip_invalid: bool = False) -> DataFrame:
    """Rows of a JSON-lines file. Blank lines don't count; a split whitelist is applied while scanning.

    A malformed line is an error that names its place, or is left out with ``skip_invalid``.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = F.try_parse_json("value").isNotNull()
    # Lines are numbered only once one is known to be malformed.
    if not skip_invalid and not lines.where(~parsed).isEmpty():
        r = numbered_lines(spark, path).where(F.length(F.trim("line")) > 0).where(F.try_parse_json("line").isNull()).orderBy("file", "line_number").first()
        raise MalformedLine(f"{r.file}:{r.line_number}: {r.line[:240]}")
    good = lines.where(parsed).select(F.from_json("value", schema).alias("r")).select("r.*")
    if splits is not None:
        good = good.where(F.trim(F.coalesce(F.col("split"), F.lit(""))).isin(list(splits)))
    return good


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_number, line`` with physical numbers from 1, blank lines counted.

    A file is split anywhere, so lines are numbered by their place in each split plus the lines before it.
    """
    raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("block", F.col("_metadata.file_block_start")).withColumn("at", F.monotonically_increasing_id())
    own = Window.partitionBy("file", "block")
    local = raw.withColumn("i", F.row_number().over(own.orderBy("at")))
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).select("file", "block", "before")
    return local.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("i")).alias("line_number"), F.col("value").alias("line"))


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records from a folder of JSON and JSON-lines files, a JSON-lines file, or a JSON file of one object or a list; with ``source_file``."""
    if path.endswith(".jsonl"):
        df = spark.read.schema(schema).json(path)
    elif path.endswith(".json"):
        df = spark.read.schema(schema).option("multiLine", True).json(path)
    else:
        lines = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(path)
        whole = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
        return _with_source(lines).unionByName(_with_source(whole))
    return _with_source(df)


def _with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    """One object for each line. ``one_file`` gathers the rows in one task: for small reports only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add one object for each line to what a log folder holds."""
    df.write.mode("append").json(path)


def layout_of(spark: SparkSession, path: str) -> str:
    """``lines``, ``object`` or ``list``: how a file holds its records, by its name and its first character."""
    if not path.endswith(".json"):
        return "lines"
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("c")).first()
    return "list" if first and first.c == "[" else "object"


def write_like(df: DataFrame, path: str, layout: str) -> None:
    """Records in the layout they were read in: one object for each line, a JSON list, or a single object.

    A list and an object are one value, which one task writes, as one task read it; only lines have no bound.
    """
    if layout == "lines":
        write_jsonl(df, path)
        return
    whole = F.to_json(F.collect_list(F.struct("*")))
    if layout == "object":
        if df.limit(2).count() != 1:
            raise ValueError("a single object can't hold several records")
        df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    else:
        df.agg(whole.alias("value")).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str, index: str, name: str) -> None:
    """One folder for each record, named by its index and name, so tasks write without meeting: ``record=000012_a_b``."""
    key = F.concat(F.lpad(F.col(index).cast("string"), 6, "0"), F.lit("_"), F.regexp_replace(F.col(name), "/", "_"))
    df.withColumn("record", key).write.mode("overwrite").partitionBy("record").json(path)
