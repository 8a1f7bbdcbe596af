"""Registry of named queries and the derived episode log they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a key: a file that is small but costs much work a row would else lie in one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


# How event types stand for tools.
TOOLS = {"view": "scan_timeline", "click": "seek_evidence", "signup": "emit_alert", "error": "verify_hypothesis", "purchase": "finalize_case"}


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each turn: ``episode_id, step_index, tool_name, start_sec, end_sec, valid, value, k``."""
    ev = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id")
    tool = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("long")
    start = F.timestamp_diff("MICROSECOND", F.min("ts").over(own), F.col("ts")) / F.lit(1e6)
    step = F.row_number().over(own.orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))).cast("long")
    out = ev.select(F.col("user_id").alias("episode_id"), step.alias("step_index"), "event_id", tool.alias("tool_name"), "value", k.alias("k"), start.alias("start_sec"))
    return out.withColumn("end_sec", F.col("start_sec") + F.col("value") * 60).withColumn("valid", F.col("k") % 10 != 0)


EP = """ep0 AS (
  SELECT user_id AS episode_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step_index, event_id,
         CASE event_type WHEN 'view' THEN 'scan_timeline' WHEN 'click' THEN 'seek_evidence' WHEN 'signup' THEN 'emit_alert'
              WHEN 'error' THEN 'verify_hypothesis' WHEN 'purchase' THEN 'finalize_case' END AS tool_name,
         value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(1000000 AS DOUBLE) AS start_sec
  FROM events),
ep AS (SELECT *, start_sec + value * 60 AS end_sec, k % 10 <> 0 AS valid FROM ep0)"""
