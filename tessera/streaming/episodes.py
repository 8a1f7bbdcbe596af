"""Episodes as a stream: state is kept by episode, and rows of one micro-batch run in order of step.

The source of truth has no event time, so these are choices of this engine: the watermark on ``ts`` only
bounds how long window aggregates wait; replies that arrive after an episode's end are dropped as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators.machine import OUT, resume

REPLIES = "episode_id long, step_index long, reply string"


def read_replies(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A policy's replies from Parquet files as they arrive."""
    return spark.readStream.schema(REPLIES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def replay_stream(replies: DataFrame) -> DataFrame:
    """The batch replay, incrementally: the same rows for the same replies in order. Of an ended episode only its end is kept."""
    return replies.groupBy("episode_id").applyInPandasWithState(resume, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def tool_counts(events: DataFrame, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tumbling counts and values by tool, with late rows dropped after ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Runs of a user's events with steps of at most ``gap``."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
