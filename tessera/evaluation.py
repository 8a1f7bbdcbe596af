"""Evaluation runs: score all rollouts against their references, write the scored records, and sum them up, one folder for each epoch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import average_precision, macro_f1
from tessera.operators.rollout_metrics import record_metrics, summary
from tessera.sources.sidecar import _path, write_text
from tessera.storage import drop_path


def epoch_folder(root: str, epoch: int) -> str:
    return f"{root.rstrip('/')}/rollout_eval/epoch_{epoch:03d}"


def clear_stale(records: DataFrame, folder: str) -> list[str]:
    """Delete what an earlier run left in the folder, and say what it was: a reader never takes it for this run's."""
    spark, found = records.sparkSession, []
    for name in ("metrics.json", "failure.json", "scored"):
        p, fs = _path(spark, f"{folder}/{name}")
        if fs.exists(p):
            drop_path(spark, f"{folder}/{name}")
            found.append(name)
    return found


def metrics_of(scored: DataFrame) -> dict:
    """All metrics over scored records: means, average precision of existence, and macro-F1 over the categories of anomalies."""
    row = summary(scored).first().asDict()
    ranks = average_precision(scored.select(F.lit(0).alias("all"), F.col("is_anomaly").cast("int").alias("hit"), "existence_score", "video_id"), ["all"], "hit", "existence_score", "video_id").first()
    f1 = macro_f1(scored.where("true_category IS NOT NULL"), "true_category", "said_category").first()
    return {**row, "existence_ap": ranks["average_precision"] if ranks else 0.0, "category_macro_f1": f1["macro_f1"] if f1 else 0.0}


def evaluate(rollouts: DataFrame, references: DataFrame, root: str, epoch: int, diagnostics: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Score, write and sum up; the summary is returned and written as ``metrics.json`` beside the ``scored`` records.

    Rollouts and references as in ``rollout_metrics`` (references unique by ``video_id``; rollouts without one aren't scored).
    ``diagnostics`` may add columns to the scored records, which are written too. What an earlier run of the epoch left is deleted
    first. If anything fails, ``failure.json`` says what, there is no ``metrics.json``, and the error is raised. Spark deals out
    the work, merges the parts, and runs lost ones again.
    """
    folder, spark = epoch_folder(root, epoch), rollouts.sparkSession
    clear_stale(rollouts, folder)
    try:
        records = record_metrics(rollouts, references)
        (diagnostics(records) if diagnostics else records).write.parquet(f"{folder}/scored")
        scored = spark.read.parquet(f"{folder}/scored")
        out = {"epoch_index": epoch, "num_scored_records": scored.count(), **metrics_of(scored)}
        write_text(spark, f"{folder}/metrics.json", json.dumps(out, indent=2))
    except Exception as e:
        write_text(spark, f"{folder}/failure.json", json.dumps({"error_type": type(e).__name__, "error": str(e)[:2000]}))
        raise
    return out
