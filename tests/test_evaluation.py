"""An evaluation run over rollouts of the log: what it writes, what it clears, and how it fails."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import evaluation as ev
from tessera.operators.rollout_metrics import record_metrics, summary
from tessera.plans.metric_queries import _rollouts

SF = "/root/testdata/sf0.001"


def test_runs_write_scored_records_and_one_summary(spark, tmp_path):
    rollouts, references = _rollouts(spark, SF)
    folder = tmp_path / "rollout_eval" / "epoch_003"
    out = ev.evaluate(rollouts, references, str(tmp_path), 3)
    assert json.loads((folder / "metrics.json").read_text()) == out and not (folder / "failure.json").exists()
    records = record_metrics(rollouts, references)
    want = summary(records).first().asDict()
    assert out["epoch_index"] == 3 and out["num_scored_records"] == records.count() == out["num_records"]
    assert {k: out[k] for k in want} == pytest.approx(want) and 0 < out["existence_ap"] <= 1 and 0 <= out["category_macro_f1"] <= 1
    rows = sorted(((r.existence_score, r.is_anomaly, r.video_id) for r in records.collect()), key=lambda r: (-r[0], r[2]))
    hits = [i for i, r in enumerate(rows, 1) if r[1]]
    assert out["existence_ap"] == pytest.approx(sum(k / i for k, i in enumerate(hits, 1)) / len(hits), abs=1e-6)

    with pytest.raises(Exception, match="no_such_column"):
        ev.evaluate(rollouts, references, str(tmp_path), 3, diagnostics=lambda r: r.withColumn("x", F.col("no_such_column")))
    assert not (folder / "metrics.json").exists() and "no_such_column" in json.loads((folder / "failure.json").read_text())["error"]
    again = ev.evaluate(rollouts, references, str(tmp_path), 3, diagnostics=lambda r: r.withColumn("shard", F.crc32(F.col("video_id").cast("binary")) % 4))
    assert again == out and not (folder / "failure.json").exists() and "shard" in spark.read.parquet(str(folder / "scored")).columns
    assert ev.clear_stale(rollouts, str(folder)) == ["metrics.json", "scored"]


def test_a_run_without_references_is_empty(spark, tmp_path):
    rollouts, references = _rollouts(spark, SF)
    out = ev.evaluate(rollouts, references.limit(0), str(tmp_path), 0)
    assert out["num_records"] == 0 and out["existence_ap"] == 0 and out["category_macro_f1"] == 0 and out["temporal_miou"] == 0
