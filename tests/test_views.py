"""Views of clip records: hand-computed times, every outcome for the span before an onset, and upgrades."""

from pyspark.sql import functions as F

from tessera.operators import views as vw


def record(i="v", anomaly=(51, 80), noted=None, moments=(), is_anomaly=True, alert=None, base=1, fps=10.0, frames=200, category="car crash", questions=True):
    meta = {"fps": fps, "total_frames": frames, "duration_sec": frames / fps}
    return {
        "video_id": i, "split": "train", "frame_index_base": base, "video_meta": meta, "scene": {"scenario": "street"}, "key_objects": ["red car and person"],
        "label": {"is_anomaly": is_anomaly, "category": category, "severity": 3, "hard_normal": False},
        "temporal": {"anomaly_interval_frames": list(anomaly) if anomaly else None, "precursor_interval_frames": list(noted) if noted else None, "earliest_alert_frame": alert},
        "evidence": {"evidence_moments": [dict(zip(("moment_id", "role", "description", "start_frame", "end_frame"), m, strict=True)) for m in moments]},
        "counterfactual": {"type": None, "text": None}, "language": {"summary": "s", "rationale": None},
        "qa_pairs": [{"type": "precursor_temporal", "question": "q", "answer": "a"}, {"type": "cause", "question": "q", "answer": "a"}] if questions else None,
    }


def base(spark, *records, **settings):
    return {r.video_id: r for r in vw.base_view(spark.createDataFrame(records, vw.RECORD), **settings).collect()}


def test_frames_become_seconds_and_roles_are_clean(spark):
    r = base(spark, record(anomaly=(30, 1), moments=[("m1", "precursor", "a red car", 1, 5), (None, "precursor", None, 40, 50), ("m3", None, None, 190, 260)], alert=12))["v"]
    assert r.temporal.anomaly_interval_sec == [0.0, 3.0] and r.temporal.earliest_alert_sec == 1.1 and r.schema_version == vw.VERSION
    got = [(m.moment_id, m.role, m.start_sec, m.end_sec) for m in r.evidence.evidence_moments]
    assert got == [("m1", "trigger", 0.0, 0.5), ("trigger_40_50", "trigger", 3.9, 5.0), ("m3", "unspecified", 18.9, 20.0)]
    assert r.label.category == "traffic_accident" and r.label.severity == 3 and r.proposal_supervision


def test_every_outcome_for_the_span_before_an_onset(spark):
    role = lambda s, e: ("p", "precursor", None, s, e)
    event = lambda s, e: ("q", "trigger", None, s, e)
    cases = {
        "normal": (record("normal", is_anomaly=False, noted=(1, 5)), ("not_applicable_normal", None, None, False)), "noted": (record("noted", noted=(50, 41)), ("annotation", [41, 50], [4.0, 5.0], False)),
        "noted alone": (record("noted alone", anomaly=None, noted=(41, 60)), ("annotation", [41, 60], [4.0, 6.0], False)),
        "role": (record("role", moments=[role(11, 20), role(31, 40), role(45, 55)]), ("evidence_precursor_role", [11, 40], [1.0, 4.0], False)),
        "role after note": (record("role after note", noted=(45, 51), moments=[role(11, 20)]), ("evidence_precursor_role", [11, 20], [1.0, 2.0], False)),
        "touching": (record("touching", moments=[role(41, 51), event(1, 9)]), ("non_strict_precursor_dropped", None, None, False)), "loose note": (record("loose note", noted=(45, 51)), ("non_strict_precursor_dropped", None, None, False)),
        "event": (record("event", moments=[event(1, 9), event(21, 30), event(49, 51)]), ("evidence_preceding_event", [1, 30], [0.0, 3.0], True)),
        "missing": (record("missing", anomaly=None, moments=[event(1, 9)]), ("missing_without_anomaly_interval", None, None, True)), "guess": (record("guess"), ("heuristic_preceding_window", [31, 50], [3.0, 5.0], True)),
        "long guess": (record("long guess", anomaly=(101, 300), frames=400), ("heuristic_preceding_window", [61, 100], [6.0, 10.0], True)), "short guess": (record("short guess", anomaly=(5, 9)), ("heuristic_preceding_window", [1, 4], [0.0, 0.4], True)),
        "none": (record("none", anomaly=(1, 9)), ("heuristic_unavailable", None, None, True)),
    }
    got = base(spark, *[r for r, _ in cases.values()])
    for name, (_, want) in cases.items():
        t = got[name].temporal
        assert (t.precursor_resolution.source, t.precursor_interval_frames, t.precursor_interval_sec, t.precursor_resolution.auto_completed) == want, name
        assert [q.type for q in got[name].qa_pairs] == (["precursor_temporal", "cause"] if want[0] == "annotation" else ["cause"])
    assert {w[0] for _, w in cases.values()} == {
        "not_applicable_normal", "annotation", "evidence_precursor_role", "non_strict_precursor_dropped", "evidence_preceding_event", "missing_without_anomaly_interval", "heuristic_preceding_window", "heuristic_unavailable",
    }


def test_training_parts_follow_the_base_view(spark):
    df = spark.createDataFrame([record(moments=[("m1", "trigger", "crash", 51, 60)], alert=51), record("n", anomaly=None, is_anomaly=False, category="whatever", base=0, questions=False)], vw.RECORD)
    rows = {r.video_id: r for r in vw.train_view(df, final_schema='{"type":"object"}').collect()}
    t, io = rows["v"].structured_target, rows["v"].tool_io
    assert (t.existence, t.category, t.anomaly_interval_sec, t.precursor_interval_sec, t.earliest_alert_sec, t.counterfactual_type, t.summary) == ("anomaly", "traffic_accident", [5.0, 8.0], [3.0, 5.0], 5.0, "none", "s")
    assert t.evidence_moment_ids == ["m1"] and t.evidence_windows_sec[0].window_sec == [5.0, 6.0] and io.oracle_windows_frames[0].window == [51, 60] and io.oracle_windows_sec[0].window == [5.0, 6.0]
    assert io.initial_scan_window_frames == [1, 200] and io.initial_scan_window_sec == [0.0, 20.0] and io.allowed_tools == vw.TOOLS and io.finalize_case_schema == '{"type":"object"}'
    n = rows["n"]
    assert (n.structured_target.existence, n.structured_target.category, n.structured_target.anomaly_interval_sec) == ("normal", "normal", None) and n.tool_io.initial_scan_window_frames == [0, 199] and n.qa_pairs == []


def test_only_rows_that_lack_a_part_are_made_anew(spark):
    df = spark.createDataFrame([record("whole"), record("part"), record("bare")], vw.RECORD)
    made = vw.train_view(df, F.lit("old words"))
    mixed = df.join(made.select("video_id", *vw.TRAIN_PARTS), "video_id")
    keep = F.col("video_id") == "whole"
    part = keep | (F.col("video_id") == "part")
    mixed = mixed.withColumns({"agent_task": F.when(part, F.col("agent_task")), "structured_target": F.when(keep, F.col("structured_target").withField("category", F.lit("by hand"))), "tool_io": F.when(part, F.col("tool_io"))})
    rows = {r.video_id: r for r in vw.upgrade(mixed, F.lit("new words")).collect()}
    assert {i: (r.upgraded, r.agent_task.task_prompt, r.structured_target.category) for i, r in rows.items()} == {
        "whole": (False, "old words", "by hand"), "part": (True, "new words", "traffic_accident"), "bare": (True, "new words", "traffic_accident"),
    }
    fresh = vw.upgrade(df, F.lit("new words"))
    assert fresh.where("upgraded").count() == 3 and set(fresh.columns) == set(vw.upgrade(mixed).columns)
