"""Oracle trajectories with arguments, against steps written out by hand."""

import json

from pyspark.sql import functions as F
from test_views import record

from tessera.operators import oracle as oc
from tessera.operators import query_package as qp
from tessera.operators import views as vw


def steps(spark, *records):
    rows = oc.trajectories(vw.train_view(spark.createDataFrame(records, vw.RECORD))).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.video_id, r.step_index)):
        out.setdefault(r.video_id, []).append((r.tool_name, json.loads(r.arguments), json.loads(r.feedback) if r.feedback else None))
        assert r.step_index == len(out[r.video_id])
    return out


def test_a_normal_clip_is_searched_in_three_parts(spark):
    got = steps(spark, record("n", anomaly=None, is_anomaly=False, frames=100))["n"]
    assert [t for t, *_ in got] == ["scan_timeline", *["seek_evidence"] * 3, "verify_hypothesis", "finalize_case"]
    assert got[0][1] == {"start_sec": 0.0, "end_sec": 10.0, "stride_sec": 1.25, "purpose": "global_overview"}
    assert [(a["start_sec"], a["end_sec"]) for _, a, _ in got[1:4]] == [(0.0, 3.333333), (3.333333, 6.666667), (6.666667, 10.0)]
    assert got[1][1]["role"] == "normal_check" and got[1][1]["query_package"]["hypothesis"] == "check whether this interval remains normal" and "segment 1" in got[1][1]["query"]
    said, answer = got[4][1], got[4][2]
    assert said == {**answer, "claim": {"existence": "normal", "category": "normal"}} and answer["selected_window_ids"] == ["w0002", "w0003", "w0004"]
    assert (answer["verification_decision"], answer["sufficiency_score"]) == ("sufficient", 0.9) and got[5][1]["existence"] == "normal"


def test_moments_are_searched_by_role_and_spares_fill_up(spark):
    moments = [("m3", "confirmation", None, 71, 80), ("m1", "trigger", "a red car crashes", 51, 60)]
    got = steps(spark, record("v", moments=moments, alert=52))["v"]
    tools = [t for t, *_ in got]
    assert tools == ["scan_timeline", "seek_evidence", "emit_alert", "verify_hypothesis", "seek_evidence", "seek_evidence", "verify_hypothesis", "seek_evidence", "emit_alert", "verify_hypothesis", "finalize_case"]
    assert got[1][1]["moment_id"] == "m1" and (got[1][1]["start_sec"], got[1][1]["end_sec"]) == (5.0, 6.0) and got[1][1]["query_source"] == "oracle_key_objects"
    assert got[2][1] == {"decision": "soft_alert", "existence": "anomaly", "category": "traffic_accident", "earliest_alert_sec": 5.1}
    soft = got[3]
    assert soft[2]["verification_decision"] == "misaligned" and soft[2]["selected_window_ids"] == ["w0002"] and soft[1]["selected_evidence_moment_ids"] == ["m1"] and soft[1]["claim"] == {"existence": "anomaly", "category": "traffic_accident"}
    assert got[4][1]["moment_id"] == "m3" and got[5][1]["role"] == "precursor" and (got[5][1]["start_sec"], got[5][1]["end_sec"]) == (3.0, 5.0)
    assert got[6][2]["selected_window_ids"] == ["w0002", "w0003"] and got[6][1]["claim"]["earliest_alert_sec"] == 5.1
    assert got[7][1]["role"] == "peak_action" and (got[7][1]["start_sec"], got[7][1]["end_sec"]) == (5.45, 6.65)
    assert got[9][2]["verification_decision"] == "sufficient" and got[9][2]["selected_window_ids"] == ["w0002", "w0003"] and got[10][1]["evidence_moment_ids"] == ["m3", "m1"]


def test_many_moments_end_in_a_redundant_check(spark):
    moments = [(f"m{i}", r, None, 51 + i, 60 + i) for i, r in enumerate(["aftermath", "peak", "trigger", "confirmation", "precursor"])]
    got = steps(spark, record("v", moments=moments))["v"]
    assert [a["moment_id"] for t, a, _ in got if t == "seek_evidence" and "moment_id" in a] == ["m2", "m4", "m1", "m3"]  # a late precursor is a trigger; the fifth is left out
    decisions = [f["verification_decision"] for *_, f in got if f]
    assert decisions == ["misaligned", "insufficient", "redundant", "sufficient"]
    redundant = next(f for *_, f in got if f and f["verification_decision"] == "redundant")
    assert redundant["selected_window_ids"] == ["w0002", "w0003", "w0004", "w0005", "w0006"] and len(redundant["selected_evidence_moment_ids"]) == 4


def test_a_clip_without_moments_or_interval(spark):
    got = steps(spark, record("v", anomaly=None, frames=40), record("w", anomaly=(51, 80)))
    assert [t for t, *_ in got["v"]] == ["scan_timeline", "emit_alert", "seek_evidence", "seek_evidence", "seek_evidence", "emit_alert", "verify_hypothesis", "finalize_case"]
    assert [(a["start_sec"], a["end_sec"]) for t, a, _ in got["v"] if t == "seek_evidence"] == [(0.6, 2.2), (2.6, 4.0), (0.0, 4.0)]
    assert "selected_window_ids" not in got["v"][6][2] and got["v"][1][1]["earliest_alert_sec"] is None
    assert [a["role"] for t, a, _ in got["w"] if t == "seek_evidence"] == ["precursor", "peak_action", "confirmation"]


def test_searches_that_all_clips_share_are_no_columns(spark):
    plan = oc.trajectories(vw.train_view(spark.createDataFrame([record("n")], vw.RECORD)))._jdf.queryExecution().analyzed().toString()
    assert oc.BROAD_QUERY not in plan
    for s in oc.SPARES.values():
        row = spark.range(1).select(qp.normal_query(F.lit(s["query"])), qp.normal_query(qp.hypothesis_for(F.lit(s["role"])))).first()
        assert tuple(row) == (s["package"]["event_cue"], s["package"]["hypothesis"])
