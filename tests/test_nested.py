"""Credit between turns, nested summaries and payload layouts against hand-computed cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import credit as cr
from tessera.operators import nested as ns


def test_credit_spills_to_the_searches_of_chosen_evidence(spark):
    turn = "ep string, step_index int, tool_name string, action string, valid boolean, response string, new_evidence_ids array<string>, global_advantage double, teacher_reward double"
    turns = spark.createDataFrame(
        [
            ("a", 1, "scan_timeline", "tool_call", True, "r", [], 0.1, None), ("a", 2, "seek_evidence", "tool_call", True, "r", ["e1", "e2"], 0.2, None), ("a", 3, "seek_evidence", "tool_call", True, "r", ["e3"], 0.3, None),
            ("a", 4, "emit_alert", "tool_call", True, "r", None, 0.4, None), ("a", 5, "verify_hypothesis", "tool_call", True, "r", None, 0.5, 0.6), ("a", 6, None, "answer", True, "r", None, 0.6, None),
            ("a", 7, "seek_evidence", "tool_call", False, "r", ["e1"], 0.7, None), ("a", 8, "finalize_case", "tool_call", True, "", None, 0.8, None), ("b", 2, "seek_evidence", "tool_call", True, "r", ["e1"], -1.0, None),
        ],
        turn,
    )
    groups = spark.createDataFrame(
        [
            ("a", 2, "search", "g1", 1.0, None), ("a", 4, "alert", "g2", -1.0, ["e3"]), ("a", 5, "evidence", "g3", 0.8, ["e1", "e2", "e9"]), ("a", 6, "evidence", "g4", 0.4, ["e2", "e3"]), ("a", 6, "alert", None, 0.2, None),
        ],
        "ep string, step_index int, group_kind string, group_id string, local_advantage double, selected_evidence_ids array<string>",
    )
    got = {(r.ep, r.step_index): r for r in cr.counterfactual_examples(turns, groups, "ep").collect()}
    assert set(got) == {("a", i) for i in range(1, 7)} | {("b", 2)}  # no invalid turn, no turn without a response
    near = lambda r, *parts: tuple(r.components) == pytest.approx(parts)
    two = got["a", 2]  # its own group, and half of both evidence groups, once each
    assert near(two, 0.2, 0.5, 0.0, 0.5 * 0.4 + 0.5 * 0.2, 0.0) and two.group_ids == ["g1", "g3", "g4"]
    assert tuple(two.weights) == (1.0, 1.0, 0.0, 0.5, 0.0) and two.advantage == pytest.approx(0.2 + 0.5 + 0.5 * 0.3)
    assert near(got["a", 3], 0.3, 0.0, 0.0, 0.1, 0.0) and got["a", 3].group_ids == ["g4"]
    assert near(got["a", 4], 0.4, 0.0, -0.5, 0.0, 0.0) and got["a", 4].advantage == pytest.approx(-0.1) and got["a", 4].sample_weight == 0
    assert near(got["a", 5], 0.5, 0.0, 0.0, 0.4, 0.3) and got["a", 5].advantage == pytest.approx(0.5 + 0.4 + 0.3)
    assert near(got["a", 6], 0.6, 0.0, 0.1, 0.2, 0.0) and got["a", 6].advantage == pytest.approx(0.6 + 0.05 + 0.1) and got["a", 6].group_ids == ["g4"]
    assert near(got["b", 2], -1.0, 0.0, 0.0, 0.0, 0.0) and tuple(got["b", 2].weights) == (1.0, 1.0, 0.0, 0.0, 0.0)
    every = cr.counterfactual_examples(turns, groups, "ep", include_invalid=True).where("step_index = 7").first()
    assert every.components.evidence_local == pytest.approx(0.2) and every.group_ids == ["g3"]


def test_the_branch_that_happened_or_the_first(spark):
    rows = [("g", "keep", 2, "keep"), ("g", "drop", 1, "keep"), ("h", "full", 2, "keep"), ("h", "drop", 1, "keep"), ("i", "full", 3, None)]
    df = spark.createDataFrame(rows, "id string, branch string, place int, actual string")
    assert {(r.id, r.branch) for r in cr.actual_branches(df, ["id"], "branch", F.col("actual"), "place").collect()} == {("g", "keep"), ("h", "drop"), ("i", "full")}


def test_nested_values_are_summed_up_by_path(spark):
    rows = [{"a": {"x": 1, "s": "up"}, "l": [5, {"y": True}]}, {"a": {"x": 3.5, "s": "odd", "_p": 9}}, {"a": {"s": None}, "t": "z"}, {}, None]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.parse_json("j").alias("v"))
    got = {(r.path, r.value): (r.n, r.share, r.mean, r.least, r.most) for r in ns.summarize(df, "v", 4, {"a.s": ["up", "down"]}).collect()}
    assert got == {
        ("a.x", None): (2, 0.4, 2.25, 1.0, 3.5), ("l.0", None): (1, 0.2, 5.0, 5.0, 5.0), ("l.1.y", "true"): (1, 0.2, None, None, None), ("t", "z"): (1, 0.2, None, None, None),
        ("a.s", "up"): (1, 0.2, None, None, None), ("a.s", "down"): (0, 0.0, None, None, None), ("a.s", "unknown"): (4, 0.8, None, None, None), ("", None): (1, 0.2, None, None, None),
    }


def test_payloads_of_all_kinds_share_one_layout(spark):
    rows = [
        "[[1, 2], [3, 4], [5, 6]]", '{"embeddings": [[1.5], [2]], "fps": 4, "timestamps_sec": [9]}', '{"embeddings": [[1, 2]], "frame_indices": [7], "timestamps_sec": [0.25], "normalized": true, "model_name": "m", "version": "v9", "embedding_dim": 8, "frame_cache_signature": "s"}',
        '{"other": 1}', '"text"', "null", '{"embeddings": []}', '{"embeddings": [[1], [2]], "frame_indices": [], "fps": 0}',
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, j string")
    got = {r.i: r.p for r in df.select("i", ns.feature_payload(F.parse_json("j"), F.lit(2.0), F.array(F.lit(3), F.lit(5))).alias("p")).collect()}
    assert [i for i in got if got[i] is None] == [3, 4, 5]
    sig = lambda fps, frames: hashlib.sha1(json.dumps({"fps": fps, "frame_indices": frames, "num_frames": len(frames)}, sort_keys=True).encode()).hexdigest()
    assert tuple(got[0]) == (ns.BARE, "legacy_tensor", 2.0, [3, 5], [0.0, 0.5], [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], 2, False, sig(2.0, [3, 5]))
    assert tuple(got[1]) == (ns.FEATURES, "unknown", 4.0, [3, 5], [0.0, 0.25], [[1.5], [2.0]], 1, False, sig(4.0, [3, 5]))
    assert tuple(got[2]) == ("v9", "m", 2.0, [7], [0.25], [[1.0, 2.0]], 8, True, "s")
    assert got[6].embeddings == [] and got[6].embedding_dim == 0 and got[7].frame_indices == [3, 5] and got[7].fps == 2.0
    alone = df.where("i = 0").select(ns.feature_payload(F.parse_json("j")).alias("p")).first().p
    assert (alone.fps, alone.frame_indices, alone.timestamps_sec) == (1.0, [0, 1, 2], [0.0, 1.0, 2.0])


def test_payloads_are_parsed_once(spark):
    text = F.concat(F.col("id").cast("string"), F.lit("mentioned"))
    plan = spark.range(1).select(ns.feature_payload(F.parse_json(text)).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("mentioned") == 1  # in a lambda over frames each mention would be parsed for each frame
