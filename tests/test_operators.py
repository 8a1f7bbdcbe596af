"""Operators that SQL can't express, and the semantic traps, against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import intervals as iv
from tessera.functions import numeric as nm
from tessera.functions import sampling as sm
from tessera.functions import text as tx
from tessera.operators import aggregates, budget, joins, machine, metrics, query_package, records, reward, rollout_metrics, schema_check, self_report, sequence, shard, span_weights, vectors, verify
from tessera.operators import intervals as ops
from tessera.plans.machine_queries import replies
from tessera.sources import jsonl, manifest, transcripts
from tessera.streaming import episodes as stream

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(v):
    return F.lit(v)


def test_merge_random_intervals_and_touching(spark):
    rng = random.Random(1)
    rows = [(k, s, s + rng.choice([0, 1, 2, 5])) for k in range(20) for s in (rng.randint(0, 30) for _ in range(8))]
    got = {}
    for r in ops.merge(spark.createDataFrame([(k, float(s), float(e)) for k, s, e in rows], "k long, start_sec double, end_sec double"), ["k"]).collect():
        got.setdefault(r.k, []).append((r.start_sec, r.end_sec))
    for k in range(20):
        want = []
        for s, e in sorted((s, e) for q, s, e in rows if q == k):
            if want and s <= want[-1][1]:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        assert sorted(got[k]) == [(s, e) for s, e in want]


def test_touching_intervals_have_no_iou_but_merge(spark):
    assert one(spark, iv.iou(lit(0.0), lit(1.0), lit(1.0), lit(2.0))).c0 == 0
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0)], "k long, start_sec double, end_sec double")
    assert ops.merge(df, ["k"]).count() == 1


def test_interval_pairs_and_frames(spark):
    r = one(spark, iv.pair(F.array(lit(3.0), lit(1.0))), iv.pair(F.array(lit(3.0))), iv.frame_window(lit(1), lit(30), lit(1), lit(10.0), lit(99.0)), iv.strictly_before(lit(50), lit(50)))
    assert (r.c0.start, r.c0.end) == (1, 3) and r.c1 is None and (r.c2.start, r.c2.end) == (0.0, 3.0) and not r.c3


def test_greedy_matching_depends_on_order_and_never_takes_zero(spark):
    schema = "p array<struct<s:double,e:double>>, r array<struct<s:double,e:double>>"
    df = spark.createDataFrame([([(0.0, 10.0), (0.0, 4.0)], [(0.0, 5.0)]), ([(0.0, 1.0)], [(1.0, 2.0)]), ([(0.0, 1.0)], [])], schema)
    assert [r[0] for r in df.select(ops.greedy_matches(F.col("p"), F.col("r"), 0.0)).collect()] == [1, 0, 0]


def test_average_precision_keeps_input_order_on_ties(spark):
    df = spark.createDataFrame([("a", 0, 0.75, 1), ("a", 1, 0.75, 2), ("b", 1, 0.75, 1), ("b", 0, 0.75, 2), ("c", 0, 1.0, 1)], "k string, y int, s double, i long")
    got = {r.k: r.average_precision for r in metrics.average_precision(df, ["k"], "y", "s", "i").collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 0.0}


def test_heap_ties_keep_the_larger_line(spark):
    df = spark.createDataFrame([(1, 1, line) for line in range(1, 6)], "images int, messages int, line int")
    assert sorted(r.line for r in aggregates.heaviest(df, 2, "images", "messages", "line").collect()) == [4, 5]


def test_advantage_eps_is_strict_only_for_groups(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (2, 2.0), (3, 5.0)], "g long, r double")
    got = df.select("g", sequence.group_advantage(F.col("r"), [F.col("g")], clip=0.5).alias("a"), sequence.group_advantage(F.col("r"), [F.col("g")], clip=None, strict=False).alias("b")).collect()
    assert sorted((r.g, r.a) for r in got) == [(1, 0.0), (1, 0.0), (2, -0.5), (2, 0.5), (3, 0.0)] and max(r.b for r in got) == pytest.approx(1.0, abs=1e-5)


def test_discounted_returns(spark):
    assert one(spark, sequence.discounted(F.array(lit(1.0), lit(2.0), lit(4.0)), 0.5)).c0 == [3.0, 4.0, 4.0]


def test_rounding_is_half_even_for_frames(spark):
    r = one(spark, nm.half_even(lit(2.5)), nm.half_even(lit(3.5)), sm.spaced(lit(0), lit(5), lit(3)), sm.uniform(lit(4), lit(4), lit(9)), sm.strided(lit(0), lit(7), lit(3)))
    assert (r.c0, r.c1) == (2, 4) and r.c2 == np.round(np.linspace(0, 5, 3)).astype(int).tolist() and r.c3 == [4] and r.c4 == [0, 3, 6, 7]


def test_text_forms(spark):
    c = lambda s: lit(s)
    r = one(spark, tx.normal_query(c("The  red_car, AND a Van!")), tx.category(c("Fire or Explosion")), tx.category(c("Robust crowd")), tx.seconds(c("1:02:03.5")), tx.seconds(c("soon")), tx.clip_text(c("ab  cd" * 50), 20), nm.safe_int(c("3.7"), 9), tx.clean_category(c(" -Car / Crash- ")))
    assert (r.c0, r.c1, r.c2, r.c3, r.c4, r.c6, r.c7) == ("red car and van", "fire_or_explosion", "robbery", 3723.5, None, 9, "car_crash") and len(r.c5) <= 20 and r.c5.endswith("...")


def test_last_block_prefers_text_outside_thoughts(spark):
    t = "<think><answer>draft</answer></think>"
    r = one(spark, tx.last_block(lit(t + "<tool_call>x</tool_call> y")), tx.last_block(lit(t)), tx.last_block(lit("plain")))
    assert (r.c0, r.c1, r.c2) == ("<tool_call>x</tool_call>", "<answer>draft</answer>", "")


def test_last_reference_wins_and_selectors(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "k long, v string, o long")
    assert joins.last_wins(df, ["k"], "o").first().v == "b"
    led = spark.createDataFrame([(g, f"w{i}", f"e{i}", f"m{i % 2}", i) for g in (1, 2, 3) for i in range(4)], "g long, window_id string, evidence_id string, moment_id string, place long")
    sel = spark.createDataFrame([(1, 2, "m1"), (1, 0, "w3"), (1, 0, "w3"), (1, 1, "e9"), (2, 0, "zz")], "g long, kind int, ref string")
    got = {}
    for r in joins.resolve(led, sel, "g").collect():
        got.setdefault(r.g, []).append((r.position, r.window_id))
    assert {g: [w for _, w in sorted(v)] for g, v in got.items()} == {1: ["w3", "w1"], 3: ["w0", "w1", "w2", "w3"]}


def test_known_ids_and_aliases(spark):
    r = one(spark, joins.known_ids(F.array(lit(" b"), lit(""), lit("a"), lit("x"), lit("b")), F.array(lit("a"), lit("b"))), joins.alias_place(lit("evidence_2")), joins.alias_place(lit("w2")), joins.alias_place(lit("w0002")))
    assert r.c0 == ["b", "a"] and (r.c1, r.c2, r.c3) == (3, 2, None)


def test_contiguous_shards_match_their_bounds(spark):
    for total, n in ((10, 3), (7, 7), (59, 11), (5, 8)):
        got = [r[0] for r in spark.range(total).select(shard.contiguous(F.col("id"), lit(total), n)).collect()]
        assert got == [next(k for k in range(n) if total * k // n <= i < total * (k + 1) // n) for i in range(total)]


def test_global_numbers_without_gathering(spark):
    df = spark.range(1000, numPartitions=7).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r.x == r.ordinal for r in shard.numbered(df, ["x"]).collect())
    got = shard.numbered(df.withColumn("y", F.col("x") % 3), ["x"], "i", {"sum": "y"}).collect()
    assert all(r.i == r.x and r["sum"] == sum(k % 3 for k in range(r.x + 1)) for r in got) and shard.numbered(df.limit(0), ["x"]).count() == 0


def test_message_budget_drops_oldest_images(spark):
    df = spark.createDataFrame([(1, t, im) for t, im in enumerate([2, 0, 2, 3])], "c long, t long, im int")
    got = {r.t: r.kept_images for r in budget.prune_images(df, "c", "t", "im", 2, 4).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 3}


def test_verifier_truth_table(spark):
    z, o, no, yes = lit(0.0), lit(1.0), lit(False), lit(True)
    full = verify.supports(o, o, o, z, o, z)
    none = verify.supports(z, z, z, z, z, z)
    f, n = verify.overall(full, yes), verify.overall(none, yes)
    d = verify.derived(f, f, n, f)
    r = one(
        spark, verify.primary_status(f, f, n, full, d), verify.primary_status(f, n, f, none, verify.derived(f, n, f, n)), verify.primary_status(f, f, f, full, verify.derived(f, f, f, f)),
        verify.alert_status(no, lit(None).cast("double"), o, z), verify.alert_status(yes, lit(5.0), z, lit(1.0)), verify.alert_status(yes, lit(1.0), z, lit(1.0)), verify.overall(full, no),
        verify.next_action(lit("complete"), lit("late"), lit("soft_alert_check")), verify.next_action(lit("complete"), lit("late"), lit("final_check")), verify.next_action(lit("complete"), lit("justified"), lit("search_step_check")),
        verify.failure_reasons(lit("redundant"), lit("late")),
    )
    assert tuple(r)[:6] == ("complete", "misaligned", "redundant", "not_applicable", "late", "premature") and 0.9 < r.c6 <= 1
    assert tuple(r)[7:] == ("continue_search", "finalize", "finalize", ["selected_evidence_not_necessary_enough", "alert_after_expected_actionable_time"])


def state(windows, chosen=(), alert=None, existence="anomaly", roles=(), known=True, precursor=None, mode="soft_alert_check", visited=()):
    w = lambda rows: [(i, f"e{i}", k, r, float(s), float(e)) for i, k, r, s, e in rows]
    return (w(windows), w(visited), list(chosen), alert is not None, alert, mode, existence, (1.0, 8.0), precursor, 1.0, list(roles), known, 10.0)


STATE = (
    f"ledger array<{verify.WINDOW}>, visited array<{verify.WINDOW}>, chosen array<string>, has_alert boolean, alert_sec double, mode string, existence string, anomaly struct<start:double,end:double>, "
    "precursor struct<start:double,end:double>, earliest_alert double, roles array<struct<role:string,start_sec:double,end_sec:double>>, known boolean, duration double"
)


def test_verdicts_by_route(spark):
    three = [("w1", "seek", "trigger", 1, 4), ("w2", "seek", "peak_action", 4, 6), ("w3", "seek", "confirmation", 6, 8)]
    roles = [("trigger", 1.0, 4.0), ("peak_action", 4.0, 6.0), ("confirmation", 6.0, 8.0), ("precursor", 0.0, 1.0)]
    rows = [
        state(three, ["w1", "w2", "w3"], 1.0, roles=roles),  # all chosen: nothing is left to drop
        state(three, ["w3"], 1.0, roles=roles), state(three, ["nothing"], 1.0, roles=roles), state(three, existence="normal", known=False), state(three, known=False, existence=None),
        state([], roles=roles, visited=[("v1", "scan", "", 0, 9), ("v2", "seek", "", 1, 8)]), state(three, [], 9.0, roles=roles, precursor=(0.0, 1.0), mode="final_check"),
    ]
    got = [r.verdict for r in verify.verdicts(spark.createDataFrame(rows, STATE).coalesce(1)).select("verdict").collect()]
    full = got[0].view_scores.full
    assert (full.exist_support, full.category_support, full.temporal_support, full.precursor_support, full.alert_support, full.counterfactual_support) == (0.92, 0.92, 1.0, 0.0, 0.85, 0.96)
    assert full.overall_support == round((0.2 * (0.92 + 0.92 + 1 + 0.85) + 0.1 * 0.96) / 0.9, 6) and got[0].view_scores.drop.overall_support == 0
    assert (got[0].primary_status, got[0].alert_status, got[0].recommended_action) == ("complete", "justified", "finalize") and got[0].verified_window_ids == ["w1", "w2", "w3"]
    assert got[1].primary_status == "incomplete" and got[1].view_scores.alert_prefix.category_support == 0.78 and got[1].failure_reasons[0] == "selected_evidence_not_sufficient"
    assert got[2].primary_status == "misaligned" and got[2].verified_window_ids == got[2].best_effort_window_ids == []
    assert got[3].view_scores.full.exist_support == round(0.25 + 0.6 * 0.7 + 0.15, 6) and got[3].view_scores.full.precursor_support == 0
    assert got[4].view_scores.full.category_support == pytest.approx(0.9 * 0.7) and got[4].view_scores.drop.overall_support == 0
    assert got[5].view_scores.full.category_support == 0.92 and got[5].verified_window_ids == [] and got[5].best_effort_window_ids == ["v2"]
    assert got[6].view_scores.full.overall_support < full.overall_support and (got[6].alert_status, got[6].recommended_action) == ("justified", "finalize")


def test_counterfactual_groups_are_normalized_on_their_own(spark):
    three = [("w1", "seek", "trigger", 1, 4), ("w2", "seek", "peak_action", 4, 6), ("w3", "seek", "confirmation", 6, 8)]
    roles = [("trigger", 1.0, 4.0), ("peak_action", 4.0, 6.0), ("confirmation", 6.0, 8.0)]
    df = spark.createDataFrame([state(three, ["w1", "w2"], 1.0, roles=roles)], STATE)
    c, none = F.col, F.array().cast(f"array<{verify.WINDOW}>")
    at = lambda n, sec: F.struct(F.lit(n).alias("branch_type"), c("ledger").alias("ledger"), none.alias("visited"), F.lit(True).alias("has_alert"), F.lit(sec).alias("alert_sec"))
    before = F.struct(F.slice("ledger", 1, 1).alias("ledger"), none.alias("visited"))
    after = F.struct(c("ledger").alias("ledger"), none.alias("visited"))
    branches = F.concat(
        verify.alert_branches(F.array(at("now", 1.0), at("late", 3.0))), verify.evidence_branches(c("ledger"), c("chosen"), c("has_alert"), c("alert_sec")),
        verify.search_branches(before, after, c("has_alert"), c("alert_sec"), c("duration")),
    )
    got = {(r.group_kind, r.branch_type): r for r in verify.counterfactuals(df.withColumns({"id": F.lit(1), "branches": branches}), ["id"]).collect()}
    assert len(got) == 9 and got["evidence", "minimal_subset"].selected_window_ids == ["w1", "w2"] and got["evidence", "drop_selected"].selected_window_ids == ["w3"]
    for kind in ("alert", "evidence", "search"):
        own = [r for (k, _), r in got.items() if k == kind]
        z = np.array([r.branch_reward for r in own])
        assert np.allclose([r.local_advantage for r in own], (z - z.mean()) / (z.std() + 1e-6) if z.std() > 1e-6 else 0, atol=1e-5)
    assert got["alert", "late"].branch_reward_components["delay_penalty"] == pytest.approx(-0.2) and got["evidence", "full_ledger"].branch_reward_components["subset_size_penalty"] == pytest.approx(-0.1)
    assert got["search", "delta_only"].branch_reward_components["search_cost_penalty"] == pytest.approx(-0.04) and got["search", "skip_search"].selected_evidence_ids == ["ew1"]


def test_phrases_packages_and_moments(spark):
    f = lambda *p: query_package.expand_phrases(F.array(*[lit(x) for x in p]))
    r = one(spark, f("the victim in a red shirt and two dogs"), f("Fire", "fire "), f(" ", "-"), f("an attacker in dark uniform kicks a man lying on the road near the shop"))
    rows = lambda c: [tuple(q) for q in c]
    assert rows(r.c0) == [("victim in red shirt", "attribute_object", 0.9), ("two dogs", "object", 0.9), ("person in red shirt", "attribute_object", 1.0)]
    assert rows(r.c1) == [("fire", "event_relation", 1.0)] and r.c2 == []
    assert [q.text for q in r.c3] == ["person in dark uniform", "physical struggle", "person on ground"]
    moment = lambda i, role, d: F.struct(lit(i).alias("moment_id"), lit(role).alias("role"), lit(0.0).alias("start_sec"), lit(1.0).alias("end_sec"), lit(d).alias("description"))
    moments = F.array(moment("m1", "trigger", "a Dog barks"), moment("m2", "", "nothing"))
    groups = query_package.supervision(F.array(lit("small dog"), lit("blue car")), moments)
    r = one(spark, groups, query_package.query_for_moment(groups, F.get(moments, lit(0)), lit("x")), query_package.query_for_moment(F.array().cast(spark.range(1).select(groups.alias("g")).schema["g"].dataType), F.get(moments, lit(0)), lit("The Cue")))
    assert [g.linked_moment_ids for g in r.c0] == [["m1"], []] and (r.c1.text, r.c1.source, r.c2.text, r.c2.source) == ("small dog", "oracle_key_objects", "cue", "role_fallback")
    package = F.struct(lit(None).cast("string").alias("event_cue"), F.array(lit("Red-Bag"), lit("red bag"), lit("!!")).alias("key_objects"), lit(" ").alias("scene_context"), lit(None).cast("string").alias("hypothesis"), F.array(lit("smoke")).alias("negative_constraints"), lit("r").alias("rewrite_reason"))
    p = query_package.normal_package(package, lit("The RED bag"), lit("street"))
    good, bad = query_package.rendered(p)
    r = one(spark, p, good, bad)
    assert tuple(r.c0) == ("red bag", ["red bag", "!!"], "street", "red bag", ["smoke"], "r")
    assert rows(r.c1) == [("red bag", 0.4, "event_cue"), ("street", 0.1, "scene_context")] and rows(r.c2) == [("smoke", 0.15, "negative_constraints")]


def test_packages_for_moments(spark):
    moment = lambda i, role, d: F.struct(lit(i).alias("moment_id"), lit(role).alias("role"), lit(0.0).alias("start_sec"), lit(1.0).alias("end_sec"), lit(d).alias("description"))
    moments = F.array(moment("m1", "trigger", "a man falls near the dog"), moment("m2", "confirmation", "smoke"), moment("", "context", ""))
    made = spark.range(1).select(query_package.supervision(F.array(lit("man falling and a small dog"), lit("smoke"), lit("blue car")), F.slice(moments, 1, 2)).alias("g"), moments.alias("m"))
    df = spark.createDataFrame(made.collect(), made.schema)
    def package(g, i, query, source, scene):
        rows = df.select(g.alias("g"), F.get("m", lit(i)).alias("moment"))
        return query_package.with_package(rows, "g", "moment", lit(query), lit(source), lit(scene)).first().package

    a, b, c = package(F.col("g"), 0, "the cue", "", "A Street"), package(F.col("g"), 1, "the cue", "", None), package(F.slice("g", 1, 0), 2, "The cue", "model", None)
    assert tuple(a) == ("man falling", ["small dog"], "street", "suspected actionable event", [], "role_fallback")
    assert (b.event_cue, b.key_objects, b.hypothesis) == ("smoke", ["cue"], "suspected anomaly confirmation")
    assert tuple(c) == ("cue", [], "", "suspected anomaly context", [], "model")


def test_kinds_and_claims(spark):
    kinds = {"blue street": "scene_context", "man jackets": "attribute_object", "people whitsuit": "event_relation", "the of": "object", "green ball": "object", "robot": "event_relation"}
    assert list(one(spark, *[tx.query_kind(lit(k)) for k in kinds])) == list(kinds.values())
    e = lambda x, c, r=False: tx.claim_error(lit(x), lit(c), r)
    got = one(spark, e("anomaly", "", True), e("anomaly", ""), e("anomaly", "junk"), e("Normal", "fire"), e("anomaly", "normal"), e(None, "fire"), tx.category(lit("fire"), lit(" NORMAL ")), tx.normal_query(lit("man-woman's")))
    assert list(got) == ["missing_category", None, "unknown_category", "category_of_normal", "normal_category_of_anomaly", None, "normal", "man woman s"]


def test_self_reports_and_judges(spark):
    none = lit(None).cast("double")
    f = lambda p, has=False, sec=none, mode="": self_report.self_report(lit(p), sec, lit(1.0), lit(has), lit(mode))
    r = one(
        spark, f('{"verification_decision": " Sufficient", "sufficiency_score": 2, "necessity_score": null, "derived_scores": {"necessity": 0.9, "alertability": 0.7}, "selected_window_ids": [], "verified_window_ids": "w7", "rationale": "why"}', True, lit(9.0)),
        f('{"primary_status": "redundant", "failure_reasons": ["x", " "], "alert_status": "late", "verification_mode": "declare_normal", "candidate_window_ids": ["a", 2]}'), f("not json"),
        self_report.missing_fields(lit('{"verification_mode": 1, "selected_window_ids": [" "], "sufficiency_score": null, "necessity_score": 0, "alertability_score": 0, "counterfactual_faithfulness": 0, "recommended_action": ""}')),
        self_report.judge_labels(lit('{"primary_status": "incomplete", "sufficiency": 0.9, "necessity_score": 0.4}')), self_report.judge_labels(lit('{"teacher_judge_scores": {"sufficiency": 0.2}, "recommended_action": "refine_evidence", "explanation": " e "}')),
    )
    a, b, c = r.c0, r.c1, r.c2
    assert (a.verification_decision, a.recommended_action, a.primary_status, a.alert_status, a.confidence, a.rationale) == ("sufficient", "finalize", "complete", "justified", 1.0, "why")
    assert (a.derived_scores.sufficiency, a.derived_scores.necessity, a.derived_scores.consistency) == (1.0, 0.0, 0.0) and a.selected_window_ids == ["w7"] and a.verification_mode == "reward_only"
    assert (b.verification_decision, b.alert_status, b.verification_mode) == ("redundant", "late", "final_check") and b.failure_reasons == ["x"] and b.best_effort_window_ids == ["a", "2"]
    assert (c.verification_decision, c.recommended_action, c.alert_status, c.failure_reasons) == ("insufficient", "continue_search", "not_applicable", ["selected_evidence_not_sufficient"])
    assert r.c3 == ["selected_window_ids", "verification_decision"] and (r.c4.decision, r.c5.decision, r.c5.rationale, r.c5.scores.sufficiency) == ("sufficient", "redundant", "e", 0.2)


def test_reports_of_a_table_are_those_of_single_payloads(spark):
    payloads = [
        '{"verification_decision": " Sufficient", "sufficiency_score": 2, "necessity_score": null, "derived_scores": {"necessity": 0.9, "alertability": 0.7}, "selected_window_ids": [], "verified_window_ids": "w7", "rationale": "why"}',
        '{"primary_status": "redundant", "failure_reasons": ["x", " ", null], "alert_status": "late", "verification_mode": "declare_normal", "candidate_window_ids": ["a", 2, {"b": "\\u00e9"}]}',
        '{"sufficiency_score": true, "necessity_score": "0.25", "alertability_score": 1e-3, "derived_scores": {"consistency": null, "counterfactual_faithfulness": ".5"}, "selected_window_ids": "w1 ", "evidence_ids": [1.50, "q\\"x"]}',
        '{"derived_scores": [1, 2], "selected_window_ids": [" "], "recommended_action": "", "explanation": "e", "alert_status": 7, "best_effort_window_ids": 0}', '{"derived_scores": "n/a", "verification_decision": {"a": 1}}',
        "not json", "[1, 2]", "{}", "", None,
    ]
    df = spark.createDataFrame([(i, p, i % 3 != 0, float(i)) for i, p in enumerate(payloads)], "i int, p string, has boolean, sec double")
    args = (F.col("p"), F.col("sec"), lit(2.0), F.col("has"), lit("final_check"))
    parts = df.select("i", self_report.self_report(*args).alias("r"), self_report.missing_fields(F.col("p")).alias("lacks")).select("i", "r.*", "lacks")
    table = self_report.with_self_report(df, *args)
    assert sorted(table.select(parts.columns).collect()) == sorted(parts.collect())
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json(MapType") == 2  # the payload, and its scores


def test_reward_ladder(spark):
    yes, no, n, at = lit(True), lit(False), lit(None).cast("long"), lambda i: lit(i).cast("long")
    got = one(
        spark, reward.protocol(at(1), at(2), at(3), yes, yes, yes), reward.protocol(at(2), at(1), at(3), yes, yes, yes), reward.protocol(at(1), at(2), n, yes, no, no), reward.protocol(at(3), at(2), n, yes, no, no), reward.protocol(n, at(2), n, yes, no, no),
        reward.protocol(n, at(2), n, no, no, no), reward.protocol(at(1), n, at(2), yes, yes, yes), reward.protocol(at(1), n, at(2), yes, yes, no), reward.protocol(at(1), n, at(2), yes, no, yes), reward.protocol(n, n, n, yes, yes, no), reward.protocol(at(3), n, at(2), yes, yes, yes),
        reward.efficiency(yes, lit(30), lit(2)), reward.efficiency(no, lit(3), lit(0)), reward.invalid(lit(2)), reward.invalid(lit(9)),
    )
    assert list(got) == [1.0, -1.0, 1.0, -1.0, 1.0, -0.75, 0.5, -0.5, -1.0, -0.5, -0.5, -1.0, 0.0, -0.8, -1.0]
    assert reward.weights_of({"temporal_reward": 3})["temporal_grounding_reward"] == 3 and reward.weights_of(None) == reward.WEIGHTS


def test_rollout_evidence_and_validity(spark):
    w = lambda *rows: F.array(*[F.struct(lit(i).alias("window_id"), lit(float(s)).alias("start_sec"), lit(float(e)).alias("end_sec")) for i, s, e in rows])
    led = w(("a", 0, 1), ("b", 3, 2), ("c", 0, 1), ("d", 5, 6), ("", 8, 9))
    ids = lambda *x: F.array(*[lit(i) for i in x]).cast("array<string>")
    t = lambda a, s, v: F.struct(lit(a).alias("action"), lit(s).alias("said_valid"), lit(v).cast("boolean").alias("valid_action"))
    r = one(spark, rollout_metrics.predicted_windows(led, ids("d", "x", "a", "c"), lit(True)), rollout_metrics.predicted_windows(led, ids(), lit(True)), rollout_metrics.predicted_windows(led, ids("d"), lit(False)), rollout_metrics.validity(F.array(t("answer", False, None), t("answer", True, None), t("x", True, True), t("x", False, None))))
    assert [tuple(x) for x in r.c0] == [(5.0, 6.0), (0.0, 1.0)] and r.c1 == [] and [tuple(x) for x in r.c2] == [(0.0, 1.0), (2.0, 3.0), (5.0, 6.0)] and r.c3 == 0.5


def test_a_missing_span_overlaps_nothing(spark):
    span = lambda s, e: F.struct(lit(s).cast("double").alias("start"), lit(e).cast("double").alias("end"))
    none, b = lit(None).cast(rollout_metrics.SPAN), span(3, 7)
    r = one(spark, rollout_metrics.span_iou(none, b), rollout_metrics.span_iou(b, none), rollout_metrics.span_iou(span(3, None), b), rollout_metrics.span_iou(span(5, 7), b))
    assert (r.c0, r.c1, r.c2, r.c3) == (0.0, 0.0, 0.0, 0.5)


def test_a_bound_that_is_no_number_overlaps_nothing(spark):
    span = lambda s, e: F.struct(lit(s).cast("double").alias("start"), lit(e).cast("double").alias("end"))
    assert one(spark, rollout_metrics.span_iou(span(3, math.nan), span(3, 7))).c0 == 0.0


def test_means_do_not_hang_on_the_order_of_records(spark):
    errors = [0.31000000000000005, 1.99, 2.48, 1.42, 2.02, 0.27, 0.32000000000000006, 0.31999999999999984]  # their mean ends in a 5
    means = set()
    for shift in (0, 3):
        rows = [(True, True, x) for x in errors[shift:] + errors[:shift]]
        df = spark.createDataFrame(rows, "is_anomaly boolean, said_anomaly boolean, severity_error double").coalesce(1)
        nulls = {c: lit(None).cast("double") for c in rollout_metrics.MEANS.values() if c != "severity_error"}
        means.add(rollout_metrics.summary(df.withColumns(nulls)).first()["severity_mae"])
    assert means == {1.14125}
    r = spark.createDataFrame([(1.0, 1e300, math.nan), (2.0, 3e300, 1.0)], "a double, b double, c double").agg(*[nm.exact_mean(F.col(x)).alias(x) for x in "abc"]).first()
    assert (r.a, r.b) == (1.5, 2e300) and math.isnan(r.c)


def test_view_scores_are_clamped_by_part_and_whole(spark):
    n = lit(None).cast("double")
    r = one(spark, nm.view_score(n, [lit(0.02), lit(1.2)]), nm.view_score(lit(1.3), [lit(0.0)]), nm.view_score(n, [n, lit(0.5)]), nm.view_score(n, [lit(-1.0), lit(0.5)]))
    assert list(r) == [0.51, 1.0, 0.25, 0.25]


def test_phrases_are_expanded_once(spark):
    df = spark.range(1).select(F.array(F.col("id").cast("string")).alias("p"), F.array(F.struct(*[F.lit("x").alias(c) for c in ("moment_id", "role", "description")], *[F.lit(0.0).alias(c) for c in ("start_sec", "end_sec")])).alias("m"))
    plan = df.select(query_package.supervision(F.col("p"), F.col("m")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("bag snatch") == 1  # each mention of an expansion would be computed anew


def test_a_report_decision_reads_its_status_once(spark):
    plan = spark.range(1).select(self_report._mapped(F.concat(F.col("id").cast("string"), lit("mentioned")), self_report.STATUS_OF, "incomplete").alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("mentioned") == 1


def test_greedy_determinants_match_slogdet():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(2, 12))
        k = vectors.kernel(rng.standard_normal((n, 4)), rng.random(n) * 5, rng.random(n))
        chosen = []
        while len(chosen) < min(4, n):
            best, at = -math.inf, -1
            for i in range(n):
                if i not in chosen:
                    s, v = np.linalg.slogdet(k[np.ix_([*chosen, i], [*chosen, i])] + vectors.JITTER * np.eye(len(chosen) + 1))
                    if s > 0 and v > best + 1e-9:
                        best, at = v, i
            if at < 0:
                break
            chosen.append(at)
        assert vectors.greedy_map(k, 4) == chosen


def call(tool, **args):
    return f'<think>I would <answer>{{}}</answer></think><tool_call>{json.dumps({"name": tool, "arguments": args})}</tool_call>'


REPORT = {"verification_mode": "normal_check", "verification_decision": "sufficient", "recommended_action": "", "sufficiency_score": 0.9, "necessity_score": 0.4, "alertability_score": 0.2, "counterfactual_faithfulness": 0.5}


def test_replies_are_read():
    read = machine.read_reply
    assert read(call("seek_evidence", start_time="1:05", end_sec="7s")) == ("tool_call", "seek_evidence", {"start_sec": 65.0, "end_sec": 7.0})
    assert read('<tool_call>{emit_alert: {"alert_type": "Hard", "description": "d"}}</tool_call>')[2] == {"alert_type": "Hard", "description": "d", "decision": "hard_alert", "reason": "d", "existence": "anomaly"}
    assert read('<tool_call>{"scan_timeline": {"a": 1}}</tool_call>')[:2] == ("tool_call", "scan_timeline") and read("<answer>{}</answer>")[0] == "answer"
    assert read("<answer>yes</answer>")[0] == "invalid_answer" and read("<think><answer>{}</answer></think>")[0] == "answer"
    assert {read(t)[0] for t in (None, "", "text", "<tool_call>[1]</tool_call>", "<tool_call>{a}</tool_call>", '<tool_call>{"name": "", "arguments": {}}</tool_call>', '<tool_call>{"x": 1, "y": 2}</tool_call>')} == {""}


def test_machine_categories_follow_the_column_rules(spark):
    raws = ["", "Car - Crash", "object", "falling object", "bag snatch", "fire or explosion", "smoke", "x_y", "punch", "slip", "water main", "collision", "robber fell", "trip"]
    got = spark.createDataFrame([(r,) for r in raws], "r string").select("r", tx.category(F.col("r")).alias("c")).collect()
    assert {r.r: r.c for r in got} == {r: machine.category(r) for r in raws} and machine.category("fire", "Normal") == "normal"


def test_machine_windows_alerts_and_claims():
    clip = machine.Clip(10.0, 2.0)
    s, a = machine.step(machine.State(), call("scan_timeline", start_sec=0, end_sec=99, role="x"), clip)
    s, b = machine.step(s, call("seek_evidence", start_time="2s", end_time=4, num_frames=3, role="trigger", moment_id="m1"), clip)
    s, c = machine.step(s, call("seek_evidence", start_sec=8, end_sec=1, stride_sec=0.5), clip)
    assert (a["window_id"], a["evidence_id"], a["end_sec"], a["image_count"], b["evidence_id"], b["timestamps"], c["start_sec"], c["end_sec"], c["image_count"]) == ("w0001", None, 10.0, 8, "e0002", [2.0, 3.0, 4.0], 8.0, 8.0, 1)
    assert [w[0] for w in s.ledger] == ["w0002", "w0003"] and s.ledger[0][3:5] == ("trigger", "m1") and s.visited[0][3] is None
    s, bad = machine.step(s, call("emit_alert", decision="soft_alert", existence="anomaly"), clip)
    s, odd = machine.step(s, call("emit_alert", decision="declare_normal", category="fire"), clip)  # a normal claim's category is normal, whatever it says
    assert not bad["valid_action"] and odd["valid_action"] and s.claim == {"existence": "normal", "category": "normal"}
    s, _ = machine.step(s, call("emit_alert", alert_type="soft", category="House fire", alert_sec="3s"), clip)
    assert s.alerts[-1]["alert_id"] == "a0002" and s.claim == {"existence": "anomaly", "category": "fire", "earliest_alert_sec": 3.0} and s.invalid == 1
    # Where the first evidence window isn't w0001, numbers count evidence windows.
    for i, want in (("evidence_0", "w0002"), ("w_1", "w0003"), ("w2", "w0003"), ("w0002", "w0003"), ("w0003", "w0003")):
        r = machine.resolve(s, {"selected_window_ids": [i, "zz"]})
        assert r["resolved"] == [want] and r["invalid"] == ["zz"], i
    assert machine.resolve(s, {"evidence_moment_ids": ["m1"], "candidate_window_ids": ["w0003"]})["resolved"] == ["w0002"]
    assert machine.resolve(s, {"candidate_window_ids": ["w0003", "q"]})["source"] == "candidate_window_ids" and machine.resolve(s, {"selected_evidence_ids": ["e9"]})["source"] == "unresolved"


def test_machine_verifies_by_three_routes():
    clip = machine.Clip(10.0)
    s = machine.State()
    for a, b in ((0, 3), (3, 6), (6, 9)):
        s, _ = machine.step(s, call("seek_evidence", start_sec=a, end_sec=b), clip)
    s, _ = machine.step(s, call("emit_alert", alert_type="hard", category="fire", earliest_alert_sec=1, alert_sec=4), clip)
    own, r = machine.step(s, call("verify_hypothesis", **REPORT, selected_window_ids=["w0002", "w9"]), clip)
    assert (r["parse_mode"], r["verification_mode"], r["decision"], r["primary_status"], r["alert_status"], r["recommended_action"], r["confidence"]) == ("self_report", "final_check", "sufficient", "complete", "late", "finalize", 0.9)
    assert own.active == ("w0002",) and r["invalid_selected_window_ids"] == ["w9"] and r["failure_reasons"] == ["alert_after_expected_actionable_time"] and r["scores"]["consistency"] == 0.5
    for lacking in ({k: v for k, v in REPORT.items() if k != "necessity_score"} | {"selected_window_ids": ["w0001"]}, REPORT | {"selected_window_ids": ["w9"]}, {}, {"query": "q"}, {"query": " "}):
        t, r = machine.step(s, call("verify_hypothesis", **lacking), clip)
        assert not r["valid_action"] and t.invalid == 1 and "verify_hypothesis again" in r["observation"] and "w0001" in r["observation"]
    _, r = machine.step(s, call("verify_hypothesis", candidate_window_ids=["w0001"], allow_external_verifier_fallback=True), clip)
    assert (r["parse_mode"], r["verified_window_ids"], r["scores"]["sufficiency"]) == ("external_verifier_fallback", ["w0001"], round(0.4 * (0.2 + 0.18 + 0.17 + 0.04 + 0.15 + 0.08), 6)) and r["primary_status"] == "incomplete"
    _, r = machine.step(s, call("verify_hypothesis", query="q", claim={"existence": "normal"}), machine.Clip(10.0, legacy=True))
    assert r["parse_mode"] == "legacy_compatibility" and r["verified_window_ids"] == ["w0001", "w0002", "w0003"] and r["scores"]["sufficiency"] > 0.8
    _, r = machine.step(s, call("verify_hypothesis", selected_window_ids=["w9"], query="q"), machine.Clip(10.0, external=True))
    assert r["verified_window_ids"] == r["best_effort_window_ids"] == [] and "selected_evidence_not_resolved_to_known_windows" in r["failure_reasons"] and r["selection_source"] == "unresolved"
    assert not machine.step(s, call("verify_hypothesis", query="q"), machine.Clip(external=True, no_external=True))[1]["valid_action"]


def test_machine_ends():
    clip = machine.Clip(final_schema={"required": ["severity"], "properties": {"severity": {"type": "integer"}, "category": {"type": "string"}}})
    s, r = machine.step(machine.State(), call("finalize_case", existence="anomaly", category="theft"), clip)
    t, u = machine.step(s, call("finalize_case", existence="anomaly", category="theft", severity="3"), clip)
    assert not r["valid_action"] and not u["valid_action"] and t.invalid == 2
    s, r = machine.step(t, call("finalize_case", existence="anomaly", category="theft", severity=3), clip)
    assert r["done"] and s.ended == "finalized" and s.final["category"] == "robbery" and machine.step(s, call("scan_timeline"))[0] == s
    assert machine.State.from_json(s.to_json()) == machine.State(turns=1, invalid=2, ended="finalized") and machine.step(t, "<answer>{}</answer>")[0].ended == "answered"
    live, _ = machine.step(machine.State(), call("seek_evidence", end_sec=3), machine.Clip(9.0))
    assert machine.State.from_json(live.to_json()) == live
    s = machine.State()
    while not s.ended:
        s, _ = machine.step(s, "nonsense")
    assert s.ended == "max_attempts" and s.invalid == machine.ATTEMPTS_PER_TURN * machine.MAX_TURNS + 1
    s = machine.State()
    while not s.ended:
        s, _ = machine.step(s, call("scan_timeline"))
    assert s.ended == "max_turns" and s.turns == machine.MAX_TURNS


def test_stream_equals_batch(spark, tmp_path):
    turns = replies(spark, SF).where("step_index <= 70")
    for i, (lo, hi) in enumerate(((1, 5), (6, 12), (13, 70))):
        turns.where(F.col("step_index").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = stream.read_replies(spark, str(tmp_path / "in"))
    q = stream.replay_stream(files).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(machine.replay(turns))


def test_stream_windows_equal_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e"))
    for name, f in (("counts", stream.tool_counts), ("sessions", stream.sessions)):
        q = f(live).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").trigger(availableNow=True).start()
        q.awaitTermination(240)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == ev.count()
    assert spark.table("sessions").count() <= f(ev).count()


def test_schema_errors(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "number"}, "b": {"type": "array", "minItems": 1, "items": {"enum": ["x", "y"]}}, "c": {"oneOf": [{"type": "null"}, {"type": "string"}]}}}
    texts = ['{"a": 1.5, "b": ["x"]}', '{"a": true, "b": []}', '{"b": ["z"], "a": 1, "c": 3}', "nope", None, '{"a": 1}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(schema_check.schema_errors(F.col("t"), schema)).collect()]
    assert got[0] == [] and got[1] == ["$.a: not number", "$.b: fewer than 1 items"] and got[2] == ["$.b[0]: not one of ['x', 'y']", "$.c: not exactly one form fits"] and got[3] == got[4] == ["$: not JSON"] and got[5] == ["$.b: missing"]


def test_span_weights(spark):
    t = '<think>hm</think><answer>{"decision": "go", "n": 12, "z": "ab"}</answer>'
    w = span_weights.char_weights(t, ["ab"])
    at = lambda s: w[t.index(s)]
    assert (at("<think>"), at("hm"), at('"decision"'), at('"go"'), at("12"), at("ab"), at("{"), at("</answer>")) == (0.15, 0.35, 0.8, 1.35, 1.15, 2.5, 0.2, 0.15)
    assert spark.createDataFrame([(t,), (None,)], "t string").select(span_weights.response_weights(F.col("t"), ["ab"])).collect()[0][0] == w


def test_jsonl_sources(spark, tmp_path):
    schema = spark.createDataFrame([], "video_id string, split string").schema
    good = tmp_path / "a.jsonl"
    good.write_text('{"video_id": "v1", "split": " train"}\n\n{"video_id": "v2", "split": null}\n{"video_id": "v3", "split": "test"}\n')
    assert {r.video_id for r in jsonl.read_jsonl(spark, str(good), schema, ["train", ""]).collect()} == {"v1", "v2"}
    assert [(r.line_number, r.line[:5]) for r in jsonl.numbered_lines(spark, str(good)).orderBy("line_number").collect()][1] == (2, "")
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"video_id": "v1"}\n\n{"video_id": \n')
    with pytest.raises(jsonl.MalformedLine, match=r"b\.jsonl:3: "):
        jsonl.read_jsonl(spark, str(bad), schema)
    assert jsonl.read_jsonl(spark, str(bad), schema, skip_invalid=True).count() == 1
    many = tmp_path / "many"
    many.mkdir()
    (many / "x.json").write_text(json.dumps([{"video_id": "j1"}, {"video_id": "j2"}]))
    (many / "y.json").write_text(json.dumps({"video_id": "j3"}, indent=1))
    (many / "z.jsonl").write_text('{"video_id": "j4"}\n')
    df = jsonl.read_records(spark, str(many), schema)
    assert {r.video_id for r in df.collect()} == {"j1", "j2", "j3", "j4"} and df.select("source_file").distinct().count() == 3
    jsonl.write_jsonl(df.drop("source_file"), str(tmp_path / "out"), one_file=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    jsonl.write_records(df.select(F.lit(12).alias("i"), F.lit("a/b").alias("n"), "video_id").limit(1), str(tmp_path / "each"), "i", "n")
    assert (tmp_path / "each" / "record=000012_a_b").is_dir()


def test_transcripts(spark):
    lines = [(1, '{"role": "user", "content": "hi"}'), (2, '{"payload": {"role": "assistant", "content": [{"text": "a"}, {"content": ["b", {"text": ""}]}]}}'), (3, "junk"), (4, '{"role": "robot", "content": "x"}')]
    got = {r.line_number: r.markdown for r in transcripts.to_markdown(spark.createDataFrame(lines, "line_number long, line string")).collect()}
    assert got == {1: "## User\n\nhi\n", 2: "## Assistant\n\na\nb\n"}


def test_incremental_build(spark):
    items = spark.createDataFrame([("a", "1"), ("b", "none"), ("c", "boom"), ("d", "4")], "k string, p string")
    done = spark.createDataFrame([("d",)], "k string")

    def make(p):
        if p == "boom":
            raise ValueError("broken")
        return None if p == "none" else p.encode()

    assert {(r.k, r.status) for r in manifest.build(items, done, "k", "p", make).collect()} == {("a", "built"), ("b", "missing"), ("c", "failed")}
    assert manifest.build(items, done, "k", "p", make, overwrite=True).count() == 4
    cov = {r.missing: (r.n, r.first_missing) for r in manifest.coverage(items, done, "k", 2).collect()}
    assert cov == {True: (3, ["a", "b"]), False: (1, ["a", "b"])}
    with pytest.raises(manifest.ConfigMismatch, match="fps"):
        manifest.require_config({"fps": 2}, {"fps": 4})
    manifest.require_config({"fps": 2}, {"fps": 2})


# The reference's rules by value (categories.py:21-100, proposal.py:15-36).
CATEGORY_OF = {
    "traffic_accident": "vehicle_collision vehicle_crash vehicle_accident collision car_crash traffic_collision heavy_traffic train_collision crashing a_vehicle_accident",
    "fighting": "physical_altercation violent_confrontation brawl street_fight verbal_altercation a_brawl confrontation",
    "people_falling": "fall falling falling_or_tripping slip_and_fall tripping slipped people_fall",
    "shooting": "person_with_weapon gun_violence armed_shooting shooter gunman weapons firearm",
    "robbery": "theft bag_snatch bag_theft stealing robbed snatching steals thefts",
    "vandalism": "vandals graffiti property_damage", "object_falling": "object_fell_falling dropped_object falling_objects", "assault": "attacked attack punch kicked beating assaulting",
    "water_incident": "underwater drown drowning", "explosion": "explosions blast explode", "fire": "house_fire flames smoke", "normal": "normal",
    "": "", "object": "object", "fire_or_explosion": "fire_or_explosion", "car_accident": "car_accident", "no_anomaly": "no_anomaly",
}


def test_categories_and_stopwords_are_the_references(spark):
    pairs = [(raw, want) for want, raws in CATEGORY_OF.items() for raw in (raws.split() or [""])]
    pairs += [("Bag/Snatch", "robbery"), ("  Car - Crash ", "traffic_accident"), (None, "")]
    df = spark.createDataFrame(pairs, "raw string, want string").select("raw", "want", tx.category(F.col("raw")).alias("got"))
    assert [r for r in df.collect() if r.got != r.want] == []
    said = "a an the and or of to in on at by for with before after near another other potential look is was this person"
    got = spark.createDataFrame([(said,)], "q string").select(tx.tokens(F.col("q")).alias("t")).first().t
    assert got == ["is", "was", "this", "person"]


def test_replay_counts_replies_not_step_numbers(spark):
    rows = [(1, 1000 * (i + 1), call("seek_evidence", end_sec=1) if i % 2 else "?") for i in range(100)]
    got = machine.replay(spark.createDataFrame(rows, "episode_id long, step_index long, reply string"), machine.Clip(9.0)).orderBy("step_index").collect()
    assert len(got) == 28 and got[-1].ended == "max_turns" and got[-1].turns == 14 and [r.step_index for r in got] == [1000 * (i + 1) for i in range(28)]



def test_places_and_toggles(spark):
    assert records.parse_places(" 3, 5-7,,9 - 8 ") == [3, 5, 6, 7, 9, 8] and records.resolve_places(4, start=2) == [2, 3] and records.resolve_places(9, "", 3, 2) == [3, 4]
    for bad in ((4, "9"), (4, "", 4), (4, "", 0, -1), (0, "")):
        with pytest.raises(ValueError):
            records.resolve_places(*bad)
    assert records.enabled_groups() == dict.fromkeys(records.GROUPS, True) and records.enabled_groups(alert=True, search=False) == {"search": False, "alert": True, "evidence": False}
    df = spark.createDataFrame([(i, f"r{i}") for i in range(6)], "i long, r string")
    assert [(r.asked, r.r) for r in records.take_places(df, "i", [4, 1, 4]).orderBy("asked").collect()] == [(0, "r4"), (1, "r1"), (2, "r4")]


def test_merged_shards_must_be_whole(spark):
    dealt = spark.createDataFrame([(i % 2, i) for i in range(6)], "shard int, ordinal int")
    assert [r.ordinal for r in records.merge_shards(dealt, dealt).collect()] == list(range(6))
    for broken in (dealt.where("ordinal <> 3"), dealt.unionByName(dealt.where("ordinal = 2")), dealt.limit(0)):
        with pytest.raises(records.IncompleteShards):
            records.merge_shards(broken, dealt)


def test_sinks_keep_their_layout_and_logs_grow(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    for name, text, layout in (("x.json", ' \n [{"i": 1}]', "list"), ("y.json", '{"i": 1}', "object"), ("z.jsonl", '{"i": 1}', "lines")):
        (tmp_path / name).write_text(text)
        assert jsonl.layout_of(spark, str(tmp_path / name)) == layout
    jsonl.write_like(df, str(tmp_path / "list"), "list")
    assert json.loads(spark.read.text(str(tmp_path / "list")).first().value) == [{"i": 1, "t": "a"}, {"i": 2, "t": "b"}]
    jsonl.write_like(df.limit(1), str(tmp_path / "one"), "object")
    assert json.loads(spark.read.text(str(tmp_path / "one")).first().value) == {"i": 1, "t": "a"}
    with pytest.raises(ValueError):
        jsonl.write_like(df, str(tmp_path / "two"), "object")
    for _ in range(2):
        jsonl.append_jsonl(df, str(tmp_path / "log"))
    assert spark.read.schema("i int").json(str(tmp_path / "log")).count() == 4


def test_quantiles_by_rank_equal_numpy(spark):
    rng = random.Random(31)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([rng.gauss(0, 9), float(rng.randint(0, 3)), None])) for _ in range(2000)] + [("one", 7.0), ("none", None)]
    got = {r.k: r.q for r in aggregates.quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.0, 0.25, 0.5, 0.99, 1.0)).collect()}
    for k in {r[0] for r in rows} - {"none"}:
        assert got[k] == pytest.approx(np.quantile([v for i, v in rows if i == k and v is not None], (0.0, 0.25, 0.5, 0.99, 1.0)).tolist(), abs=1e-12)
    assert "none" not in got
    p = {r.k: r for r in aggregates.profile(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert p["none"].n == 0 and p["none"].median is None and p["one"].p99 == 7.0 and p[None].median == round(float(np.quantile([v for i, v in rows if i is None and v is not None], 0.5)), 6)


def test_iterations_go_round_and_reports_keep_their_cadence(spark):
    df = spark.range(10).select(F.col("id").alias("ordinal"), (F.col("id") * 10).alias("v"))
    got = [(r.dataset_index, r.v, r.generation_id, r.group_id) for r in records.rollout_specs(df, "ordinal", 3, 2, 4, 2).collect()]
    assert sorted(got) == [(i, 10 * i, g, f"{i:06d}") for i in (1, 2, 3, 4) for g in (0, 1)]
    assert sorted(r.dataset_index for r in records.rollout_specs(df, "ordinal", 8, 0, 4, 1).collect()) == [0, 1, 8, 9]
    assert records.rollout_specs(df, "ordinal", 0, 7, 40, 1).count() == 10 and records.rollout_specs(df.limit(0), "ordinal", 0, 0, 4, 1).count() == 0
    assert sorted(r.done for r in records.at_cadence(df, "ordinal", 4).collect()) == [1, 4, 8, 10] and sorted(r.done for r in records.at_cadence(df, "ordinal", 0).collect()) == [1, 10]


def test_a_scope_drops_what_was_stored_inside(spark):
    from tessera import storage

    outer = storage.Stored(spark.range(3))
    with storage.scope():
        inner = storage.Stored(spark.range(4))
        early = storage.Stored(spark.range(5))
        early.drop()
        assert inner.df.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(inner.path).count()
    assert outer.df.count() == 3
    outer.drop()
