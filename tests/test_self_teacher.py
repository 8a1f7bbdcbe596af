"""Groups paid by the policy's own reports, against values computed by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import self_teacher as st
from tessera.operators import verify as vf

SCORES = "struct<sufficiency:double,necessity:double,alertability:double,counterfactual_faithfulness:double>"


def signal(scores=(0.8, 0.6, 0.9, 0.5), decision="sufficient", status="", alert="", teacher=0.4):
    held = F.struct(*[F.lit(v).alias(n) for n, v in zip(st.SCORES, scores, strict=True)]) if scores else F.lit(None).cast(SCORES)
    return st.policy_signal([F.lit(None).cast(SCORES), held], [F.lit(""), F.lit(decision)], [F.lit(status)], [F.lit(alert)], F.lit(teacher))


def windows(*rows):
    made = [F.struct(F.lit(i).alias("window_id"), F.lit("e" + i[1:]).alias("evidence_id"), F.lit("evidence").alias("kind"), F.lit(r).alias("role"), F.lit(float(s)).alias("start_sec"), F.lit(float(e)).alias("end_sec")) for i, r, s, e in rows]
    return F.array(*made).cast(f"array<{vf.WINDOW}>")


def ids(*names):
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def rows(spark, branches):
    got = st.ranked(spark.range(1).select("id", branches.cast(f"array<{st.BRANCH}>").alias("branches")), ["id"]).collect()
    return {r.branch_type: r for r in got}


def test_signals_fall_back_and_are_bounded(spark):
    one = lambda c: spark.range(1).select(c.alias("s")).first().s
    s = one(signal())
    quality = 0.35 * 1.0 + 0.20 * 0.6 + 0.15 * 0.2 + 0.15 * 0.0 + 0.15 * 0.8
    assert (s.has_signal, s.decision, s.primary_status, s.alert_status, s.teacher) == (True, "sufficient", "complete", "not_applicable", 0.4) and s.quality == pytest.approx(quality)
    s = one(signal(None, "", "Misaligned", "late", 7.0))
    assert (s.has_signal, s.primary_status, s.alert_status, s.teacher, s.quality) == (True, "misaligned", "late", 1.0, pytest.approx(-0.35 - 0.65))
    assert not one(signal(None, "", "", "", None)).has_signal and one(signal((3.0, -1.0, None, 0.5))).scores.sufficiency == 1.0


def test_searches_are_paid_for_what_they_add(spark):
    before, after = windows(("w1", "trigger", 0, 2)), windows(("w1", "trigger", 0, 2), ("w2", "peak", 4, 8))
    none = windows().cast(f"array<{vf.WINDOW}>")
    state = lambda ledger: F.struct(ledger.alias("ledger"), none.alias("visited"))
    got = rows(spark, st.search_branches(signal(), state(before), state(after), ids("w1", "w2"), ids(), ids("w1"), ids("w2"), ids("e2"), F.lit("guided_dpp"), F.lit(10.0)))
    q, cover = 0.62, 0.4
    use = 0.35 + 0.25 + 0.15 * 0.5 + 0.10 * q + 0.05 * 0.4 + 0.12 - 0.1 * cover
    skip, delta = 0.55 - 0.20 - 0.15 - 0.15 * 0.5 - 0.05 * 0.12, 0.30 + 0.35 + 0.20 * 0.5 + 0.05 * 0.4 - 0.05 * 0.1 * cover
    assert got["use_search"].branch_reward == pytest.approx(use) and got["skip_search"].branch_reward == pytest.approx(skip) and got["delta_only"].branch_reward == pytest.approx(delta)
    assert got["use_search"].selected_evidence_ids == ["e2"] and got["skip_search"].selected_evidence_ids == ["e1"] and got["delta_only"].selected_window_ids == ["w2"]
    assert got["use_search"].branch_reward_components["coverage_gain"] == cover and got["use_search"].branch_reward_components["proposal_quality_bonus"] == 0.12
    mean = (use + skip + delta) / 3
    spread = (sum((x - mean) ** 2 for x in (use, skip, delta)) / 3) ** 0.5
    assert got["use_search"].local_advantage == pytest.approx((use - mean) / (spread + 1e-6), abs=1e-6) and got["use_search"].group_reward_std == pytest.approx(spread, abs=1e-6)
    bare = rows(spark, st.search_branches(signal(None, "", "", "", None), state(none), state(none), ids(), ids(), ids(), ids(), ids(), F.lit("uniform"), F.lit(0.0)))
    assert bare["skip_search"].branch_reward == 0 and bare["use_search"].branch_reward == pytest.approx(0.1 * (-0.65)) and bare["delta_only"].branch_reward == 0


def test_alerts_are_paid_for_claims_and_time(spark):
    ledger = windows(("w1", "trigger", 0, 2))
    build = lambda claim, said, at, due=2.0: st.alert_branches(signal(), F.lit(claim), F.lit(due).cast("double"), F.lit(said), F.lit(at).cast("double"), ids("w1"), ids("e1"), ledger, ids("w1"))
    got = rows(spark, build("anomaly", "soft_alert", 6.0))
    assert got["alert_now"].branch_reward == pytest.approx(0.40 + 0.25 * 0.6 + 0.15 * 0.62 + 0.10 * 0.8 + 0.10 * 0.4) and got["hold_alert"].branch_reward == pytest.approx(-0.55 * 0.65 - 0.20 - 0.15 * 0.6 - 0.062)
    assert got["hold_alert"].selected_evidence_ids == ["e1"]
    assert rows(spark, build("normal", "declare_normal", None))["hold_alert"].branch_reward == pytest.approx(0.55 * 0.75 - 0.2 - 0.062)
    assert rows(spark, build("anomaly", "watch", 2.5))["alert_now"].branch_reward_components["claim_alert_consistency"] == -0.25
    assert spark.range(1).select(build(None, "soft_alert", 1.0).alias("b")).first().b is None


def test_selections_are_paid_for_reports(spark):
    ledger = windows(("w1", "confirmation", 0, 2), ("w2", "trigger", 2, 4), ("w3", "peak", 4, 6), ("w4", "", 6, 8))
    got = rows(spark, st.evidence_branches(signal(), ledger, ids("w1", "w2", "w3")))
    q, suff, nec, fair = 0.62, 0.6, 0.2, 0.0
    assert got["keep_selected"].branch_reward == pytest.approx(0.45 * q + 0.2 * suff + 0.2 * nec + 0.1 * fair + 0.02 - 0.25 * 0.1 * 0.75)
    assert got["full_ledger"].branch_reward == pytest.approx(0.35 * q + 0.2 * suff - 0.2 * nec - 0.1) and got["drop_selected"].branch_reward == pytest.approx(-0.45 * suff - 0.2 * q - 0.1 - 0.02)
    assert got["minimal_subset"].selected_window_ids == ["w2", "w3"] and got["minimal_subset"].branch_reward == pytest.approx(0.35 * q + 0.2 * suff + 0.3 * nec + 0.02 - 0.1 * 0.5)
    assert got["drop_selected"].selected_window_ids == ["w4"] and got["drop_selected"].branch_reward_components["drop_bonus"] == -0.5
    bare = rows(spark, st.evidence_branches(signal(), ledger, ids()))
    assert bare["full_ledger"].branch_reward == pytest.approx(got["full_ledger"].branch_reward + 0.35) and bare["minimal_subset"].selected_window_ids == []
    redundant = rows(spark, st.evidence_branches(signal(decision="redundant", status="complete"), ledger, ids("w1", "w2", "w3")))
    assert redundant["minimal_subset"].branch_reward == pytest.approx(got["minimal_subset"].branch_reward + 0.15) and redundant["full_ledger"].branch_reward == pytest.approx(got["full_ledger"].branch_reward - 0.15)
    assert spark.range(1).select(st.evidence_branches(signal(None, "", "", "", None), ledger, ids()).alias("b")).first().b is None
