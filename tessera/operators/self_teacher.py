"""Counterfactual groups without a verifier: branches of a turn are paid by what the policy itself reported, and by its judge.

Each builder gives the branches of one anchor turn as an array; ``ranked`` puts them on rows with their advantage in their group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reward import PRIMARY, lookup
from .self_report import STATUS_OF
from .verify import clip_share, evidence_ids, minimal_subset

# What a search is paid for the way its frames were found, when an alert is on time, and what holding an alert is worth by claim.
BACKENDS = {"guided_dpp": 0.12, "feature_topk": 0.10}
ON_TIME, HOLD = 0.5, {"normal": 0.75, "anomaly": -0.65}
SCORES = ("sufficiency", "necessity", "alertability", "counterfactual_faithfulness")
BRANCH = "struct<group_kind:string,branch_type:string,selected_window_ids:array<string>,selected_evidence_ids:array<string>,branch_reward:double,branch_reward_components:map<string,double>>"
IDS = "array<string>"


def _signed(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def _text(*given: Column) -> Column:
    """The first of them that isn't empty, trimmed and in lower case."""
    return F.lower(F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in given], F.lit(""))))


def policy_signal(scores: Sequence[Column], decisions: Sequence[Column], statuses: Sequence[Column], alert_statuses: Sequence[Column], teacher_reward: Column) -> Column:
    """What a turn says of its own verification: ``has_signal, decision, primary_status, alert_status, scores, quality, teacher``.

    Of each argument's columns the first that holds something counts (the turn's own, then its last record's, then the verifier's).
    """
    held = F.coalesce(*scores)
    unit = {s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(held[s], F.lit(0.0)))) for s in SCORES}
    decision = _text(*decisions)
    stands_for = F.lit("")
    for d, s in STATUS_OF.items():
        stands_for = F.when(decision == d, s).otherwise(stands_for)
    status = _text(*statuses, stands_for)
    twice = lambda s: 2 * unit[s] - 1
    quality = _signed(0.35 * lookup(status, PRIMARY) + 0.20 * twice("sufficiency") + 0.15 * twice("necessity") + 0.15 * twice("counterfactual_faithfulness") + 0.15 * twice("alertability"))
    return F.struct(
        ((decision != "") | (status != "") | held.isNotNull()).alias("has_signal"), decision.alias("decision"), status.alias("primary_status"), F.when(_text(*alert_statuses) != "", _text(*alert_statuses)).otherwise("not_applicable").alias("alert_status"),
        F.struct(*[c.alias(s) for s, c in unit.items()]).alias("scores"), quality.alias("quality"), _signed(teacher_reward).alias("teacher"),
    )


def _branch(kind: str, name: str, windows: Column, evidence: Column, reward: Column, **parts: Column) -> Column:
    paid = F.map_from_arrays(F.array(*[F.lit(p) for p in parts]), F.array(*[F.round(c.cast("double"), 6) for c in parts.values()]))
    return F.struct(
        F.lit(kind).alias("group_kind"), F.lit(name).alias("branch_type"), windows.cast(IDS).alias("selected_window_ids"), evidence.cast(IDS).alias("selected_evidence_ids"), _signed(reward).alias("branch_reward"), paid.alias("branch_reward_components"),
    )


def _or(a: Column, b: Column) -> Column:
    """The first list, unless it is empty."""
    return F.when(F.coalesce(F.size(a) > 0, F.lit(False)), a).otherwise(F.coalesce(b, F.array().cast(IDS)))


def search_branches(signal: Column, before: Column, after: Column, selected: Column, selected_evidence: Column, selected_before: Column, new_windows: Column, new_evidence: Column, backend: Column, duration: Column, cost: float = 0.10) -> Column:
    """A search skipped, used, and what it added alone. ``before`` and ``after``: states of ``ledger`` and ``visited``; the others are ids."""
    none = F.array().cast(IDS)
    new, added = F.array_distinct(F.coalesce(new_windows, none)), F.coalesce(new_evidence, none)
    current, earlier = F.array_distinct(_or(selected, new)), F.array_distinct(F.coalesce(selected_before, none))
    overlap = F.size(F.array_intersect(new, current)) / F.greatest(F.when(F.size(current) > 0, F.size(current)).otherwise(F.size(new)), F.lit(1))
    gain = F.least(F.size(added), F.lit(1)).cast("double")
    support, held = (F.size(current) > 0).cast("double"), (F.size(earlier) > 0).cast("double")
    bonus = F.lit(0.0)
    for name, worth in BACKENDS.items():
        bonus = F.when(backend == name, worth).otherwise(bonus)
    seen = lambda s: F.when(duration > 1e-8, clip_share(F.when(F.size(s["visited"]) > 0, s["visited"]).otherwise(s["ledger"]), duration)).otherwise(0.0)
    cover = F.greatest(seen(after) - seen(before), F.lit(0.0))
    quality, teacher = signal["quality"], signal["teacher"]
    return F.array(
        _branch("search", "skip_search", earlier, evidence_ids(before["ledger"], earlier), 0.55 * held - 0.20 * support - 0.15 * gain - 0.15 * overlap - 0.05 * bonus,
                preexisting_support=held, current_support_penalty=-support, new_evidence_penalty=-gain, selected_overlap_penalty=-overlap),
        _branch("search", "use_search", current, _or(selected_evidence, added), 0.35 * support + 0.25 * gain + 0.15 * overlap + 0.10 * quality + 0.05 * teacher + bonus - abs(cost) * cover,
                current_support=support, selected_overlap=overlap, new_evidence_gain=gain, coverage_gain=cover, verification_quality=quality, teacher_reward=teacher, proposal_quality_bonus=bonus),
        _branch("search", "delta_only", new, added, 0.30 * support + 0.35 * gain + 0.20 * overlap + 0.05 * teacher - 0.05 * abs(cost) * cover,
                current_support=support, marginal_overlap=F.greatest(overlap, gain), coverage_gain=cover, teacher_reward=teacher),
    )


def alert_branches(signal: Column, existence: Column, earliest_sec: Column, decision: Column, alert_sec: Column, selected: Column, selected_evidence: Column, before: Column, selected_before: Column, delay: float = 0.10) -> Column:
    """An alert given now, and held back. ``existence`` and ``earliest_sec`` are of the claim; a turn without claim or alert has no branches (null)."""
    claim, said = _text(existence), _text(decision)
    alarm = said.isin("soft_alert", "hard_alert")
    fits = F.when(claim == "anomaly", F.when(alarm, 1.0).when(said == "declare_normal", -1.0).otherwise(-0.25)).when(claim == "normal", F.when(said == "declare_normal", 1.0).when(alarm, -1.0).otherwise(0.25)).otherwise(0.0)
    late = alert_sec - earliest_sec
    timely = F.when(late.isNull(), 0.0).when(late <= ON_TIME, 1.0).otherwise(_signed(1 - abs(delay) * F.greatest(late, F.lit(0.0))))
    hold = F.when(claim == "normal", HOLD["normal"]).when(claim == "anomaly", HOLD["anomaly"]).otherwise(0.0)
    quality, teacher, able = signal["quality"], signal["teacher"], signal["scores"]["alertability"]
    missed = F.when(claim == "anomaly", timely).otherwise(0.0)
    both = F.array(
        _branch("alert", "alert_now", selected, selected_evidence, 0.40 * fits + 0.25 * timely + 0.15 * quality + 0.10 * (2 * able - 1) + 0.10 * teacher,
                claim_alert_consistency=fits, timeliness_reward=timely, verification_quality=quality, alertability=able, teacher_reward=teacher),
        _branch("alert", "hold_alert", selected_before, evidence_ids(before, selected_before), 0.55 * hold - 0.20 * fits - 0.15 * missed - 0.10 * quality,
                hold_reward=hold, consistency_penalty=-fits, timeliness_penalty=-missed, verification_quality_penalty=-quality),
    )
    return F.when(existence.isNotNull() & decision.isNotNull(), both)


def evidence_branches(signal: Column, ledger: Column, selected: Column, size: float = 0.10) -> Column:
    """The whole ledger, what is selected, what isn't, and the telling part of it; null without a signal."""
    keep = F.coalesce(selected, F.array().cast(IDS))
    every = F.transform(F.filter(ledger, lambda w: F.coalesce(w["window_id"], F.lit("")) != ""), lambda w: w["window_id"])
    drop, least = F.filter(every, lambda i: ~F.array_contains(keep, i)), minimal_subset(ledger, keep)
    n = F.greatest(F.size(every), F.lit(1))
    s = signal["scores"]
    suff, nec, fair = (2 * s[k] - 1 for k in ("sufficiency", "necessity", "counterfactual_faithfulness"))
    q, t, said, p = signal["quality"], signal["teacher"], signal["decision"], abs(size)
    odd = F.when(said.isin("misaligned", "redundant"), 1.0).otherwise(-0.5)
    paid = {
        "full": _signed(0.35 * q + 0.20 * suff - 0.20 * nec + 0.10 * fair - p), "keep": _signed(0.45 * q + 0.20 * suff + 0.20 * nec + 0.10 * fair + 0.05 * t - 0.25 * p * F.size(keep) / n),
        "drop": -0.45 * suff - 0.20 * q + 0.20 * odd - 0.05 * t, "least": _signed(0.35 * q + 0.20 * suff + 0.30 * nec + 0.10 * fair + 0.05 * t - p * F.size(least) / n),
    }
    # Nothing selected speaks for the ledger, a redundant selection for its telling part.
    bare, redundant = F.size(keep) == 0, said == "redundant"
    turn = lambda c, none, less: F.when(bare, _signed(c + none)).when(redundant, _signed(c + less)).otherwise(c)
    ids = lambda w: evidence_ids(ledger, w)
    return F.when(signal["has_signal"], F.array(
        _branch("evidence", "full_ledger", every, ids(every), turn(paid["full"], 0.35, -0.15), verification_quality=q, sufficiency=s["sufficiency"], necessity_penalty=-nec),
        _branch("evidence", "keep_selected", keep, ids(keep), turn(paid["keep"], -0.35, 0.0), verification_quality=q, sufficiency=s["sufficiency"], necessity=s["necessity"], teacher_reward=t),
        _branch("evidence", "drop_selected", drop, ids(drop), paid["drop"], drop_bonus=odd, sufficiency_penalty=-suff, verification_quality=q),
        _branch("evidence", "minimal_subset", least, ids(least), turn(paid["least"], -0.25, 0.15), verification_quality=q, sufficiency=s["sufficiency"], necessity=s["necessity"], compactness_bonus=nec),
    ))


def ranked(df: DataFrame, keys: Sequence[str], branches: str = "branches", eps: float = 1e-6) -> DataFrame:
    """One row for each branch (an array column of ``BRANCH``), with ``local_advantage, group_reward_mean, group_reward_std`` of its own group of its anchor (``keys``)."""
    rows = df.select(*keys, F.inline(branches))
    own = Window.partitionBy(*keys, "group_kind")
    mean, spread = F.avg("branch_reward").over(own), F.stddev_pop("branch_reward").over(own)
    z = F.when(spread <= eps, 0.0).otherwise((F.col("branch_reward") - mean) / (spread + eps))
    return rows.withColumns({"local_advantage": F.round(z, 6), "group_reward_mean": F.round(mean, 6), "group_reward_std": F.round(spread, 6)})
