"""Reward components of a rollout, second-judge agreement and weights, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numeric import clamp

# Component weights, former names of components, and what each verdict is worth.
WEIGHTS = {
    "decision_reward": 1.2, "protocol_reward": 1.0, "temporal_grounding_reward": 0.8, "alert_calibration_reward": 0.8, "self_verification_quality_reward": 1.0, "efficiency_reward": 0.4, "invalid_attempt_penalty": 0.6,
    "counterfactual_reward": 0.6, "teacher_agreement_reward": 0.6,
}
FORMER = {"temporal_reward": "temporal_grounding_reward", "alert_reward": "alert_calibration_reward", "verification_reward": "self_verification_quality_reward", "teacher_judge_reward": "teacher_agreement_reward"}
PRIMARY = {"complete": 1.0, "redundant": 0.35, "incomplete": -0.35, "misaligned": -1.0}
ALERT = {"justified": 1.0, "not_applicable": 0.0, "late": -0.35, "premature": -0.8}
SCORES = ["sufficiency", "necessity", "consistency", "alertability", "counterfactual_faithfulness"]


def lookup(value: Column, worth: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in worth.items():
        out = F.when(value == name, F.lit(w)).otherwise(out)
    return out


def weights_of(given: dict[str, float] | None) -> dict[str, float]:
    """All weights, with the given ones in place of their own, under former names too."""
    return WEIGHTS | {FORMER.get(k, k): float(v) for k, v in (given or {}).items()}


def latest_verifier(turns: Column, offline: Column) -> Column:
    """The last verify turn of an array of turns in order; without one the offline verdict; else null.

    Both are structs; of a turn the fields ``tool_name, primary_status, alert_status, scores`` are read (``scores``:
    map of names to scores), of the offline verdict ``primary_status, alert_status, scores``.
    """
    took = lambda x, source: F.struct(x["primary_status"].alias("primary_status"), x["alert_status"].alias("alert_status"), x["scores"].alias("scores"), F.lit(source).alias("source"))
    last = F.try_element_at(F.filter(turns, lambda t: t["tool_name"] == "verify_hypothesis"), F.lit(-1))
    return F.when(last.isNotNull(), took(last, "online_turn")).when(offline.isNotNull(), took(offline, "offline"))


def first_step(turns: Column, field: str, value: str) -> Column:
    return F.get(F.filter(turns, lambda t: t[field] == value), F.lit(0))["step_index"]


def protocol(verify: Column, finalize: Column, answer: Column, verified: Column, finalized: Column, answered: Column) -> Column:
    """How far the episode kept to verify, then finalize, then answer.

    ``verify``, ``finalize``, ``answer``: the first step of each, or null. ``verified``: a verdict exists, be it offline;
    ``finalized``: the state holds a final case; ``answered``: an answer was read. An episode that ends with its final case needs no answer.
    """
    closed = finalize.isNotNull() | finalized
    ended = (answer.isNotNull() & answered) | (answer.isNull() & closed)
    before = lambda a, b: F.coalesce(a < b, F.lit(False))
    return (
        F.when(~closed, -1.0).when(~ended, -0.5).when(verify.isNull() & ~verified, -0.75)
        .when(finalize.isNotNull() & answer.isNotNull(), F.when(before(verify, finalize) & before(finalize, answer), 1.0).otherwise(-1.0))
        .when(finalize.isNotNull(), F.when(verify.isNull() | before(verify, finalize), 1.0).otherwise(-1.0))
        .when(before(verify, answer), 0.5).otherwise(-0.5)
    )


def efficiency(finalized: Column, turns: Column, invalid_attempts: Column) -> Column:
    n = F.coalesce(turns, F.lit(0)) + invalid_attempts
    return F.when(finalized & (n > 0), clamp(1 - 0.15 * F.greatest(n - 1, F.lit(0)), -1.0, 1.0)).otherwise(F.lit(0.0))


def invalid(n: Column) -> Column:
    return F.when(n > 0, -F.least(F.lit(1.0), 0.4 * n)).otherwise(F.lit(0.0))


def components(turns: Column, offline: Column, finalized: Column, answered: Column, num_turns: Column, invalid_attempts: Column, teacher: Column) -> dict[str, Column]:
    """The nine components. ``turns``: array of structs as in ``latest_verifier``, with ``step_index`` and ``action``; ``teacher``: a second judge's reward or null."""
    v = latest_verifier(turns, offline)
    score = lambda k: F.coalesce(F.try_element_at(v["scores"], F.lit(k)), F.lit(0.0))
    has = v.isNotNull()
    if_any = lambda c: F.when(has, c).otherwise(F.lit(0.0))
    bad = F.greatest(F.coalesce(invalid_attempts, F.lit(0)), F.lit(0))
    ended = protocol(first_step(turns, "tool_name", "verify_hypothesis"), first_step(turns, "tool_name", "finalize_case"), first_step(turns, "action", "answer"), has, finalized, answered)
    rows = [
        F.when(finalized, 1.0).otherwise(0.0), ended, if_any(clamp(0.5 * score("consistency") + 0.5 * score("sufficiency"), -1.0, 1.0)), if_any(lookup(v["alert_status"], ALERT)),
        if_any(clamp(lookup(v["primary_status"], PRIMARY) + 0.2 * score("sufficiency") + 0.2 * score("necessity"), -1.0, 1.0)), efficiency(finalized, num_turns, bad), invalid(bad),
        if_any(clamp(score("counterfactual_faithfulness"), -1.0, 1.0)), if_any(F.coalesce(teacher, F.lit(0.0))),
    ]
    return dict(zip(WEIGHTS, rows, strict=True))


def total(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    out, held = F.lit(0.0), weights_of(weights)
    for name, c in parts.items():
        out = out + held[name] * c
    return out


def with_former_names(parts: dict[str, Column]) -> dict[str, Column]:
    """Components under their former names too."""
    return parts | {old: parts[new] for old, new in FORMER.items()}


def agreement(teacher: Column, policy: Column) -> Column:
    """Mean closeness over shared keys of two score maps; 0.5 without any."""
    shared = F.array_intersect(F.map_keys(teacher), F.map_keys(policy))
    near = F.transform(shared, lambda k: F.greatest(F.lit(0.0), 1 - F.abs(F.try_element_at(teacher, k) - F.try_element_at(policy, k))))
    return F.when(F.size(shared) > 0, F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(shared)).otherwise(F.lit(0.5))


def confidence(teacher: Column) -> Column:
    v = F.map_values(teacher)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(F.lit(0.5))


def teacher_reward(conf: Column, align: Column, agree: Column) -> Column:
    """``align`` is 1, 0 or null (undecided)."""
    return clamp(conf * (0.7 * F.coalesce(2 * align - 1, F.lit(0.0)) + 0.3 * (2 * agree - 1)), -1.0, 1.0)


def multiplier(conf: Column, hard: Column, agrees: Column) -> Column:
    f = (0.85 + 0.5 * conf) * F.when(hard, 1.15).otherwise(1.0) * F.when(agrees.isNull(), 1.0).when(agrees, 1.15).otherwise(0.7)
    return clamp(f, 0.35, 2.0)
