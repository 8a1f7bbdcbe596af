"""Verification payloads (JSON texts) as typed structs: a policy's own report, and a judge's labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.binding import let
from tessera.functions.numeric import unit
from tessera.functions.text import category, claim_error, first_structured_block

from .verify import alert_status as timing
from .verify import failure_reasons

# Decisions, the status and action each stands for, and the modes with their former names.
STATUS_OF = {"sufficient": "complete", "insufficient": "incomplete", "misaligned": "misaligned", "redundant": "redundant"}
ACTION_OF = {"sufficient": "finalize", "insufficient": "continue_search", "misaligned": "revise_claim", "redundant": "refine_evidence"}
MODES = ["soft_alert_check", "hard_alert_check", "final_check", "full_keep_drop", "reward_only", "search_step_check"]
FORMER_MODES = {"normal_check": "final_check", "declare_normal": "final_check"}
ALERT_STATUSES = ["justified", "premature", "late", "not_applicable"]
SCORES = ["sufficiency", "necessity", "alertability", "counterfactual_faithfulness"]
MAP = "map<string,string>"
# What a policy's report must hold.
REQUIRED = [
    "verification_mode", "selected_window_ids", "verification_decision", "recommended_action", "sufficiency_score", "necessity_score", "alertability_score", "counterfactual_faithfulness",
]
# What makes a verify call a report of its own.
COMPACTED = ["verification_decision", "recommended_action", "sufficiency_score", "necessity_score", "alertability_score", "counterfactual_faithfulness", "selected_window_ids", "selected_evidence_moment_ids"]


@dataclass(frozen=True)
class Fields:
    """A payload that was parsed once: maps of its own values and of those of its ``derived_scores``, as JSON or plain texts."""

    values: Column
    derived: Column


Payload = Column | Fields


def _get(p: Payload, path: str) -> Column:
    if isinstance(p, Fields):
        return p.derived[path.removeprefix("derived_scores.")] if path.startswith("derived_scores.") else p.values[path]
    return F.get_json_object(p, f"$.{path}")


def _has(p: Payload, key: str) -> Column:
    has = F.map_contains_key(p.values, key) if isinstance(p, Fields) else F.array_contains(F.json_object_keys(p), key)
    return F.coalesce(has, F.lit(False))


def _lower(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _plain(value: Column, use: Callable[[Column], Column]) -> Column:
    """As ``let``, for a value that is a column or read from one at no cost."""
    return use(value)


def score_of(text: Column, let: Callable = let) -> Column:
    """A score in [0, 1]; 0 for what is no number."""
    return let(text, lambda t: F.coalesce(unit(F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(t.try_cast("double"))), F.lit(0.0)))


def _first_of(p: Payload, *keys: str) -> Column:
    """The first value that isn't missing, null, empty, zero or false."""
    once = _plain if isinstance(p, Fields) else let
    return F.coalesce(*[once(_get(p, k), lambda v: F.when(~v.isin("", "[]", "{}", "0", "false"), v)) for k in keys])


def string_list(v: Column, let: Callable = let) -> Column:
    """A JSON list or a single value as trimmed texts, blank ones dropped."""
    items = let(v, lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v.isNotNull(), F.array(v)))
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("None")))), lambda x: x != "")


def _mapped(c: Column, table: dict[str, str], default: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(known[c], F.lit(default) if isinstance(default, str) else default)


def report_decision(p: Payload) -> Column:
    """As said; else what the primary status stands for; else insufficient."""
    said = _lower(_get(p, "verification_decision"))
    return F.when(said.isin(*STATUS_OF), said).otherwise(_mapped(_lower(_get(p, "primary_status")), {s: d for d, s in STATUS_OF.items()}, "insufficient"))


def mode_of(value: Column, default: Column) -> Column:
    t = _lower(value)
    return F.when(t.isin(*MODES), t).otherwise(_mapped(t, FORMER_MODES, F.when(F.coalesce(default, F.lit("")) == "", "reward_only").otherwise(default)))


Bind = Callable[[dict[str, Column]], list[Column]]


def _filled(p: Payload, alert_sec: Column, expected_sec: Column, has_alert: Column, mode: Column, bind: Bind) -> dict[str, Column]:
    """The parts of a report. ``bind`` takes what is used several times, and gives what stands for it."""
    once = _plain if isinstance(p, Fields) else let
    names = ("selected_window_ids", "verified_window_ids", "best_effort_window_ids")
    key = {s: s if s == "counterfactual_faithfulness" else f"{s}_score" for s in SCORES}
    said, told, own, windows, others, why, *texts = bind({
        "said": _lower(_get(p, "recommended_action")), "told": _lower(_get(p, "alert_status")), "own": _get(p, "derived_scores.consistency"),
        "windows": _first_of(p, *names), "others": _get(p, "candidate_window_ids"), "why": _first_of(p, "failure_reasons"),
        **{f"{s}_text": F.when(_has(p, key[s]), _get(p, key[s])).otherwise(_get(p, f"derived_scores.{s}")) for s in SCORES},
    })
    decision, selected, candidates, reasons, *values = bind({
        "decision": report_decision(p), "selected": string_list(windows, once), "candidates": string_list(others, once), "reasons": string_list(why, once),
        **{s: score_of(t, once) for s, t in zip(SCORES, texts, strict=True)},
    })
    scores = dict(zip(SCORES, values, strict=True))
    suff, nec = scores["sufficiency"], scores["necessity"]
    alert = F.when(told.isin(*ALERT_STATUSES), told).otherwise(timing(has_alert, alert_sec, scores["alertability"], expected_sec))
    status, alert = bind({"status": _mapped(decision, STATUS_OF, "incomplete"), "alert": alert})
    action = F.when(said.isin(*ACTION_OF.values()), said).otherwise(_mapped(decision, ACTION_OF, "continue_search"))
    consistency = F.when(own.isNotNull(), score_of(own, once)).when((suff != 0) | (nec != 0), unit(1 - F.abs(suff - nec))).otherwise(F.lit(0.0))
    return {
        "verification_mode": mode_of(F.coalesce(_first_of(p, "verification_mode"), mode), mode), "verification_decision": decision, "recommended_action": action, "primary_status": status, "alert_status": alert,
        "derived_scores": F.struct(*[F.round(c, 6).alias(s) for s, c in scores.items()], F.round(consistency, 6).alias("consistency")),
        "selected_window_ids": selected, "candidate_window_ids": candidates,
        "selected_evidence_ids": string_list(_first_of(p, "selected_evidence_ids", "candidate_evidence_ids", "evidence_ids"), once),
        "selected_evidence_moment_ids": string_list(_first_of(p, "selected_evidence_moment_ids", "candidate_evidence_moment_ids", "evidence_moment_ids"), once),
        "best_effort_window_ids": F.when(F.size(selected) > 0, selected).otherwise(candidates),
        "failure_reasons": F.when(F.size(reasons) > 0, reasons).otherwise(failure_reasons(status, alert)),
        "rationale": F.coalesce(_first_of(p, "rationale", "explanation"), F.lit("")), "confidence": F.round(F.greatest(suff, nec), 6),
    }


def self_report(p: Column, alert_sec: Column, expected_sec: Column, has_alert: Column, mode: Column) -> Column:
    """A policy's report, filled up: decision, action, status, scores, windows, alert status and failure reasons.

    ``alert_sec``, ``expected_sec`` (of the claim) and ``has_alert`` tell the timing where the report doesn't;
    ``mode`` stands in for a mode that it lacks. ``with_self_report`` does the same for a table, at a fraction of the work.
    """
    parts = _filled(p, alert_sec, expected_sec, has_alert, mode, lambda shared: list(shared.values()))
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def with_self_report(df: DataFrame, p: Column, alert_sec: Column, expected_sec: Column, has_alert: Column, mode: Column) -> DataFrame:
    """Add the parts of ``self_report`` and ``lacks`` (as of ``missing_fields``) as columns.

    Each payload is parsed once, and what is used several times is a column: inside one expression each mention would
    parse the payload and fill up the report anew. A text that is no whole JSON object holds nothing.
    """
    out = df.withColumn("_values", F.from_json(p, MAP)).withColumn("_derived", F.from_json(F.col("_values")["derived_scores"], MAP))

    def bind(shared: dict[str, Column]) -> list[Column]:
        nonlocal out
        out = out.withColumns({f"_{n}": c for n, c in shared.items()})
        return [F.col(f"_{n}") for n in shared]

    fields = Fields(F.col("_values"), F.col("_derived"))
    parts = _filled(fields, alert_sec, expected_sec, has_alert, mode, bind)
    return out.select(*df.columns, *[c.alias(n) for n, c in parts.items()], missing_fields(fields).alias("lacks"))


def missing_fields(p: Payload) -> Column:
    """Which required fields a policy's report lacks; an empty list of windows counts as lacking."""
    lacks = [F.when(~_has(p, k) | (F.size(string_list(_get(p, k))) == 0 if k == "selected_window_ids" else F.lit(False)), k) for k in REQUIRED]
    return F.filter(F.array(*lacks), lambda x: x.isNotNull())


def verify_decision(p: Column) -> Column:
    """The decision in a verify call: as said, else by its action; empty if neither tells."""
    said = _lower(_get(p, "verification_decision"))
    return F.when(said.isin(*STATUS_OF), said).otherwise(_mapped(_lower(_get(p, "recommended_action")), {a: d for d, a in ACTION_OF.items()}, ""))


def judge_labels(p: Column) -> Column:
    """A judge's ``scores``, ``decision`` and ``rationale`` under any of their names.

    The decision is as said; else the primary status or the action if they settle it (what is incomplete or to be
    continued doesn't); else sufficient if the scores are high enough.
    """

    def score(s: str) -> Column:
        held = _get(p, "teacher_judge_scores")
        inside, outside = F.coalesce(_has(held, s), F.lit(False)), _has(p, f"{s}_score")
        return score_of(F.when(inside, _get(p, f"teacher_judge_scores.{s}")).when(outside, _get(p, f"{s}_score")).otherwise(_get(p, s)))

    scores = {s: score(s) for s in SCORES}
    said = _lower(_first_of(p, "teacher_judge_decision", "verification_decision"))
    high = F.when((scores["sufficiency"] >= 0.75) & (scores["necessity"] >= 0.35), "sufficient").otherwise("insufficient")
    by_action = _mapped(_lower(_get(p, "recommended_action")), {a: d for d, a in ACTION_OF.items() if d != "insufficient"}, high)
    by_status = _mapped(_lower(_get(p, "primary_status")), {s: d for d, s in STATUS_OF.items() if d != "insufficient"}, by_action)
    return F.struct(
        F.struct(*[F.round(c, 6).alias(s) for s, c in scores.items()]).alias("scores"), F.when(said.isin(*STATUS_OF), said).otherwise(by_status).alias("decision"),
        F.trim(F.coalesce(_first_of(p, "teacher_judge_rationale", "rationale", "explanation"), F.lit(""))).alias("rationale"),
    )


def compact_report(p: Column) -> Column:
    """A verify call's arguments in short (JSON text): mode, decision, action, scores, claim, alert and selections, without query and reasons.

    Null where a claim or alert names no valid category. Fields that are null or blank are left out, and so are claims and
    alerts that hold nothing else.
    """
    decision = report_decision(p)
    said = _lower(_get(p, "recommended_action"))
    action = F.when(said.isin(*ACTION_OF.values()), said).otherwise(_mapped(decision, ACTION_OF, "continue_search"))
    score = lambda k: F.round(score_of(_get(p, k)), 6)
    wrong = F.lit(False)
    parts = {}
    for name, times, required in (("claim", ("earliest_alert_sec",), True), ("alert", ("alert_sec", "earliest_alert_sec"), False)):
        o = _get(p, name)
        here = F.coalesce(o.startswith("{"), F.lit(False)) & (F.coalesce(o, F.lit("{}")) != "{}")
        existence, label = _get(p, f"{name}.existence"), _get(p, f"{name}.category")
        told = F.trim(F.coalesce(label, F.lit(""))) != ""
        kind = F.when(told, category(label, existence))
        wrong = wrong | (here & claim_error(existence, kind, required).isNotNull())
        text = lambda c: F.when(F.trim(c) != "", c)
        fields = [text(existence).alias("existence"), kind.alias("category"), *[F.try_parse_json(_get(p, f"{name}.{t}")).alias(t) for t in times]]
        if name == "alert":
            fields = [text(_get(p, "alert.decision")).alias("decision"), *fields]
        held = F.struct(*fields)
        parts[name] = F.when(here & (F.to_json(held) != "{}"), held)
    some = lambda v: F.when(F.size(v) > 0, v)
    return F.when(~wrong, F.to_json(F.struct(
        mode_of(_first_of(p, "verification_mode"), F.lit("reward_only")).alias("verification_mode"), decision.alias("verification_decision"), action.alias("recommended_action"), score("sufficiency_score").alias("sufficiency_score"),
        score("necessity_score").alias("necessity_score"), score("alertability_score").alias("alertability_score"), score("counterfactual_faithfulness").alias("counterfactual_faithfulness"), parts["claim"].alias("claim"), parts["alert"].alias("alert"),
        some(string_list(_first_of(p, "selected_window_ids", "verified_window_ids", "best_effort_window_ids"))).alias("selected_window_ids"),
        some(string_list(_first_of(p, "selected_evidence_moment_ids", "evidence_moment_ids", "candidate_evidence_moment_ids"))).alias("selected_evidence_moment_ids"),
    )))


def compact_verify_call(text: Column) -> Column:
    """A reply cut to its first structured block; a verify call that reports on itself in its short form, behind the thoughts. Other calls stay as they are."""
    cut = first_structured_block(text)
    call = F.trim(F.regexp_extract(cut, r"(?s)<tool_call>(.*?)</tool_call>", 1))
    args = F.get_json_object(call, "$.arguments")
    keys = F.coalesce(F.json_object_keys(args), F.array().cast("array<string>"))
    reports = F.coalesce((F.get_json_object(call, "$.name") == "verify_hypothesis") & F.arrays_overlap(keys, F.array(*[F.lit(k) for k in COMPACTED])), F.lit(False))
    short = F.when(reports, compact_report(args))
    think = F.regexp_extract(cut, r"(?s)^<think>.*?</think>", 0)
    return F.when(short.isNull(), cut).otherwise(F.concat(think, F.lit('<tool_call>{"name":"verify_hypothesis","arguments":'), short, F.lit("}</tool_call>")))
