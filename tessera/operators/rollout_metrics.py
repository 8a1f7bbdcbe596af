"""Evaluation of scored rollouts against their references: metrics of each record, and one row over all of them.

Columns of a rollout: ``video_id``, ``num_turns``, ``turns`` and ``invalid_attempts`` (arrays of ``TURN``), the claims
``finalized_case``, ``final_answer`` and ``last_claim`` (structs ``CLAIM`` or null), ``alerts`` (array of ``ALERT``),
``visited`` and ``ledger`` (arrays of ``WINDOW``), ``selection`` (ids) and ``selection_observed``. Of a reference:
``video_id``, ``target`` (``TARGET``), ``evidence`` (array of ``SPAN``) and ``duration``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.intervals import iou
from tessera.functions.numeric import exact_mean, ratio
from tessera.functions.text import category, says

from .intervals import greedy_matches
from .reward import first_step
from .verify import covered

SPAN = "struct<start:double,end:double>"
CLAIM = f"struct<existence:string,category:string,severity:double,counterfactual_type:string,anomaly:{SPAN},precursor:{SPAN}>"
TARGET = f"struct<existence:string,category:string,severity:double,counterfactual_type:string,anomaly:{SPAN},precursor:{SPAN},hard_normal:boolean,earliest_alert_sec:double>"
TURN = "struct<step_index:long,action:string,tool_name:string,said_valid:boolean,valid_action:boolean>"
ALERT = "struct<decision:string,alert_sec:double>"
# Decisions that call an anomaly, actions that are valid unless said otherwise, and tools that search.
ALARMS, VALID_ACTIONS, SEARCHES = ["soft_alert", "hard_alert"], ["tool_call", "answer"], ["scan_timeline", "seek_evidence"]


def claim_of(finalized: Column, answer: Column, last: Column) -> Column:
    """The claim that counts: the final case, else the answer, else the last claim."""
    return F.coalesce(finalized, answer, last)


def first_alert(alerts: Column) -> Column:
    """The first alert that calls an anomaly; else the first."""
    return F.coalesce(F.get(F.filter(alerts, lambda a: a["decision"].isin(ALARMS)), F.lit(0)), F.get(alerts, F.lit(0)))


def existence_score(claim: Column, alert: Column) -> Column:
    """1 or 0 as claimed; without a claim, 0.75 if an alert calls an anomaly."""
    return F.when(claim.isNotNull(), F.when(says(claim["existence"], "anomaly"), 1.0).otherwise(0.0)).when(alert["decision"].isin(ALARMS), 0.75).otherwise(0.0)


def valid(turn: Column) -> Column:
    """As said (a null said is no); what says nothing is valid by its action."""
    return F.when(turn["said_valid"], F.coalesce(turn["valid_action"], F.lit(False))).otherwise(F.coalesce(turn["action"].isin(VALID_ACTIONS), F.lit(False)))


def validity(turns: Column) -> Column:
    return ratio(F.size(F.filter(turns, valid)), F.size(turns))


def protocol_flag(turns: Column, finalized: Column, answered: Column) -> Column:
    """Whether the episode closed its case, before any answer; an answer that couldn't be read spoils it."""
    f, a = first_step(turns, "tool_name", "finalize_case"), first_step(turns, "action", "answer")
    closed = f.isNotNull() | finalized
    ended = (a.isNotNull() & answered) | a.isNull()
    return F.when(closed & ended, F.when(f.isNotNull() & a.isNotNull(), (f < a).cast("double")).otherwise(1.0)).otherwise(0.0)


def predicted_windows(ledger: Column, selection: Column, observed: Column, k: int = 3) -> Column:
    """The first ``k`` distinct intervals of the selected windows; of the whole ledger only where no selection was observed.

    Of windows that repeat an id the first counts.
    """
    span = lambda w: F.struct(F.least(w["start_sec"], w["end_sec"]).alias("s"), F.greatest(w["start_sec"], w["end_sec"]).alias("e"))
    named = F.filter(ledger, lambda w: F.trim(F.coalesce(w["window_id"], F.lit(""))) != "")
    ids = lambda c: F.filter(F.array_distinct(c), lambda i: F.exists(named, lambda w: w["window_id"] == i))
    of = lambda c: F.slice(F.array_distinct(F.transform(ids(c), lambda i: span(F.get(F.filter(named, lambda w: w["window_id"] == i), F.lit(0))))), 1, k)
    chosen = F.coalesce(selection, F.array().cast("array<string>"))
    return F.when(observed, of(chosen)).otherwise(of(F.transform(named, lambda w: w["window_id"])))


def _length(span: Column) -> Column:
    return F.coalesce(span["end"] - span["start"], F.lit(0.0))


def span_iou(a: Column, b: Column) -> Column:
    """0 where a span or a bound is missing or NaN: ``least`` and ``greatest`` skip nulls, so ``iou`` alone would call that a full match."""
    known = F.lit(True)
    for bound in (a["start"], a["end"], b["start"], b["end"]):
        known = known & bound.isNotNull() & ~F.isnan(bound)
    return F.when(known, iou(a["start"], a["end"], b["start"], b["end"])).otherwise(F.lit(0.0))


def record_metrics(rollouts: DataFrame, references: DataFrame, k: int = 3, least_iou: float = 0.3) -> DataFrame:
    """One row for each rollout whose ``video_id`` has a reference; a metric that doesn't apply to a record is null.

    Of references that repeat an id, take the last before (``joins.last_wins``). One join by id, nothing else is shuffled.
    """
    c = F.col
    r = rollouts.join(references, "video_id")
    r = r.withColumns({"claim": claim_of(c("finalized_case"), c("final_answer"), c("last_claim")), "alert": first_alert(c("alerts"))})
    anomaly, said = says(c("target.existence"), "anomaly"), says(c("claim.existence"), "anomaly")
    alarm = F.coalesce(c("alert.decision").isin(ALARMS), F.lit(False))
    if_anomaly = lambda x: F.when(anomaly, x)
    pred = predicted_windows(c("ledger"), c("selection"), c("selection_observed"), k)
    r = r.withColumns({"_pred": pred, "_ref": F.transform("evidence", lambda w: F.struct(F.least(w["start"], w["end"]).alias("s"), F.greatest(w["start"], w["end"]).alias("e")))})
    r = r.withColumn("_hits", greedy_matches(c("_pred"), c("_ref"), least_iou))
    has = anomaly & (F.size("_ref") > 0)
    p, q = ratio(c("_hits"), F.size("_pred")), ratio(c("_hits"), F.size("_ref"))
    t0, at = F.coalesce(c("target.earliest_alert_sec"), c("target.anomaly.start"), F.lit(0.0)), F.coalesce(c("alert.alert_sec"), c("target.earliest_alert_sec"), c("target.anomaly.start"), F.lit(0.0))
    tolerance = F.greatest(F.lit(0.5), 0.02 * F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0)))
    early, late = alarm & (at < t0 - tolerance), alarm & (at > t0 + tolerance)
    before, during = F.greatest(_length(c("target.precursor")), F.lit(1.0)), F.greatest(_length(c("target.anomaly")), F.lit(1.0))
    timely = F.when(~alarm, 0.0).when(early, -F.least(F.lit(1.0), (t0 - at) / before)).otherwise(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), at - t0) / during))
    label = lambda x: F.coalesce(F.nullif(category(x), F.lit("")), F.lit("unknown"))
    told = F.coalesce(F.nullif(F.lower(F.trim(c("target.counterfactual_type"))), F.lit("")), F.lit("none"))
    claimed = F.coalesce(F.nullif(F.lower(F.trim(c("claim.counterfactual_type"))), F.lit("")), F.lit("none"))
    searched = F.size(F.filter("turns", lambda t: t["tool_name"].isin(SEARCHES)))
    flag = lambda x: x.cast("double")
    return r.select(
        "video_id", anomaly.alias("is_anomaly"), said.alias("said_anomaly"), existence_score(c("claim"), c("alert")).alias("existence_score"),
        if_anomaly(label(c("target.category"))).alias("true_category"), if_anomaly(F.when(said, label(c("claim.category"))).otherwise("normal")).alias("said_category"),
        if_anomaly(span_iou(c("claim.anomaly"), c("target.anomaly"))).alias("temporal_iou"), F.when(anomaly & c("target.precursor").isNotNull(), span_iou(c("claim.precursor"), c("target.precursor"))).alias("precursor_iou"),
        F.when(~anomaly, F.when(alarm, -1.0).otherwise(1.0)).otherwise(timely).alias("alert_utility"), if_anomaly(flag(early)).alias("premature"), if_anomaly(flag(late)).alias("late"),
        F.when(~anomaly, flag(alarm)).alias("false_alert"), F.when(~anomaly & F.coalesce(c("target.hard_normal"), F.lit(False)), flag(alarm)).alias("hard_normal_false_alert"),
        F.when(has, p).alias("evidence_precision"), F.when(has, q).alias("evidence_recall"), F.when(has, ratio(2 * p * q, p + q)).alias("evidence_f1"),
        F.when(anomaly & (told != "none"), flag(claimed == told)).alias("counterfactual_hit"), if_anomaly(F.abs(c("claim.severity") - c("target.severity"))).alias("severity_error"),
        ratio(covered(c("visited")), F.coalesce("duration", F.lit(0.0))).alias("inspected_clip_ratio"), searched.cast("double").alias("search_steps"), F.coalesce(c("num_turns").cast("double"), F.lit(0.0)).alias("num_turns"),
        validity(F.concat("turns", "invalid_attempts")).alias("tool_call_validity"), validity(c("turns")).alias("formal_turn_validity"),
        protocol_flag(c("turns"), c("finalized_case").isNotNull(), c("final_answer").isNotNull()).alias("protocol_compliance"),
    )


#: Names of the summary's means, and the record's metric each is of.
MEANS = {
    "temporal_miou": "temporal_iou", "precursor_miou": "precursor_iou", "alert_utility": "alert_utility", "premature_alert_rate": "premature", "late_alert_rate": "late", "false_alert_rate": "false_alert",
    "hard_normal_false_alert_rate": "hard_normal_false_alert", "evidence_precision_at_3": "evidence_precision", "evidence_recall_at_3": "evidence_recall", "evidence_f1_at_3": "evidence_f1",
    "counterfactual_type_accuracy": "counterfactual_hit", "severity_mae": "severity_error", "mean_inspected_clip_ratio": "inspected_clip_ratio", "mean_search_steps": "search_steps", "mean_num_turns": "num_turns",
    "tool_call_validity_rate": "tool_call_validity", "formal_turn_validity_rate": "formal_turn_validity", "protocol_compliance_rate": "protocol_compliance",
}


def summary(records: DataFrame) -> DataFrame:
    """One row: how many records, accuracy of existence, and the mean of each metric over the records it applies to (0 over none)."""
    right = F.when(F.col("is_anomaly") == F.col("said_anomaly"), 1.0).otherwise(0.0)
    return records.agg(F.count(F.lit(1)).alias("num_records"), exact_mean(right).alias("existence_accuracy"), *[exact_mean(F.col(c)).alias(n) for n, c in MEANS.items()])
