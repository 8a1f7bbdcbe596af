"""Credit of turns from counterfactual groups: a turn's own, and what spills to the searches whose evidence it chose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much each component counts for a turn of a tool, or for an answer; of evidence that a search found and a later turn chose; and the share that spills.
COMPONENTS = ("global", "search_local", "alert_local", "evidence_local", "teacher_local")
TOOL_WEIGHTS = {
    "seek_evidence": {"search_local": 1.0},
    "emit_alert": {"alert_local": 1.0, "evidence_local": 0.25},
    "verify_hypothesis": {"alert_local": 0.5, "evidence_local": 1.0},
    "finalize_case": {"alert_local": 0.25, "evidence_local": 1.0},
}
ANSWER_WEIGHTS = {"alert_local": 0.5, "evidence_local": 0.5}
CHOSEN_EVIDENCE, SPILL = 0.5, 0.5
ALPHAS = {"search": 0.5, "alert": 0.5, "evidence": 0.5}
KINDS = ("search", "alert", "evidence")


def actual_branches(records: DataFrame, keys: Sequence[str], branch: str, wanted: Column, order: str) -> DataFrame:
    """Of each group (``keys``) the branch that happened: the one named ``wanted``, else the first by ``order``."""
    rest = [c for c in records.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct((F.coalesce(F.col(branch) != wanted, F.lit(True))).cast("int").alias("other"), F.col(order)))
    return records.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*")


def component_weights(tool: Column, action: Column, evidence_hit: Column, teacher_present: Column) -> dict[str, Column]:
    """How much each component counts for a turn."""

    def weight(name: str) -> Column:
        out = F.when((action == "answer") & ~F.coalesce(tool.isin(*TOOL_WEIGHTS), F.lit(False)), ANSWER_WEIGHTS.get(name, 0.0)).otherwise(0.0)
        # A search without chosen evidence that is the answer, too, counts as an answer.
        if name in ANSWER_WEIGHTS:
            out = F.when((tool == "seek_evidence") & ~evidence_hit & (action == "answer"), ANSWER_WEIGHTS[name]).otherwise(out)
        for t, w in TOOL_WEIGHTS.items():
            if name in w:
                out = F.when(tool == t, w[name]).otherwise(out)
        if name == "evidence_local":
            out = F.when((tool == "seek_evidence") & evidence_hit, CHOSEN_EVIDENCE).otherwise(out)
        if name == "teacher_local":
            out = F.when((tool == "verify_hypothesis") & teacher_present, 1.0).otherwise(out)
        return out

    return {"global": F.lit(1.0), **{c: weight(c) for c in COMPONENTS[1:]}}


def counterfactual_examples(turns: DataFrame, groups: DataFrame, key: str, step: str = "step_index", alphas: Mapping[str, float] = ALPHAS, teacher_alpha: float = 0.5, include_invalid: bool = False) -> DataFrame:
    """One training example for each turn with a response: its components, their weights, ``advantage``, ``sample_weight`` and ``group_ids``.

    ``turns``: ``key, step, tool_name, action, valid, response, new_evidence_ids, global_advantage, teacher_reward`` (null without
    a teacher). ``groups``: the branch that happened of each group: ``key, step`` of its anchor, ``group_kind, group_id,
    local_advantage, selected_evidence_ids``. A group's scaled advantage goes to its anchor; of an evidence group, ``SPILL`` of it
    also goes to each search of the episode that found some of the evidence it selected, once however much it found.
    """
    alpha = F.coalesce(*[F.when(F.col("group_kind") == k, F.lit(a)) for k, a in alphas.items()], F.lit(0.0))
    scaled = groups.select(key, F.col(step).alias("_anchor"), "group_kind", "group_id", (alpha * F.coalesce("local_advantage", F.lit(0.0))).alias("_share"), "selected_evidence_ids")
    own = scaled.select(key, F.col("_anchor").alias(step), "group_kind", "group_id", "_anchor", "_share", F.lit(0).alias("_spilt"))
    chosen = scaled.where("group_kind = 'evidence'").select(key, "_anchor", "group_kind", "group_id", "_share", F.explode(F.array_distinct("selected_evidence_ids")).alias("_evidence"))
    found = turns.where("tool_name = 'seek_evidence'").select(key, step, F.explode(F.array_distinct("new_evidence_ids")).alias("_evidence"))
    spilt = chosen.join(found, [key, "_evidence"]).groupBy(key, step, "group_kind", "group_id", "_anchor").agg((SPILL * F.first("_share")).alias("_share")).withColumn("_spilt", F.lit(1))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("group_kind"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("_anchor"), F.col("_spilt"), F.col("group_id").alias("g")))), lambda x: x["g"])
    local = own.unionByName(spilt).groupBy(key, step).agg(*[F.sum(F.when(F.col("group_kind") == k, F.col("_share")).otherwise(0.0)).alias(f"{k}_local") for k in KINDS], F.filter(ids, lambda g: F.coalesce(g, F.lit("")) != "").alias("group_ids"))
    e = turns.join(local, [key, step], "left")
    values = {
        "global": F.coalesce("global_advantage", F.lit(0.0)), **{f"{k}_local": F.coalesce(f"{k}_local", F.lit(0.0)) for k in KINDS}, "teacher_local": F.coalesce(teacher_alpha * F.col("teacher_reward"), F.lit(0.0)),
    }
    hit = (F.coalesce(F.size("new_evidence_ids"), F.lit(0)) > 0) & (values["evidence_local"] != 0)
    weights = component_weights(F.coalesce("tool_name", F.lit("")), F.coalesce("action", F.lit("")), hit, F.col("teacher_reward").isNotNull())
    named = lambda m: F.struct(*[m[c].cast("double").alias(c) for c in COMPONENTS])
    e = e.withColumns({"components": named(values), "weights": named(weights), "group_ids": F.coalesce("group_ids", F.array().cast("array<string>"))})
    e = e.withColumn("advantage", sum((F.col(f"components.{c}") * F.col(f"weights.{c}") for c in COMPONENTS), F.lit(0.0)))
    kept = e.where(F.coalesce("response", F.lit("")) != "")
    kept = kept if include_invalid else kept.where("valid")
    return kept.withColumn("sample_weight", F.greatest("advantage", F.lit(0.0))).drop(*[f"{k}_local" for k in KINDS])
