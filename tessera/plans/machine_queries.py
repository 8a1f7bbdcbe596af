"""Queries of the episode state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.machine import Clip, replay

from .registry import EP, episodes, query


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply of each turn of the log: tool calls in several spellings, some that break a rule, some that can't be read."""
    k = F.col("k")
    num = lambda c: F.round(c, 3).cast("string")
    kind = F.get(F.array(*[F.lit(x) for x in ("House Fire", "brawl", "nonsense", "robbery")]), (k % 4).cast("int"))
    times = F.concat(F.lit('"start_time":"'), num(F.col("value") / 10), F.lit('s","end_sec":'), num(F.col("value") / 5))
    alert = F.concat(F.lit('"alert_type":"'), F.when(k % 3 == 0, "normal").when(k % 3 == 1, "soft").otherwise("hard"), F.lit('","category":"'), F.when(k % 3 == 0, "").otherwise(kind), F.lit('","alert_sec":'), num(F.col("value") / 8))
    report = F.concat(
        F.lit('"verification_mode":"final_check","selected_window_ids":["w000'), (k % 9).cast("string"), F.lit('","evidence_0"],"verification_decision":"'), F.when(k % 2 == 0, "sufficient").otherwise("?"),
        F.lit('","recommended_action":"","sufficiency_score":'), num(k / 100), F.lit(',"necessity_score":0.4,"alertability_score":'), num((k % 10) / 10), F.lit(',"counterfactual_faithfulness":0.2'),
    )
    request = F.concat(F.lit('"query":"any","allow_external_verifier_fallback":'), F.when(k % 2 == 0, "true").otherwise("false"))
    final = F.concat(F.lit('"existence":"anomaly","category":"'), kind, F.lit('"'))
    t = F.col("tool_name")
    args = F.when(t.isin("scan_timeline", "seek_evidence"), times).when(t == "emit_alert", alert).when(t == "verify_hypothesis", F.when(k % 5 == 0, request).otherwise(report)).otherwise(final)
    call = F.when(k % 7 == 0, F.concat(F.lit("<tool_call>{"), t, F.lit(": {"), args, F.lit("}}</tool_call>"))).otherwise(F.concat(F.lit('<think><answer>no</answer></think><tool_call>{"name":"'), t, F.lit('","arguments":{'), args, F.lit("}}</tool_call>")))
    reply = F.when(~F.col("valid"), "I think so").when((k == 99) & (t == "finalize_case"), '<answer>{"existence":"normal"}</answer>').otherwise(call)
    return episodes(spark, sf_dir).select("episode_id", "step_index", reply.alias("reply"))


@query()
def episode_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply of every episode up to its end, with what it gave."""
    return replay(replies(spark, sf_dir), Clip(duration=60.0, fps=2.0))


@query(f"""
WITH {EP},
k AS (SELECT *, (CASE WHEN tool_name = 'seek_evidence' THEN 'search' WHEN tool_name = 'emit_alert' THEN 'alert' WHEN tool_name = 'finalize_case' THEN 'finalization' WHEN tool_name = 'verify_hypothesis' AND k % 2 = 0 THEN 'final_verification' WHEN tool_name = 'verify_hypothesis' THEN 'soft_alert_verification' ELSE 'unknown' END) AS stage FROM ep)
SELECT episode_id, step_index, stage, concat_ws(',', CASE WHEN stage = 'search' AND valid THEN 'search_anchor' END, CASE WHEN stage IN ('alert', 'finalization') AND valid THEN 'alert_anchor' END, CASE WHEN stage LIKE '%verification' AND valid THEN 'evidence_anchor' END) AS tags FROM k""")
def turn_stages_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tool_name")
    stage = F.when(t == "seek_evidence", "search").when(t == "emit_alert", "alert").when(t == "finalize_case", "finalization").when((t == "verify_hypothesis") & (F.col("k") % 2 == 0), "final_verification").when(t == "verify_hypothesis", "soft_alert_verification").otherwise("unknown")
    e = episodes(spark, sf_dir).withColumn("stage", stage)
    s, ok = F.col("stage"), F.col("valid")
    tags = F.concat_ws(",", F.when((s == "search") & ok, "search_anchor"), F.when(s.isin("alert", "finalization") & ok, "alert_anchor"), F.when(s.endswith("verification") & ok, "evidence_anchor"))
    return e.select("episode_id", "step_index", "stage", tags.alias("tags"))
