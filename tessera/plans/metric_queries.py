"""Queries of evaluation metrics and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import mean_or_zero, ratio
from tessera.operators import metrics as mt
from tessera.operators import reward as rw
from tessera.operators import rollout_metrics as rm

from .registry import EP, episodes, query, table
from .summary_queries import STATUS_SQL, status

E, S = "episode_id", "step_index"


@query(f"""
WITH {EP},
r AS (SELECT episode_id, count(*) AS n, count(*) FILTER (WHERE valid) AS ok, count(*) FILTER (WHERE k % 8 = 1) AS attempts, count(*) FILTER (WHERE tool_name = 'seek_evidence') AS seek FROM ep GROUP BY episode_id)
SELECT round(avg(seek), 6) AS mean_search_steps, round(avg(n), 6) AS mean_turns, round(sum(ok) / CAST(sum(n + attempts) AS DOUBLE), 6) AS tool_validity, round(sum(ok) / CAST(sum(n) AS DOUBLE), 6) AS formal_validity FROM r""")
def tool_validity_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = episodes(spark, sf_dir).groupBy(E).agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("ok"), F.count_if(F.col("k") % 8 == 1).alias("bad"), F.count_if(F.col("tool_name") == "seek_evidence").alias("seek"))
    return r.agg(
        F.round(mean_or_zero(F.col("seek")), 6).alias("mean_search_steps"), F.round(mean_or_zero(F.col("n")), 6).alias("mean_turns"),
        F.round(ratio(F.sum("ok"), F.sum(F.col("n") + F.col("bad"))), 6).alias("tool_validity"), F.round(ratio(F.sum("ok"), F.sum("n")), 6).alias("formal_validity"),
    )


@query("""
WITH s AS (SELECT lang, doc_id, quality AS target, CASE WHEN n_chars % 4 = 0 THEN 0.75 WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS score FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER w AS rank, sum(target) OVER (PARTITION BY lang ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id))
SELECT lang, round(coalesce(sum(CASE WHEN target = 1 THEN tp / CAST(rank AS DOUBLE) END) / nullif(sum(target), 0), 0), 6) AS average_precision FROM r GROUP BY lang""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision at each hit in stable order of falling score: ties keep the order of ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    n = F.col("n_chars")
    s = table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", "doc_id", F.col("quality").alias("target"), F.when(n % 4 == 0, 0.75).when(n % 3 == 0, 0.0).otherwise(1.0).alias("score"))
    return mt.average_precision(s, ["lang"], "target", "score", "doc_id")


@query("""
WITH p AS (SELECT lang AS truth, CASE WHEN n_chars % 7 = 0 THEN 'en' WHEN n_chars % 11 = 0 THEN 'it' ELSE lang END AS guess FROM documents WHERE lang <> 'de'),
t AS (SELECT truth AS c, count(*) AS n, count(*) FILTER (WHERE truth = guess) AS tp FROM p GROUP BY truth), g AS (SELECT guess AS c, count(*) AS n FROM p GROUP BY guess)
SELECT t.c AS class, round(CASE WHEN tp > 0 THEN 2 * tp / CAST(t.n + coalesce(g.n, 0) AS DOUBLE) ELSE 0 END, 6) AS f1, round(avg(CASE WHEN tp > 0 THEN 2 * tp / CAST(t.n + coalesce(g.n, 0) AS DOUBLE) ELSE 0 END) OVER (), 6) AS macro_f1 FROM t LEFT JOIN g ON t.c = g.c""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each true class and their mean; classes that are only predicted don't count."""
    n = F.col("n_chars")
    p = table(spark, sf_dir, "documents").where("lang <> 'de'").select(F.col("lang").alias("truth"), F.when(n % 7 == 0, "en").when(n % 11 == 0, "it").otherwise(F.col("lang")).alias("guess"))
    return mt.macro_f1(p, "truth", "guess")


ALERT_CTES = """alert0 AS (SELECT episode_id, min(CASE WHEN tool_name = 'finalize_case' THEN start_sec END) AS onset, max(CASE WHEN tool_name = 'finalize_case' THEN end_sec END) AS offset_sec, max(end_sec) AS duration,
             coalesce(min(CASE WHEN tool_name = 'emit_alert' AND k % 2 = 0 THEN start_sec END), min(CASE WHEN tool_name = 'emit_alert' THEN start_sec END)) AS alert, min(CASE WHEN k % 6 = 0 THEN start_sec END) AS precursor, episode_id % 3 <> 0 AS anomaly FROM ep GROUP BY episode_id),
alert1 AS (SELECT *, coalesce(onset, 0) AS t0, greatest(0.5, 0.02 * duration) AS tol, greatest(coalesce(offset_sec - onset, 0), 1) AS len, greatest(coalesce(onset - precursor, 0), 1) AS pre FROM alert0),
alerts AS (SELECT episode_id, anomaly, round(alert, 6) AS alert_sec, round(CASE WHEN NOT anomaly THEN CASE WHEN alert IS NULL THEN 1 ELSE -1 END WHEN alert IS NULL THEN 0 WHEN alert < t0 - tol THEN -least(1, (t0 - alert) / pre) ELSE 1 - least(1, greatest(0, alert - t0) / len) END, 6) AS utility,
       (anomaly AND alert IS NOT NULL AND alert < t0 - tol) AS premature, (anomaly AND alert IS NOT NULL AND alert > t0 + tol) AS late, (NOT anomaly AND alert IS NOT NULL) AS false_alert
FROM alert1)"""
ALERT = f"WITH {EP},\n{ALERT_CTES}\nSELECT * FROM alerts"


@query(ALERT)
def alert_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How timely the first anomaly alert (else the first alert) of each episode is."""
    return _alerts(spark, sf_dir)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.col("tool_name"), F.col("start_sec")
    first = lambda cond: F.min(F.when(cond, s))
    a = episodes(spark, sf_dir).groupBy(E).agg(
        first(t == "finalize_case").alias("onset"), F.max(F.when(t == "finalize_case", F.col("end_sec"))).alias("off"), F.max("end_sec").alias("duration"),
        F.coalesce(first((t == "emit_alert") & (F.col("k") % 2 == 0)), first(t == "emit_alert")).alias("alert"), first(F.col("k") % 6 == 0).alias("pre"),
    )
    a = a.withColumn("anomaly", F.col(E) % 3 != 0)
    return mt.alert_utility(a, "onset", "off", "pre", "duration", "alert", "anomaly").select(E, "anomaly", F.round("alert", 6).alias("alert_sec"), "utility", "premature", "late", "false_alert")


@query(f"""
WITH {EP},
v AS (SELECT episode_id, {STATUS_SQL} AS p, CASE k % 4 WHEN 0 THEN 'justified' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'late' ELSE 'premature' END AS a, k / CAST(100 AS DOUBLE) AS suff, value / 500 AS nec, (k % 11) / CAST(10 AS DOUBLE) AS cons, 1.5 - k / CAST(50 AS DOUBLE) AS faith
      FROM ep WHERE tool_name = 'verify_hypothesis' AND episode_id % 4 <> 3 QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY step_index DESC) = 1),
o AS (SELECT DISTINCT episode_id, 'complete' AS p, 'late' AS a, CAST(0.5 AS DOUBLE) AS suff, CAST(0.25 AS DOUBLE) AS nec, CAST(0 AS DOUBLE) AS cons, CAST(0.5 AS DOUBLE) AS faith FROM ep WHERE episode_id % 4 = 3 AND episode_id % 8 = 3),
lv AS (SELECT * FROM v UNION ALL SELECT * FROM o),
t AS (SELECT episode_id, count(*) % 9 AS turns, count(*) FILTER (WHERE NOT valid) % 4 AS bad, min(step_index) FILTER (WHERE tool_name = 'verify_hypothesis' AND episode_id % 4 <> 3) AS fv, min(step_index) FILTER (WHERE tool_name = 'finalize_case' AND episode_id % 5 <> 4) AS ff,
        min(step_index) FILTER (WHERE tool_name = 'emit_alert' AND episode_id % 2 = 0 AND k > 40) AS fa, episode_id % 3 <> 2 AS finalized, episode_id % 7 <> 6 AS answered FROM ep GROUP BY episode_id),
c AS (SELECT t.episode_id, CAST(CASE WHEN finalized THEN 1 ELSE 0 END AS DOUBLE) AS decision,
        CAST(CASE WHEN ff IS NULL AND NOT finalized THEN -1 WHEN NOT ((fa IS NOT NULL AND answered) OR fa IS NULL) THEN -0.5 WHEN fv IS NULL AND lv.p IS NULL THEN -0.75 WHEN ff IS NOT NULL AND fa IS NOT NULL THEN CASE WHEN fv < ff AND ff < fa THEN 1 ELSE -1 END
             WHEN ff IS NOT NULL THEN CASE WHEN fv IS NULL OR fv < ff THEN 1 ELSE -1 END WHEN fv < fa THEN 0.5 ELSE -0.5 END AS DOUBLE) AS protocol,
        CASE WHEN lv.p IS NULL THEN 0 ELSE 0.5 * cons + 0.5 * suff END AS temporal, CAST(CASE a WHEN 'justified' THEN 1 WHEN 'late' THEN -0.35 WHEN 'premature' THEN -0.8 ELSE 0 END AS DOUBLE) AS alert,
        CASE WHEN lv.p IS NULL THEN 0 ELSE greatest(-1, least(1, CASE lv.p WHEN 'complete' THEN 1 WHEN 'redundant' THEN 0.35 WHEN 'incomplete' THEN -0.35 WHEN 'misaligned' THEN -1 ELSE 0 END + 0.2 * suff + 0.2 * nec)) END AS verification,
        CAST(CASE WHEN NOT finalized OR turns + bad = 0 THEN 0 ELSE greatest(-1, 1 - 0.15 * greatest(turns + bad - 1, 0)) END AS DOUBLE) AS efficiency, CAST(-least(1, 0.4 * bad) AS DOUBLE) AS invalid,
        CASE WHEN lv.p IS NULL THEN 0 ELSE greatest(-1, least(1, faith)) END AS counterfactual, CAST(CASE WHEN lv.p IS NULL THEN 0 ELSE turns / CAST(16 AS DOUBLE) - 0.25 END AS DOUBLE) AS teacher
      FROM t LEFT JOIN lv ON t.episode_id = lv.episode_id)
SELECT episode_id, round(decision, 5) AS decision_reward, round(protocol, 5) AS protocol_reward, round(temporal, 5) AS temporal_grounding_reward, round(alert, 5) AS alert_calibration_reward, round(verification, 5) AS self_verification_quality_reward, round(efficiency, 5) AS efficiency_reward,
       round(invalid, 5) AS invalid_attempt_penalty, round(counterfactual, 5) AS counterfactual_reward, round(teacher, 5) AS teacher_agreement_reward, round(verification, 5) AS verification_reward,
       round(1.2 * decision + protocol + 0.8 * temporal + 0.8 * alert + verification + 0.4 * efficiency + 0.6 * invalid + 0.6 * counterfactual + 0.6 * teacher, 5) AS total_reward
FROM c""")
def reward_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine weighted components of each episode's reward; the verdict is its last verification, else an offline one."""
    i, k, t = F.col(E), F.col("k"), F.col("tool_name")
    verify = (t == "verify_hypothesis") & (i % 4 != 3)
    tool = F.when(verify, t).when((t == "finalize_case") & (i % 5 != 4), t)
    action = F.when((t == "emit_alert") & (i % 2 == 0) & (k > 40), "answer").otherwise("tool_call")
    scores = lambda suff, nec, cons, faith: F.create_map(F.lit("sufficiency"), suff, F.lit("necessity"), nec, F.lit("consistency"), cons, F.lit("counterfactual_faithfulness"), faith)
    timing = F.get(F.array(*[F.lit(x) for x in ("justified", "not_applicable", "late", "premature")]), (k % 4).cast("int"))
    turn = F.struct(F.col(S).alias("step_index"), tool.alias("tool_name"), action.alias("action"), status(k).alias("primary_status"), timing.alias("alert_status"), F.when(verify, scores(k / 100, F.col("value") / 500, (k % 11) / 10, 1.5 - k / 50)).alias("scores"))
    ordered = F.array_sort(F.collect_list(turn), lambda a, b: (a["step_index"] - b["step_index"]).cast("int"))
    ep = episodes(spark, sf_dir).groupBy(E).agg(ordered.alias("turns"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("bad"))
    offline = F.when(i % 8 == 3, F.struct(F.lit("complete").alias("primary_status"), F.lit("late").alias("alert_status"), scores(F.lit(0.5), F.lit(0.25), F.lit(0.0), F.lit(0.5)).alias("scores")))
    rows = ep.select(E, "turns", offline.alias("offline"), (i % 3 != 2).alias("finalized"), (i % 7 != 6).alias("answered"), (F.col("n") % 9).alias("n"), (F.col("bad") % 4).alias("bad"))
    parts = rw.components(F.col("turns"), F.col("offline"), F.col("finalized"), F.col("answered"), F.col("n"), F.col("bad"), F.col("n") / 16 - 0.25)
    shown = {n: c for n, c in rw.with_former_names(parts).items() if n in rw.WEIGHTS or n == "verification_reward"}
    return rows.select(E, *[F.round(c, 5).alias(n) for n, c in shown.items()], F.round(rw.total(parts), 5).alias("total_reward"))


@query("""
WITH t AS (SELECT d.doc_id, quality, toxic, n_chars, (n_chars % 11) / CAST(10 AS DOUBLE) AS s1, (n_chars % 7) / CAST(6 AS DOUBLE) AS s2, (d.doc_id % 11) / CAST(10 AS DOUBLE) AS p1, (d.doc_id % 7) / CAST(6 AS DOUBLE) AS p2 FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
a AS (SELECT *, (greatest(0, 1 - abs(s1 - p1)) + greatest(0, 1 - abs(s2 - p2))) / 2 AS agreement, (s1 + s2) / 2 AS confidence, CAST(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END AS DOUBLE) AS align FROM t)
SELECT doc_id, round(agreement, 6) AS agreement, round(confidence, 6) AS confidence, round(greatest(-1, least(1, confidence * (0.7 * (2 * align - 1) + 0.3 * (2 * agreement - 1)))), 6) AS teacher_reward,
       round(greatest(0.35, least(2, (0.85 + 0.5 * confidence) * CASE WHEN n_chars > 2000 THEN 1.15 ELSE 1 END * CASE WHEN align = 1 THEN 1.15 ELSE 0.7 END)), 6) AS multiplier
FROM a""")
def teacher_signal_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a second judgement agrees with the first, and the weight that follows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    t = table(spark, sf_dir, "labels").join(d, "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    teacher = F.create_map(F.lit("sufficiency"), (n % 11) / 10, F.lit("necessity"), (n % 7) / 6)
    policy = F.create_map(F.lit("sufficiency"), (i % 11) / 10, F.lit("necessity"), (i % 7) / 6)
    align = (F.col("quality") == 1 - F.col("toxic")).cast("double")
    agreement, confidence = rw.agreement(teacher, policy), rw.confidence(teacher)
    return t.select("doc_id", F.round(agreement, 6).alias("agreement"), F.round(confidence, 6).alias("confidence"), F.round(rw.teacher_reward(confidence, align, agreement), 6).alias("teacher_reward"), F.round(rw.multiplier(confidence, n > 2000, align == 1), 6).alias("multiplier"))


CLIP = 2_592_000
#: Rollouts from the log: the claim is the last finalize turn (by where it stands: final case, answer or last claim), references are made of the first ones.
ROLLOUT_CTES = """t0 AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY step_index) AS i, row_number() OVER (PARTITION BY episode_id, tool_name ORDER BY step_index) AS j FROM ep),
goal AS (SELECT episode_id, max(start_sec) FILTER (WHERE j = 1) AS g1, max(end_sec) FILTER (WHERE j = 1) AS g2, max(start_sec) FILTER (WHERE j = 2) AS c1, max(end_sec) FILTER (WHERE j = 2) AS c2, max(k) FILTER (WHERE j = 1) AS gk, max(k) FILTER (WHERE j = 2) AS ck FROM t0 WHERE tool_name = 'finalize_case' GROUP BY episode_id),
al AS (SELECT episode_id, coalesce(min(start_sec) FILTER (WHERE k % 2 = 0), min(start_sec)) AS asec, count(*) FILTER (WHERE k % 2 = 0) > 0 AS alarm FROM ep WHERE tool_name = 'emit_alert' GROUP BY episode_id),
lg AS (SELECT episode_id, start_sec AS s, start_sec + value * 600 AS e, j, k FROM t0 WHERE tool_name = 'seek_evidence'),
pick AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY j) AS o FROM lg WHERE episode_id % 4 = 0 OR k % 3 = 0),
pred AS (SELECT episode_id, list({'s': s, 'e': e} ORDER BY j) AS p FROM pick WHERE o <= 3 GROUP BY episode_id),
tn AS (SELECT episode_id, count(*) AS n, count(*) FILTER (WHERE tool_name IN ('scan_timeline', 'seek_evidence')) AS searches, count(*) FILTER (WHERE CASE WHEN k % 4 = 0 THEN k % 8 = 0 ELSE k % 7 <> 0 END) AS ok,
         min(step_index) FILTER (WHERE tool_name = 'finalize_case') AS ff, min(step_index) FILTER (WHERE k % 7 = 1 AND k % 4 <> 0 AND tool_name = 'emit_alert') AS fa FROM ep GROUP BY episode_id)"""


def _rollouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rollouts and references made of the episode log, in the schema of ``rollout_metrics``; one aggregate over the log."""
    i, k, t, s = F.col(E), F.col("k"), F.col("tool_name"), F.col("start_sec")
    ordered = lambda cond, x: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(S).alias("at"), x.alias("x"))))), lambda y: y["x"])
    action = F.when(k.isNull(), F.lit(None)).when(k % 7 == 0, "bad").when((k % 7 == 1) & (t == "emit_alert") & (k % 4 != 0), "answer").otherwise("tool_call")
    turn = F.struct(F.col(S).alias("step_index"), action.alias("action"), t.alias("tool_name"), (k % 4 == 0).alias("said_valid"), F.when(k % 4 == 0, F.when(k % 8 == 0, True)).alias("valid_action"))
    window = F.struct(F.concat(F.lit("w"), F.col(S).cast("string")).alias("window_id"), s.alias("start_sec"), F.when(t == "seek_evidence", s + F.col("value") * 600).otherwise(F.col("end_sec")).alias("end_sec"))
    alert = F.struct(F.when(k % 2 == 0, "soft_alert").otherwise("none").alias("decision"), s.alias("alert_sec"))
    goal = F.struct(s.alias("start"), F.col("end_sec").alias("end"), k.alias("k"))
    a = episodes(spark, sf_dir).groupBy(E).agg(
        F.count(F.lit(1)).alias("n"), ordered(F.lit(True), turn).alias("turns"), ordered(t == "seek_evidence", window).alias("ledger"), ordered(t.isin("scan_timeline", "seek_evidence"), window).alias("visited"),
        ordered((t == "seek_evidence") & (k % 3 == 0), F.concat(F.lit("w"), F.col(S).cast("string"))).alias("selection"), ordered(t == "emit_alert", alert).alias("alerts"), ordered(t == "finalize_case", goal).alias("goals"),
    )
    g, c = F.get("goals", F.lit(0)), F.get("goals", F.lit(1))
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    kinds = lambda x: F.get(F.array(*[F.lit(v) for v in ("House Fire", "brawl", "none of these", "")]), (x % 4).cast("int"))
    claim = F.when(c.isNotNull(), F.struct(F.when(c["k"] % 5 != 0, "Anomaly ").otherwise("normal").alias("existence"), kinds(c["k"]).alias("category"), (c["k"] / 20).alias("severity"), F.when(c["k"] % 2 == 0, "Remove").alias("counterfactual_type"), span(c).alias("anomaly"), F.struct((c["start"] - 3600).alias("start"), c["start"].alias("end")).alias("precursor")))
    none = F.lit(None)
    target = F.struct(
        F.when(i % 3 != 0, "anomaly").otherwise("normal").alias("existence"), kinds(g["k"]).alias("category"), F.when(i % 5 != 0, g["k"] / 25).alias("severity"), F.when(i % 2 == 0, "remove").alias("counterfactual_type"),
        span(g).alias("anomaly"), F.when(i % 4 == 1, F.struct((g["start"] - 7200).alias("start"), g["start"].alias("end"))).alias("precursor"), (i % 2 == 0).alias("hard_normal"), F.when(i % 5 == 1, g["start"] + 60).alias("earliest_alert_sec"),
    )
    one = a.where(g.isNotNull()).withColumn("video_id", i.cast("string"))
    rollouts = one.select(
        "video_id", F.col("n").alias("num_turns"), "turns", F.slice("turns", 1, 2).alias("invalid_attempts"), F.when(i % 6 < 3, claim).alias("finalized_case"), F.when((i % 6 < 5) & c["k"].isNotNull(), claim).alias("final_answer"), claim.alias("last_claim"),
        "alerts", "visited", "ledger", "selection", (i % 4 != 0).alias("selection_observed"),
    )
    evidence = F.when(i % 7 == 6, F.array().cast("array<struct<start:double,end:double>>")).otherwise(F.transform(F.filter("ledger", lambda w, p: p % 2 == 0), lambda w: F.struct(w["start_sec"].alias("start"), (w["end_sec"] + 300).alias("end"))))
    return rollouts, one.select("video_id", target.alias("target"), evidence.alias("evidence"), F.lit(float(CLIP)).alias("duration"))


KIND_SQL = "CASE {k} % 4 WHEN 0 THEN 'fire' WHEN 1 THEN 'fighting' WHEN 2 THEN 'none_of_these' ELSE 'unknown' END"
RECORD_SQL = f"""r AS (SELECT g.*, g.episode_id % 3 <> 0 AS anomaly, coalesce(ck % 5 <> 0, false) AS said, coalesce(alarm, false) AS alarm, asec, CASE WHEN g.episode_id % 5 = 1 THEN g1 + 60 ELSE g1 END AS t0, n, searches, ok, ff, fa, p,
       greatest(0, least(g2, c2) - greatest(g1, c1)) AS ov FROM goal g LEFT JOIN al ON g.episode_id = al.episode_id JOIN tn ON g.episode_id = tn.episode_id LEFT JOIN pred ON g.episode_id = pred.episode_id),
u0 AS (SELECT episode_id, start_sec AS s, CASE tool_name WHEN 'seek_evidence' THEN start_sec + value * 600 ELSE end_sec END AS e FROM ep WHERE tool_name IN ('seek_evidence', 'scan_timeline')),
u1 AS (SELECT *, max(e) OVER (PARTITION BY episode_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM u0 WHERE e > s),
u AS (SELECT episode_id, sum(greatest(0, e - greatest(s, coalesce(b, s)))) / {CLIP} AS clip FROM u1 GROUP BY episode_id),
iv AS (SELECT episode_id, sum(CASE WHEN CASE WHEN k % 4 = 0 THEN k % 8 = 0 ELSE k % 7 <> 0 END THEN 1 ELSE 0 END) AS ok2, count(*) AS n2 FROM t0 WHERE i <= 2 GROUP BY episode_id),
m AS (SELECT CAST(r.episode_id AS VARCHAR) AS video_id, anomaly AS is_anomaly, said AS said_anomaly, CAST(CASE WHEN ck IS NOT NULL THEN CASE WHEN said THEN 1 ELSE 0 END WHEN alarm THEN 0.75 ELSE 0 END AS DOUBLE) AS existence_score,
  CASE WHEN anomaly THEN {KIND_SQL.format(k='gk')} END AS true_category, CASE WHEN anomaly THEN CASE WHEN said THEN {KIND_SQL.format(k='ck')} ELSE 'normal' END END AS said_category,
  CASE WHEN anomaly THEN coalesce(ov / greatest((g2 - g1) + (c2 - c1) - ov, 1e-6), 0) END AS temporal_iou, CASE WHEN anomaly AND r.episode_id % 4 = 1 THEN coalesce(greatest(0, least(g1, c1) - greatest(g1 - 7200, c1 - 3600)) / greatest(10800 - greatest(0, least(g1, c1) - greatest(g1 - 7200, c1 - 3600)), 1e-6), 0) END AS precursor_iou,
  CASE WHEN NOT anomaly THEN CASE WHEN alarm THEN -1 ELSE 1 END WHEN NOT alarm THEN 0 WHEN asec < t0 - greatest(0.5, 0.02 * {CLIP}) THEN -least(1, (t0 - asec) / CASE WHEN r.episode_id % 4 = 1 THEN 7200 ELSE 1 END) ELSE 1 - least(1, greatest(0, asec - t0) / greatest(g2 - g1, 1)) END::DOUBLE AS alert_utility,
  CASE WHEN anomaly THEN CAST(alarm AND asec < t0 - 0.02 * {CLIP} AS INTEGER) END::DOUBLE AS premature, CASE WHEN anomaly THEN CAST(alarm AND asec > t0 + 0.02 * {CLIP} AS INTEGER) END::DOUBLE AS late, CASE WHEN NOT anomaly THEN CAST(alarm AS INTEGER) END::DOUBLE AS false_alert,
  CASE WHEN NOT anomaly AND r.episode_id % 2 = 0 THEN CAST(alarm AS INTEGER) END::DOUBLE AS hard_normal_false_alert, CASE WHEN anomaly AND r.episode_id % 2 = 0 THEN CAST(coalesce(ck % 2 = 0, false) AS INTEGER) END::DOUBLE AS counterfactual_hit,
  CASE WHEN anomaly AND r.episode_id % 5 <> 0 THEN abs(ck / CAST(20 AS DOUBLE) - gk / CAST(25 AS DOUBLE)) END AS severity_error, coalesce(clip, 0) AS inspected_clip_ratio, CAST(searches AS DOUBLE) AS search_steps, CAST(n AS DOUBLE) AS num_turns,
  (ok + ok2) / CAST(n + n2 AS DOUBLE) AS tool_call_validity, ok / CAST(n AS DOUBLE) AS formal_turn_validity,
  CAST(CASE WHEN fa IS NOT NULL AND (ck IS NULL OR r.episode_id % 6 = 5) THEN 0 WHEN fa IS NOT NULL THEN CASE WHEN ff < fa THEN 1 ELSE 0 END ELSE 1 END AS DOUBLE) AS protocol_compliance
  FROM r LEFT JOIN u ON r.episode_id = u.episode_id JOIN iv ON r.episode_id = iv.episode_id)"""
RECORD_COLUMNS = "is_anomaly said_anomaly existence_score true_category said_category temporal_iou precursor_iou alert_utility premature late false_alert hard_normal_false_alert counterfactual_hit severity_error inspected_clip_ratio search_steps num_turns tool_call_validity formal_turn_validity protocol_compliance".split()
TEXTS = ("is_anomaly", "said_anomaly", "true_category", "said_category")


def _short(c: str) -> Column:
    """Four decimals, as the SQL's engine rounds doubles: 0.07125 * 10000 is below 712.5."""
    return (F.round(F.col(c) * 10_000) / 10_000).alias(c)


@query(f"""
WITH {EP},
{ROLLOUT_CTES},
{RECORD_SQL}
SELECT video_id, {", ".join(c if c in TEXTS else f"round({c}, 4) AS {c}" for c in RECORD_COLUMNS)} FROM m""")
def rollout_record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each rollout against its reference (evidence matches are in ``evidence_prf_at3``)."""
    m = rm.record_metrics(*_rollouts(spark, sf_dir))
    return m.select("video_id", *[F.col(c) if c in TEXTS else _short(c) for c in RECORD_COLUMNS])


SUMMARY_SQL = ", ".join(f"round(coalesce(avg({c}), 0), 4) AS {n}" for n, c in rm.MEANS.items() if not n.startswith("evidence"))


@query(f"""
WITH {EP},
{ROLLOUT_CTES},
{RECORD_SQL}
SELECT CAST(count(*) AS BIGINT) AS num_records, round(avg(CASE WHEN is_anomaly = said_anomaly THEN 1 ELSE 0 END), 4) AS existence_accuracy, {SUMMARY_SQL} FROM m""")
def episode_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics over the rollouts that have a reference, in one row (evidence means are tested apart)."""
    s = rm.summary(rm.record_metrics(*_rollouts(spark, sf_dir)))
    return s.select("num_records", *[_short(c) for c in ("existence_accuracy", *[n for n in rm.MEANS if not n.startswith("evidence")])])
