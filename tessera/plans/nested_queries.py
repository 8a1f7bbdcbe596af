"""Queries of nested summaries, payloads of several layouts, and credit between turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import credit as cr
from tessera.operators import judge_package as jp
from tessera.operators import nested as ns
from tessera.operators import self_teacher as st
from tessera.operators import verify as vf

from .registry import EP, episodes, query, table

E, S = "episode_id", "step_index"
STATUSES = ["complete", "incomplete", "redundant", "misaligned"]


@query(f"""
WITH {EP},
a AS (SELECT episode_id, count(*) AS n, avg(value) AS reward, count(*) FILTER (WHERE tool_name = 'seek_evidence') AS seeks, min(start_sec) FILTER (WHERE tool_name = 'emit_alert') AS alert, max(value) FILTER (WHERE tool_name = 'verify_hypothesis') AS v FROM ep GROUP BY episode_id),
s AS (SELECT *, CASE WHEN v > 480 THEN 'complete' WHEN v > 400 THEN 'incomplete' WHEN v > 300 THEN 'odd' END AS primary_status, CASE WHEN alert > 86400 THEN 'late' WHEN alert IS NOT NULL THEN 'justified' END AS alert_status FROM a),
t AS (SELECT count(*) AS n FROM s),
p AS (SELECT 'reward.total' AS path, NULL AS value, round(reward + 1e-9, 3) AS x FROM s UNION ALL SELECT 'reward.parts.search', NULL, seeks FROM s UNION ALL SELECT 'reward.parts.turns', NULL, n FROM s WHERE n > 60
      UNION ALL SELECT 'search.first.0', NULL, seeks FROM s UNION ALL SELECT 'search.first.1', NULL, n FROM s),
g AS (SELECT path, CAST(NULL AS VARCHAR) AS value, count(*) AS c, avg(x) AS mean, min(x) AS least, max(x) AS most FROM p GROUP BY path
      UNION ALL SELECT 'status.alert', alert_status, count(*), NULL, NULL, NULL FROM s WHERE alert_status IS NOT NULL GROUP BY alert_status
      UNION ALL SELECT 'status.primary', d, (SELECT count(*) FROM s WHERE coalesce(CASE WHEN primary_status IN ('complete', 'incomplete', 'redundant', 'misaligned') THEN primary_status END, 'unknown') = d), NULL, NULL, NULL FROM unnest(['complete', 'incomplete', 'redundant', 'misaligned', 'unknown']) u(d))
SELECT path, value, CAST(c AS BIGINT) AS n, round(c / CAST((SELECT n FROM t) AS DOUBLE), 6) AS share, round(mean, 6) AS mean, round(CAST(least AS DOUBLE), 6) AS least, round(CAST(most AS DOUBLE), 6) AS most FROM g""")
def nested_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards, their parts, statuses and searches of all episodes, nested as their records hold them, summed up by path."""
    t, v = F.col("tool_name"), F.col("value")
    a = episodes(spark, sf_dir).groupBy(E).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("reward"), F.count_if(t == "seek_evidence").alias("seeks"), F.min(F.when(t == "emit_alert", F.col("start_sec"))).alias("alert"), F.max(F.when(t == "verify_hypothesis", v)).alias("v"),
    )
    n = F.col("n")
    primary = F.when(F.col("v") > 480, "complete").when(F.col("v") > 400, "incomplete").when(F.col("v") > 300, "odd")
    alert = F.when(F.col("alert") > 86400, "late").when(F.col("alert").isNotNull(), "justified")
    parts = F.struct(F.col("seeks").alias("search"), F.when(n > 60, n).alias("turns"))
    record = F.struct(
        F.struct(F.round(F.col("reward") + 1e-9, 3).alias("total"), parts.alias("parts")).alias("reward"), F.struct(primary.alias("primary"), alert.alias("alert"), F.lit("x").alias("_note")).alias("status"), F.struct(F.array("seeks", "n").alias("first")).alias("search"),
    )
    s = ns.summarize(a.select(F.parse_json(F.to_json(record)).alias("record")), "record", 4, {"status.primary": STATUSES})
    return s.select("path", "value", "n", *[F.round(c, 6).alias(c) for c in ("share", "mean", "least", "most")])


@query("""
WITH e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, list_transform(embedding[1:3], lambda x: floor(CAST(x AS DOUBLE) * 1000)) AS v FROM embeddings),
g AS (SELECT label, count(*) AS n, list(vec_id ORDER BY vec_id) AS ids, list(i ORDER BY i) AS places, sum(v[1] + v[2] + v[3]) AS total FROM e GROUP BY label),
k AS (SELECT *, label % 4 AS kind, CASE WHEN label % 4 = 1 THEN CAST(2.5 AS DOUBLE) WHEN label % 4 = 2 THEN 4 ELSE 2 END AS fps FROM g WHERE label % 4 <> 3),
f AS (SELECT *, CASE WHEN kind = 0 THEN places ELSE ids END AS frames FROM k)
SELECT CAST(label AS INTEGER) AS label, CASE kind WHEN 0 THEN 'features.v0' WHEN 1 THEN 'features.v1' ELSE 'own' END AS version, CASE kind WHEN 0 THEN 'legacy_tensor' WHEN 1 THEN 'unknown' ELSE 'm' END AS model_name, fps, CAST(n AS INTEGER) AS n_frames,
       CAST(frames[1] AS INTEGER) AS first_frame, round(CASE WHEN kind = 2 THEN n * 0.5 ELSE list_sum(list_transform(places, lambda p: round(p / fps, 6))) END, 4) AS seconds, CAST(3 AS INTEGER) AS embedding_dim, kind = 2 AS normalized, round(total, 3) AS total,
       CASE WHEN kind = 2 THEN 'sig' ELSE sha1('{"fps": ' || fps || ', "frame_indices": [' || array_to_string(frames, ', ') || '], "num_frames": ' || n || '}') END AS frame_cache_signature
FROM f""")
def feature_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose payloads are bare lists, objects with gaps, whole objects, and no payload at all, in one layout."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("v"))
    g = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("r"))
    rows, ids, kind = F.transform("r", lambda x: x["v"]), F.transform("r", lambda x: x["vec_id"]), F.col("label") % 4
    short = F.to_json(F.struct(rows.alias("embeddings"), ids.alias("frame_indices"), F.array(F.lit(0.5)).alias("timestamps_sec"), F.lit(2.5).alias("fps")))
    whole = F.struct(
        F.lit("own").alias("version"), F.lit("m").alias("model_name"), F.lit(4.0).alias("fps"), ids.alias("frame_indices"), F.transform(ids, lambda x: F.lit(0.5)).alias("timestamps_sec"), rows.alias("embeddings"), F.lit(3).alias("embedding_dim"),
        F.lit(True).alias("normalized"), F.lit("sig").alias("frame_cache_signature"),
    )
    text = F.when(kind == 0, F.to_json(rows)).when(kind == 1, short).when(kind == 2, F.to_json(whole)).otherwise('{"note":"no features"}')
    p = g.select("label", ns.feature_payload(F.parse_json(text), F.lit(2.0)).alias("p")).where("p IS NOT NULL").select("label", "p.*")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda n, x: n + x)
    return p.select(
        "label", "version", "model_name", "fps", F.size("embeddings").alias("n_frames"), F.get("frame_indices", F.lit(0)).alias("first_frame"), F.round(add("timestamps_sec"), 4).alias("seconds"), "embedding_dim", "normalized",
        F.round(add(F.flatten("embeddings")), 3).alias("total"), "frame_cache_signature",
    )


@query(f"""
WITH {EP},
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, tool_name ORDER BY step_index) AS i, (value - 250) / CAST(250 AS DOUBLE) AS adv FROM ep),
gr AS (SELECT episode_id, step_index, adv * 0.5 AS share, CASE tool_name WHEN 'seek_evidence' THEN 'search' WHEN 'emit_alert' THEN 'alert' ELSE 'evidence' END AS kind FROM r WHERE i <= 2 AND tool_name IN ('seek_evidence', 'emit_alert', 'verify_hypothesis')),
sel AS (SELECT DISTINCT g.episode_id, g.step_index, g.share, r.k FROM gr g JOIN r ON g.kind = 'evidence' AND g.episode_id = r.episode_id AND r.tool_name = 'seek_evidence' AND r.step_index BETWEEN g.step_index - 6 AND g.step_index - 1),
sp AS (SELECT r.episode_id, r.step_index, s.step_index AS anchor, s.share * 0.5 AS share FROM sel s JOIN r ON r.tool_name = 'seek_evidence' AND r.episode_id = s.episode_id AND r.k = s.k),
al AS (SELECT episode_id, step_index, kind, share FROM gr UNION ALL SELECT episode_id, step_index, 'evidence', share FROM sp),
lo AS (SELECT episode_id, step_index, sum(share) FILTER (WHERE kind = 'search') AS s, sum(share) FILTER (WHERE kind = 'alert') AS a, sum(share) FILTER (WHERE kind = 'evidence') AS e, count(*) AS n FROM al GROUP BY ALL),
c AS (SELECT r.episode_id, r.step_index, r.tool_name, value / 500 AS g, coalesce(s, 0) AS s, coalesce(a, 0) AS a, coalesce(e, 0) AS e, CASE WHEN r.tool_name = 'verify_hypothesis' AND value > 100 THEN 0.5 * (value / 1000) ELSE 0 END AS t, coalesce(n, 0) AS n_groups FROM r LEFT JOIN lo ON r.episode_id = lo.episode_id AND r.step_index = lo.step_index WHERE valid AND tool_name <> 'scan_timeline'),
w AS (SELECT *, CASE WHEN tool_name = 'seek_evidence' THEN 1 ELSE 0 END AS ws, CASE tool_name WHEN 'emit_alert' THEN 1 WHEN 'verify_hypothesis' THEN 0.5 WHEN 'finalize_case' THEN 0.25 ELSE 0 END AS wa,
             CASE tool_name WHEN 'emit_alert' THEN 0.25 WHEN 'verify_hypothesis' THEN 1 WHEN 'finalize_case' THEN 1 WHEN 'seek_evidence' THEN CASE WHEN e <> 0 THEN 0.5 ELSE 0 END ELSE 0 END AS we FROM c)
SELECT episode_id, step_index, tool_name, round(s, 6) AS search_local, round(a, 6) AS alert_local, round(e, 6) AS evidence_local, round(t, 6) AS teacher_local, CAST(n_groups AS INTEGER) AS n_groups, round(g + s * ws + a * wa + e * we + t, 6) AS advantage FROM w""")
def counterfactual_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples of all turns with the credit of the first two groups of each kind, and what spills to the searches of the evidence they chose."""
    own = Window.partitionBy(E).orderBy(S)
    t, v = F.col("tool_name"), F.col("value")
    name = F.concat(F.lit("e"), F.col("k").cast("string"))
    before = F.array_distinct(F.collect_list(F.when(t == "seek_evidence", name)).over(own.rowsBetween(-6, -1)))
    ep = episodes(spark, sf_dir).withColumns({"i": F.row_number().over(Window.partitionBy(E, "tool_name").orderBy(S)), "before": before})
    turns = ep.where("tool_name <> 'scan_timeline'").select(
        E, S, "tool_name", F.lit("tool_call").alias("action"), "valid", F.lit("said").alias("response"), F.when(t == "seek_evidence", F.array(name)).alias("new_evidence_ids"), (v / 500).alias("global_advantage"),
        F.when((t == "verify_hypothesis") & (v > 100), v / 1000).alias("teacher_reward"),
    )
    kind = F.when(t == "seek_evidence", "search").when(t == "emit_alert", "alert").when(t == "verify_hypothesis", "evidence")
    groups = ep.where("i <= 2").withColumn("group_kind", kind).where("group_kind IS NOT NULL").select(
        E, S, "group_kind", F.concat_ws("-", "group_kind", E, S).alias("group_id"), ((v - 250) / 250).alias("local_advantage"), F.when(kind == "evidence", F.col("before")).alias("selected_evidence_ids"),
    )
    e = cr.counterfactual_examples(turns, groups, E)
    return e.select(E, S, "tool_name", *[F.round(f"components.{c}", 6).alias(c) for c in ("search_local", "alert_local", "evidence_local", "teacher_local")], F.size("group_ids").alias("n_groups"), F.round("advantage", 6).alias("advantage"))


@query(f"""
WITH {EP},
l AS (SELECT *, count(*) FILTER (WHERE tool_name = 'seek_evidence') OVER w AS n, count(*) FILTER (WHERE tool_name = 'seek_evidence' AND k % 2 = 0) OVER w AS kept FROM ep WINDOW w AS (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, least(1, value / 500) AS suff, k / CAST(100 AS DOUBLE) AS nec, 1 - least(1, value / 500) AS able, k / CAST(200 AS DOUBLE) AS fair, ['sufficient', 'insufficient', 'misaligned', 'redundant'][k % 4 + 1] AS decision, [1.0, -0.35, -1.0, 0.35][k % 4 + 1] AS worth, value / 1000 - 0.2 AS t FROM l WHERE valid),
q AS (SELECT *, greatest(-1, least(1, 0.35 * worth + 0.20 * (2 * suff - 1) + 0.15 * (2 * nec - 1) + 0.15 * (2 * fair - 1) + 0.15 * (2 * able - 1))) AS q FROM s),
ev AS (SELECT *, greatest(n, 1) AS d, least(kept, 2) AS few, 2 * suff - 1 AS a, 2 * nec - 1 AS b, 2 * fair - 1 AS c, CASE WHEN decision IN ('misaligned', 'redundant') THEN 1 ELSE -0.5 END AS odd FROM q WHERE tool_name = 'verify_hypothesis'),
e2 AS (SELECT *, greatest(-1, least(1, 0.35 * q + 0.2 * a - 0.2 * b + 0.1 * c - 0.1)) AS full_, greatest(-1, least(1, 0.45 * q + 0.2 * a + 0.2 * b + 0.1 * c + 0.05 * t - 0.025 * kept / d)) AS keep_, greatest(-1, least(1, 0.35 * q + 0.2 * a + 0.3 * b + 0.1 * c + 0.05 * t - 0.1 * few / d)) AS least_ FROM ev),
al AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'normal' ELSE 'anomaly' END AS claim, CASE WHEN k % 5 = 0 THEN 'declare_normal' ELSE 'soft_alert' END AS said, (k - 60) / CAST(10 AS DOUBLE) AS late FROM q WHERE tool_name = 'emit_alert'),
a2 AS (SELECT *, CASE WHEN claim = 'anomaly' THEN CASE WHEN said = 'soft_alert' THEN 1 ELSE -1 END ELSE CASE WHEN said = 'soft_alert' THEN -1 ELSE 1 END END AS fits, CASE WHEN late <= 0.5 THEN 1 ELSE greatest(-1, 1 - 0.1 * late) END AS timely, CASE claim WHEN 'normal' THEN 0.75 ELSE -0.65 END AS hold FROM al),
b AS (
  SELECT episode_id, step_index, 'evidence' AS kind, 'full_ledger' AS branch, CASE WHEN kept = 0 THEN greatest(-1, least(1, full_ + 0.35)) WHEN decision = 'redundant' THEN greatest(-1, full_ - 0.15) ELSE full_ END AS reward, n AS picked FROM e2
  UNION ALL SELECT episode_id, step_index, 'evidence', 'keep_selected', CASE WHEN kept = 0 THEN greatest(-1, keep_ - 0.35) ELSE keep_ END, kept FROM e2
  UNION ALL SELECT episode_id, step_index, 'evidence', 'drop_selected', greatest(-1, least(1, -0.45 * a - 0.2 * q + 0.2 * odd - 0.05 * t)), n - kept FROM e2
  UNION ALL SELECT episode_id, step_index, 'evidence', 'minimal_subset', CASE WHEN kept = 0 THEN greatest(-1, least_ - 0.25) WHEN decision = 'redundant' THEN least(1, least_ + 0.15) ELSE least_ END, few FROM e2
  UNION ALL SELECT episode_id, step_index, 'alert', 'alert_now', greatest(-1, least(1, 0.4 * fits + 0.25 * timely + 0.15 * q + 0.1 * (2 * able - 1) + 0.1 * t)), kept FROM a2
  UNION ALL SELECT episode_id, step_index, 'alert', 'hold_alert', greatest(-1, least(1, 0.55 * hold - 0.2 * fits - 0.15 * CASE WHEN claim = 'anomaly' THEN timely ELSE 0 END - 0.1 * q)), 0 FROM a2),
g AS (SELECT *, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS sd FROM b WINDOW w AS (PARTITION BY episode_id, step_index, kind))
SELECT episode_id, step_index, kind AS group_kind, branch AS branch_type, CAST(picked AS INTEGER) AS n_selected, round(reward + 1e-9, 5) AS branch_reward, round(round(CASE WHEN sd <= 1e-6 THEN 0 ELSE (reward - m) / (sd + 1e-6) END, 6) + 1e-9, 3) AS local_advantage FROM g""")
def self_teacher_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of alerts and verifications, paid by what the policy reports of itself; the ledger is what the last five turns searched."""
    own = Window.partitionBy(E).orderBy(S).rowsBetween(-5, 0)
    t, v, k = F.col("tool_name"), F.col("value"), F.col("k")
    window = F.struct(
        F.concat(F.lit("w"), F.col(S).cast("string")).alias("window_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("evidence_id"), F.lit("evidence").alias("kind"), F.when(k % 2 == 0, "trigger").otherwise("other").alias("role"),
        F.col("start_sec"), F.col("end_sec"),
    )
    ep = episodes(spark, sf_dir).withColumn("ledger", F.collect_list(F.when(t == "seek_evidence", window)).over(own).cast(f"array<{vf.WINDOW}>"))
    ids = F.transform(F.filter("ledger", lambda w: w["role"] == "trigger"), lambda w: w["window_id"])
    suff = F.least(F.lit(1.0), v / 500)
    scores = F.struct(suff.alias("sufficiency"), (k / 100).alias("necessity"), (1 - suff).alias("alertability"), (k / 200).alias("counterfactual_faithfulness"))
    decision = F.when(k % 4 == 0, "Sufficient").when(k % 4 == 1, "insufficient").when(k % 4 == 2, "misaligned").otherwise("redundant")
    none = F.lit(None).cast("string")
    signal = st.policy_signal([scores], [none, decision], [F.lit("")], [none], v / 1000 - 0.2)
    e = ep.where("valid AND tool_name IN ('emit_alert', 'verify_hypothesis')").withColumns({"signal": signal, "ids": ids})
    empty = F.array().cast("array<string>")
    alert = st.alert_branches(F.col("signal"), F.when(k % 3 == 0, "normal").otherwise("Anomaly"), F.lit(6.0), F.when(k % 5 == 0, "declare_normal").otherwise("soft_alert"), k / 10, F.col("ids"), vf.evidence_ids(F.col("ledger"), F.col("ids")), F.col("ledger"), empty)
    evidence = st.evidence_branches(F.col("signal"), F.col("ledger"), F.col("ids"))
    rows = e.withColumn("branches", F.when(t == "emit_alert", alert).otherwise(evidence).cast(f"array<{st.BRANCH}>"))
    r = st.ranked(rows, [E, S])
    return r.select(E, S, "group_kind", "branch_type", F.size("selected_window_ids").alias("n_selected"), F.round(F.col("branch_reward") + 1e-9, 5).alias("branch_reward"), F.round(F.col("local_advantage") + 1e-9, 3).alias("local_advantage"))


@query(f"""
WITH {EP},
l AS (SELECT *, list(CASE WHEN tool_name = 'seek_evidence' THEN {{'k': k, 'e': end_sec}} END) OVER (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS w FROM ep),
v AS (SELECT episode_id, step_index, value, k, start_sec, list_filter(coalesce(w, []), lambda x: x IS NOT NULL) AS w FROM l WHERE tool_name = 'verify_hypothesis'),
s AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: x.k % 2 = 0)) AS kept, value > 250 AS alert, CASE k % 3 WHEN 0 THEN 'sufficient' WHEN 1 THEN 'redundant' ELSE 'insufficient' END AS decision FROM v),
o AS (SELECT *, CASE WHEN kept > 0 THEN list_filter(w, lambda x: x.k % 2 = 0) ELSE w END AS shown_of FROM s),
p AS (SELECT *, CASE WHEN alert THEN len(shown_of) ELSE least(len(shown_of), 1) END AS prefix, CASE WHEN alert THEN len(shown_of) + len(list_filter(shown_of, lambda x: x.e <= start_sec + 1e-6)) ELSE 2 * least(len(shown_of), 1) END AS pi FROM o),
r AS (SELECT *, CASE WHEN decision <> 'sufficient' THEN 1 ELSE 0 END + CASE WHEN kept > 1 THEN 1 ELSE 0 END + CASE WHEN alert THEN 1 ELSE 0 END AS reasons, least(2, 2 * n) AS c1, least(2, 2 * n) + least(2, 2 * kept) AS c2, least(5, least(2, 2 * n) + least(2, 2 * kept) + least(2, 2 * (n - kept))) AS c3 FROM p)
SELECT episode_id, step_index, CAST(kept AS INTEGER) AS n_keep, CAST(n - kept AS INTEGER) AS n_drop, CAST(prefix AS INTEGER) AS n_prefix, CAST(reasons AS INTEGER) AS n_reasons, CASE WHEN reasons > 0 AND n > 0 THEN 'multimodal_visual' ELSE 'text_only' END AS mode,
       CAST(CASE WHEN reasons > 0 AND n > 0 THEN 1 + 1 + CASE WHEN c1 < 5 THEN 1 ELSE 0 END + CASE WHEN c2 < 5 THEN 1 ELSE 0 END + CASE WHEN c3 < 5 THEN 1 ELSE 0 END + 2 * CASE WHEN c3 < 5 THEN least(5, c3 + least(2, pi)) ELSE 5 END ELSE 5 END AS INTEGER) AS n_items FROM r""")
def judge_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge sees of each verification: the searches of the four turns before it, of which even ones are selected, with two frames each."""
    own = Window.partitionBy(E).orderBy(S).rowsBetween(-4, -1)
    c, none = F.col, F.lit(None).cast("string")
    name = F.concat(F.lit("w"), c(S).cast("string"))
    image = lambda at: F.struct(name.alias("path"), c(at).alias("timestamp_sec"))
    window = F.struct(
        name.alias("window_id"), F.when(c("k") % 2 == 0, "even").otherwise("odd").alias("evidence_id"), none.alias("moment_id"), c("tool_name"), none.alias("role"), none.alias("query"), F.array("start_sec", "end_sec").alias("timestamps_sec"),
        F.array(image("start_sec"), image("end_sec")).alias("images"),
    )
    ep = episodes(spark, sf_dir).withColumn("w", F.collect_list(F.when(c("tool_name") == "seek_evidence", window)).over(own).cast(f"array<{jp.WINDOW}>")).where("tool_name = 'verify_hypothesis'")
    alert = F.when(c("value") > 250, c("start_sec"))
    ids = F.array().cast("array<string>")
    x = ep.withColumn("s", jp.resolved_windows(c("w"), ids, F.array(F.lit("even")), ids)).withColumn("v", jp.views(c("w"), c("s"), alert))
    images = {v: jp.view_images(c(f"v.{v}"), 2) for v in jp.VIEWS}
    decision = F.when(c("k") % 3 == 0, "sufficient").when(c("k") % 3 == 1, "redundant").otherwise("insufficient")
    x = x.withColumn("r", jp.case_reasons(decision, F.lit("finalize"), c("s"), alert.isNotNull()))
    x = x.withColumn("mode", jp.input_mode(F.lit("auto"), c("r"), sum((F.size(i) for i in images.values()), F.lit(0))))
    items = jp.content(F.lit("judge"), {v: jp.summary(c(f"v.{v}"), F.lit(f"no {v}")) for v in jp.VIEWS}, images, c("mode"), 5)
    return x.select(E, S, F.size("s").alias("n_keep"), F.size("v.drop").alias("n_drop"), F.size("v.alert_prefix").alias("n_prefix"), F.size("r").alias("n_reasons"), "mode", F.size(items).alias("n_items"))
