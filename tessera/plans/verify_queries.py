"""Queries of the verifier, counterfactual branches and vector retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import vectors as vc
from tessera.operators import verify as vf

from .registry import EP, episodes, query, table

E, S = "episode_id", "step_index"
DAY, CLIP = 86_400, 2_592_000

#: Targets of an episode: the trigger is its first finalize window, peak and confirmation the second and third, a day long each; the precursor (of every other episode) the day before.
#: ``led``: its evidence windows; ``br``: the branches to judge; ``bw``: the windows each branch holds, and whether it chose them.
STATE_CTES = """tg AS (SELECT episode_id, start_sec AS t, row_number() OVER (PARTITION BY episode_id ORDER BY step_index) AS i FROM ep WHERE tool_name = 'finalize_case'),
goals AS (SELECT episode_id, max(t) FILTER (WHERE i = 1) AS t1, max(t) FILTER (WHERE i = 2) AS t2, max(t) FILTER (WHERE i = 3) AS t3 FROM tg GROUP BY episode_id),
al AS (SELECT episode_id, list(start_sec ORDER BY step_index) AS a FROM ep WHERE tool_name = 'emit_alert' GROUP BY episode_id),
g AS (SELECT goals.*, a[1] AS a1, coalesce(a[2], a[1] + 86400) AS a2 FROM goals LEFT JOIN al ON goals.episode_id = al.episode_id),
led AS (SELECT ep.episode_id, 'w' || step_index AS id, k % 4 AS r, start_sec AS s, start_sec + value * 600 AS e, k % 2 = 0 AS sel, t1, a1, a2,
          count(*) FILTER (WHERE k % 2 = 0) OVER (PARTITION BY ep.episode_id) AS nsel, count(*) OVER (PARTITION BY ep.episode_id) AS n FROM ep JOIN g ON ep.episode_id = g.episode_id WHERE tool_name = 'seek_evidence')"""
def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each episode with a target: its windows as arrays, its alerts and its goals, in one aggregate over the log."""
    t, s = F.col("tool_name"), F.col("start_sec")
    window = lambda kind, end: F.struct(
        F.concat(F.lit("w"), F.col(S).cast("string")).alias("window_id"), F.concat(F.lit("e"), F.col(S).cast("string")).alias("evidence_id"), F.lit(kind).alias("kind"),
        F.get(F.array(F.lit("trigger"), F.lit("peak_action"), F.lit("confirmation"), F.lit("")), (F.col("k") % 4).cast("int")).alias("role"), s.alias("start_sec"), end.alias("end_sec"),
    )
    held = lambda cond, x: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(S).alias("i"), x.alias("x"))))), lambda y: y["x"])
    seek, scan = window("seek", s + F.col("value") * 600), window("scan", F.col("end_sec"))
    rows = episodes(spark, sf_dir).groupBy(E).agg(
        held(t == "seek_evidence", seek).alias("ledger"), held(t.isin("seek_evidence", "scan_timeline"), F.when(t == "seek_evidence", seek).otherwise(scan)).alias("visited"),
        held((t == "seek_evidence") & (F.col("k") % 2 == 0), F.concat(F.lit("w"), F.col(S).cast("string"))).alias("chosen"), held(t == "emit_alert", s).alias("alerts"), F.slice(held(t == "finalize_case", s), 1, 3).alias("goals"),
    )
    return rows.where(F.size("goals") > 0).withColumn("t1", F.get("goals", F.lit(0))).withColumn("a1", F.get("alerts", F.lit(0))).withColumn("a2", F.coalesce(F.get("alerts", F.lit(1)), F.col("a1") + DAY))


def _measured(states: DataFrame) -> DataFrame:
    """States with what they are measured against."""
    span = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    t1, names = F.col("t1"), F.array(*[F.lit(n) for n in ("trigger", "peak_action", "confirmation")])
    role = lambda n, s, e: F.struct(n.alias("role"), s.alias("start_sec"), e.alias("end_sec"))
    told = F.transform(F.col("goals"), lambda s, i: role(F.get(names, i), s, s + DAY))
    return states.withColumns({
        "existence": F.lit("anomaly"), "anomaly": span(t1, F.array_max("goals") + DAY), "precursor": F.when(F.col(E) % 2 == 0, span(t1 - DAY, t1)), "earliest_alert": t1,
        "roles": F.concat(told, F.array(role(F.lit("precursor"), t1 - DAY, t1))), "known": F.lit(True), "duration": F.lit(float(CLIP)), "has_alert": F.col("a1").isNotNull(), "alert_sec": F.col("a1"),
    })


def _r6(x: str) -> str:
    """Rounding by decimal digits, as Spark does it."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE)"


REWARD_SQL = """CASE grp WHEN 'alert' THEN 0.4 * alertability + 0.3 * suff + 0.2 * timing_bonus + 0.1 * alert_bonus - 0.00001 * late
        WHEN 'evidence' THEN 0.35 * suff + 0.35 * nec + 0.2 * faith + 0.1 * bonus - 0.1 * (n_windows / CAST(n AS DOUBLE)) ELSE 0.35 * suff + 0.2 * nec + 0.2 * faith + 0.1 * alertability + 0.15 * bonus - 0.1 * ratio END"""
# Weights are summed as doubles, in the operator's order.
OVERALL_SQL = f"""CASE WHEN episode_id % 2 = 0 THEN (0.2 * exist + 0.2 * category + 0.2 * temporal + 0.1 * pre + 0.2 * alert + 0.1 * cf) / CAST({0.0 + 0.2 + 0.2 + 0.2 + 0.1 + 0.2 + 0.1!r} AS DOUBLE)
  ELSE (0.2 * exist + 0.2 * category + 0.2 * temporal + 0.2 * alert + 0.1 * cf) / CAST({0.0 + 0.2 + 0.2 + 0.2 + 0.0 + 0.2 + 0.1!r} AS DOUBLE) END"""
SCORE_CTES = f"""roles AS (SELECT episode_id, 'trigger' AS role, t1 AS s, t1 + 86400 AS e FROM g UNION ALL SELECT episode_id, 'peak', t2, t2 + 86400 FROM g WHERE t2 IS NOT NULL
          UNION ALL SELECT episode_id, 'confirm', t3, t3 + 86400 FROM g WHERE t3 IS NOT NULL UNION ALL SELECT episode_id, 'precursor', t1 - 86400, t1 FROM g),
vw AS (SELECT episode_id, grp, branch, 'full' AS view, s, e FROM bw UNION ALL SELECT episode_id, grp, branch, 'keep', s, e FROM bw WHERE chosen UNION ALL SELECT episode_id, grp, branch, 'drop', s, e FROM bw WHERE NOT chosen
          UNION ALL SELECT bw.episode_id, bw.grp, bw.branch, 'prefix', s, e FROM bw JOIN br USING (episode_id, grp, branch) JOIN g USING (episode_id) WHERE s <= coalesce(br.alert_sec, t1)),
ro AS (SELECT v.episode_id, v.grp, v.branch, v.view, r.role, max(greatest(least(v.e, r.e) - greatest(v.s, r.s), 0) / 86400) AS o FROM vw v JOIN roles r ON v.episode_id = r.episode_id GROUP BY ALL),
pv AS (SELECT episode_id, grp, branch, view, coalesce(max(o) FILTER (WHERE role = 'trigger'), 0) AS trigger, coalesce(max(o) FILTER (WHERE role = 'peak'), 0) AS peak, coalesce(max(o) FILTER (WHERE role = 'confirm'), 0) AS confirm, coalesce(max(o) FILTER (WHERE role = 'precursor'), 0) AS precursor FROM ro GROUP BY ALL),
target AS (SELECT episode_id, 'anomaly' AS what, t1 AS s, greatest(t1, t2, t3) + 86400 AS e FROM g UNION ALL SELECT episode_id, 'precursor', t1 - 86400, t1 FROM g WHERE episode_id % 2 = 0),
ct AS (SELECT DISTINCT v.episode_id, v.grp, v.branch, v.view, p.what, greatest(v.s, p.s) AS s, least(v.e, p.e) AS e, p.e - p.s AS len FROM vw v JOIN target p ON v.episode_id = p.episode_id WHERE least(v.e, p.e) > greatest(v.s, p.s)),
cm AS (SELECT *, max(e) OVER (PARTITION BY episode_id, grp, branch, view, what ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ct),
cc AS (SELECT episode_id, grp, branch, view, coalesce(sum(greatest(0, e - greatest(s, coalesce(b, s))) / len) FILTER (WHERE what = 'anomaly'), 0) AS cov, coalesce(sum(greatest(0, e - greatest(s, coalesce(b, s))) / len) FILTER (WHERE what = 'precursor'), 0) AS covp FROM cm GROUP BY ALL),
bv AS (SELECT br.*, unnest(['full', 'keep', 'drop', 'prefix']) AS view FROM br),
s0 AS (SELECT bv.episode_id, bv.grp, bv.branch, bv.view, coalesce(trigger, 0) AS t, coalesce(peak, 0) AS p, coalesce(confirm, 0) AS c, coalesce(precursor, 0) AS r, coalesce(cov, 0) AS cov, coalesce(covp, 0) AS covp
          FROM bv LEFT JOIN pv USING (episode_id, grp, branch, view) LEFT JOIN cc USING (episode_id, grp, branch, view)),
s1 AS (SELECT *, CAST(CASE WHEN t >= 0.25 AND (p >= 0.25 OR c >= 0.25) THEN 0.92 WHEN t >= 0.25 THEN 0.78 WHEN p >= 0.25 AND c >= 0.25 THEN 0.74 WHEN p >= 0.25 THEN 0.48 WHEN c >= 0.25 THEN 0.36 WHEN r >= 0.25 THEN 0.2 WHEN cov > 0 THEN 0.1 ELSE 0 END AS DOUBLE) AS category,
          CAST(CASE WHEN t >= 0.25 THEN 0.85 WHEN p >= 0.25 AND c >= 0.25 THEN 0.72 WHEN p >= 0.25 THEN 0.45 WHEN c >= 0.25 THEN 0.3 WHEN r >= 0.25 THEN 0.15 ELSE 0 END AS DOUBLE) AS alert, least(1, 0.5 * cov + 0.5 * greatest(t, p, c)) AS temporal FROM s0),
s2 AS (SELECT episode_id, grp, branch, view, category, alert, {_r6('temporal')} AS temporal, {_r6('greatest(category, 0.9 * cov)')} AS exist, {_r6('greatest(covp, 0.8 * r)')} AS pre, {_r6('least(1, 0.5 * category + 0.5 * temporal)')} AS cf FROM s1),
s3 AS (SELECT *, {_r6(OVERALL_SQL)} AS overall FROM s2),
w AS (SELECT episode_id, grp, branch, max(overall) FILTER (WHERE view = 'full') AS f, max(overall) FILTER (WHERE view = 'keep') AS k, max(overall) FILTER (WHERE view = 'drop') AS d, max(overall) FILTER (WHERE view = 'prefix') AS alertability,
          max(exist) FILTER (WHERE view = 'keep') AS ke, max(temporal) FILTER (WHERE view = 'keep') AS kt, max(category) FILTER (WHERE view = 'keep') AS kc FROM s3 GROUP BY ALL),
x AS (SELECT w.*, br.alert_sec, t1 AS expected, k AS suff, {_r6('greatest(0, f - d)')} AS nec, {_r6('1 - abs(f - k)')} AS cons, {_r6('0.5 * k + 0.5 * greatest(0, f - d)')} AS faith FROM w JOIN br USING (episode_id, grp, branch) JOIN g USING (episode_id)),
verdict AS (SELECT *, CASE WHEN ke < 0.2 AND kt < 0.2 THEN 'misaligned' WHEN kc < 0.15 AND k < 0.35 THEN 'misaligned' WHEN k < 0.55 AND f >= 0.6 THEN 'incomplete' WHEN k >= 0.6 AND d >= 0.65 THEN 'redundant' WHEN k >= 0.6 AND nec >= 0.2 AND cons >= 0.75 THEN 'complete' ELSE 'incomplete' END AS status,
          CASE WHEN alert_sec IS NULL THEN 'not_applicable' WHEN alertability >= 0.65 THEN 'justified' WHEN alert_sec > expected + 0.5 THEN 'late' ELSE 'premature' END AS timing FROM x)"""


@query(f"""
WITH {EP},
{STATE_CTES},
br AS (SELECT episode_id, 'main' AS grp, 'main' AS branch, a1 AS alert_sec FROM g),
bw AS (SELECT episode_id, 'main' AS grp, 'main' AS branch, id, s, e, sel OR nsel = 0 AS chosen FROM led),
{SCORE_CTES}
SELECT episode_id, f AS "full", k AS keep, d AS "drop", alertability AS alert_prefix, suff AS sufficiency, nec AS necessity, cons AS consistency, faith AS counterfactual_faithfulness, status, timing AS alert_status,
       CASE status WHEN 'complete' THEN CASE WHEN timing IN ('justified', 'not_applicable') THEN 'finalize' ELSE 'continue_search' END WHEN 'incomplete' THEN 'continue_search' WHEN 'redundant' THEN 'refine_evidence' ELSE 'revise_claim' END AS action,
       concat_ws(',', CASE status WHEN 'incomplete' THEN 'selected_evidence_not_sufficient' WHEN 'redundant' THEN 'selected_evidence_not_necessary_enough' WHEN 'misaligned' THEN 'selected_evidence_not_aligned_with_claim' END,
                 CASE timing WHEN 'premature' THEN 'alert_prefix_not_actionable' WHEN 'late' THEN 'alert_after_expected_actionable_time' END) AS reasons
FROM verdict""")
def view_scores_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each episode's chosen windows: view scores, derived scores, statuses, action and reasons."""
    v = vf.verdicts(_measured(_states(spark, sf_dir)).withColumns({"mode": F.lit("soft_alert_check"), "visited": F.array().cast(f"array<{vf.WINDOW}>")}), "v")
    return v.select(
        E, *[F.col(f"v.view_scores.{x}.overall_support").alias(x) for x in vf.VIEWS], *[F.col(f"v.derived_scores.{x}").alias(x) for x in ("sufficiency", "necessity", "consistency", "counterfactual_faithfulness")],
        F.col("v.primary_status").alias("status"), F.col("v.alert_status").alias("alert_status"), F.col("v.recommended_action").alias("action"), F.array_join("v.failure_reasons", ",").alias("reasons"),
    )


@query(f"""
WITH {EP},
{STATE_CTES},
br AS (SELECT episode_id, 'alert' AS grp, 'alert_now' AS branch, a1 AS alert_sec FROM g UNION ALL SELECT episode_id, 'alert', 'alert_next', a2 FROM g UNION ALL SELECT episode_id, 'alert', 'alert_final', t1 + 172800 FROM g
       UNION ALL SELECT episode_id, 'evidence', unnest(['full_ledger', 'keep_selected', 'drop_selected', 'minimal_subset']), a1 FROM g UNION ALL SELECT episode_id, 'search', unnest(['skip_search', 'use_search', 'delta_only']), a1 FROM g),
least_ids AS (SELECT episode_id, id FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY CASE r WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END, e DESC, id) AS i FROM led WHERE sel) WHERE i <= 2),
bw AS (SELECT episode_id, 'alert' AS grp, 'alert_now' AS branch, id, s, e, true AS chosen FROM led WHERE a1 IS NULL OR s <= a1 UNION ALL SELECT episode_id, 'alert', 'alert_next', id, s, e, true FROM led WHERE a1 IS NULL OR s <= a2
       UNION ALL SELECT episode_id, 'alert', 'alert_final', id, s, e, true FROM led UNION ALL SELECT episode_id, 'evidence', 'full_ledger', id, s, e, true FROM led
       UNION ALL SELECT episode_id, 'evidence', 'keep_selected', id, s, e, sel OR nsel = 0 FROM led UNION ALL SELECT episode_id, 'evidence', 'drop_selected', id, s, e, NOT sel OR nsel = n FROM led
       UNION ALL SELECT episode_id, 'evidence', 'minimal_subset', id, s, e, nsel = 0 OR (episode_id, id) IN (SELECT episode_id, id FROM least_ids) FROM led
       UNION ALL SELECT episode_id, 'search', 'skip_search', id, s, e, true FROM led WHERE s <= t1 UNION ALL SELECT episode_id, 'search', 'use_search', id, s, e, true FROM led UNION ALL SELECT episode_id, 'search', 'delta_only', id, s, e, true FROM led WHERE s > t1),
{SCORE_CTES},
seen AS (SELECT ep.episode_id, unnest(CASE WHEN start_sec <= t1 THEN ['skip_search', 'use_search'] ELSE ['use_search', 'delta_only'] END) AS branch, start_sec AS s, CASE tool_name WHEN 'seek_evidence' THEN start_sec + value * 600 ELSE end_sec END AS e
         FROM ep JOIN g ON ep.episode_id = g.episode_id WHERE tool_name IN ('seek_evidence', 'scan_timeline')),
seen2 AS (SELECT *, max(e) OVER (PARTITION BY episode_id, branch ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM seen WHERE e > s),
clip AS (SELECT episode_id, branch, least(1, sum(greatest(0, e - greatest(s, coalesce(b, s)))) / 2592000) AS ratio FROM seen2 GROUP BY ALL),
nw AS (SELECT episode_id, grp, branch, count(*) AS held FROM bw GROUP BY ALL),
ns AS (SELECT DISTINCT episode_id, n, nsel FROM led),
r AS (SELECT v.episode_id, v.grp, v.branch, v.status, v.timing,
        CASE v.branch WHEN 'keep_selected' THEN coalesce(nsel, 0) WHEN 'drop_selected' THEN coalesce(n - nsel, 0) WHEN 'minimal_subset' THEN coalesce(least(2, nsel), 0) ELSE coalesce(held, 0) END AS n_windows,
        CASE status WHEN 'complete' THEN 0.3 WHEN 'incomplete' THEN -0.2 WHEN 'redundant' THEN -0.3 ELSE -0.6 END::DOUBLE AS bonus,
        CASE status WHEN 'complete' THEN 0.2 WHEN 'incomplete' THEN -0.1 WHEN 'redundant' THEN -0.05 ELSE -0.4 END::DOUBLE AS alert_bonus,
        CASE timing WHEN 'justified' THEN 0.4 WHEN 'premature' THEN -0.5 WHEN 'late' THEN -0.15 ELSE 0 END::DOUBLE AS timing_bonus, suff, nec, faith, alertability, coalesce(greatest(0, alert_sec - expected), 0) AS late, coalesce(ratio, 0) AS ratio, greatest(1, coalesce(n, 0)) AS n
      FROM verdict v LEFT JOIN nw USING (episode_id, grp, branch) LEFT JOIN ns USING (episode_id) LEFT JOIN clip ON v.episode_id = clip.episode_id AND v.branch = clip.branch),
q AS (SELECT *, {_r6(REWARD_SQL)} AS reward FROM r),
z AS (SELECT *, avg(reward) OVER (PARTITION BY episode_id, grp) AS m, stddev_pop(reward) OVER (PARTITION BY episode_id, grp) AS sd FROM q)
SELECT episode_id, grp AS group_kind, branch AS branch_type, CAST(n_windows AS BIGINT) AS n_windows, status AS primary_status, timing AS alert_status, reward AS branch_reward, round(round(CASE WHEN sd <= 1e-6 THEN 0 ELSE (reward - m) / (sd + 1e-6) END, 6) + 1e-9, 3) AS local_advantage FROM z""")
def counterfactual_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of each episode's alert, evidence and search group, with its advantage in its own group."""
    c = F.col
    until = lambda x, t: F.filter(c(x), lambda w: t.isNull() | (w["start_sec"] <= t))
    none = F.array().cast(f"array<{vf.WINDOW}>")
    at = lambda name, ledger, sec: F.struct(F.lit(name).alias("branch_type"), ledger.alias("ledger"), none.alias("visited"), sec.isNotNull().alias("has_alert"), sec.alias("alert_sec"))
    alerts = F.array(at("alert_now", until("ledger", c("a1")), c("a1")), at("alert_next", until("ledger", c("a2")), c("a2")), at("alert_final", c("ledger"), c("t1") + 2 * DAY))
    state = lambda t: F.struct(until("ledger", t).alias("ledger"), until("visited", t).alias("visited"))
    has, sec = c("has_alert"), c("alert_sec")
    branches = F.concat(
        vf.alert_branches(alerts), vf.evidence_branches(c("ledger"), c("chosen"), has, sec),
        vf.search_branches(state(c("t1")), state(F.lit(None).cast("double")), has, sec, c("duration")),
    )
    rows = vf.counterfactuals(_measured(_states(spark, sf_dir)).withColumn("branches", branches), [E], delay=1e-5)
    return rows.select(
        E, "group_kind", "branch_type", F.size("selected_window_ids").cast("long").alias("n_windows"), F.col("verdict.primary_status").alias("primary_status"), F.col("verdict.alert_status").alias("alert_status"),
        "branch_reward", F.round(F.col("local_advantage") + 1e-9, 3).alias("local_advantage"),
    )


@query(f"""
WITH {EP},
n AS (SELECT episode_id, count(*) FILTER (WHERE tool_name = 'seek_evidence') % 6 AS n, least(1, sum(value) / 20000) AS v FROM ep GROUP BY episode_id),
c AS (SELECT *, CASE WHEN n > 0 THEN least(1, 0.25 + 0.15 * n) ELSE 0 END AS c FROM n)
SELECT episode_id, CAST(n AS BIGINT) AS n, round(CAST(0.2 * c + 0.2 * 0.9 * c + 0.2 * 0.85 * c + 0.1 * 0.4 * c + 0.2 * 0.75 * c + 0.1 * 0.8 * c AS DOUBLE) + 1e-9, 6) AS counted,
       round(CASE WHEN n > 0 THEN 1 ELSE 0 END * (0.2 * greatest(0, least(1, 0.25 + 0.6 * v + 0.05 * n)) + 0.2 * greatest(0, least(1, 0.2 + 0.55 * v + 0.05 * n)) + 0.2 * greatest(0, least(1, 0.15 + 0.6 * v + 0.05 * greatest(n - 1, 0)))
              + 0.2 * greatest(0, least(1, 0.15 + 0.5 * v + 0.05 * n)) + 0.1 * greatest(0, least(1, 0.1 + 0.5 * v + 0.05 * n))) / 0.9 + 1e-9, 6) AS normal
FROM c""")
def reference_free_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = episodes(spark, sf_dir).groupBy(E).agg((F.count_if(F.col("tool_name") == "seek_evidence") % 6).alias("n"), F.least(F.lit(1.0), F.sum("value") / 20000).alias("v"))
    a = vf.overall(vf.count_fallback(F.col("n")), F.lit(True))
    b = vf.overall(vf.normal_fallback(F.col("v"), F.col("n")), F.lit(False))
    return n.select(E, "n", F.round(a + 1e-9, 6).alias("counted"), F.round(b + 1e-9, 6).alias("normal"))


@query("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(avg(0.35 * l_discount + 0.65 * l_tax) + 1e-9, 6) AS both, round(avg(l_discount) + 1e-9, 6) AS only_first, round(avg(l_tax * 2) + 1e-9, 6) AS only_second FROM lineitem GROUP BY l_orderkey""")
def blend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score maps mixed; keys of one map only keep their score."""
    a = F.create_map(F.lit("both"), "l_discount", F.lit("only_first"), "l_discount")
    b = F.create_map(F.lit("both"), F.col("l_tax"), F.lit("only_second"), F.col("l_tax") * 2)
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", vf.blend(a, b, 0.35).alias("m"))
    return m.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col("m")[k]) + 1e-9, 6).alias(k) for k in ("both", "only_first", "only_second")])


PACKAGE = [(7, 0.40), (21, 0.20), (35, 0.25), (49, -0.15)]


@query("""
WITH q(id, w) AS (VALUES (7, CAST(0.40 AS DOUBLE)), (21, 0.20), (35, 0.25), (49, -0.15)),
qs AS (SELECT w, embedding AS v FROM embeddings JOIN q ON vec_id = id),
s AS (SELECT vec_id, label, round(sum(w * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))))), 4) AS score FROM embeddings, qs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s),
t AS (SELECT label, max(score) FILTER (WHERE rank = 1) AS t1, coalesce(max(score) FILTER (WHERE rank = 5), 0) AS t5, count(*) AS n FROM r WHERE rank <= 8 GROUP BY label)
SELECT r.label, vec_id, score, CAST(rank AS INTEGER) AS rank, CAST(least(2 + CASE WHEN n >= 5 AND t1 - t5 < 0.08 THEN 1 ELSE 0 END + 1, 8, 4) AS INTEGER) AS budget FROM r JOIN t ON r.label = t.label WHERE rank <= 8""")
def weighted_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best frames of each label for a weighted package of queries, and how many the label deserves."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    w = F.create_map(*[F.lit(x) for kv in PACKAGE for x in kv])
    qs = e.where(F.col("vec_id").isin([i for i, _ in PACKAGE])).select(F.try_element_at(w, F.col("vec_id").cast("int")).alias("weight"), F.col("embedding").alias("q"))
    s = vc.weighted_scores(e, qs, "vec_id", "embedding").select("label", "vec_id", F.round("score", 4).alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("rank <= 8")
    own = Window.partitionBy("label")
    at = lambda i: F.coalesce(F.max(F.when(F.col("rank") == i, F.col("score"))).over(own), F.lit(0.0))
    budget = vc.frame_budget(F.lit(3.0), at(1), at(5), F.count(F.lit(1)).over(own), F.lit(3), F.lit(4))
    return r.select("label", "vec_id", "score", "rank", budget.cast("int").alias("budget"))


@query()
def dpp_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four good and unlike frames of each label, by greedy determinants over its best candidates."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    w = F.create_map(*[F.lit(x) for kv in PACKAGE for x in kv])
    qs = e.where(F.col("vec_id").isin([i for i, _ in PACKAGE])).select(F.try_element_at(w, F.col("vec_id").cast("int")).alias("weight"), F.col("embedding").alias("q"))
    s = vc.weighted_scores(e, qs, "vec_id", "embedding")
    best = s.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= vc.CANDIDATES)
    return vc.select_diverse(best.withColumn("at", F.col("vec_id") / 2), "label", "vec_id", "embedding", "at", "score", 4)
