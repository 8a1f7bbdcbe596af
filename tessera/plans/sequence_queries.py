"""Queries over ordered turns: as-of lookups, traces, deltas, clusters, advantages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import clamp
from tessera.operators import sequence as sq

from .registry import EP, episodes, query, table

E, S = "episode_id", "step_index"
FOLLOWING = "OVER (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
SO_FAR = "OVER (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"""
WITH {EP}
SELECT episode_id, step_index,
       first_value(CASE WHEN tool_name IN ('emit_alert', 'finalize_case') THEN step_index END IGNORE NULLS) {FOLLOWING} AS next_decision,
       first_value(CASE WHEN tool_name = 'verify_hypothesis' THEN step_index END IGNORE NULLS) {FOLLOWING} AS next_verify,
       last_value(CASE WHEN tool_name = 'emit_alert' THEN step_index END IGNORE NULLS) {SO_FAR} AS last_alert,
       min(CASE WHEN tool_name = 'finalize_case' THEN step_index END) OVER (PARTITION BY episode_id) AS first_finalize
FROM ep""")
def asof_next_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.col("tool_name"), F.col(S)
    return episodes(spark, sf_dir).select(
        E, S, sq.next_where(t.isin("emit_alert", "finalize_case"), s, E, S).alias("next_decision"), sq.next_where(t == "verify_hypothesis", s, E, S).alias("next_verify"),
        sq.last_where(t == "emit_alert", s, E, S).alias("last_alert"), F.min(F.when(t == "finalize_case", s)).over(Window.partitionBy(E)).alias("first_finalize"),
    )


@query(f"""
WITH {EP},
c AS (SELECT *, sum(CASE WHEN tool_name = 'seek_evidence' THEN 1 ELSE 0 END) {SO_FAR} AS ledger, sum(CASE WHEN tool_name IN ('seek_evidence', 'scan_timeline') THEN 1 ELSE 0 END) {SO_FAR} AS visited,
             sum(CASE WHEN tool_name = 'emit_alert' THEN 1 ELSE 0 END) {SO_FAR} AS alerts FROM ep),
d AS (SELECT *, ledger - coalesce(lag(ledger) OVER w, 0) AS dl, visited - coalesce(lag(visited) OVER w, 0) AS dv, alerts - coalesce(lag(alerts) OVER w, 0) AS da FROM c WINDOW w AS (PARTITION BY episode_id ORDER BY step_index))
SELECT episode_id, step_index, CAST(ledger AS BIGINT) AS ledger, CAST(dl AS BIGINT) AS new_evidence, CAST(dv AS BIGINT) AS new_visited, CAST(da AS BIGINT) AS new_alerts,
       CASE WHEN dl > 0 THEN 'e' || lpad(CAST(visited AS VARCHAR), 4, '0') ELSE '' END AS evidence_id
FROM d""")
def state_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn appended to its episode's lists; scans take evidence numbers without an entry in the ledger."""
    t = F.col("tool_name")
    w, o = sq.so_far(E, S), Window.partitionBy(E).orderBy(S)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(w)
    c = episodes(spark, sf_dir).withColumns({"ledger": n(t == "seek_evidence"), "visited": n(t.isin("seek_evidence", "scan_timeline")), "alerts": n(t == "emit_alert")})
    step = lambda x: F.col(x) - F.coalesce(F.lag(x).over(o), F.lit(0))
    d = c.withColumns({"new_evidence": step("ledger"), "new_visited": step("visited"), "new_alerts": step("alerts")})
    return d.select(E, S, "ledger", "new_evidence", "new_visited", "new_alerts", F.when(F.col("new_evidence") > 0, F.concat(F.lit("e"), F.lpad(F.col("visited").cast("string"), 4, "0"))).otherwise("").alias("evidence_id"))


@query(f"""
WITH {EP}
SELECT episode_id, step_index, round(last_value(CASE WHEN tool_name IN ('emit_alert', 'verify_hypothesis') THEN value END IGNORE NULLS) {SO_FAR}, 4) AS latest_claim,
       CAST(count(CASE WHEN tool_name IN ('emit_alert', 'verify_hypothesis') THEN 1 END) {SO_FAR} AS BIGINT) AS n_claims, round(max(CASE WHEN tool_name IN ('seek_evidence', 'scan_timeline') THEN end_sec END) {SO_FAR}, 6) AS horizon
FROM ep""")
def latest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tool_name")
    claim = t.isin("emit_alert", "verify_hypothesis")
    w = sq.so_far(E, S)
    return episodes(spark, sf_dir).select(E, S, F.round(sq.last_where(claim, F.col("value"), E, S), 4).alias("latest_claim"), F.count(F.when(claim, 1)).over(w).alias("n_claims"), F.round(F.max(F.when(t.isin("seek_evidence", "scan_timeline"), F.col("end_sec"))).over(w), 6).alias("horizon"))


@query(f"""
WITH {EP},
a AS (SELECT episode_id, step_index, CASE WHEN tool_name = 'seek_evidence' THEN 'search' WHEN tool_name IN ('emit_alert', 'finalize_case') THEN 'alert' WHEN tool_name = 'verify_hypothesis' THEN 'evidence' END AS kind FROM ep WHERE valid)
SELECT episode_id, kind, step_index, CAST(i AS INTEGER) AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, kind ORDER BY step_index) AS i FROM a WHERE kind IS NOT NULL) WHERE i <= 2""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two turns of each kind."""
    t = F.col("tool_name")
    kind = F.when(t == "seek_evidence", "search").when(t.isin("emit_alert", "finalize_case"), "alert").when(t == "verify_hypothesis", "evidence")
    a = episodes(spark, sf_dir).where("valid").select(E, kind.alias("kind"), S).where("kind IS NOT NULL")
    return a.withColumn("anchor", F.row_number().over(Window.partitionBy(E, "kind").orderBy(S))).where("anchor <= 2")


@query(f"""
WITH {EP},
q AS (SELECT *, CASE WHEN k % 5 = 0 THEN '' ELSE 'q' || CAST(k % 4 AS VARCHAR) END AS query, CASE WHEN k % 3 = 0 THEN 'uniform' ELSE 'guided' END AS backend FROM ep WHERE tool_name = 'seek_evidence'),
n AS (SELECT *, lag(query) OVER (PARTITION BY episode_id ORDER BY step_index) AS before FROM q WHERE query <> '')
SELECT a.episode_id, CAST(a.n AS BIGINT) AS n_seek, CAST(guided AS BIGINT) AS n_guided, CAST(a.n - guided AS BIGINT) AS n_uniform, CAST(coalesce(changes, 0) AS BIGINT) AS query_changes
FROM (SELECT episode_id, count(*) AS n, count(*) FILTER (WHERE backend = 'guided') AS guided FROM q GROUP BY episode_id) a
LEFT JOIN (SELECT episode_id, count(*) FILTER (WHERE before IS NOT NULL AND before <> query) AS changes FROM n GROUP BY episode_id) b ON a.episode_id = b.episode_id""")
def search_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seek turns by backend, and how often consecutive non-blank queries differ: a window over non-blank rows, no self-join."""
    seek = episodes(spark, sf_dir).where("tool_name = 'seek_evidence'")
    q = F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("q"), (F.col("k") % 4).cast("string")))
    seek = seek.withColumn("query", q).withColumn("before", F.last(F.nullif("query", F.lit("")), ignorenulls=True).over(sq.earlier(E, S)))
    guided = F.count_if(F.col("k") % 3 != 0)
    return seek.groupBy(E).agg(F.count(F.lit(1)).alias("n_seek"), guided.alias("n_guided"), (F.count(F.lit(1)) - guided).alias("n_uniform"), F.count_if((F.col("query") != "") & (F.col("before") != F.col("query"))).alias("query_changes"))


@query(f"""
WITH {EP},
f AS (SELECT episode_id, CAST(floor(start_sec / 3600) AS BIGINT) AS hour, value AS score FROM ep),
g AS (SELECT *, CASE WHEN hour - lag(hour) OVER w <= 6 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY hour)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY episode_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM g),
s AS (SELECT episode_id, cluster, min(hour) AS start_at, max(hour) AS end_at, count(*) AS n, round(max(score), 6) AS top, round(avg(score), 6) AS mean FROM c GROUP BY ALL)
SELECT episode_id, start_at, end_at, CAST(n AS BIGINT) AS n, top, mean, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY top DESC, mean DESC, start_at) AS INTEGER) AS rank FROM s""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with events at most six hours apart, ranked by top score, mean, then start."""
    f = episodes(spark, sf_dir).select(E, F.floor(F.col("start_sec") / 3600).alias("at"), F.col("value").alias("score"))
    s = sq.gap_clusters(f, E, "at", F.lit(6)).groupBy(E, "cluster").agg(F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("top"), F.round(F.avg("score"), 6).alias("mean"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(E).orderBy(F.desc("top"), F.desc("mean"), "start_at"))).drop("cluster")


@query("""
SELECT o_orderkey, o_custkey, round(CASE WHEN s < 1e-6 THEN 0 ELSE greatest(-3, least(3, (r - m) / (s + 1e-6))) END, 6) AS advantage,
       round(CASE WHEN s <= 1e-6 THEN 0 ELSE (r - m) / (s + 1e-6) END, 6) AS local_advantage
FROM (SELECT o_orderkey, o_custkey, o_totalprice AS r, avg(o_totalprice) OVER w AS m, stddev_pop(o_totalprice) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey))""")
def group_relative_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, g = table(spark, sf_dir, "orders"), [F.col("o_custkey")]
    r = F.col("o_totalprice")
    return o.select("o_orderkey", "o_custkey", sq.group_advantage(r, g).alias("advantage"), sq.group_advantage(r, g, clip=None, strict=False).alias("local_advantage"))


# The weights of a turn's credit, the discount and the mixing of local credit.
INVALID, SEARCH, EVIDENCE, FINAL, ANSWER, STEP = 0.75, 0.05, 0.1, 0.2, 1.2, 0.4 * 0.15
GAMMA, ALPHA = 0.9, 0.5


@query(f"""
WITH {EP},
a AS (SELECT *, CASE WHEN k % 8 = 1 THEN 1 ELSE 0 END AS attempts, CASE WHEN tool_name = 'seek_evidence' THEN k % 3 ELSE 0 END AS fresh, max(step_index) OVER (PARTITION BY episode_id) AS last FROM ep),
c AS (SELECT episode_id, step_index, CAST(-0.75 * attempts - CASE WHEN valid THEN 0 ELSE 0.75 END + CASE WHEN tool_name = 'seek_evidence' THEN 0.05 ELSE 0 END + 0.1 * fresh + CASE WHEN tool_name = 'finalize_case' THEN 0.2 ELSE 0 END
             + CASE WHEN step_index = last THEN 1.2 ELSE 0 END - 0.06 * (step_index - 1) AS DOUBLE) AS credit, sum(value - 230) OVER (PARTITION BY episode_id) / CAST(1000 AS DOUBLE) AS r FROM a),
m AS (SELECT *, avg(credit) OVER (PARTITION BY episode_id) AS mu FROM c),
d AS (SELECT *, avg(abs(credit - mu)) OVER (PARTITION BY episode_id) AS mad FROM m),
g AS (SELECT x.episode_id, x.step_index, sum(y.credit * pow(0.9, y.step_index - x.step_index)) AS suffix FROM c x JOIN c y ON x.episode_id = y.episode_id AND y.step_index >= x.step_index GROUP BY ALL)
SELECT d.episode_id, d.step_index, round(credit + 1e-9, 6) AS credit, round(suffix + 1e-9, 6) AS discounted,
       round(CASE WHEN abs(r) < 1e-8 THEN 0 WHEN mad <= 1e-8 THEN r ELSE r + 0.5 * greatest(abs(r), 0.25) * (credit - mu) / mad END + 1e-9, 6) AS advantage
FROM d JOIN g ON d.episode_id = g.episode_id AND d.step_index = g.step_index""")
def turn_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit of each turn, its discounted suffix return, and the episode's reward spread by centred credit."""
    own = Window.partitionBy(E)
    a = episodes(spark, sf_dir).withColumn("last", F.max(S).over(own)).withColumn("r", F.sum(F.col("value") - 230).over(own) / 1000)
    t = F.col("tool_name")
    on = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    fresh = F.when(t == "seek_evidence", F.col("k") % 3).otherwise(0)
    credit = -on(F.col("k") % 8 == 1, INVALID) - on(~F.col("valid"), INVALID) + on(t == "seek_evidence", SEARCH) + EVIDENCE * fresh + on(t == "finalize_case", FINAL) + on(F.col(S) == F.col("last"), ANSWER) - STEP * (F.col(S) - 1)
    c = a.select(E, S, "r", credit.alias("credit"))
    per = c.groupBy(E, "r").agg(F.array_sort(F.collect_list(F.struct(S, "credit"))).alias("t"))
    per = per.withColumn("g", sq.discounted(F.transform("t", lambda x: x["credit"]), GAMMA)).withColumn("mu", F.aggregate("t", F.lit(0.0), lambda n, x: n + x["credit"]) / F.size("t"))
    per = per.withColumn("mad", F.aggregate("t", F.lit(0.0), lambda n, x: n + F.abs(x["credit"] - F.col("mu"))) / F.size("t"))
    each = per.select(E, "r", "mu", "mad", F.explode(F.arrays_zip("t", "g")).alias("z")).select(E, "r", "mu", "mad", "z.t.step_index", "z.t.credit", "z.g")
    norm = (F.col("credit") - F.col("mu")) / F.when(F.col("mad") > 1e-8, F.col("mad"))
    adv = F.when(F.abs("r") < 1e-8, F.lit(0.0)).when(F.col("mad") <= 1e-8, F.col("r")).otherwise(F.col("r") + ALPHA * F.greatest(F.abs("r"), F.lit(0.25)) * norm)
    return each.select(E, S, F.round(F.col("credit") + 1e-9, 6).alias("credit"), F.round(F.col("g") + 1e-9, 6).alias("discounted"), F.round(adv + 1e-9, 6).alias("advantage"))


@query(f"""
WITH {EP},
p AS (SELECT episode_id, min(CASE WHEN tool_name = 'verify_hypothesis' AND valid THEN step_index END) AS v, min(CASE WHEN tool_name = 'finalize_case' AND valid THEN step_index END) AS f, max(CASE WHEN k % 9 = 4 AND valid THEN step_index END) AS a FROM ep GROUP BY episode_id)
SELECT episode_id, v AS first_verify, f AS first_finalize, a AS answer_step, (f IS NOT NULL AND a IS NOT NULL AND f < a) AS metric_flag,
       CAST(CASE WHEN a IS NULL THEN CASE WHEN f IS NULL THEN -1 ELSE -0.5 END WHEN f IS NULL THEN -1 WHEN v IS NULL THEN -0.75 WHEN v < f AND f < a THEN 1 ELSE -1 END AS DOUBLE) AS protocol_reward
FROM p""")
def episode_protocol_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an episode verified, finalized and answered in order; the metric's flag leaves verification out."""
    t, ok = F.col("tool_name"), F.col("valid")
    p = episodes(spark, sf_dir).groupBy(E).agg(F.min(F.when((t == "verify_hypothesis") & ok, F.col(S))).alias("v"), F.min(F.when((t == "finalize_case") & ok, F.col(S))).alias("f"), F.max(F.when((F.col("k") % 9 == 4) & ok, F.col(S))).alias("a"))
    v, f, a = F.col("v"), F.col("f"), F.col("a")
    flag = F.coalesce(f < a, F.lit(False))
    reward = F.when(a.isNull(), F.when(f.isNull(), -1.0).otherwise(-0.5)).when(f.isNull(), -1.0).when(v.isNull(), -0.75).when((v < f) & (f < a), 1.0).otherwise(-1.0)
    return p.select(E, v.alias("first_verify"), f.alias("first_finalize"), a.alias("answer_step"), flag.alias("metric_flag"), reward.alias("protocol_reward"))


@query(f"""
WITH {EP},
f AS (SELECT episode_id, value, CAST(step_index AS DOUBLE) AS t FROM ep)
SELECT episode_id, CAST(clips AS INTEGER) AS segment, round(w * clips + 1e-9, 6) AS start_sec, round(w * (clips + 1) + 1e-9, 6) AS end_sec
FROM (SELECT episode_id, max(start_sec) / 3 AS w FROM ep GROUP BY episode_id), range(0, 3) r(clips)""")
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three equal windows of each clip."""
    d = episodes(spark, sf_dir).groupBy(E).agg((F.max("start_sec") / 3).alias("w")).select(E, "w", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("segment"))
    return d.select(E, "segment", F.round(F.col("w") * F.col("segment") + 1e-9, 6).alias("start_sec"), F.round(F.col("w") * (F.col("segment") + 1) + 1e-9, 6).alias("end_sec"))


@query(f"""
WITH {EP}
SELECT episode_id, step_index, round(1 / CAST(count(*) OVER (PARTITION BY episode_id) AS DOUBLE), 9) AS sample_weight, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY step_index) - 1 AS BIGINT) AS history FROM ep WHERE valid""")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training example for each valid step, together of weight one, with the length of its history."""
    w = Window.partitionBy(E)
    return episodes(spark, sf_dir).where("valid").select(E, S, F.round(1 / F.count(F.lit(1)).over(w), 9).alias("sample_weight"), (F.row_number().over(w.orderBy(S)) - 1).cast("long").alias("history"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, exp((l_discount - l_tax) * 10) AS ratio, l_quantity / 25 - 1 AS adv FROM lineitem)
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(-avg(least(ratio * adv, greatest(0.8, least(1.2, ratio)) * adv)), 6) AS loss, round(avg(CASE WHEN ratio > 1.2 OR ratio < 0.8 THEN 1 ELSE 0 END), 6) AS clipped,
       round(avg(ratio - 1 - ln(ratio)), 6) AS kl
FROM l GROUP BY l_orderkey""")
def surrogate_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clipped surrogate of a policy ratio and an advantage, and an estimate of the divergence, by order."""
    ratio, adv = F.exp((F.col("l_discount") - F.col("l_tax")) * 10), F.col("l_quantity") / 25 - 1
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", ratio.alias("ratio"), adv.alias("adv"))
    r, a = F.col("ratio"), F.col("adv")
    return l.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(-F.avg(F.least(r * a, clamp(r, 0.8, 1.2) * a)), 6).alias("loss"),
        F.round(F.avg(F.when((r > 1.2) | (r < 0.8), 1.0).otherwise(0.0)), 6).alias("clipped"), F.round(F.avg(r - 1 - F.log(r)), 6).alias("kl"),
    )
