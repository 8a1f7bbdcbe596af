"""Queries of summaries: fixed domains, profiles, rankings, health and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import mean_or_zero, ratio
from tessera.operators import aggregates as ag

from .registry import EP, episodes, query, table

# Verdicts of a verification.
STATUS = ["complete", "incomplete", "redundant", "misaligned", "unknown"]
STATUS_SQL = "CASE k % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'redundant' WHEN 3 THEN 'misaligned' ELSE 'unknown' END"


def status(k: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in STATUS]), F.least(k % 6, F.lit(4)).cast("int")), F.lit("unknown"))


@query(f"""
WITH {EP},
d(value) AS (VALUES ('complete'), ('incomplete'), ('redundant'), ('misaligned'), ('unknown')),
v AS (SELECT {STATUS_SQL} AS value FROM ep WHERE tool_name = 'verify_hypothesis')
SELECT d.value, CAST(count(v.value) AS BIGINT) AS n, round(count(v.value) / CAST((SELECT count(*) FROM v) AS DOUBLE), 6) AS share FROM d LEFT JOIN v ON d.value = v.value GROUP BY d.value""")
def status_ratios_fixed_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = episodes(spark, sf_dir).where("tool_name = 'verify_hypothesis'")
    return ag.fixed_domain(v, status(F.col("k")), STATUS, "unknown")


@query("""
WITH j AS (SELECT d.doc_id, lang, source, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = toxic),
g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'b' WHEN grouping(source) = 1 THEN 'a' ELSE 'ab' END AS level, lang AS ka, source AS kb, count(*) AS n, count(DISTINCT doc_id) AS n_items, avg(n_chars) AS mean,
        array_to_string(list_sort(list(DISTINCT doc_id))[1:5], ',') AS first_items
      FROM j GROUP BY GROUPING SETS ((lang), (source), (lang, source)))
SELECT level, ka, kb, CAST(n AS BIGINT) AS n, CAST(n_items AS BIGINT) AS n_items, round(mean, 6) AS mean, first_items FROM g""")
def disagreement_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose two labels disagree (a good one should not be toxic), by language, source and both."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = table(spark, sf_dir, "labels").where("quality = toxic").join(d, "doc_id")
    return ag.cluster_report(j, "lang", "source", "doc_id", "n_chars")


@query("""
SELECT lang, CAST(count(n_chars) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean,
       round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99
FROM documents GROUP BY lang""")
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.profile(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query("""
SELECT coalesce(nullif(trim(source), ''), '(none)') AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def ranked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.ranked(table(spark, sf_dir, "documents"), F.col("source"), 10)


@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS n_assistant, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS n_user,
       CAST(sum(length(text)) AS BIGINT) AS total, CAST(max(length(text)) AS BIGINT) AS most, round(avg(length(text)), 6) AS mean
FROM conversations GROUP BY conv_id ORDER BY most DESC, mean DESC, n DESC, conv_id LIMIT 20""")
def video_load_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long"))
    per = c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count_if(F.col("role") == "user").alias("n_user"),
        F.sum("size").alias("total"), F.max("size").alias("most"), F.round(F.avg("size"), 6).alias("mean"),
    )
    return per.orderBy(F.desc("most"), F.desc("mean"), F.desc("n"), "conv_id").limit(20)


@query("""
SELECT CAST(length(text) % 5 AS BIGINT) AS images, turn AS messages, conv_id * 100 + turn AS line FROM conversations ORDER BY images DESC, messages DESC, line DESC LIMIT 15""")
def heaviest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.length("text") % 5).cast("long").alias("images"), F.col("turn").alias("messages"), (F.col("conv_id") * 100 + F.col("turn")).alias("line"))
    return ag.heaviest(c, 15, "images", "messages", "line").orderBy(F.desc("images"), F.desc("messages"), "line")


@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS user_messages, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS assistant_messages,
       CAST(coalesce(sum(length(text) % 3) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS user_images, CAST(coalesce(sum(length(text) % 3) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS assistant_images,
       CAST(max(length(text) % 3) AS BIGINT) AS most_in_message
FROM conversations GROUP BY conv_id""")
def example_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and images by role for each example; a message's images are its text length modulo 3."""
    c = table(spark, sf_dir, "conversations").withColumn("im", (F.length("text") % 3).cast("long"))
    by = lambda role, x: F.coalesce(F.sum(F.when(F.col("role") == role, x)), F.lit(0))
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), by("user", F.lit(1)).cast("long").alias("user_messages"), by("assistant", F.lit(1)).cast("long").alias("assistant_messages"),
        by("user", F.col("im")).alias("user_images"), by("assistant", F.col("im")).alias("assistant_images"), F.max("im").alias("most_in_message"),
    )


@query(f"""
WITH {EP}
SELECT CAST(count(*) AS BIGINT) AS n_records, round(coalesce(avg(r), 0), 4) AS mean_reward, round(coalesce(min(r), 0), 4) AS least_reward, round(coalesce(max(r), 0), 4) AS most_reward, round(coalesce(avg(n), 0), 6) AS mean_turns
FROM (SELECT episode_id, sum(value) AS r, count(*) AS n FROM ep GROUP BY episode_id)""")
def reward_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir).groupBy("episode_id").agg(F.sum("value").alias("r"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return e.agg(F.count(F.lit(1)).alias("n_records"), F.round(mean_or_zero(F.col("r")), 4).alias("mean_reward"), F.round(zero(F.min("r")), 4).alias("least_reward"), F.round(zero(F.max("r")), 4).alias("most_reward"), F.round(mean_or_zero(F.col("n")), 6).alias("mean_turns"))


@query(f"""
WITH {EP},
m AS (SELECT tool_name AS key, value AS v FROM ep UNION ALL SELECT 'bonus', CAST(k AS DOUBLE) FROM ep WHERE valid UNION ALL SELECT 'penalty', -value FROM ep WHERE NOT valid)
SELECT key, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS mean FROM m GROUP BY key""")
def mean_by_map_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the records that have the key, of one map for each turn."""
    ep = episodes(spark, sf_dir)
    more = F.when(F.col("valid"), F.create_map(F.lit("bonus"), F.col("k").cast("double"))).otherwise(F.create_map(F.lit("penalty"), -F.col("value")))
    m = ep.select(F.explode(F.map_concat(F.create_map("tool_name", "value"), more)).alias("key", "v"))
    return m.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


MODE_SQL = "CASE WHEN k % 7 < 4 THEN 'self_report' WHEN k % 7 < 6 THEN 'legacy_compat' ELSE 'external' END"


@query(f"""
WITH {EP},
v AS (SELECT {MODE_SQL} AS mode, k % 5 = 0 AS missing, k % 11 = 0 AS bad FROM ep WHERE tool_name = 'verify_hypothesis')
SELECT CAST(count(*) AS BIGINT) AS n_verify, CAST(count(*) FILTER (WHERE mode = 'self_report') AS BIGINT) AS n_self_report, CAST(count(*) FILTER (WHERE mode = 'legacy_compat') AS BIGINT) AS n_legacy,
       CAST(count(*) FILTER (WHERE mode = 'external') AS BIGINT) AS n_external, round(count(*) FILTER (WHERE mode = 'legacy_compat') / CAST(count(*) AS DOUBLE), 6) AS legacy_rate,
       round(count(*) FILTER (WHERE missing) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, round(count(*) FILTER (WHERE bad) / CAST(count(*) AS DOUBLE), 6) AS invalid_rate
FROM v""")
def verify_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = episodes(spark, sf_dir).where("tool_name = 'verify_hypothesis'").select("k", F.expr(MODE_SQL).alias("mode"))
    n = F.count(F.lit(1))
    of = lambda m: F.count_if(F.col("mode") == m)
    return v.agg(
        n.alias("n_verify"), of("self_report").alias("n_self_report"), of("legacy_compat").alias("n_legacy"), of("external").alias("n_external"),
        F.round(ratio(of("legacy_compat"), n), 6).alias("legacy_rate"), F.round(ratio(F.count_if(F.col("k") % 5 == 0), n), 6).alias("missing_rate"), F.round(ratio(F.count_if(F.col("k") % 11 == 0), n), 6).alias("invalid_rate"),
    )


@query(f"""
WITH {EP},
r AS (SELECT episode_id, count(*) FILTER (WHERE tool_name = 'verify_hypothesis') AS nv, count(*) FILTER (WHERE tool_name = 'verify_hypothesis' AND k % 4 = 0) AS nt FROM ep GROUP BY episode_id)
SELECT CAST(count(*) AS BIGINT) AS n_records, CAST(count(*) FILTER (WHERE nv > 0) AS BIGINT) AS with_verify, round(avg(nv), 6) AS mean_verify, CAST(count(*) FILTER (WHERE nt > 0) AS BIGINT) AS with_teacher, CAST(sum(nt) AS BIGINT) AS teacher_turns FROM r""")
def verify_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("tool_name") == "verify_hypothesis"
    r = episodes(spark, sf_dir).groupBy("episode_id").agg(F.count_if(v).alias("nv"), F.count_if(v & (F.col("k") % 4 == 0)).alias("nt"))
    return r.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("nv") > 0).alias("with_verify"), F.round(mean_or_zero(F.col("nv")), 6).alias("mean_verify"), F.count_if(F.col("nt") > 0).alias("with_teacher"), F.sum("nt").alias("teacher_turns"))


@query("""
WITH j AS (SELECT d.doc_id, n_chars, CASE WHEN toxic = 1 THEN 'anomaly' WHEN toxic = 0 THEN 'normal' ELSE 'unknown' END AS g, coalesce(quality, 0) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
g(label_group) AS (VALUES ('anomaly'), ('normal'), ('unknown'))
SELECT label_group, CAST(count(doc_id) AS BIGINT) AS n_records, CAST(coalesce(sum(q), 0) AS BIGINT) AS n_cases, round(coalesce(avg(n_chars), 0), 6) AS mean, CAST(coalesce(min(n_chars), 0) AS BIGINT) AS least, CAST(coalesce(max(n_chars), 0) AS BIGINT) AS most
FROM g LEFT JOIN j ON g.label_group = j.g GROUP BY label_group""")
def reward_by_label_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed domain of three groups; unlabelled documents are the unknown one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    g = F.when(F.col("toxic") == 1, "anomaly").when(F.col("toxic") == 0, "normal").otherwise("unknown")
    stats = d.groupBy(g.alias("label_group")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("q"), F.avg("n_chars").alias("a"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    domain = spark.createDataFrame([("anomaly",), ("normal",), ("unknown",)], "label_group string")
    z = lambda c: F.coalesce(c, F.lit(0))
    return domain.join(stats, "label_group", "left").select("label_group", z("n").cast("long").alias("n_records"), z("q").cast("long").alias("n_cases"), F.round(F.coalesce("a", F.lit(0.0)), 6).alias("mean"), z("lo").cast("long").alias("least"), z("hi").cast("long").alias("most"))


@query(f"""
WITH {EP}
SELECT CAST(count(*) AS BIGINT) AS n_examples, CAST(count(DISTINCT episode_id) AS BIGINT) AS n_clips, CAST(count(*) FILTER (WHERE tool_name = 'finalize_case') AS BIGINT) AS n_answer, CAST(count(*) FILTER (WHERE tool_name <> 'finalize_case') AS BIGINT) AS n_tool FROM ep""")
def example_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("tool_name") == "finalize_case"
    return episodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_examples"), F.count_distinct("episode_id").alias("n_clips"), F.count_if(f).alias("n_answer"), F.count_if(~f).alias("n_tool"))


@query(f"""
WITH {EP}
SELECT episode_id, CAST(count(*) FILTER (WHERE tool_name = 'seek_evidence') AS BIGINT) AS n_search, CAST(count(*) FILTER (WHERE tool_name = 'emit_alert') AS BIGINT) AS n_alert, CAST(count(*) FILTER (WHERE tool_name = 'verify_hypothesis') AS BIGINT) AS n_evidence,
       coalesce(string_agg(CAST(step_index AS VARCHAR), ',' ORDER BY step_index) FILTER (WHERE tool_name IN ('emit_alert', 'finalize_case')), '') AS decision_steps
FROM ep GROUP BY episode_id""")
def anchor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tool_name")
    steps = F.array_sort(F.collect_list(F.when(t.isin("emit_alert", "finalize_case"), F.col("step_index"))))
    return episodes(spark, sf_dir).groupBy("episode_id").agg(F.count_if(t == "seek_evidence").alias("n_search"), F.count_if(t == "emit_alert").alias("n_alert"), F.count_if(t == "verify_hypothesis").alias("n_evidence"), F.array_join(steps.cast("array<string>"), ",").alias("decision_steps"))


@query(f"""
WITH {EP},
f AS (SELECT episode_id, step_index, value, count(*) OVER () AS total FROM ep WHERE k % 7 = 2 AND NOT valid OR k % 13 = 5)
SELECT episode_id, step_index, round(value, 4) AS value, CAST(total AS BIGINT) AS total FROM f ORDER BY episode_id, step_index LIMIT 25""")
def disagreement_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cases of a report, with the number of all of them: counted once, joined as a single row's column."""
    f = episodes(spark, sf_dir).where("k % 7 = 2 AND NOT valid OR k % 13 = 5").select("episode_id", "step_index", F.round("value", 4).alias("value"))
    total = f.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    return f.orderBy("episode_id", "step_index").limit(25).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
