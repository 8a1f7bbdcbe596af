"""Queries of lookups in order of precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import precedence as pc

from .registry import EP, episodes, query, table

E, S = "episode_id", "step_index"


@query(f"""
WITH {EP},
m AS (SELECT episode_id, step_index, 'm' || k AS moment_id, CASE WHEN value < 60 THEN 'precursor' WHEN value < 120 THEN 'trigger' ELSE 'peak' END AS role, CAST(floor(start_sec / 86400) AS DOUBLE) AS a, CAST(floor(end_sec / 86400) AS DOUBLE) AS z FROM ep WHERE tool_name = 'seek_evidence'),
mk AS (SELECT *, CASE WHEN a = 0 THEN -1 ELSE a END AS ka, CASE WHEN z = 0 THEN -1 ELSE z END AS kz FROM m),
c AS (SELECT episode_id, step_index, CASE WHEN valid THEN 'm' || k END AS moment_id, CASE WHEN value < 60 THEN 'precursor' WHEN value < 120 THEN 'trigger' WHEN value < 400 THEN 'peak' ELSE '' END AS role, CASE WHEN value < 200 THEN CAST(floor(start_sec / 86400) AS DOUBLE) END AS a, CAST(floor(end_sec / 86400) AS DOUBLE) AS z FROM ep WHERE tool_name = 'verify_hypothesis'),
h AS (
  SELECT c.episode_id, c.step_index, mk.step_index AS at_, CASE WHEN c.moment_id = mk.moment_id THEN 0 WHEN c.a IS NOT NULL AND c.z IS NOT NULL THEN 1 ELSE 2 END AS rank
  FROM c JOIN mk ON c.episode_id = mk.episode_id AND (c.moment_id = mk.moment_id OR c.role <> '' AND c.role = mk.role AND (c.a IS NULL OR c.z IS NULL OR c.a = mk.ka AND c.z = mk.kz))),
b AS (SELECT episode_id, step_index, arg_min(at_, rank * 1000000 + at_) AS found, min(rank) AS rank FROM h GROUP BY ALL)
SELECT c.episode_id, c.step_index, found AS moment_step, CASE rank WHEN 0 THEN 'id' WHEN 1 THEN 'role and bounds' WHEN 2 THEN 'role' ELSE 'none' END AS matched_by FROM c LEFT JOIN b ON c.episode_id = b.episode_id AND c.step_index = b.step_index""")
def moment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which searched moment each verification means: by id, by role and days, or by role alone."""
    ep, v = episodes(spark, sf_dir), F.col("value")
    day = lambda c: F.floor(F.col(c) / 86400).cast("double")
    role = F.when(v < 60, "precursor").when(v < 120, "trigger")
    name = F.concat(F.lit("m"), F.col("k").cast("string"))
    moments = ep.where("tool_name = 'seek_evidence'").select(E, S, name.alias("moment_id"), role.otherwise("peak").alias("role"), day("start_sec").alias("start_sec"), day("end_sec").alias("end_sec"))
    calls = ep.where("tool_name = 'verify_hypothesis'").select(
        E, S, "event_id", F.when(F.col("valid"), name).alias("moment_id"), role.when(v < 400, "peak").otherwise("").alias("role"), F.when(v < 200, day("start_sec")).alias("start_sec"), day("end_sec").alias("end_sec"),
    )
    return pc.find_moments(calls, moments, "event_id", E, S).select(E, S, F.col(f"match.{S}").alias("moment_step"), "matched_by")


@query("""
WITH l AS (SELECT label AS clip, count(*) AS n FROM embeddings GROUP BY label),
c AS (SELECT clip, CASE WHEN clip = 9 THEN 'load_error' ELSE 'loaded' END AS status, n FROM l),
r AS (SELECT conv_id, turn, conv_id % 12 AS clip, CASE WHEN role <> 'system' AND turn % 4 < 3 THEN length(text) // 8 END AS sampled, CASE WHEN role = 'assistant' AND turn > 2 THEN turn END AS raw, CASE WHEN turn < 5 THEN length(text) / CAST(100 AS DOUBLE) END AS ts FROM conversations),
j AS (SELECT r.*, status, n, coalesce(status = 'loaded', false) AS ok, coalesce(status = 'loaded' AND sampled >= 0 AND sampled < n, false) AS hit,
             coalesce(raw, sampled, CASE WHEN n IS NOT NULL AND ts IS NOT NULL THEN greatest(least(CAST(round_even(ts * 4, 0) AS BIGINT), 4 * n - 1), 0) END) AS frame FROM r LEFT JOIN c ON r.clip = c.clip)
SELECT conv_id, turn, CASE WHEN hit THEN 'cached' WHEN frame IS NOT NULL THEN 'raw' END AS source, CAST(CASE WHEN hit THEN sampled ELSE frame END AS INTEGER) AS frame,
       CASE WHEN hit THEN NULL WHEN frame IS NULL THEN 'unresolved' WHEN ok AND sampled IS NULL THEN 'missing_sampled_frame_index' WHEN ok THEN 'sampled_frame_index_out_of_range:' || sampled WHEN status IS NOT NULL THEN 'cache_status:' || status ELSE 'missing_frame_cache' END AS reason
FROM j""")
def image_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn's image comes from: the clip's cache, or its own frames, and why."""
    n = F.length("text")
    refs = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.pmod("conv_id", F.lit(12)).cast("string").alias("video_path"), F.when((F.col("role") != "system") & (F.col("turn") % 4 < 3), F.floor(n / 8)).cast("int").alias("sampled_frame_index"),
        F.when((F.col("role") == "assistant") & (F.col("turn") > 2), F.col("turn")).cast("int").alias("raw_frame_index"), F.when(F.col("turn") < 5, n / F.lit(100.0)).alias("timestamp_sec"),
    )
    clips = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("video_path")).agg(F.count(F.lit(1)).alias("n_cached"))
    caches = clips.withColumns({"status": F.when(F.col("video_path") == "9", "load_error").otherwise("loaded"), "fps": F.lit(4.0), "n_frames": 4 * F.col("n_cached")})
    return pc.image_sources(refs, caches).select("conv_id", "turn", "source", "frame", "reason")


@query("""
WITH x AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS hit, toxic, quality, lang, source, CASE WHEN n_chars > 2000 THEN ' Anomaly ' WHEN n_chars > 600 THEN 'other' END AS answer, CASE WHEN n_chars > 200 THEN 'normal' ELSE '' END AS finalized FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT *, CASE WHEN hit AND quality = 1 THEN CASE WHEN toxic = 1 THEN 'anomaly' ELSE 'normal' END WHEN hit AND toxic = 1 THEN 'anomaly' WHEN answer = ' Anomaly ' THEN 'anomaly' WHEN answer IS NULL AND finalized = 'normal' THEN 'normal' ELSE 'unknown' END AS label_group,
             CASE WHEN hit AND quality = 1 THEN 'label' WHEN hit AND toxic = 1 THEN 'target' WHEN answer = ' Anomaly ' OR answer IS NULL AND finalized = 'normal' THEN 'policy' ELSE 'none' END AS group_source FROM x)
SELECT doc_id, label_group, group_source, CASE WHEN hit AND quality = 1 THEN lang WHEN hit AND toxic = 1 THEN source WHEN answer IS NOT NULL THEN source WHEN finalized <> '' THEN lang ELSE label_group END AS category,
       CASE WHEN hit AND quality = 1 THEN 'label' WHEN hit AND toxic = 1 THEN 'target' WHEN answer IS NOT NULL THEN 'policy0' WHEN finalized <> '' THEN 'policy1' ELSE 'group' END AS category_source
FROM g""")
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label group and category of each document, and where they come from: labels of good ones, targets of toxic ones, else what its own size and source say."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    x = d.join(table(spark, sf_dir, "labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    hit, n = F.coalesce("hit", F.lit(False)), F.col("n_chars")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    answer, finalized = F.when(n > 2000, " Anomaly ").when(n > 600, "other"), F.when(n > 200, "normal").otherwise("")
    group = pc.label_group(hit, F.when(good, toxic), F.when(toxic, "Anomaly"), answer, finalized)
    x = x.withColumn("g", group)
    category = pc.reference_category(hit, F.when(good, F.upper("lang")), F.when(toxic, F.col("source")), [F.when(answer.isNotNull(), F.col("source")), F.when(finalized != "", F.col("lang"))], F.col("g.group"))
    return x.withColumn("c", category).select("doc_id", F.col("g.group").alias("label_group"), F.col("g.source").alias("group_source"), F.col("c.category"), F.col("c.source").alias("category_source"))


@query(f"""
WITH {EP},
t AS (SELECT episode_id, step_index, list_filter([CASE WHEN lag(tool_name) OVER o = 'seek_evidence' THEN 'w' || (step_index - 1) END, CASE WHEN lag(tool_name, 2) OVER o = 'seek_evidence' THEN 'w' || (step_index - 2) END, CASE WHEN lag(tool_name, 3) OVER o = 'seek_evidence' THEN 'w' || (step_index - 3) END], lambda x: x IS NOT NULL) AS known,
             CASE WHEN value > 300 THEN ['w' || (step_index - 1), ' ', 'w' || (step_index - 3)] ELSE [] END AS after_, CASE WHEN value > 200 THEN ['w' || (step_index - 2), ' w' || (step_index - 2)] END AS verified, CASE WHEN value > 100 THEN ['w' || (step_index - 3), 'w0'] ELSE [] END AS best FROM ep WINDOW o AS (PARTITION BY episode_id ORDER BY step_index)),
c AS (SELECT *, CASE WHEN len(after_) > 0 THEN after_ WHEN len(verified) > 0 THEN verified WHEN len(best) > 0 THEN best ELSE known END AS ids, CASE WHEN len(after_) > 0 THEN 'selected' WHEN len(verified) > 0 THEN 'verified' WHEN len(best) > 0 THEN 'best_effort' WHEN len(known) > 0 THEN 'active' ELSE 'none' END AS source FROM t)
SELECT episode_id, step_index, array_to_string(list_filter(['w' || (step_index - 1), 'w' || (step_index - 2), 'w' || (step_index - 3)], lambda x: list_contains(list_transform(ids, lambda i: trim(i)), x) AND list_contains(known, x)), ',') AS windows, source FROM c""")
def selected_window_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows each turn leaves selected, of the searches in the three turns before it, and what named them."""
    own = Window.partitionBy(E).orderBy(S)
    back = lambda i: F.concat(F.lit("w"), (F.col(S) - i).cast("string"))
    none = F.array().cast("array<string>")
    known = F.filter(F.array(*[F.when(F.lag("tool_name", i).over(own) == "seek_evidence", back(i)) for i in (1, 2, 3)]), lambda x: x.isNotNull())
    v = F.col("value")
    t = episodes(spark, sf_dir).select(
        E, S, known.alias("known"), F.when(v > 300, F.array(back(1), F.lit(" "), back(3))).otherwise(none).alias("after"),
        F.when(v > 200, F.array(back(2), F.concat(F.lit(" "), back(2)))).alias("verified"), F.when(v > 100, F.array(back(3), F.lit("w0"))).otherwise(none).alias("best"),
    )
    got = pc.selected_windows(F.col("after"), F.col("verified"), F.col("best"), F.col("known"), F.col("known"))
    return t.withColumn("got", got).select(E, S, F.array_join("got.ids", ",").alias("windows"), F.col("got.source").alias("source"))
