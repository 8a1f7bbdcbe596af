"""Queries of clip views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import messages as ms
from tessera.operators import oracle as oc
from tessera.operators import references as rf
from tessera.operators import views as vw

from .registry import query, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clips of 12 seconds at 10 frames a second, and their lines as moments; low ones hold an older target."""
    o, c = table(spark, sf_dir, "orders"), F.col
    line = table(spark, sf_dir, "lineitem")
    start, flag = c("l_quantity").cast("int"), c("l_returnflag")
    role = F.when(flag == "A", "precursor").when(flag == "N", "peak_action").otherwise("")
    moments = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(c("l_linenumber").cast("string").alias("moment_id"), role.alias("role"), F.lit(None).cast("string").alias("description"), start.alias("start_frame"), (start + c("l_linenumber")).alias("end_frame"))).alias("m"))
    first, rank = (c("o_custkey") % 60 + 10).cast("int"), F.substring("o_orderpriority", 1, 1)
    d = o.join(moments, c("o_orderkey") == c("l_orderkey"), "left")
    kind = F.when(rank == "1", "Car Crash").when(rank == "2", "bag-snatch").when(rank == "3", "Odd  thing").otherwise("brawl")
    interval = lambda a, b: F.array(a.cast("int"), b.cast("int"))
    none = F.lit(None).cast("string")
    return d.select(
        c("o_orderkey").cast("string").alias("video_id"), c("o_orderpriority").alias("split"), F.lit(1).alias("frame_index_base"), F.struct(F.lit(10.0).alias("fps"), F.lit(120).alias("total_frames"), F.lit(12.0).alias("duration_sec")).alias("video_meta"),
        F.struct(rank.alias("scenario")).alias("scene"), F.array(c("o_orderstatus")).alias("key_objects"),
        F.struct((c("o_orderstatus") != "O").alias("is_anomaly"), kind.alias("category"), F.lit(1).alias("severity"), F.lit(False).alias("hard_normal")).alias("label"),
        F.struct(
            F.when(c("o_custkey") % 7 != 0, interval(first + 20, first)).alias("anomaly_interval_frames"), F.when(rank == "1", interval(first - 8, first - 2)).when(rank == "2", interval(first - 8, first + 1)).alias("precursor_interval_frames"),
            F.when(rank != "3", first + 3).alias("earliest_alert_frame"),
        ).alias("temporal"),
        F.struct(F.coalesce("m", F.array().cast(f"array<{vw.MOMENT}>")).alias("evidence_moments")).alias("evidence"), F.struct(none.alias("type"), none.alias("text")).alias("counterfactual"), F.struct(none.alias("summary"), none.alias("rationale")).alias("language"),
        F.array(F.struct(F.lit("precursor_temporal").alias("type"), none.alias("question"), none.alias("answer")), F.struct(F.lit("cause").alias("type"), none.alias("question"), none.alias("answer"))).alias("qa_pairs"),
    )


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus <> 'O' AS anomaly, substr(o_orderpriority, 1, 1) AS rank, o_custkey % 60 + 10 AS a0, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 60 + 10 END AS onset FROM orders),
m AS (SELECT l_orderkey, l_returnflag AS flag, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + l_linenumber AS e FROM lineitem),
j AS (SELECT o.o_orderkey, onset, flag, s, e, flag = 'A' AND (onset IS NULL OR e < onset) AS strict, flag = 'A' AND NOT (onset IS NULL OR e < onset) AS loose, coalesce(e < onset, false) AS before FROM o JOIN m ON o_orderkey = l_orderkey),
g AS (
  SELECT o_orderkey, count(*) AS n, bool_or(strict) AS has_role, bool_or(loose) AS has_loose, bool_or(before) AS has_event, min(s) FILTER (WHERE strict) AS rs, max(e) FILTER (WHERE strict) AS re, min(s) FILTER (WHERE before) AS es, max(e) FILTER (WHERE before) AS ee,
         count(*) FILTER (WHERE strict) AS precursors, count(*) FILTER (WHERE loose AND s >= onset) AS triggers, count(*) FILTER (WHERE loose AND s < onset) AS evidence, sum(least(greatest((e - 1 + 1) / CAST(10 AS DOUBLE), 0), 12) - least(greatest((s - 1) / CAST(10 AS DOUBLE), 0), 12)) AS seconds FROM j GROUP BY o_orderkey),
p AS (SELECT o.*, g.n, precursors, triggers, evidence, seconds, rs, re, es, ee, CASE WHEN rank = '1' THEN a0 - 2 WHEN rank = '2' THEN a0 + 1 END AS noted, coalesce(has_role, false) AS has_role, coalesce(has_loose, false) AS has_loose, coalesce(has_event, false) AS has_event FROM o LEFT JOIN g ON o.o_orderkey = g.o_orderkey),
r AS (
  SELECT *, noted IS NOT NULL AND (onset IS NULL OR noted < onset) AS annotated,
         CASE WHEN NOT anomaly THEN 'not_applicable_normal' WHEN noted IS NOT NULL AND (onset IS NULL OR noted < onset) THEN 'annotation' WHEN has_role THEN 'evidence_precursor_role' WHEN noted IS NOT NULL OR has_loose THEN 'non_strict_precursor_dropped'
              WHEN has_event THEN 'evidence_preceding_event' WHEN onset IS NULL THEN 'missing_without_anomaly_interval' WHEN onset - 1 >= greatest(1, onset - 20) THEN 'heuristic_preceding_window' ELSE 'heuristic_unavailable' END AS source FROM p),
f AS (SELECT *, CASE source WHEN 'annotation' THEN a0 - 8 WHEN 'evidence_precursor_role' THEN rs WHEN 'evidence_preceding_event' THEN es WHEN 'heuristic_preceding_window' THEN greatest(1, onset - 20) END AS fs,
             CASE source WHEN 'annotation' THEN noted WHEN 'evidence_precursor_role' THEN re WHEN 'evidence_preceding_event' THEN ee WHEN 'heuristic_preceding_window' THEN onset - 1 END AS fe FROM r)
SELECT CAST(o_orderkey AS VARCHAR) AS video_id, 'view.v2' AS schema_version, source, CASE WHEN fs IS NOT NULL THEN round(least(greatest((fs - 1) / CAST(10 AS DOUBLE), 0), 12), 6) END AS lead_start, CASE WHEN fs IS NOT NULL THEN round(least(greatest(fe / CAST(10 AS DOUBLE), 0), 12), 6) END AS lead_end,
       round((onset - 1) / CAST(10 AS DOUBLE), 6) AS anomaly_start, round((onset + 20) / CAST(10 AS DOUBLE), 6) AS anomaly_end, CASE WHEN rank <> '3' THEN round((a0 + 2) / CAST(10 AS DOUBLE), 6) END AS alert_sec,
       CAST(coalesce(n, 0) AS INTEGER) AS n_moments, CAST(coalesce(precursors, 0) AS INTEGER) AS n_precursor, CAST(coalesce(triggers, 0) AS INTEGER) AS n_trigger, CAST(coalesce(evidence, 0) AS INTEGER) AS n_evidence, round(coalesce(seconds, 0), 4) AS seconds,
       CASE WHEN rank = '5' THEN 'older' WHEN NOT anomaly THEN 'normal' ELSE CASE rank WHEN '1' THEN 'traffic_accident' WHEN '2' THEN 'robbery' WHEN '3' THEN 'odd_thing' ELSE 'fighting' END END AS category,
       CAST(CASE WHEN source = 'annotation' THEN 2 ELSE 1 END AS INTEGER) AS n_questions, rank <> '5' AS upgraded
FROM f""")
def clip_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training views of all records; those of rank 5 hold a whole older view, those of rank 4 a part of one, which doesn't count."""
    d = _records(spark, sf_dir)
    rank = F.substring("split", 1, 1)
    made = vw.train_view(d).schema
    kind = {c: made[c].dataType.simpleString() for c in vw.TRAIN_PARTS}
    blank = {c: F.lit(None).cast(k) for c, k in kind.items()}
    old = d.withColumns(blank)
    older = F.from_json(F.lit('{"category":"older"}'), kind["structured_target"])
    old = old.withColumns({
        "structured_target": F.when(rank.isin("4", "5"), older), "agent_task": F.when(rank == "5", F.from_json(F.lit('{"task_prompt":"old"}'), kind["agent_task"])),
        "tool_io": F.when(rank == "5", F.from_json(F.lit("{}"), kind["tool_io"])),
    })
    v, t, m = vw.upgrade(old), F.col("temporal"), F.col("evidence.evidence_moments")
    n = lambda role: F.size(F.filter(m, lambda x: x["role"] == role))
    at = lambda c, i: F.get(t[c], F.lit(i))
    return v.select(
        "video_id", "schema_version", t["precursor_resolution"]["source"].alias("source"), at("precursor_interval_sec", 0).alias("lead_start"), at("precursor_interval_sec", 1).alias("lead_end"), at("anomaly_interval_sec", 0).alias("anomaly_start"),
        at("anomaly_interval_sec", 1).alias("anomaly_end"), t["earliest_alert_sec"].alias("alert_sec"), F.size(m).alias("n_moments"), n("precursor").alias("n_precursor"), n("trigger").alias("n_trigger"), n("evidence").alias("n_evidence"),
        F.round(F.aggregate(m, F.lit(0.0), lambda s, x: s + x["end_sec"] - x["start_sec"]), 4).alias("seconds"), F.col("structured_target.category").alias("category"), F.size("qa_pairs").alias("n_questions"), "upgraded",
    )


@query()
def oracle_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of the oracle trajectories of all records, with the times it looks at and what its verifier answers."""
    rows = oc.trajectories(vw.train_view(_records(spark, sf_dir)))
    keys, a = ("start_sec", "end_sec", "query", "decision", "verification_decision", "selected_window_ids"), F.col("arguments")
    return rows.select("*", F.json_tuple(a, *keys).alias(*keys)).select(
        "video_id", "step_index", "tool_name", F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec"), "query", F.coalesce("decision", "verification_decision").alias("decision"),
        F.coalesce(F.json_array_length("selected_window_ids"), F.lit(0)).alias("n_selected"), F.sha2(F.coalesce(a, F.lit("")).cast("binary"), 256).alias("arguments_sha256"),
    )


@query("""
WITH l AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity WHEN 3 THEN NULL ELSE l_quantity END AS a, l_quantity + CASE WHEN l_linenumber < 3 THEN 5 ELSE 1 END AS b, l_linenumber AS i, l_returnflag FROM lineitem),
w AS (SELECT l_orderkey, count(*) FILTER (WHERE a IS NOT NULL AND l_returnflag <> 'N') AS nt, sum(a) FILTER (WHERE a IS NOT NULL AND l_returnflag <> 'N') AS st, sum(b - a) FILTER (WHERE a IS NOT NULL AND l_returnflag <> 'N') AS lt,
             count(*) FILTER (WHERE a IS NOT NULL) AS ng, sum(a) AS sg, sum(b - a) FILTER (WHERE a IS NOT NULL) AS lg FROM l GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_orderstatus, substr(o_orderpriority, 1, 1) AS rank, o_custkey FROM orders)
SELECT o_orderkey, CASE WHEN rank <= '2' THEN 'own' WHEN o_orderstatus = 'F' THEN 'anomaly' ELSE 'normal' END AS existence, CASE WHEN rank <= '2' THEN NULL ELSE o_orderstatus END AS category, CASE WHEN rank <= '2' THEN CAST(1.5 AS DOUBLE) WHEN rank = '3' THEN CAST(o_custkey AS DOUBLE) END AS earliest_alert_sec,
       CASE WHEN rank <= '2' THEN NULL ELSE 'none' END AS counterfactual_type, CAST(CASE WHEN coalesce(nt, 0) > 0 THEN nt ELSE coalesce(ng, 0) END AS INTEGER) AS n_windows, round(CASE WHEN coalesce(nt, 0) > 0 THEN st ELSE coalesce(sg, 0) END, 4) AS starts, round(CASE WHEN coalesce(nt, 0) > 0 THEN lt ELSE coalesce(lg, 0) END, 4) AS seconds
FROM o LEFT JOIN w ON o_orderkey = l_orderkey""")
def reference_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of orders, their own for ranks 1 and 2, and windows of their lines: the tools' list leaves out new ones, so orders of those alone take the target's."""
    c, q, i = F.col, F.col("l_quantity"), F.col("l_linenumber")
    none = F.lit(None).cast("string")
    span = F.when(i == 1, F.array(q, q + 5)).when(i == 2, F.array(q + 5, q)).when(i == 3, F.array(q)).otherwise(F.array().cast("array<double>"))
    entry = F.struct(c("l_linenumber").cast("string").alias("moment_id"), c("l_returnflag").alias("role"), none.alias("description"), span.alias("window"), F.when(i > 3, F.array(q, q + 1)).alias("window_sec"))
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.collect_list(F.when(c("l_returnflag") != "N", entry)).alias("tools"), F.collect_list(entry).alias("own"))
    o = table(spark, sf_dir, "orders").join(lines, c("o_orderkey") == c("k"), "left")
    rank, times = F.substring("o_orderpriority", 1, 1), F.lit(None).cast("array<double>")
    whole = "struct<existence:string,category:string,severity:int,hard_normal:boolean,anomaly_interval_sec:array<double>,precursor_interval_sec:array<double>,earliest_alert_sec:double,counterfactual_type:string>"
    own = F.when(rank <= "2", F.from_json(F.lit('{"existence":"own","earliest_alert_sec":1.5}'), whole))
    label = F.struct((c("o_orderstatus") == "F").alias("is_anomaly"), c("o_orderstatus").alias("category"), F.lit(1).alias("severity"), F.lit(False).alias("hard_normal"))
    temporal = F.struct(times.alias("anomaly_interval_sec"), times.alias("precursor_interval_sec"), F.when(rank == "3", c("o_custkey").cast("double")).alias("earliest_alert_sec"))
    r = o.select("o_orderkey", rf.target(own, label, temporal, none).alias("t"), rf.windows(c("tools"), c("own")).alias("w"))
    add = lambda f: F.round(F.aggregate("w", F.lit(0.0), lambda n, x: n + f(x)), 4)
    return r.select(
        "o_orderkey", "t.existence", "t.category", "t.earliest_alert_sec", "t.counterfactual_type", F.size("w").alias("n_windows"), add(lambda x: x["start_sec"]).alias("starts"), add(lambda x: x["end_sec"] - x["start_sec"]).alias("seconds"),
    )


@query("""
WITH e AS (SELECT label, count(*) AS n, min(vec_id) AS v, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label),
i AS (SELECT label, n, ids, r.range AS place, r.range * (n // 4) + CASE WHEN r.range = 4 THEN 7 ELSE 0 END AS i FROM e, range(0, 5) r)
SELECT CAST(label AS INTEGER) AS label, CAST(7 + count(*) FILTER (WHERE i < n) AS INTEGER) AS n_items, string_agg(printf('%.3fs', i / CAST(4 AS DOUBLE)), ' ' ORDER BY place) AS times, coalesce(sum(i) FILTER (WHERE i < n), 0)::BIGINT AS sampled, coalesce(sum(ids[i + 1]) FILTER (WHERE i < n), 0)::BIGINT AS raw
FROM i GROUP BY label""")
def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode's first messages on each label's clip, with five previewed frames of which the last lies behind the end."""
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("frames"), F.count(F.lit(1)).cast("int").alias("n"))
    step = F.floor(F.col("n") / 4).cast("int")
    preview = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: p * step + F.when(p == 4, 7).otherwise(0))
    m = ms.initial_messages(F.lit("rules"), F.lit("task"), preview, F.lit(4.0), F.col("frames"), F.col("n"), F.lit("v"))
    items = F.flatten(F.transform(m, lambda x: x["content"]))
    d = e.select("label", items.alias("items"))
    images = F.filter("items", lambda x: x["type"] == "image")
    times = F.filter("items", lambda x: (x["type"] == "text") & x["text"].rlike("^[0-9]"))
    add = lambda k: F.aggregate(images, F.lit(0).cast("long"), lambda n, x: n + x["image_ref"][k])
    return d.select("label", F.size("items").alias("n_items"), F.array_join(F.transform(times, lambda x: x["text"]), " ").alias("times"), add("sampled_frame_index").alias("sampled"), add("raw_frame_index").alias("raw"))
