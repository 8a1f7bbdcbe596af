"""Queries of lookups, filters, shards and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import case_id, entry_path
from tessera.operators import budget as bd
from tessera.operators import joins as jn
from tessera.operators import messages as ms
from tessera.operators import records as rc
from tessera.operators import shard as sh

from .registry import EP, episodes, query, table

E, S = "episode_id", "step_index"


@query(f"""
WITH {EP},
r AS (SELECT episode_id, k, step_index FROM ep WHERE tool_name = 'finalize_case' QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY step_index DESC) = 1)
SELECT ep.episode_id, ep.step_index, r.k AS reference_k, r.step_index AS reference_step, c_mktsegment FROM ep JOIN r ON ep.episode_id = r.episode_id JOIN customer ON ep.episode_id = c_custkey WHERE ep.tool_name = 'verify_hypothesis'""")
def reference_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns joined to the last of their key's references and to the clip table; unmatched ones drop."""
    ep = episodes(spark, sf_dir)
    refs = ep.where("tool_name = 'finalize_case'").select(E, F.col("k").alias("reference_k"), F.col(S).alias("reference_step"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(E), "c_mktsegment")
    return ep.where("tool_name = 'verify_hypothesis'").select(E, S).join(jn.last_wins(refs, [E], "reference_step"), E).join(c, E)


@query("""
SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'anomaly' WHEN toxic = 0 THEN 'normal' WHEN source = 'src0' THEN 'hard_normal' ELSE 'unknown' END AS label_group, coalesce(CASE WHEN quality = 1 THEN lang END, nullif(source, 'src1'), 'none') AS category,
       CASE WHEN n_chars % 10 < 3 AND n_chars % 50 < 20 THEN 'cached' WHEN n_chars % 10 < 3 THEN 'sampled_out_of_range' WHEN n_chars % 10 < 6 THEN 'raw' WHEN n_chars % 10 < 9 THEN 'timestamp' ELSE 'unresolved' END AS image_source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def reference_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left lookups with ladders of fallbacks, and where each image reference would be resolved."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    m, t = F.col("n_chars") % 10, F.col("toxic")
    return d.select(
        "doc_id", F.when(t == 1, "anomaly").when(t == 0, "normal").when(F.col("source") == "src0", "hard_normal").otherwise("unknown").alias("label_group"),
        F.coalesce(F.when(F.col("quality") == 1, F.col("lang")), F.nullif("source", F.lit("src1")), F.lit("none")).alias("category"),
        F.when((m < 3) & (F.col("n_chars") % 50 < 20), "cached").when(m < 3, "sampled_out_of_range").when(m < 6, "raw").when(m < 9, "timestamp").otherwise("unresolved").alias("image_source"),
    )


@query("""
SELECT CAST(count(*) AS BIGINT) AS n_items, CAST(count(l.doc_id) AS BIGINT) AS n_skipped, CAST(count(*) - count(l.doc_id) AS BIGINT) AS n_built, CAST(sum(CASE WHEN l.doc_id IS NULL THEN n_chars ELSE 0 END) AS BIGINT) AS n_bytes,
       'entries/' || substr(min(CASE WHEN l.doc_id IS NULL THEN md5(CAST(d.doc_id AS VARCHAR)) END), 1, 2) || '/' || min(CASE WHEN l.doc_id IS NULL THEN md5(CAST(d.doc_id AS VARCHAR)) END) || '.pt' AS first_path
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def incremental_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to build when the labelled documents are done, with counts, bytes and the first entry's path."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    todo = jn.to_do(d, table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select("doc_id", "n_chars", key.alias("key"), F.lit(1).alias("new"))
    a = d.select("doc_id", F.lit(0).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("new")).unionByName(todo)
    n = F.count_if(F.col("new") == 0)
    built = F.count_if(F.col("new") == 1)
    return a.agg(n.alias("n_items"), (n - built).alias("n_skipped"), built.alias("n_built"), F.sum("n_chars").alias("n_bytes"), entry_path(F.min("key")).alias("first_path"))


@query("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN ' train ' WHEN doc_id % 10 < 9 THEN 'test' ELSE NULL END AS split FROM documents)
SELECT CASE WHEN trim(coalesce(split, '')) = 'train' THEN 'train' WHEN trim(coalesce(split, '')) = 'test' THEN 'test' ELSE 'other' END AS route, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM s GROUP BY 1""")
def split_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 10
    s = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.coalesce(F.when(m < 7, " train ").when(m < 9, "test"), F.lit(""))).alias("s"))
    return s.groupBy(F.when(F.col("s").isin("train", "test"), F.col("s")).otherwise("other").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""
WITH {EP}
SELECT episode_id, step_index, k % 4 <> 1 AND CASE k % 3 WHEN 0 THEN tool_name = 'verify_hypothesis' ELSE value > 100 END AS candidate, abs(coalesce(CASE WHEN k % 3 > 0 THEN (k - 50) / CAST(50 AS DOUBLE) END, value / 500)) >= 0.4 AS kept,
       CASE WHEN k % 5 <> 0 THEN 'confirmation' WHEN k - 3 < 40 THEN 'precursor' WHEN k - 10 >= 40 THEN 'trigger' ELSE 'evidence' END AS role, CAST(CASE WHEN k % 2 = 0 AND k % 6 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_questions,
       CAST(least(k, greatest(least(4 * greatest(k % 20, 4), 64), 8)) AS BIGINT) AS n_candidates FROM ep""")
def candidate_and_threshold_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second judge may look at, what is over a threshold, the role each window keeps, and the questions left of its clip."""
    k = F.col("k")
    payload = F.when(F.col("value") > 100, "verify_hypothesis")
    candidate = rc.judge_candidate(F.when(k % 4 == 1, "answer").when(k % 4 == 2, " Tool_Call"), F.when(k % 3 == 0, F.col("tool_name")).otherwise(" "), payload)
    kept = rc.heavy_enough(F.when(k % 3 > 0, (k - 50) / 50), F.col("value") / 500, -0.4)
    role = rc.evidence_role(F.when(k % 5 != 0, "confirmation").otherwise("precursor"), k - 10, k - 3, F.lit(40))
    pairs = F.array(F.struct(F.lit("precursor_temporal").alias("type")), F.struct(F.lit("cause").alias("type")), F.lit(None).cast("struct<type:string>"))
    questions = rc.clean_questions(pairs, F.when(k % 2 == 0, k), F.when(k % 6 == 0, "annotation").otherwise("heuristic"))
    return episodes(spark, sf_dir).select(
        E, S, candidate.alias("candidate"), kept.alias("kept"), role.alias("role"), F.size(questions).cast("long").alias("n_questions"), rc.candidate_count(k, k % 20, F.lit(8)).cast("long").alias("n_candidates"),
    )


@query("""
WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part),
w AS (SELECT unnest([3, 7, 8, 9, 5, 4, 3]) AS i, unnest([0, 1, 2, 3, 4, 5, 6]) AS asked)
SELECT CAST(asked AS INTEGER) AS asked, p_partkey FROM w JOIN o ON o.i = w.i""")
def row_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their place in order, as a list of places and ranges names them."""
    parts = sh.numbered(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"])
    return rc.take_places(parts, "ordinal", rc.parse_places("3, 7-9,5-3")).select("asked", "p_partkey")


@query("""
WITH t AS (SELECT conv_id, turn, length(text) % 5 AS m FROM conversations),
x AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
e AS (SELECT conv_id, 'message[' || turn || '] content is not a list' AS error FROM t WHERE m = 0 UNION ALL SELECT conv_id, 'message[' || turn || '].content[1]: image_ref.video_path is missing' FROM t WHERE m = 1
  UNION ALL SELECT conv_id, 'message[' || turn || '].content[1]: image_ref needs sampled_frame_index, raw_frame_index, or timestamp_sec' FROM t WHERE m = 2 AND turn % 2 = 0 UNION ALL SELECT conv_id, 'message[' || turn || '].content[1]: image item is missing both image and image_ref' FROM t WHERE m = 3 AND turn % 2 = 1
  UNION ALL SELECT conv_id, 'missing non-empty target_response' FROM x WHERE conv_id % 4 = 1)
SELECT error, CAST(count(*) AS BIGINT) AS n, min(conv_id) AS first_conv, CAST((SELECT count(*) FROM t WHERE m IN (1, 2)) AS BIGINT) AS image_refs, CAST((SELECT count(*) FROM t WHERE m = 3 AND turn % 2 = 0) AS BIGINT) AS inline_images FROM e GROUP BY error""")
def example_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the errors of all examples by place, and of their images; examples are made of conversations."""
    m, t = F.length("text") % 5, F.col("turn")
    ref = F.when(m == 1, F.struct(F.lit(" ").alias("video_path"), F.lit(1).alias("sampled_frame_index"), F.lit(None).cast("int").alias("raw_frame_index"), F.lit(None).cast("double").alias("timestamp_sec")))
    ref = ref.when(m == 2, F.struct(F.lit("v.mp4").alias("video_path"), F.lit(None).cast("int").alias("sampled_frame_index"), F.when(t % 2 == 1, 3).alias("raw_frame_index"), F.lit(None).cast("double").alias("timestamp_sec")))
    text = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("binary").alias("image"), F.lit(None).cast(ms.REF).alias("image_ref"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.when((m == 3) & (t % 2 == 0), F.lit("x").cast("binary")).alias("image"), ref.alias("image_ref"))
    content = F.when(m == 4, F.array(text)).when(m != 0, F.array(text, image))
    message = F.struct(F.col("role"), F.lit(None).cast("string").alias("name"), content.alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(t.alias("at"), message.alias("m"))), lambda a, b: (a["at"] - b["at"]).cast("int")), lambda x: x["m"])
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("messages"))
    target = F.when(F.col("conv_id") % 4 == 1, " ").otherwise("done")
    e = c.select("conv_id", ms.example_errors(F.col("conv_id"), F.col("messages"), target).alias("errors"), ms.image_counts(F.col("messages")).alias("images"))
    images = e.agg(F.sum("images.refs").alias("image_refs"), F.sum("images.inline").alias("inline_images"))
    found = e.select("conv_id", F.explode("errors").alias("error")).withColumn("error", F.regexp_replace("error", r"^example\[-?[0-9]+\]: ", ""))
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv")).crossJoin(F.broadcast(images))


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem)
SELECT CAST((SELECT count(*) FROM orders WHERE EXISTS (SELECT 1 FROM l WHERE l_orderkey = o_orderkey)) AS BIGINT) AS with_lines, CAST((SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM l WHERE l_orderkey = o_orderkey)) AS BIGINT) AS without_lines,
       CAST((SELECT count(*) FROM (SELECT l_partkey FROM l WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM l WHERE l_returnflag = 'A')) AS BIGINT) AS both_flags,
       CAST((SELECT count(*) FROM (SELECT l_partkey FROM l WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM l WHERE l_returnflag = 'A')) AS BIGINT) AS only_r, CAST((SELECT count(*) FROM (SELECT l_partkey FROM l WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey FROM l WHERE l_returnflag = 'A')) AS BIGINT) AS all_rows""")
def membership_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    r, a = l.where("l_returnflag = 'R'").select("l_partkey"), l.where("l_returnflag = 'A'").select("l_partkey")
    parts = {"with_lines": o.join(l, "l_orderkey", "left_semi"), "without_lines": o.join(l, "l_orderkey", "left_anti"), "both_flags": r.intersect(a), "only_r": r.subtract(a), "all_rows": r.unionAll(a)}
    counts = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("name") == x, F.col("n"))).alias(x) for x in parts])


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity, 0) AS BIGINT) AS score, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS priority, l_extendedprice FROM lineitem)
SELECT l_orderkey, arg_max(l_linenumber, score * 1000 - l_linenumber) AS best_line, max(score) AS best_score FROM (SELECT l_orderkey, l_linenumber, max(score) AS score FROM s GROUP BY ALL) GROUP BY l_orderkey""")
def best_match_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each order with the largest quantity; the earliest of equals."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("best_line")).agg(F.max(F.round("l_quantity", 0).cast("long")).alias("best_score"))
    return jn.best_match(l, "l_orderkey", "best_score", "best_line")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS priority, max(date_diff('day', DATE '1990-01-01', l_shipdate)) AS e FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY priority, e DESC, l_linenumber) AS subset
FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY priority, e DESC, l_linenumber) <= 2) GROUP BY l_orderkey""")
def minimal_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two foremost lines of each order by role, then latest end, then id."""
    role = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(role).alias("p"), F.max(F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))).alias("e"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("p", F.desc("e"), "l_linenumber"))
    top = l.withColumn("i", rank).where("i <= 2")
    return top.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l_linenumber"))), lambda x: x["l_linenumber"].cast("string")), ",").alias("subset"))


@query(f"""
WITH {EP},
led AS (SELECT episode_id, 'w' || lpad(CAST(step_index AS VARCHAR), 4, '0') AS w, 'e' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS e, 'm' || CAST(k % 7 AS VARCHAR) AS m, step_index AS place FROM ep WHERE tool_name = 'seek_evidence'),
sel AS (SELECT episode_id, 0 AS kind, 'w' || lpad(CAST(step_index - k % 3 AS VARCHAR), 4, '0') AS ref FROM ep WHERE tool_name = 'verify_hypothesis' AND k % 4 = 0 AND episode_id % 5 > 0 UNION ALL
        SELECT episode_id, 2, 'm' || CAST(k % 9 AS VARCHAR) FROM ep WHERE tool_name = 'verify_hypothesis' AND k % 6 = 1 AND episode_id % 5 > 0),
h AS (SELECT led.episode_id, w, min(kind * 100000 + place) AS at_ FROM led JOIN sel ON led.episode_id = sel.episode_id AND (kind = 0 AND ref = w OR kind = 2 AND ref = m) GROUP BY ALL
      UNION ALL SELECT episode_id, w, place FROM led WHERE episode_id NOT IN (SELECT episode_id FROM sel))
SELECT episode_id, w AS window_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY at_) AS INTEGER) AS position FROM h""")
def selector_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep = episodes(spark, sf_dir)
    pad = lambda p, c, n: F.concat(F.lit(p), F.lpad(c.cast("string"), n, "0"))
    k = F.col("k")
    led = ep.where("tool_name = 'seek_evidence'").select(E, pad("w", F.col(S), 4).alias("window_id"), pad("e", F.col("event_id"), 6).alias("evidence_id"), F.concat(F.lit("m"), (k % 7).cast("string")).alias("moment_id"), F.col(S).alias("place"))
    v = ep.where("tool_name = 'verify_hypothesis' AND episode_id % 5 > 0")
    sel = v.where(k % 4 == 0).select(E, F.lit(0).alias("kind"), pad("w", F.col(S) - k % 3, 4).alias("ref")).unionByName(v.where(k % 6 == 1).select(E, F.lit(2).alias("kind"), F.concat(F.lit("m"), (k % 9).cast("string")).alias("ref")))
    return jn.resolve(led, sel, E)


@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS t, o_orderpriority = '1-URGENT' AS c FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i) - 1 AS ci FROM n)
SELECT o_orderkey, CAST(i AS BIGINT) AS ordinal, CAST(i % 7 AS INTEGER) AS strided, CAST(((i + 1) * 7 - 1) // t AS INTEGER) AS contiguous, CAST(CASE WHEN c THEN ci % 7 ELSE i % 7 END AS INTEGER) AS balanced FROM m""")
def shard_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("c"))
    n = sh.numbered(o, ["o_orderdate", "o_orderkey"])
    own = sh.numbered(o.where("c"), ["o_orderdate", "o_orderkey"], "own").select("o_orderkey", "own")
    total = o.agg(F.count(F.lit(1)).alias("t")).withColumn("_one", F.lit(1))
    m = n.join(own, "o_orderkey", "left").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    i = F.col("ordinal")
    return m.select("o_orderkey", "ordinal", sh.strided(i, 7).alias("strided"), sh.contiguous(i, F.col("t"), 7).alias("contiguous"), sh.balanced(F.col("c"), F.col("own"), i, 7).alias("balanced"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)
SELECT i AS dataset_index, p_partkey, p_brand, CAST(g.range AS INTEGER) AS generation_id, lpad(CAST(i AS VARCHAR), 6, '0') AS group_id FROM p, range(0, 4) g WHERE (i - (13 + 5 * 24)) % n >= 0 AND (i - (13 + 5 * 24)) % n < 24 OR (i - (13 + 5 * 24)) % n + n < 24 AND (i - (13 + 5 * 24)) % n < 0""")
def rollout_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of one iteration, a circular run of 24 by their order, each for every generation."""
    p = sh.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"])
    return rc.rollout_specs(p, "ordinal", start=13, iteration=5, count=24, generations=4).select("dataset_index", "p_partkey", "p_brand", "generation_id", "group_id")


@query("""
WITH m AS (SELECT conv_id, turn, length(text) AS n, length(text) % 3 AS im FROM conversations),
r AS (SELECT *, sum(CASE WHEN im > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ir,
             CASE WHEN turn > 0 THEN row_number() OVER (PARTITION BY conv_id, turn = 0 ORDER BY turn DESC) END AS hr, sum(n) OVER (PARTITION BY conv_id, turn = 0 ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM m),
f AS (SELECT *, CASE WHEN im > 0 AND ir <= 2 THEN im ELSE 0 END AS fresh FROM r),
g AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM f)
SELECT conv_id, turn, CAST(least(fresh, greatest(3 - after, 0)) AS BIGINT) AS kept_images, turn = 0 OR hr <= 4 AND used <= 1500 AS kept FROM g""")
def message_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and history that a budget leaves of each conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), (F.length("text") % 3).alias("im"))
    c = bd.prune_images(c, "conv_id", "turn", "im", 2, 3)
    return bd.fit_history(c, "conv_id", "turn", "n", F.col("turn") == 0, 4, 1500).select("conv_id", "turn", "kept_images", "kept")


@query("""
WITH e AS (SELECT vec_id, vec_id % 6 AS n, range(vec_id, vec_id + 6) AS ids FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN i >= 6 - n THEN ids[i + 1] ELSE -100 END), ',') AS labels FROM e""")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(bd.response_labels(F.sequence(i, i + 5), i % 6).cast("array<string>"), ",").alias("labels"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w, vec_id % 9 AS a FROM embeddings)
SELECT vec_id, round(list_avg(w[a + 1 : a + 4]), 6) AS first_weight, round(list_avg(w[a + 5 : a + 5]), 6) AS second_weight, CAST(0 AS DOUBLE) AS empty_weight FROM e""")
def token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token weights from character weights, over three spans of which the last is empty."""
    a = (F.col("vec_id") % 9).cast("int")
    span = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    w = bd.token_weights(F.col("embedding").cast("array<double>"), F.array(span(a, a + 4), span(a + 4, a + 5), span(a + 5, a + 5)))
    return table(spark, sf_dir, "embeddings").select("vec_id", w.alias("w")).select("vec_id", *[F.round(F.get("w", F.lit(i)), 6).alias(n) for i, n in enumerate(("first_weight", "second_weight", "empty_weight"))])


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, i AS done, round(i / CAST(n AS DOUBLE), 6) AS share FROM o WHERE i = 1 OR i = n OR i % 64 = 0""")
def progress_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders at which a run over all of them would report: the first, the last and every 64th."""
    o = sh.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return rc.at_cadence(o, "ordinal", 64).select("o_orderkey", "done", F.round(F.col("done") / F.col("total"), 6).alias("share"))


@query("""
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_orderkey, o_custkey LIMIT 100""")
def ordered_merge_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards merged in order once both are known to be whole, and the first hundred rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"), (F.col("o_orderkey") % 2).alias("shard"))
    written = o.where("shard = 0").unionByName(o.where("shard = 1"))
    return rc.merge_shards(written, o, ordinal="o_orderkey").drop("shard").limit(100)


@query(f"""
WITH {EP},
l AS (SELECT episode_id, max(CASE WHEN tool_name = 'emit_alert' THEN step_index END) AS a, max(CASE WHEN tool_name = 'verify_hypothesis' AND k % 3 = 0 THEN step_index END) AS v, max(CASE WHEN tool_name = 'scan_timeline' AND k % 2 = 0 THEN step_index END) AS act, min(CASE WHEN tool_name = 'seek_evidence' THEN step_index END) AS led FROM ep GROUP BY episode_id)
SELECT episode_id, a AS alert_step, coalesce(v, act, led) AS window_step, CASE WHEN v IS NOT NULL THEN 'verified' WHEN act IS NOT NULL THEN 'active' WHEN led IS NOT NULL THEN 'ledger' ELSE 'none' END AS source, episode_id % 4 = 0 AS kept_existing FROM l""")
def offline_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last alert and the windows an offline verdict would use; episodes that have a verdict keep theirs."""
    t, s, k = F.col("tool_name"), F.col(S), F.col("k")
    l = episodes(spark, sf_dir).groupBy(E).agg(
        F.max(F.when(t == "emit_alert", s)).alias("a"), F.max(F.when((t == "verify_hypothesis") & (k % 3 == 0), s)).alias("v"), F.max(F.when((t == "scan_timeline") & (k % 2 == 0), s)).alias("act"), F.min(F.when(t == "seek_evidence", s)).alias("led"),
    )
    src = F.when(F.col("v").isNotNull(), "verified").when(F.col("act").isNotNull(), "active").when(F.col("led").isNotNull(), "ledger").otherwise("none")
    return l.select(E, F.col("a").alias("alert_step"), F.coalesce("v", "act", "led").alias("window_step"), src.alias("source"), (F.col(E) % 4 == 0).alias("kept_existing"))


@query(f"""
WITH {EP},
b AS (SELECT episode_id, max(end_sec) AS d, min(CASE WHEN tool_name = 'finalize_case' THEN start_sec END) AS s, min(CASE WHEN tool_name = 'finalize_case' THEN end_sec END) AS e, count(*) AS n FROM ep GROUP BY episode_id)
SELECT b.episode_id, round(d, 6) AS duration_sec, round(s, 6) AS anomaly_start, round(e, 6) AS anomaly_end, CASE WHEN s IS NULL THEN 'normal' ELSE 'anomaly' END AS existence, round(greatest(round(d / 8 + 1e-9, 6), 0.5), 6) AS scan_stride, c_mktsegment AS scene,
       'case_' || substr(sha1(c_name), 1, 10) AS case_id
FROM b JOIN customer ON b.episode_id = c_custkey""")
def base_and_train_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip records: derived seconds, targets and tool parameters."""
    t = F.col("tool_name") == "finalize_case"
    b = episodes(spark, sf_dir).groupBy(E).agg(F.max("end_sec").alias("d"), F.min(F.when(t, F.col("start_sec"))).alias("s"), F.min(F.when(t, F.col("end_sec"))).alias("e"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(E), "c_name", "c_mktsegment")
    return b.join(c, E).select(
        E, F.round("d", 6).alias("duration_sec"), F.round("s", 6).alias("anomaly_start"), F.round("e", 6).alias("anomaly_end"), F.when(F.col("s").isNull(), "normal").otherwise("anomaly").alias("existence"),
        F.round(F.greatest(F.round(F.col("d") / 8 + 1e-9, 6), F.lit(0.5)), 6).alias("scan_stride"), F.col("c_mktsegment").alias("scene"), case_id(F.col("c_name")).alias("case_id"),
    )


@query(f"""
WITH {EP},
b AS (SELECT episode_id, min(start_sec) AS s, min(end_sec) AS e FROM ep WHERE tool_name = 'finalize_case' GROUP BY episode_id),
x AS (SELECT episode_id, s, e, greatest(0.15 * (e - s), 0.5) AS pad, greatest(0.35 * (e - s), 0.5) AS tail FROM b),
w AS (SELECT episode_id, 1 AS i, s - pad AS a, s AS b FROM x UNION ALL SELECT episode_id, 2, s + 0.15 * (e - s), s + 0.55 * (e - s) FROM x UNION ALL SELECT episode_id, 3, e - tail, e FROM x UNION ALL SELECT episode_id, 4, s - pad, e + pad FROM x UNION ALL SELECT episode_id, 5, s, e FROM x),
k AS (SELECT * FROM w WHERE b > a AND NOT (episode_id % 2 = 0 AND i = 1))
SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY i) AS INTEGER) AS position, round(a + 1e-9, 6) AS start_sec, round(b + 1e-9, 6) AS end_sec FROM k QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY i) <= 3""")
def supplemental_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three more windows of an anomaly, from five in order, without those in use."""
    t = F.col("tool_name") == "finalize_case"
    b = episodes(spark, sf_dir).where(t).groupBy(E).agg(F.min("start_sec").alias("s"), F.min("end_sec").alias("e"))
    s, e = F.col("s"), F.col("e")
    n = e - s
    pad, tail = F.greatest(0.15 * n, F.lit(0.5)), F.greatest(0.35 * n, F.lit(0.5))
    specs = F.array(*[F.struct(F.lit(i).alias("i"), a.alias("a"), z.alias("b")) for i, (a, z) in enumerate(((s - pad, s), (s + 0.15 * n, s + 0.55 * n), (e - tail, e), (s - pad, e + pad), (s, e)), 1)])
    free = F.slice(F.filter(specs, lambda w: (w["b"] > w["a"]) & ~((F.col(E) % 2 == 0) & (w["i"] == 1))), 1, 3)
    return b.select(E, F.posexplode(free).alias("p", "w")).select(E, (F.col("p") + 1).alias("position"), F.round(F.col("w.a") + 1e-9, 6).alias("start_sec"), F.round(F.col("w.b") + 1e-9, 6).alias("end_sec"))


# How much each kind of advantage counts for a turn, by tool.
COMPONENTS = {"seek_evidence": (1.0, 0.0, 0.0), "emit_alert": (0.0, 1.0, 0.25), "verify_hypothesis": (0.0, 0.5, 1.0), "finalize_case": (0.0, 0.25, 1.0)}


@query(f"""
WITH {EP},
p AS (SELECT episode_id, list(k % 5) AS ks FROM ep WHERE tool_name = 'verify_hypothesis' GROUP BY episode_id),
w AS (SELECT ep.episode_id, step_index, tool_name, k, CASE tool_name WHEN 'seek_evidence' THEN 1 ELSE 0 END AS ws, CASE tool_name WHEN 'emit_alert' THEN 1 WHEN 'verify_hypothesis' THEN 0.5 WHEN 'finalize_case' THEN 0.25 ELSE 0 END AS wa,
        CASE tool_name WHEN 'seek_evidence' THEN CASE WHEN list_contains(ks, k % 5) THEN 0.5 ELSE 0 END WHEN 'emit_alert' THEN 0.25 WHEN 'verify_hypothesis' THEN 1 WHEN 'finalize_case' THEN 1 ELSE 0 END AS we, value FROM ep LEFT JOIN p ON ep.episode_id = p.episode_id WHERE valid)
SELECT episode_id, step_index, tool_name, round(CAST(ws AS DOUBLE), 6) AS w_search, round(CAST(wa AS DOUBLE), 6) AS w_alert, round(CAST(we AS DOUBLE), 6) AS w_evidence, round(value / 500 + 0.5 * (ws * (k - 50) / 50 + wa * (k % 7 - 3) / 3 + we * (k % 11 - 5) / 5), 6) AS advantage FROM w""")
def turn_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example for each valid turn: a global advantage and three local ones, weighted by tool; seek turns share the credit of what verification selected."""
    ep = episodes(spark, sf_dir)
    chosen = ep.where("tool_name = 'verify_hypothesis'").select(E, (F.col("k") % 5).alias("c")).distinct().withColumn("used", F.lit(True))
    t, k = F.col("tool_name"), F.col("k")
    e = ep.where("valid").withColumn("c", k % 5).join(chosen, [E, "c"], "left")
    pick = lambda j: F.coalesce(*[F.when(t == n, F.lit(w[j])) for n, w in COMPONENTS.items()], F.lit(0.0))
    ws, wa = pick(0), pick(1)
    we = F.when((t == "seek_evidence") & F.coalesce("used", F.lit(False)), 0.5).otherwise(pick(2))
    adv = F.col("value") / 500 + 0.5 * (ws * (k - 50) / 50 + wa * (k % 7 - 3) / 3 + we * (k % 11 - 5) / 5)
    return e.select(E, S, "tool_name", ws.alias("w_search"), wa.alias("w_alert"), we.alias("w_evidence"), F.round(adv, 6).alias("advantage"))


@query(f"""
WITH {EP}
SELECT episode_id, step_index, CASE WHEN k % 3 = 0 THEN 'missing_feature_cache' WHEN k % 11 = 0 THEN 'missing_query_encoder' WHEN k % 5 = 0 THEN 'empty_query_package' WHEN k % 13 = 0 THEN 'invalid_feature_cache' WHEN k = 1 THEN 'empty_query_embeddings' WHEN k % 7 = 0 THEN 'empty_candidate_windows' WHEN k % 17 = 0 THEN 'dpp_failure' ELSE '' END AS fallback_reason,
       CAST(least(8, 1 + CASE WHEN value * 60 >= 2 THEN 1 ELSE 0 END + k % 2) AS BIGINT) AS n_frames
FROM ep WHERE tool_name = 'seek_evidence'""")
def proposal_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames each seek turn takes, and why it fell back where it did."""
    k = F.col("k")
    reason = rc.proposal_fallback(k % 3 != 0, k % 11 != 0, k % 5 != 0, k % 13 != 0, k != 1, k % 7 != 0, k % 17 != 0)
    return episodes(spark, sf_dir).where("tool_name = 'seek_evidence'").select(E, S, F.coalesce(reason, F.lit("")).alias("fallback_reason"), F.least(F.lit(8), 1 + F.when(F.col("value") * 60 >= 2, 1).otherwise(0) + k % 2).alias("n_frames"))
