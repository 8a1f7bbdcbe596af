"""Queries of interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import intervals as iv
from tessera.functions.numeric import clamp, half_even, ratio
from tessera.operators import intervals as ops

from .registry import EP, episodes, query, table


@query(f"""
WITH {EP},
m AS (SELECT *, max(end_sec) OVER (PARTITION BY episode_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ep),
i AS (SELECT *, sum(CASE WHEN start_sec <= before THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m),
u AS (SELECT episode_id, island, min(start_sec) AS s, max(end_sec) AS e FROM i GROUP BY ALL),
t AS (SELECT episode_id, sum(e - s) AS union_sec, min(s) AS hull_start, max(e) AS hull_end, count(*) AS islands FROM u GROUP BY episode_id),
d AS (SELECT episode_id, count(*) AS n, max(start_sec) AS duration FROM ep GROUP BY episode_id)
SELECT t.episode_id, CAST(n AS BIGINT) AS n_windows, CAST(islands AS BIGINT) AS n_islands, round(union_sec, 6) AS union_sec, round(hull_start, 6) AS hull_start, round(hull_end, 6) AS hull_end,
       round(CASE WHEN duration > 0 THEN union_sec / duration ELSE 0 END, 6) AS clip_ratio,
       round(greatest(0, least(1, CASE WHEN duration > 0 THEN union_sec / duration ELSE 0 END)), 6) AS clip_ratio_clamped
FROM t JOIN d ON t.episode_id = d.episode_id""")
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep = episodes(spark, sf_dir)
    merged = ops.merge(ep, ["episode_id"])
    union = merged.groupBy("episode_id").agg(F.sum(iv.length(F.col("start_sec"), F.col("end_sec"))).alias("u"), F.min("start_sec").alias("s"), F.max("end_sec").alias("e"), F.count(F.lit(1)).alias("i"))
    size = ep.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.max("start_sec").alias("d"))
    r = ratio(F.col("u"), F.col("d"))
    return union.join(size, "episode_id").select(
        "episode_id", F.col("n").alias("n_windows"), F.col("i").alias("n_islands"), F.round("u", 6).alias("union_sec"), F.round("s", 6).alias("hull_start"), F.round("e", 6).alias("hull_end"),
        F.round(r, 6).alias("clip_ratio"), F.round(clamp(r, 0.0, 1.0), 6).alias("clip_ratio_clamped"),
    )


LINES = """l AS (
  SELECT l_orderkey, l_linenumber, CAST(least(date_diff('day', o_orderdate, l_shipdate), 0) AS DOUBLE) AS s, CAST(greatest(date_diff('day', o_orderdate, l_shipdate), 0) AS DOUBLE) AS e,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order date to ship date of each line, in days from the order date; many are reversed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    d = F.datediff("l_shipdate", "o_orderdate").cast("double")
    l = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    p = iv.pair(F.array(F.lit(0.0), d))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    return l.select("l_orderkey", "l_linenumber", p["start"].alias("s"), p["end"].alias("e"), rank.alias("i"))


@query(f"""
WITH {LINES},
p AS (SELECT a.l_orderkey, a.i, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) AS ov FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.i = a.i + 1)
SELECT l_orderkey, CAST(i AS INTEGER) AS i, CAST(ov AS DOUBLE) AS overlap_days,
       round(CASE WHEN e2 - s2 > 0 THEN ov / (e2 - s2) ELSE 0 END, 6) AS overlap_share,
       round(greatest(0, least(1, ov / greatest((e1 - s1) + (e2 - s2) - ov, 1e-6))), 6) AS iou
FROM p""")
def interval_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("i")
    l = _lines(spark, sf_dir).withColumn("s2", F.lead("s").over(w)).withColumn("e2", F.lead("e").over(w)).where("s2 IS NOT NULL")
    a = [F.col(c) for c in ("s", "e", "s2", "e2")]
    return l.select("l_orderkey", "i", iv.overlap(*a).alias("overlap_days"), F.round(iv.overlap_share(*a), 6).alias("overlap_share"), F.round(iv.iou(*a), 6).alias("iou"))


@query(f"""
WITH {LINES},
c AS (SELECT DISTINCT l_orderkey, greatest(s, CAST(0 AS DOUBLE)) AS s, least(e, CAST(30 AS DOUBLE)) AS e FROM l WHERE least(e, CAST(30 AS DOUBLE)) > greatest(s, CAST(0 AS DOUBLE))),
m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
g AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m),
u AS (SELECT l_orderkey, island, max(e) - min(s) AS len FROM g GROUP BY ALL),
t AS (SELECT l_orderkey, sum(len) AS len FROM u GROUP BY l_orderkey),
h AS (SELECT l_orderkey, min(s) AS hull_start, max(e) AS hull_end FROM l GROUP BY l_orderkey)
SELECT h.l_orderkey, hull_start, hull_end, round(coalesce(len, 0) / CAST(30 AS DOUBLE), 6) AS coverage FROM h LEFT JOIN t ON h.l_orderkey = t.l_orderkey""")
def interval_hull_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)
    hull = l.groupBy("l_orderkey").agg(F.min("s").alias("hull_start"), F.max("e").alias("hull_end"))
    c = ops.coverage(l.withColumn("ts", F.lit(0.0)).withColumn("te", F.lit(30.0)), ["l_orderkey"], "ts", "te", "s", "e")
    return hull.join(c.select("l_orderkey", "coverage"), "l_orderkey", "left").select("l_orderkey", "hull_start", "hull_end", F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"))


PRF_CTES = """p AS (SELECT episode_id, s, e, row_number() OVER (PARTITION BY episode_id ORDER BY f) AS i FROM (SELECT episode_id, start_sec AS s, end_sec AS e, min(step_index) AS f FROM ep WHERE tool_name = 'seek_evidence' GROUP BY ALL)),
r AS (SELECT episode_id, start_sec - 3600 AS s, end_sec + 43200 AS e, row_number() OVER (PARTITION BY episode_id ORDER BY step_index) AS j FROM ep WHERE tool_name = 'finalize_case'),
x0 AS (SELECT p.episode_id, i, j, greatest(least(p.e, r.e) - greatest(p.s, r.s), 0) AS ov, (p.e - p.s) + (r.e - r.s) AS total FROM p JOIN r ON p.episode_id = r.episode_id WHERE i <= 3),
x AS (SELECT episode_id, i, j, greatest(0, least(1, ov / greatest(total - ov, 1e-6))) AS iou FROM x0),
y AS (SELECT * FROM x WHERE iou >= 0.3),
m1 AS (SELECT episode_id, j FROM y WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY iou DESC, j) = 1),
m2 AS (SELECT episode_id, j FROM y WHERE i = 2 AND (episode_id, j) NOT IN (SELECT episode_id, j FROM m1) QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY iou DESC, j) = 1),
m3 AS (SELECT episode_id, j FROM y WHERE i = 3 AND (episode_id, j) NOT IN (SELECT episode_id, j FROM m1 UNION SELECT episode_id, j FROM m2) QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY iou DESC, j) = 1),
m AS (SELECT episode_id, count(*) AS tp FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3) GROUP BY episode_id),
np AS (SELECT episode_id, least(count(*), 3) AS n FROM p GROUP BY episode_id), nr AS (SELECT episode_id, count(*) AS n FROM r GROUP BY episode_id),
a AS (SELECT e.episode_id, coalesce(tp, 0) AS tp, coalesce(np.n, 0) AS np, coalesce(nr.n, 0) AS nr
      FROM (SELECT DISTINCT episode_id FROM ep) e LEFT JOIN m ON e.episode_id = m.episode_id LEFT JOIN np ON e.episode_id = np.episode_id LEFT JOIN nr ON e.episode_id = nr.episode_id)"""
PRF = f"""
WITH {EP},
{PRF_CTES}
SELECT episode_id, CAST(tp AS BIGINT) AS matched, CAST(np AS BIGINT) AS n_predicted, CAST(nr AS BIGINT) AS n_reference,
       round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 6) AS precision, round(CASE WHEN nr > 0 THEN tp / nr ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2 * tp / CAST(np + nr AS DOUBLE) ELSE 0 END, 6) AS f1
FROM a"""


@query(PRF)
def evidence_prf_at3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep = episodes(spark, sf_dir)
    item = F.struct("step_index", F.struct(F.col("start_sec").alias("s"), F.col("end_sec").alias("e")).alias("w"))
    ref = F.struct("step_index", F.struct((F.col("start_sec") - 3600).alias("s"), (F.col("end_sec") + 43200).alias("e")).alias("w"))
    sets = ep.groupBy("episode_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("tool_name") == "seek_evidence", item))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("tool_name") == "finalize_case", ref))).alias("r"),
    )
    w = sets.select("episode_id", F.slice(F.array_distinct(F.transform("p", lambda x: x["w"])), 1, 3).alias("p"), F.transform("r", lambda x: x["w"]).alias("r"))
    c = w.select("episode_id", ops.greedy_matches(F.col("p"), F.col("r")).cast("long").alias("matched"), F.size("p").cast("long").alias("n_predicted"), F.size("r").cast("long").alias("n_reference"))
    return c.select(
        "*", F.round(ratio(F.col("matched"), F.col("n_predicted")), 6).alias("precision"), F.round(ratio(F.col("matched"), F.col("n_reference")), 6).alias("recall"),
        F.round(F.when(F.col("matched") > 0, 2 * F.col("matched") / (F.col("n_predicted") + F.col("n_reference"))).otherwise(F.lit(0.0)), 6).alias("f1"),
    )


@query(f"""
WITH {EP},
o AS (SELECT episode_id, min(step_index) AS onset FROM ep WHERE tool_name = 'finalize_case' AND step_index > 1 GROUP BY episode_id),
m AS (SELECT ep.episode_id, min(CASE WHEN k % 3 = 0 THEN step_index END) AS marked, max(CASE WHEN tool_name = 'emit_alert' THEN step_index END) AS alert
      FROM ep JOIN o ON ep.episode_id = o.episode_id AND ep.step_index < o.onset GROUP BY ep.episode_id),
a AS (SELECT e.episode_id, onset, marked, alert FROM (SELECT DISTINCT episode_id FROM ep) e LEFT JOIN o ON e.episode_id = o.episode_id LEFT JOIN m ON e.episode_id = m.episode_id)
SELECT episode_id,
       CASE WHEN onset IS NULL THEN 'not_applicable_normal' WHEN marked IS NOT NULL AND marked <= 3 THEN 'annotation' WHEN alert IS NOT NULL AND alert >= onset - 5 THEN 'evidence_precursor_role'
            WHEN marked IS NOT NULL THEN 'evidence_preceding_event' WHEN onset > 1 THEN 'heuristic_preceding_window' ELSE 'heuristic_unavailable' END AS source,
       CAST(CASE WHEN onset IS NULL THEN NULL WHEN marked IS NOT NULL AND marked <= 3 THEN marked WHEN alert IS NOT NULL AND alert >= onset - 5 THEN alert WHEN marked IS NOT NULL THEN marked
            WHEN onset > 1 THEN greatest(1, onset - round_even(onset * CAST(0.25 AS DOUBLE), 0)) END AS BIGINT) AS start_frame,
       CAST(onset - 1 AS BIGINT) AS end_frame
FROM a""")
def precursor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the span before an episode's first finalize step starts: the first source that applies gives it."""
    ep = episodes(spark, sf_dir)
    onset = F.min(F.when((F.col("tool_name") == "finalize_case") & (F.col("step_index") > 1), F.col("step_index"))).over(Window.partitionBy("episode_id"))
    before = iv.strictly_before(F.col("step_index"), F.col("onset"))
    a = ep.withColumn("onset", onset).groupBy("episode_id", "onset").agg(
        F.min(F.when(before & (F.col("k") % 3 == 0), F.col("step_index"))).alias("marked"), F.max(F.when(before & (F.col("tool_name") == "emit_alert"), F.col("step_index"))).alias("alert"),
    )
    normal, noted = F.col("onset").isNull(), F.col("marked") <= 3
    role, some, can = F.col("alert") >= F.col("onset") - 5, F.col("marked").isNotNull(), F.col("onset") > 1
    source = F.when(normal, "not_applicable_normal").when(noted, "annotation").when(role, "evidence_precursor_role").when(some, "evidence_preceding_event").when(can, "heuristic_preceding_window").otherwise("heuristic_unavailable")
    guess = F.greatest(F.lit(1).cast("long"), F.col("onset") - half_even(F.col("onset") * 0.25))
    start = F.when(normal, F.lit(None).cast("long")).when(noted, F.col("marked")).when(role, F.col("alert")).when(some, F.col("marked")).when(can, guess)
    return a.select("episode_id", source.alias("source"), start.alias("start_frame"), (F.col("onset") - 1).alias("end_frame"))
