"""Queries through extension points: table functions in SQL, and a model as a function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import extensions as ex

from .registry import query, table


@query("""
WITH o AS (SELECT o_orderkey, 60 + o_custkey % 40 AS d, CASE WHEN o_orderstatus = 'F' THEN 10 END AS s, CASE WHEN o_orderstatus = 'F' THEN 11 + o_custkey % 20 END AS e FROM orders),
x AS (SELECT *, e - s AS n, greatest(0.15 * (e - s), 0.5) AS pad, greatest(0.35 * (e - s), 0.5) AS tail FROM o),
st AS (
  SELECT o_orderkey, 1 AS i, 'scan_timeline' AS tool, 0 AS a, d AS b FROM x
  UNION ALL SELECT o_orderkey, 2 + r.range, 'seek_evidence', d * r.range / CAST(3 AS DOUBLE), d * (r.range + 1) / CAST(3 AS DOUBLE) FROM x, range(0, 3) r WHERE s IS NULL
  UNION ALL SELECT o_orderkey, 5, 'verify_hypothesis', 0, d FROM x WHERE s IS NULL UNION ALL SELECT o_orderkey, 6, 'finalize_case', 0, d FROM x WHERE s IS NULL
  UNION ALL SELECT o_orderkey, 2, 'seek_evidence', s + 0.15 * n, s + 0.55 * n FROM x WHERE s IS NOT NULL UNION ALL SELECT o_orderkey, 3, 'emit_alert', s, e FROM x WHERE s IS NOT NULL
  UNION ALL SELECT o_orderkey, 4, 'seek_evidence', e - tail, e FROM x WHERE s IS NOT NULL UNION ALL SELECT o_orderkey, 5, 'seek_evidence', s - pad, e + pad FROM x WHERE s IS NOT NULL
  UNION ALL SELECT o_orderkey, 6, 'seek_evidence', s, e FROM x WHERE s IS NOT NULL UNION ALL SELECT o_orderkey, 7, 'emit_alert', s, e FROM x WHERE s IS NOT NULL
  UNION ALL SELECT o_orderkey, 8, 'verify_hypothesis', s, e FROM x WHERE s IS NOT NULL UNION ALL SELECT o_orderkey, 9, 'finalize_case', s, e FROM x WHERE s IS NOT NULL)
SELECT o_orderkey, CAST(i AS INTEGER) AS step_index, tool AS tool_name, round(CAST(a AS DOUBLE), 4) AS start_sec, round(CAST(b AS DOUBLE), 4) AS end_sec FROM st""")
def oracle_steps_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of clips (orders; those done hold an anomaly) by a table function in SQL."""
    ex.register_table_functions(spark)
    clips = table(spark, sf_dir, "orders").select(
        "o_orderkey", (60 + F.col("o_custkey") % 40).cast("double").alias("d"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit(10.0), (11 + F.col("o_custkey") % 20).cast("double"))).alias("anomaly"),
    )
    return spark.sql(
        """SELECT o_orderkey, step_index, tool_name, round(start_sec, 4) AS start_sec, round(end_sec, 4) AS end_sec
           FROM {clips}, LATERAL oracle_steps(d, anomaly, CAST(NULL AS ARRAY<DOUBLE>), CAST(NULL AS ARRAY<STRUCT<role: STRING, start: DOUBLE, `end`: DOUBLE>>))""",
        clips=clips,
    )


@query("""
SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(trim(text))) AS BIGINT) AS n_chars, CAST(sum(len(string_split(trim(text), ' '))) AS BIGINT) AS judged FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY role""")
def chat_parts_and_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records, some of them wrapped, read by a table function and judged by a model (it counts words) as a function of SQL."""
    ex.register_table_functions(spark)
    ex.register_model(spark, "count_words", lambda texts: [len(t.split(" ")) for t in texts], "long")
    plain = F.to_json(F.struct("role", F.array(F.struct(F.col("text"))).alias("content")))
    wrapped = F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("payload")))
    c = table(spark, sf_dir, "conversations")
    chats = c.select("turn", F.when(F.col("role") == "system", "{broken").when(F.col("turn") % 2 == 0, plain).otherwise(wrapped).alias("record"))
    return spark.sql(
        "SELECT role, count(*) AS n, sum(length(text)) AS n_chars, sum(count_words(text)) AS judged FROM {chats}, LATERAL chat_parts(record) GROUP BY role", chats=chats
    )


