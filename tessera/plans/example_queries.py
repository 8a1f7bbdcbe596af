"""Queries of training examples: what fits a size, and what each token of a response is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fitting as ft

from .registry import query, table

IMAGE, MESSAGE, RESPONSE, LIMIT = 60, 4, 50, 1200


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: each line of a turn but the last is a frame behind its timestamp; an answer of several lines is frames only."""
    lines = F.split("text", "\n", -1)
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    frames = F.flatten(F.transform(lines, lambda x, i: F.when(i < F.size(lines) - 1, F.array(item("text", F.concat(i.cast("string"), F.lit("s"))), item("image", F.lit(None).cast("string")))).otherwise(F.array())))
    said = F.when((F.col("role") == "assistant") & (F.size(lines) > 1), F.array()).otherwise(F.array(item("text", F.element_at(lines, -1))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.concat(frames, said).alias("content")).alias("m"))
    by_turn = lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m"), by_turn).alias("messages"))


@query(f"""
WITH l AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS x FROM conversations),
m AS (SELECT conv_id, turn, role, len(x) - 1 AS imgs, CASE WHEN role = 'assistant' AND len(x) > 1 THEN NULL ELSE length(x[len(x)]) END AS said FROM l),
i AS (SELECT m.*, r.range AS at_, {IMAGE} + length(r.range || 's') AS own FROM m, range(0, 1000) r WHERE r.range < imgs),
d AS (
  SELECT conv_id, turn, at_, 0 AS phase, said IS NULL AND at_ = imgs - 1 AS whole, own + CASE WHEN said IS NULL AND at_ = imgs - 1 THEN {MESSAGE} ELSE 0 END AS saved FROM i
  UNION ALL SELECT conv_id, turn, -1, 1, true, {MESSAGE} + coalesce(said, 0) FROM m WHERE role NOT IN ('system', 'user') AND said IS NOT NULL),
t AS (SELECT conv_id, {RESPONSE} + sum({MESSAGE} + coalesce(said, 0) + coalesce(own, 0)) AS total FROM m LEFT JOIN (SELECT conv_id AS c, turn AS t, sum(own) AS own FROM i GROUP BY ALL) ON conv_id = c AND turn = t GROUP BY conv_id),
o AS (SELECT d.*, total - {LIMIT} - coalesce(sum(saved) OVER (PARTITION BY d.conv_id ORDER BY phase, turn, at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM d JOIN t ON d.conv_id = t.conv_id),
g AS (SELECT * FROM o WHERE over_ > 0),
s AS (SELECT conv_id, sum(saved) AS saved, count(*) FILTER (WHERE phase = 0) AS imgs, count(*) FILTER (WHERE whole) AS whole, count(*) FILTER (WHERE phase = 1) AS late FROM g GROUP BY conv_id),
k AS (SELECT m.conv_id, m.turn, 2 * (imgs - coalesce(n, 0)) + CASE WHEN said IS NULL THEN 0 ELSE 1 END AS items FROM m LEFT JOIN (SELECT conv_id, turn, count(*) FILTER (WHERE phase = 0) AS n, bool_or(whole) AS whole FROM g GROUP BY ALL) x ON m.conv_id = x.conv_id AND m.turn = x.turn WHERE NOT coalesce(whole, false)),
ks AS (SELECT conv_id, string_agg(turn || ':' || items, ',' ORDER BY turn) AS kept FROM k GROUP BY conv_id)
SELECT t.conv_id, CAST(total - coalesce(saved, 0) AS BIGINT) AS size, CAST(coalesce(imgs, 0) AS INTEGER) AS dropped_images, CAST(coalesce(whole, 0) AS INTEGER) AS dropped_messages,
       CASE WHEN total - coalesce(saved, 0) > {LIMIT} THEN 'over' WHEN saved IS NULL THEN 'whole' WHEN late = 0 THEN 'images' ELSE 'history' END AS fit, coalesce(kept, '') AS kept
FROM t LEFT JOIN s ON t.conv_id = s.conv_id LEFT JOIN ks ON t.conv_id = ks.conv_id""")
def message_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each conversation under a size, oldest images and then oldest answers leaving first."""
    fit = ft.fit_messages(F.col("messages"), F.lit(LIMIT), F.length, IMAGE, MESSAGE, F.lit(RESPONSE))
    done = _observations(spark, sf_dir).select("conv_id", fit.alias("f"))
    kept = F.array_join(F.transform("f.messages", lambda m: F.concat_ws(":", m["turn"].cast("string"), F.size(m["content"]).cast("string"))), ",")
    return done.select("conv_id", "f.size", "f.dropped_images", "f.dropped_messages", "f.fit", kept.alias("kept"))


def _marked(text: Column, marks: str, yes: float, no: float) -> Column:
    """A weight for each character: ``yes`` for those of ``marks``."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(marks), c) > 0, F.lit(yes)).otherwise(F.lit(no)))


@query("""
WITH a AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w, (length(text) - 200) / CAST(200 AS DOUBLE) AS g, (turn - 3) / CAST(4 AS DOUBLE) AS s FROM conversations WHERE role = 'assistant'),
k AS (SELECT conv_id, turn, g, s * 0.5 AS s, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM a),
v AS (SELECT *, CASE WHEN x = '' THEN 1 ELSE 1 + length(regexp_replace(x, '[^A-Z]', '', 'g')) / CAST(length(x) AS DOUBLE) END AS wg, CASE WHEN x = '' THEN 1 ELSE 1 - length(regexp_replace(x, '[^aeiou]', '', 'g')) / CAST(length(x) AS DOUBLE) END AS ws FROM k),
m AS (SELECT *, avg(wg) OVER (PARTITION BY conv_id, turn) AS mg, avg(ws) OVER (PARTITION BY conv_id, turn) AS ms FROM v),
z AS (SELECT conv_id, turn, n, i, CASE WHEN abs(g) > 1e-8 OR abs(s) > 1e-8 THEN CASE WHEN abs(g) > 1e-8 THEN g * wg / CASE WHEN mg <= 1e-8 THEN 1 ELSE mg END ELSE 0 END + CASE WHEN abs(s) > 1e-8 THEN s * ws / CASE WHEN ms <= 1e-8 THEN 1 ELSE ms END ELSE 0 END ELSE wg * 0.25 / mg END AS adv, n + turn % 3 - 1 AS want FROM m)
SELECT conv_id, turn, CAST(max(want) AS INTEGER) AS n_tokens, round(coalesce(sum(adv) FILTER (WHERE i <= want), 0) + greatest(max(want) - max(n), 0) * max(adv) FILTER (WHERE i = n), 6) AS total,
       CASE WHEN max(want) > 0 THEN round(max(adv) FILTER (WHERE i = 1), 6) END AS first_value, CASE WHEN max(want) > 0 THEN round(max(adv) FILTER (WHERE i = least(n, want)), 6) END AS last_value
FROM z GROUP BY conv_id, turn""")
def token_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advantages of the tokens (words) of each answer from two components, for one token less, as many, or one more than it has words."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    # Words lie between the places of spaces.
    spaces = F.filter(F.transform(F.split("text", ""), lambda c, i: F.when(c == " ", i)), lambda i: i.isNotNull())
    a = a.withColumn("spaces", spaces)
    span = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    offsets = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("spaces", lambda i: i + 1)), F.concat("spaces", F.array(F.length("text"))), span)
    a = a.withColumns({"offsets": offsets, "upper": _marked(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2.0, 1.0), "vowels": _marked(F.col("text"), "aeiou", 0.0, 1.0)})
    part = lambda advantage, weight, chars: F.struct(advantage.alias("advantage"), F.lit(weight).alias("weight"), F.col(chars).alias("char_weights"))
    a = a.withColumn("parts", F.array(part((F.length("text") - 200) / F.lit(200.0), 1.0, "upper"), part((F.col("turn") - 3) / F.lit(4.0), 0.5, "vowels")))
    adv = ft.token_advantages(F.col("parts"), F.col("offsets"), F.size("offsets") + (F.col("turn") % 3).cast("int") - 1, F.lit(0.25), F.col("upper"))
    done = a.select("conv_id", "turn", adv.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda n, x: n + x)
    return done.select("conv_id", "turn", F.size("v").alias("n_tokens"), F.round(total, 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first_value"), F.round(F.try_element_at("v", F.lit(-1)), 6).alias("last_value"))
