"""Queries of whole frame proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import proposal as pr

from .registry import query, table

FPS, TOP_K = 4.0, 6


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A request for each turn, the clips of the embeddings' labels, and vectors of words.

    A turn asks for its first two words (by form) and against its last one, in a stretch of its conversation's clip as long as its
    text. A word's vector is the embedding whose id is its length; longer words than six letters have none. Clip 9 has broken frames.
    """
    e = table(spark, sf_dir, "embeddings")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    frames = e.select(F.col("label").cast("long").alias("clip"), place.alias("frame_index"), F.when((F.col("label") < 9) | (F.get("embedding", F.lit(0)) > 0), F.col("embedding").cast("array<double>")).alias("vector"))
    c = table(spark, sf_dir, "conversations")
    w = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")
    entry = lambda t, weight, positive: F.struct(t.alias("text"), F.lit(weight).alias("weight"), F.lit(positive).alias("positive"))
    texts = F.array(entry(F.get(w, F.lit(0)), 0.4, True), entry(F.get(w, F.lit(1)), 0.25, True), entry(F.element_at(w, -1), 0.15, False))
    requests = c.select(
        F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.pmod("conv_id", F.lit(12)).alias("clip"), (F.col("turn") * 1.0).alias("start_sec"), (F.col("turn") + F.length("text") / 100.0).alias("end_sec"),
        F.lit(FPS).alias("fps"), F.col("turn").cast("int").alias("num_frames"), (F.col("role") != "system").alias("has_encoder"), texts.alias("texts"),
    )
    words = requests.select(F.explode("texts.text").alias("text")).where("length(text) BETWEEN 1 AND 6").distinct()
    vectors = words.join(e.select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("vector")), F.length("text") == F.col("n")).select("text", "vector")
    return requests, frames, vectors


@query(f"""
WITH f AS (SELECT CAST(label AS BIGINT) AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS v, label = 9 AND NOT embedding[1] > 0 AS bad FROM embeddings),
cl AS (SELECT clip, count(*) AS n, bool_or(bad) AS bad FROM f GROUP BY clip),
t AS (SELECT conv_id || ':' || turn AS request_id, conv_id % 12 AS clip, turn, role <> 'system' AS enc, CAST(turn AS DOUBLE) AS s, turn + length(text) / CAST(100 AS DOUBLE) AS e, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM conversations),
q AS (SELECT request_id, w[1] AS text, 0.4 AS weight, true AS pos FROM t UNION ALL SELECT request_id, w[2], 0.25, true FROM t UNION ALL SELECT request_id, w[len(w)], -0.15, false FROM t),
qe AS (SELECT request_id, pos, CAST(weight AS DOUBLE) AS weight, CASE WHEN length(text) <= 6 THEN CAST(x.embedding AS DOUBLE[]) END AS v FROM q LEFT JOIN embeddings x ON x.vec_id = length(text) WHERE coalesce(text, '') <> ''),
qs AS (SELECT request_id, count(*) FILTER (WHERE pos) AS positive, count(*) FILTER (WHERE pos AND v IS NOT NULL) AS encoded FROM qe GROUP BY request_id),
r AS (
  SELECT t.*, cl.n, CASE WHEN cl.n IS NULL THEN 'missing_feature_cache' WHEN NOT enc THEN 'missing_query_encoder' WHEN coalesce(positive, 0) = 0 THEN 'empty_query_package' WHEN cl.bad THEN 'invalid_feature_cache' WHEN encoded = 0 THEN 'empty_query_embeddings' END AS early,
         greatest(floor(s * {FPS}), 0) AS a, greatest(least(floor(e * {FPS}), cl.n - 1), greatest(floor(s * {FPS}), 0)) AS z
  FROM t LEFT JOIN cl ON t.clip = cl.clip LEFT JOIN qs ON t.request_id = qs.request_id),
m AS (SELECT r.request_id, r.turn, r.a, r.z, r.n, frame, f.v FROM r JOIN f ON r.clip = f.clip AND frame BETWEEN a AND z WHERE early IS NULL),
sc AS (SELECT m.request_id, turn, least(z, n - 1) - a + 1 AS span, frame, sum(weight * list_dot_product(m.v, qe.v) / (sqrt(list_dot_product(m.v, m.v)) * sqrt(list_dot_product(qe.v, qe.v)))) AS score FROM m JOIN qe ON m.request_id = qe.request_id WHERE qe.v IS NOT NULL GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, frame) AS rank FROM sc),
h AS (SELECT * FROM rk WHERE rank <= least(span, greatest(least(4 * greatest(turn, 4), 64), {TOP_K}, 1))),
g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY request_id ORDER BY frame) <= {FPS} THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY request_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS cluster FROM g),
wn AS (SELECT request_id, cluster, min(frame) AS a, max(frame) AS z, round(max(score), 6) AS mx, round(avg(score), 6) AS mn FROM k GROUP BY ALL),
ws AS (SELECT request_id, count(*) AS n, string_agg(a || '-' || z, ',' ORDER BY mx DESC, mn DESC, a) AS windows, max(mx) AS best FROM wn GROUP BY request_id),
hs AS (SELECT request_id, count(*) AS n, max(round(score, 6)) FILTER (WHERE rank = 1) - max(round(score, 6)) FILTER (WHERE rank = 5) AS drop5 FROM h GROUP BY request_id)
SELECT r.request_id, coalesce(early, CASE WHEN ws.n IS NULL THEN 'empty_candidate_windows' END, 'none') AS fallback_reason, CAST(coalesce(hs.n, 0) AS INTEGER) AS n_candidates, coalesce(windows, '') AS windows,
       CAST(CASE WHEN ws.n IS NULL THEN 0 ELSE greatest(least(CASE WHEN turn > 0 THEN least(8, turn) ELSE 8 END, CASE WHEN greatest(e - s, 1e-6) < 2 THEN 1 ELSE 2 END + CASE WHEN hs.n >= 5 AND drop5 < 0.08 THEN 1 ELSE 0 END + CASE WHEN ws.n >= 3 THEN 1 ELSE 0 END), 1) END AS INTEGER) AS n_frames,
       round(best + 1e-9, 4) AS best_score
FROM r LEFT JOIN ws ON r.request_id = ws.request_id LEFT JOIN hs ON r.request_id = hs.request_id""")
def proposal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, windows, budgets and reasons of each turn's request, all but the choice itself."""
    found = pr.candidates(*_inputs(spark, sf_dir), top_k=TOP_K)
    windows = F.array_join(F.transform("windows", lambda w: F.concat_ws("-", w["start_frame"].cast("string"), w["end_frame"].cast("string"))), ",")
    return found.select(
        "request_id", F.coalesce("fallback_reason", F.lit("none")).alias("fallback_reason"), F.coalesce(F.size("ranked"), F.lit(0)).alias("n_candidates"), windows.alias("windows"), "n_frames",
        F.round(F.get("windows", F.lit(0))["score_max"] + 1e-9, 4).alias("best_score"),
    )


@query()
def frame_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole proposal of each turn's request, with the frames it chose."""
    found = pr.propose(*_inputs(spark, sf_dir), top_k=TOP_K)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("request_id", "backend", F.coalesce("fallback_reason", F.lit("none")).alias("fallback_reason"), "n_frames", F.size("windows").alias("n_windows"), joined("candidate_frames").alias("candidate_frames"), joined("selected_frames").alias("selected_frames"))
