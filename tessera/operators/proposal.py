"""Which frames of a clip a search should look at: scores, candidates, windows, a budget, and a diverse choice, for many requests at once.

Requests meet the frames of their clip in one join, are scored by their package's vectors, and only the ranked head of each
(``candidate_count`` frames) goes on. Every request that can't be served says why.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored

from .records import candidate_count, proposal_fallback
from .sequence import gap_clusters
from .vectors import dot, greedy_map, kernel, normalized

#: A clip's frames are looked at by rank up to here, or to the caller's ``top_k``: no request asks for more.
MOST_CANDIDATES = 64
MOST_FRAMES, FLAT, MANY = 8, 0.08, 3
WINDOW = "struct<start_frame:int,end_frame:int,start_sec:double,end_sec:double,frames:array<int>,score_max:double,score_mean:double>"


def _encoded(requests: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """For each request: how many positive texts aren't blank, how many of them have a vector, and the sum of all vectors by their signed weights.

    Scores are sums of weighted products, so one product with that sum gives the same.
    """
    each = requests.select(key, F.explode_outer("texts").alias("t")).select(key, F.trim("t.text").alias("text"), "t.weight", "t.positive")
    named = each.where("text <> ''").join(vectors.select("text", "vector"), "text", "left")
    signed = F.struct(F.when(F.col("positive"), F.col("weight")).otherwise(-F.col("weight")).alias("w"), normalized(F.col("vector")).alias("v"), "text", "positive")
    held = named.groupBy(key).agg(
        F.count_if("positive").alias("_positive"), F.count_if(F.col("positive") & F.col("vector").isNotNull()).alias("_encoded"),
        F.array_sort(F.collect_list(F.when(F.col("vector").isNotNull(), signed))).alias("_each"),
    )
    none = F.transform(F.get("_each", F.lit(0))["v"], lambda x: F.lit(0.0))
    total = F.aggregate("_each", none, lambda t, q: F.zip_with(t, q["v"], lambda a, b: a + q["w"] * b))
    return held.select(key, "_positive", "_encoded", total.alias("_query"))


def candidates(requests: DataFrame, frames: DataFrame, vectors: DataFrame, key: str = "request_id", top_k: int = 8, merge_gap: float = 1.0) -> DataFrame:
    """One row for each request: ``fallback_reason`` (of the six that come before the choice; null if none), ``n_frames``, ``windows``, and ``ranked`` candidates.

    ``requests``: ``key`` (unique), ``clip, start_sec, end_sec, fps, num_frames, has_encoder`` and ``texts``, an array of
    ``text, weight, positive`` (a handful). ``frames``: ``clip, frame_index`` (from 0, without holes) and ``vector``; a clip with
    a null or empty vector, or vectors of several lengths, is invalid. ``vectors``: what the encoder makes of each ``text``.
    Candidates are the best-scored frames between the times (scores compared to nine places, ties to the earlier frame); a window is a run of candidates without a gap
    over ``merge_gap`` seconds, best first. ``n_frames`` grows with long spans, flat scores and many windows.
    """
    bad = F.col("vector").isNull() | (F.size("vector") <= 0)
    clips = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("_n"), (F.coalesce(F.bool_or(bad), F.lit(False)) | (F.min(F.size("vector")) != F.max(F.size("vector")))).alias("_bad"))
    asked = requests.drop("texts").join(clips, "clip", "left").join(_encoded(requests, vectors, key), key, "left")
    fps = F.greatest(F.col("fps"), F.lit(1e-6))
    first = F.greatest(F.floor(F.col("start_sec") * F.col("fps")), F.lit(0))
    last = F.least(F.floor(F.col("end_sec") * F.col("fps")), F.col("_n") - 1)
    asked = asked.withColumns({"_from": first.cast("int"), "_to": F.greatest(last, first).cast("int")})
    asked = asked.withColumn("_span", F.greatest(F.least(F.col("_to"), F.col("_n") - 1) - F.col("_from") + 1, F.lit(0)))
    served = asked.where("NOT _bad AND has_encoder AND _encoded > 0")
    pool = served.select(key, "clip", "_from", "_to", "_query", "fps", candidate_count(F.col("_span"), F.col("num_frames"), F.lit(top_k)).alias("_most"))
    # A frame is normalized once, not for each request that looks at it; under a new name, as inside a lambda an alias would hide its own column.
    units = frames.where(~bad).select("clip", F.col("frame_index").cast("int").alias("frame"), normalized(F.col("vector")).alias("unit"))
    met = pool.join(units, "clip").where("frame BETWEEN _from AND _to")
    scored = met.select(key, "fps", "_most", "frame", "unit", F.round(dot(F.col("unit"), F.col("_query")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "frame"))
    head = scored.withColumn("rank", rank).where(F.col("rank") <= max(MOST_CANDIDATES, top_k)).where(F.col("rank") <= F.col("_most"))
    gap = F.greatest(F.bround(merge_gap * fps, 0), F.lit(1))
    runs = gap_clusters(head, key, "frame", gap)
    second = lambda c: F.round(c / fps, 6)
    windows = runs.groupBy(key, "cluster").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.array_sort(F.collect_list("frame")).alias("frames"), F.round(F.max("score"), 6).alias("score_max"), F.round(F.avg("score"), 6).alias("score_mean"),
        F.first("fps").alias("fps"), F.collect_list(F.struct("rank", "frame", F.round("score", 6).alias("score"), F.col("unit").alias("vector"))).alias("members"),
    )
    one = F.struct(
        (-F.col("score_max")).alias("a"), (-F.col("score_mean")).alias("b"), F.col("start_frame").alias("c"),
        F.struct("start_frame", "end_frame", second(F.col("start_frame")).alias("start_sec"), second(F.col("end_frame")).alias("end_sec"), "frames", "score_max", "score_mean").alias("w"),
    )
    by_rank = lambda a, b: a["rank"] - b["rank"]
    found = windows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["w"]).alias("windows"), F.array_sort(F.flatten(F.collect_list("members")), by_rank).alias("ranked"))
    out = asked.join(found, key, "left")
    n = F.size("ranked")
    cap = F.when(F.col("num_frames") > 0, F.greatest(F.least(F.lit(MOST_FRAMES), F.col("num_frames")), F.lit(1))).otherwise(MOST_FRAMES)
    long = F.when(F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(1e-6)) < 2, 1).otherwise(2)
    flat = F.when((n >= 5) & (F.get("ranked", F.lit(0))["score"] - F.get("ranked", F.lit(4))["score"] < FLAT), 1).otherwise(0)
    many = F.when(F.size("windows") >= MANY, 1).otherwise(0)
    positive = F.coalesce(F.col("_positive"), F.lit(0)) > 0
    windows_found = F.coalesce(F.size("windows") > 0, F.lit(False))
    reason = proposal_fallback(F.col("_n").isNotNull(), F.col("has_encoder"), positive, ~F.col("_bad"), F.col("_encoded") > 0, windows_found, F.lit(True))
    budget = F.when(reason.isNull(), F.greatest(F.least(cap, long + flat + many), F.lit(1))).otherwise(0)
    none = F.array().cast(f"array<{WINDOW}>")
    return out.select(
        key, "fps", reason.alias("fallback_reason"), budget.cast("int").alias("n_frames"), F.coalesce("windows", none).alias("windows"), F.when(reason.isNull(), F.col("ranked")).alias("ranked"),
    )


def choose(frames: np.ndarray, scores: np.ndarray, vectors: np.ndarray, fps: float, n: int) -> tuple[list[int], bool]:
    """``n`` places of ranked candidates, good and unlike, and whether that worked; else the best ones."""
    with np.errstate(all="ignore"):
        k = kernel(vectors, frames / max(fps, 1e-6), scores)
    if not np.isfinite(k).all():
        return list(range(min(n, len(frames)))), False
    return greedy_map(k, n), True


def propose(requests: DataFrame, frames: DataFrame, vectors: DataFrame, key: str = "request_id", top_k: int = 8, merge_gap: float = 1.0, backend: str = "guided_dpp") -> DataFrame:
    """One row for each request: ``backend, fallback_reason, n_frames, windows, candidate_frames, candidate_scores, selected_frames, selected_scores``.

    ``backend``: its name where the choice worked, ``feature_topk`` where the best frames stand in for it (``dpp_failure``: the
    kernel isn't finite), ``uniform`` where nothing is proposed. See ``candidates`` for the rest. Building the result runs jobs.
    """
    found = stored(candidates(requests, frames, vectors, key, top_k, merge_gap))  # read twice below

    def pick(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for k, fps, n, ranked in zip(b["key"], b["fps"], b["n_frames"], b["ranked"], strict=True):
                at, scores = np.array([r["frame"] for r in ranked]), np.array([r["score"] for r in ranked], float)
                got, worked = choose(at, scores, np.stack([np.asarray(r["vector"], float) for r in ranked]), fps, int(n))
                got.sort(key=lambda i: at[i])
                rows.append((k, [int(at[i]) for i in got], [float(scores[i]) for i in got], worked))
            yield pd.DataFrame(rows, columns=["key", "selected_frames", "selected_scores", "worked"])

    # A row holds the candidates of one request: 64 of them, or top_k, at most.
    ready = found.where("ranked IS NOT NULL").select(F.col(key).cast("string").alias("key"), "fps", "n_frames", "ranked")
    chosen = ready.mapInPandas(pick, "key string, selected_frames array<int>, selected_scores array<double>, worked boolean")
    out = found.join(chosen.withColumnRenamed("key", "_key"), F.col(key).cast("string") == F.col("_key"), "left")
    failed = ~F.coalesce("worked", F.lit(True))
    reason = F.coalesce("fallback_reason", F.when(failed, "dpp_failure"))
    name = F.when(F.col("fallback_reason").isNotNull(), "uniform").when(failed, "feature_topk").otherwise(backend)
    ranked = F.coalesce("ranked", F.array().cast("array<struct<rank:int,frame:int,score:double,vector:array<double>>>"))
    return out.select(
        key, name.alias("backend"), reason.alias("fallback_reason"), "n_frames", "windows", F.transform(ranked, lambda r: r["frame"]).alias("candidate_frames"), F.transform(ranked, lambda r: r["score"]).alias("candidate_scores"),
        F.coalesce("selected_frames", F.array().cast("array<int>")).alias("selected_frames"), F.coalesce("selected_scores", F.array().cast("array<double>")).alias("selected_scores"),
    )
