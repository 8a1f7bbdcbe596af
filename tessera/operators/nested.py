"""Summaries of nested values by path, and feature payloads of any shape in one layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.binding import let
from tessera.functions.canonical import DEPTH, leaves

from .aggregates import fixed_domain

#: Version of the one layout of feature payloads, and what older ones are called.
FEATURES, BARE = "features.v1", "features.v0"
MATRIX = "array<array<double>>"


def summarize(df: DataFrame, payload: str, depth: int = DEPTH, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each path of a nested value (VARIANT) and, of texts, for each of its values: ``path, value, n, share, mean, least, most``.

    Numbers are summed up by path (``value`` is null): how many rows have the path, their share of all rows, and mean, least
    and most. Texts are counted by value. ``domains`` names all values of a path: those without rows count 0, and rows that
    lack the path or hold another value count as ``unknown``. Lists are paths by place. Aggregates combine before their shuffle,
    and their rows are few, as names of fields are.
    """
    domains = domains or {}
    each = df.select(F.explode(leaves(F.col(payload), depth)).alias("l")).select("l.path", F.col("l.value").alias("text"), F.col("l.value").try_cast("double").alias("number"))
    free = each.where(~F.col("path").isin(*domains)) if domains else each
    found = free.groupBy("path", F.when(F.col("number").isNull(), F.col("text")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg("number").alias("mean"), F.min("number").alias("least"), F.max("number").alias("most"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    out = found.crossJoin(F.broadcast(total)).select("path", "value", "n", (F.col("n") / F.col("_all")).alias("share"), "mean", "least", "most")  # one row
    for path, known in domains.items():
        counted = fixed_domain(df, F.try_variant_get(F.col(payload), f"$.{path}", "string"), [*known, "unknown"], "unknown")
        none = [F.lit(None).cast("double").alias(c) for c in ("mean", "least", "most")]
        out = out.unionByName(counted.select(F.lit(path).alias("path"), "value", "n", "share", *none))
    return out


def _numbers(v: Column, path: str) -> Column:
    """A list of numbers; null if it is missing, empty, or holds anything else."""
    return let(F.try_variant_get(v, path, "array<double>"), lambda got: F.when(F.size(got) > 0, got))


def frame_signature(fps: Column, frames: Column) -> Column:
    """The hash by which a payload knows the frames it was made of."""
    rate = F.round(fps, 6)
    text = F.concat(F.lit('{"fps": '), rate.cast("string"), F.lit(', "frame_indices": ['), F.array_join(frames.cast("array<string>"), ", "), F.lit('], "num_frames": '), F.size(frames).cast("string"), F.lit("}"))
    return F.sha1(text.cast("binary"))


def feature_payload(v: Column, fps: Column | None = None, frames: Column | None = None) -> Column:
    """One layout for feature payloads of every kind; null for what is none of them.

    A bare list of vectors is the oldest kind. An object must hold ``embeddings``; what else it lacks comes from the arguments
    (``fps``, frame numbers), else from defaults: 1 frame a second, frames from 0. Timestamps of another number than the
    frames are made anew from their places.
    """
    fps = F.lit(None).cast("double") if fps is None else fps
    frames = F.lit(None).cast("array<int>") if frames is None else frames
    return let(v, lambda v: let(_rows(v), lambda held: F.when(held["rows"].isNotNull(), _layout(v, held["rows"], held["own"], fps, frames))))


def _rows(v: Column) -> Column:
    """The vectors, and whether they come from an object that may hold more."""
    bare = F.try_variant_get(v, "$", MATRIX)
    return let(bare, lambda bare: F.struct(F.coalesce(bare, F.try_variant_get(v, "$.embeddings", MATRIX)).alias("rows"), bare.isNull().alias("own")))


def _layout(v: Column, rows: Column, own: Column, fps: Column, frames: Column) -> Column:
    text = lambda path, default: F.coalesce(F.when(own, F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))), default)
    rate = F.coalesce(F.when(own, F.nullif(F.try_variant_get(v, "$.fps", "double"), F.lit(0.0))), F.nullif(fps, F.lit(0.0)), F.lit(1.0))
    counted = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.coalesce(F.when(own, _numbers(v, "$.frame_indices").cast("array<int>")), F.when(F.size(frames) > 0, frames), counted)
    times = F.when(own, F.try_variant_get(v, "$.timestamps_sec", "array<double>"))
    width = F.coalesce(F.when(own, F.nullif(F.try_variant_get(v, "$.embedding_dim", "int"), F.lit(0))), F.size(F.get(rows, F.lit(0))), F.lit(0))

    def filled(b: Column) -> Column:
        rate, numbers, times = b["rate"], b["numbers"], b["times"]
        made = F.transform(numbers, lambda x, i: F.round(i / F.greatest(rate, F.lit(1e-6)), 6))
        return F.struct(
            text("$.version", F.when(own, FEATURES).otherwise(BARE)).alias("version"), text("$.model_name", F.when(own, "unknown").otherwise("legacy_tensor")).alias("model_name"), rate.alias("fps"), numbers.alias("frame_indices"),
            F.when(F.size(times) == F.size(numbers), times).otherwise(made).alias("timestamps_sec"), rows.alias("embeddings"), width.alias("embedding_dim"),
            F.coalesce(F.when(own, F.try_variant_get(v, "$.normalized", "boolean")), F.lit(False)).alias("normalized"), text("$.frame_cache_signature", frame_signature(rate, numbers)).alias("frame_cache_signature"),
        )

    return let(F.struct(rate.alias("rate"), numbers.alias("numbers"), times.alias("times")), filled)
