"""Rules on whole records: which rows to take, how fields are cleaned, and checks of what shards wrote."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.intervals import strictly_before

# Reasons why a proposal falls back to a uniform choice, in the order they are looked for.
FALLBACKS = ["missing_feature_cache", "missing_query_encoder", "empty_query_package", "invalid_feature_cache", "empty_query_embeddings", "empty_candidate_windows", "dpp_failure"]
GROUPS = ("search", "alert", "evidence")


def parse_places(text: str) -> list[int]:
    """Numbers and ranges such as ``3,5-8,9-7``, in the order given; a range may fall."""
    out: list[int] = []
    for token in filter(None, (t.strip() for t in text.split(","))):
        span = re.fullmatch(r"(-?\d+)\s*-\s*(-?\d+)", token)
        if span:
            a, b = int(span[1]), int(span[2])
            out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
        else:
            out.append(int(token))
    return out


def resolve_places(size: int, text: str = "", start: int = 0, count: int = 0) -> list[int]:
    """The places a text names, else ``count`` from ``start`` (all of the rest for 0); an error if none, or if one is outside the ``size`` rows."""
    if not text and count < 0:
        raise ValueError("give places, or a count of at least zero")
    places = parse_places(text) if text else list(range(start, start + count if count else size))
    if not text and not 0 <= start < size:
        raise ValueError(f"place {start} is outside 0 to {size - 1}")
    if not places:
        raise ValueError("no place is named")
    bad = [p for p in places if not 0 <= p < size]
    if bad:
        raise ValueError(f"place {bad[0]} is outside 0 to {size - 1}")
    return places


def take_places(df: DataFrame, ordinal: str, places: Sequence[int]) -> DataFrame:
    """The rows at these places (``ordinal`` counts from 0), each as often as named, with ``asked``: its turn in the list."""
    wanted = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(places)], "_place long, asked int")
    return df.join(F.broadcast(wanted), F.col(ordinal) == F.col("_place")).drop("_place")  # a list that someone typed


def rollout_specs(df: DataFrame, ordinal: str, start: int, iteration: int, count: int, generations: int) -> DataFrame:
    """The rows of one iteration, once for each generation: ``count`` of them in a circle from ``start`` plus what the iterations before took.

    ``ordinal`` counts from 0 without holes. Rows are picked where they are, by their distance from the first one; a table of
    fewer rows than ``count`` gives each once.
    """
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    away = F.pmod(F.col(ordinal) - (start + iteration * count), F.col("_n"))
    picked = df.crossJoin(F.broadcast(size)).where(away < count)  # one row
    return picked.select(
        F.col(ordinal).alias("dataset_index"), *[c for c in df.columns if c != ordinal], F.explode(F.sequence(F.lit(0), F.lit(generations - 1))).alias("generation_id"),
        F.lpad(F.col(ordinal).cast("string"), 6, "0").alias("group_id"),
    )


def at_cadence(df: DataFrame, ordinal: str, every: int) -> DataFrame:
    """The rows at which a run over all of them reports: the first, the last, and each ``every``-th, with ``done`` (from 1) and ``total``."""
    size = df.agg(F.count(F.lit(1)).alias("total"))
    done = F.col(ordinal) + 1
    return df.crossJoin(F.broadcast(size)).withColumn("done", done).where((done == 1) | (done == F.col("total")) | (done % every == 0) if every > 0 else (done == 1) | (done == F.col("total")))


def judge_candidate(action: Column, tool: Column, payload_name: Column) -> Column:
    """Whether a second judge may look at an example: a tool call (or nothing said), of the verifier by name or else by its payload."""
    a, t = F.lower(F.trim(F.coalesce(action, F.lit("")))), F.trim(F.coalesce(tool, F.lit("")))
    return a.isin("", "tool_call") & F.when(t != "", t == "verify_hypothesis").otherwise(F.coalesce(payload_name == "verify_hypothesis", F.lit(False)))


def heavy_enough(advantage: Column, weight: Column, least: float) -> Column:
    """Whether an example's advantage, else its weight, is far enough from zero; a threshold of zero keeps all."""
    return F.abs(F.coalesce(advantage, weight, F.lit(0.0))) >= abs(least) if least else F.lit(True)


def clean_questions(pairs: Column, precursor: Column, source: Column) -> Column:
    """Question pairs (structs with ``type``) without nulls, and without those on a precursor's time unless it was annotated."""
    sure = precursor.isNotNull() & F.coalesce(source == "annotation", F.lit(False))
    return F.filter(F.coalesce(pairs, F.array()), lambda q: q.isNotNull() & (sure | ~F.coalesce(q["type"] == "precursor_temporal", F.lit(False))))


def evidence_role(role: Column, start_frame: Column, end_frame: Column, onset: Column) -> Column:
    """A precursor that doesn't end before the onset is a trigger if it starts at or after it, else plain evidence."""
    r = F.when(F.coalesce(role, F.lit("")) == "", "unspecified").otherwise(role)
    late = (r == "precursor") & onset.isNotNull() & ~(strictly_before(end_frame, onset) & (start_frame <= end_frame))
    return F.when(late, F.when(start_frame >= onset, "trigger").otherwise("evidence")).otherwise(r)


def candidate_count(frames: Column, asked: Column, top_k: Column) -> Column:
    """How many frames a proposal looks at: four times what is asked for (four at least), up to 64, or ``top_k`` if more."""
    wide = F.least(4 * F.greatest(F.coalesce(asked, F.lit(0)), F.lit(4)), F.lit(64))
    return F.least(frames, F.greatest(wide, top_k, F.lit(1)))


def proposal_fallback(cache: Column, encoder: Column, package: Column, frames: Column, queries: Column, windows: Column, chosen: Column) -> Column:
    """Why a proposal fell back (null if it didn't): the first of its seven needs that isn't met, each a boolean."""
    needs = [cache, encoder, package, frames, queries, windows, chosen]
    out = F.lit(None).cast("string")
    for need, reason in reversed(list(zip(needs, FALLBACKS, strict=True))):
        out = F.when(~F.coalesce(need, F.lit(False)), reason).otherwise(out)
    return out


def enabled_groups(**chosen: bool) -> dict[str, bool]:
    """All counterfactual groups are on unless any is chosen by name."""
    return {g: bool(chosen.get(g)) if any(chosen.values()) else True for g in GROUPS}


class IncompleteShards(ValueError):
    """A shard wrote another number of rows than it was dealt."""


def merge_shards(rows: DataFrame, dealt: DataFrame, shard: str = "shard", ordinal: str = "ordinal") -> DataFrame:
    """``rows`` in their order, once each shard's are as many as it was dealt, and no ordinal is missing or doubled.

    ``dealt``: ``shard`` and ``ordinal`` of all rows that were to be written. The check is one full join of counts.
    """
    both = dealt.groupBy(shard, ordinal).agg(F.count(F.lit(1)).alias("_want")).join(rows.groupBy(shard, ordinal).agg(F.count(F.lit(1)).alias("_got")), [shard, ordinal], "full")
    wrong = both.where(~F.coalesce(F.col("_want") == F.col("_got"), F.lit(False))).groupBy(shard).agg(F.sum("_want").alias("want"), F.sum("_got").alias("got")).orderBy(shard).limit(1).collect()
    if wrong:
        raise IncompleteShards(f"shard {wrong[0][shard]}: {wrong[0].want or 0} rows are missing or doubled, {wrong[0].got or 0} were written in their place")
    return rows.orderBy(ordinal)
