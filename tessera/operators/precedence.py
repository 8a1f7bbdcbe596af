"""Lookups by several keys in order of precedence, and ladders of fallbacks that say which rung held."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import known_ids


def composite(*parts: Column) -> Column:
    """One key of several values; null if one of them is."""
    return F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\x1f"))])


def first_match(
    left: DataFrame, key: str, wanted: Sequence[tuple[str, str, Column]], right: DataFrame, offered: Sequence[tuple[str, Column]], ordinal: str, within: Sequence[str] = (), otherwise: str = "none",
) -> DataFrame:
    """``left`` with ``match`` (a row of ``right`` as a struct, or null) and ``matched_by``: which of the ``wanted`` keys found it.

    ``wanted``: reason, kind and value of a row's keys, foremost first; ``offered``: kind and value of the keys that a row of
    ``right`` answers to. Nulls match nothing. Of several rows with one key that of the least ``ordinal`` counts, and ``within``
    names columns that must be equal as well. ``key`` is unique in ``left``. Each offered key is one row before the join, so
    however many rows share a key, a wanted key meets one; and all keys go through one join.
    """
    rest = [c for c in right.columns if c not in within]
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in offered])
    each = right.select(*within, F.struct(*rest).alias("_row"), F.col(ordinal).alias("_at"), F.explode(keys).alias("_k"))
    offers = each.where("_k.value IS NOT NULL").groupBy(*within, F.col("_k.kind").alias("_kind"), F.col("_k.value").alias("_value")).agg(F.min_by("_row", "_at").alias("match"))
    asks = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(reason).alias("reason"), F.lit(kind).alias("kind"), value.cast("string").alias("value")) for i, (reason, kind, value) in enumerate(wanted)])
    asked = left.select(F.col(key).alias("_key"), *within, F.explode(asks).alias("_a")).select("_key", *within, "_a.rank", "_a.reason", F.col("_a.kind").alias("_kind"), F.col("_a.value").alias("_value"))
    found = asked.join(offers, [*within, "_kind", "_value"]).groupBy("_key").agg(F.min_by(F.struct("match", "reason"), "rank").alias("_f"))
    out = left.join(found, F.col(key) == F.col("_key"), "left")
    return out.select(*left.columns, F.col("_f.match").alias("match"), F.coalesce("_f.reason", F.lit(otherwise)).alias("matched_by"))


def find_moments(calls: DataFrame, moments: DataFrame, key: str, clip: str, ordinal: str) -> DataFrame:
    """The evidence moment that each call means: that of its ``moment_id``, else the first of its ``role``, with the call's bounds if it has both."""
    bounded = F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull()
    role = F.when(F.coalesce(F.col("role"), F.lit("")) != "", F.col("role"))
    start = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0))  # noqa: E731  an unknown bound
    wanted = [("id", "id", F.col("moment_id")), ("role and bounds", "bounds", F.when(bounded, composite(role, start("start_sec"), start("end_sec")))), ("role", "role", F.when(~bounded, role))]
    # A moment's own bound of zero counts as unknown, as the records that this follows have it.
    known = lambda c: F.when(start(c) == 0, -1.0).otherwise(start(c))
    offered = [("id", F.col("moment_id")), ("bounds", composite(role, known("start_sec"), known("end_sec"))), ("role", role)]
    return first_match(calls, key, wanted, moments, offered, ordinal, [clip])


def first_filled(**lists: Column) -> Column:
    """``ids, source``: the first of several lists that isn't empty, and its name (``none``, and an empty list)."""
    ids, source = F.array().cast("array<string>"), F.lit("none")
    for name, c in reversed(list(lists.items())):
        filled = F.coalesce(F.size(c) > 0, F.lit(False))
        ids, source = F.when(filled, c).otherwise(ids), F.when(filled, F.lit(name)).otherwise(source)
    return F.struct(ids.alias("ids"), source.alias("source"))


def selected_windows(after: Column, verified: Column, best_effort: Column, active: Column, known: Column) -> Column:
    """The windows that a turn left selected: those it names, then verified ones, the best it had, and what was active; of those the known ones."""
    chosen = first_filled(selected=after, verified=verified, best_effort=best_effort, active=known_ids(F.coalesce(active, F.array().cast("array<string>")), known))
    return F.struct(known_ids(chosen["ids"], known).alias("ids"), chosen["source"].alias("source"))


def state_windows(active: Column, records: Column, known: Column) -> Column:
    """The windows that a state has selected: active ones, else what the last of its ``records`` (``verified, best_effort``) verified, or had at best."""
    last = F.try_element_at(records, F.lit(-1))
    clean = lambda c: known_ids(F.coalesce(c, F.array().cast("array<string>")), known)
    return first_filled(active=clean(active), verified=clean(last["verified"]), best_effort=clean(last["best_effort"]))


def image_sources(refs: DataFrame, caches: DataFrame, video: str = "video_path") -> DataFrame:
    """``refs`` with ``source`` (``cached`` or ``raw``), ``frame``, and ``reason`` where the cache didn't serve.

    ``refs``: ``sampled_frame_index, raw_frame_index, timestamp_sec``. ``caches``: one row for each video that has a cache:
    ``status`` (``loaded`` or what is wrong), ``n_cached``; and ``fps, n_frames`` of the video itself. In range, the sampled
    frame comes from the cache. Otherwise it is the raw index, the sampled one as a raw index, or the frame nearest to the time;
    a reference with none of them has no source and the reason ``unresolved``.
    """
    held = refs.join(caches.withColumnRenamed(video, "_video"), F.col(video) == F.col("_video"), "left").drop("_video")
    sampled, loaded = F.col("sampled_frame_index"), F.coalesce(F.col("status") == "loaded", F.lit(False))
    hit = loaded & F.coalesce((sampled >= 0) & (sampled < F.col("n_cached")), F.lit(False))
    at = F.greatest(F.least(F.bround(F.col("timestamp_sec") * F.col("fps"), 0).cast("int"), F.col("n_frames") - 1), F.lit(0))
    raw = F.coalesce("raw_frame_index", sampled, F.when((F.col("fps") > 0) & F.col("timestamp_sec").isNotNull(), at))
    status = F.coalesce("status", F.lit("missing"))
    why = F.when(loaded & sampled.isNull(), "missing_sampled_frame_index").when(loaded, F.concat(F.lit("sampled_frame_index_out_of_range:"), sampled.cast("string"))).when(status != "missing", F.concat(F.lit("cache_status:"), status)).otherwise("missing_frame_cache")
    return held.select(
        *refs.columns, F.when(hit, "cached").when(raw.isNotNull(), "raw").alias("source"), F.when(hit, sampled).otherwise(raw).cast("int").alias("frame"),
        F.when(~hit, F.when(raw.isNull(), "unresolved").otherwise(why)).alias("reason"),
    )


def _said(c: Column) -> Column:
    """Lower case, trimmed; null if nothing is left."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def label_group(matched: Column, is_anomaly: Column, target: Column, answer: Column, finalized: Column) -> Column:
    """``group, source``: what the reference's label says, else its target, else the policy's own answer, else that of its finalized case.

    ``answer`` and ``finalized`` are existences; an answer that is there (not null) hides the case, whatever it says.
    """
    known = lambda c: F.when(_said(c).isin("anomaly", "normal"), _said(c))
    label = F.when(matched & is_anomaly.isNotNull(), F.when(is_anomaly, "anomaly").otherwise("normal"))
    own = F.when(answer.isNotNull(), known(answer)).otherwise(known(finalized))
    rungs = [("label", label), ("target", F.when(matched, known(target))), ("policy", own), ("none", F.lit("unknown"))]
    return _ladder("group", rungs)


def reference_category(matched: Column, label: Column, target: Column, policy: Sequence[Column], group: Column) -> Column:
    """``category, source``: the reference's label, its target, then the policy's own places in order, else the label group."""
    rungs = [("label", F.when(matched, _said(label))), ("target", F.when(matched, _said(target))), *[(f"policy{i}", _said(c)) for i, c in enumerate(policy)], ("group", group)]
    return _ladder("category", rungs)


def _ladder(name: str, rungs: Sequence[tuple[str, Column]]) -> Column:
    source = F.lit(None).cast("string")
    for reason, value in reversed(rungs):
        source = F.when(value.isNotNull(), F.lit(reason)).otherwise(source)
    return F.struct(F.coalesce(*[v for _, v in rungs]).alias(name), source.alias("source"))
