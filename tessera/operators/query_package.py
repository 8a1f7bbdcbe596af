"""Search queries as column expressions: phrases to weighted queries, packages of queries, and the moments they tell of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.binding import let
from tessera.functions.text import CLOTHING_TERMS, EVENTS, normal_query, query_kind, tokens

QUERY = "struct<text:string,kind:string,weight:double>"
# Longest phrase that is a query as it stands, who may wear clothes, who of them is any person, and the weights of a package.
MOST_WORDS = 4
# What a role lets one suppose, how much a link to a moment's id and role counts, and key objects of a package.
HYPOTHESES = {"precursor": "suspected pre-anomaly cue", "trigger": "suspected actionable event", "peak_action": "suspected actionable event", "confirmation": "suspected anomaly confirmation", "normal_check": "check whether this interval remains normal", "context": "suspected anomaly context"}
OTHER_HYPOTHESIS, ID_LINK, ROLE_LINK, MOST_OBJECTS = "suspected anomaly evidence", 4.0, 2.0, 4
WEARERS, ANYONE = ["person", "man", "woman", "individual", "victim", "attacker"], ["victim", "attacker", "individual"]
PACKAGE_WEIGHTS = {"event_cue": 0.40, "key_objects": 0.20, "scene_context": 0.10, "hypothesis": 0.25}
NEGATIVE_WEIGHT = 0.15


def _query(text: Column, kind: Column, weight: float) -> Column:
    return F.struct(text.alias("text"), kind.alias("kind"), F.lit(weight).alias("weight"))


def _few_words(t: Column) -> Column:
    return (t != "") & (F.size(F.split(t, " ")) <= MOST_WORDS)


def _entries(normal: Column) -> Column:
    """All queries of one normal phrase, equal ones too: its parts, its clothes, the whole, its events."""
    parts = F.filter(F.split(normal, r"\s+and\s+"), _few_words)
    wearing = rf"\b({'|'.join(WEARERS)})\s+in\s+([a-z0-9 ]{{1,40}}?(?:{'|'.join(CLOTHING_TERMS)}))\b"
    pairs = F.arrays_zip(F.regexp_extract_all(normal, F.lit(wearing), 1).alias("who"), F.regexp_extract_all(normal, F.lit(wearing), 2).alias("what"))
    who = lambda p: F.when(p["who"].isin(ANYONE), "person").otherwise(p["who"])
    none = F.array().cast(f"array<{QUERY}>")
    events = [F.when(normal.rlike("|".join(words)), F.array(_query(F.lit(text), F.lit("event_relation"), weight))).otherwise(none) for words, text, weight in EVENTS]
    return F.concat(
        F.transform(parts, lambda t: _query(t, query_kind(t), 0.9)),
        F.transform(pairs, lambda p: _query(F.concat_ws(" in ", who(p), F.trim(p["what"])), F.lit("attribute_object"), 1.0)),
        F.when(_few_words(normal), F.array(_query(normal, query_kind(normal), 1.0))).otherwise(none),
        *events,
    )


def _merged(entries: Column) -> Column:
    """Equal texts once, in order of their first: with the largest weight, and the first kind that isn't a plain object."""

    def one(t: Column, same: Column) -> Column:
        told = F.filter(same, lambda e: e["kind"] != "object")
        return F.struct(t.alias("text"), F.coalesce(F.get(told, F.lit(0))["kind"], F.lit("object")).alias("kind"), F.array_max(F.transform(same, lambda e: e["weight"])).alias("weight"))

    return let(entries, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda e: e["text"])), lambda t: let(F.filter(all_, lambda e: e["text"] == t), lambda same: one(t, same))))


def expand_phrases(phrases: Column) -> Column:
    """Weighted queries (``text, kind, weight``) of an array of phrases. Null and blank phrases give none."""
    normal = F.filter(F.transform(phrases, lambda p: normal_query(p)), lambda t: t != "")
    return F.coalesce(_merged(F.flatten(F.transform(normal, _entries))), F.array().cast(f"array<{QUERY}>"))


def _text_or(c: Column) -> Column:
    """The normal form of a text; where that is empty, the text itself."""
    own = F.trim(F.coalesce(c, F.lit("")))
    return let(own, lambda t: F.coalesce(F.nullif(normal_query(t), F.lit("")), t))


def _blank_to(c: Column, *others: Column) -> Column:
    out = F.lit("")
    for x in reversed((c, *others)):
        out = F.coalesce(F.nullif(F.trim(x), F.lit("")), out)
    return out


def _texts_or(c: Column) -> Column:
    trimmed = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.array_distinct(F.transform(trimmed, _text_or))


def scene_context(scene: Column) -> Column:
    """A scene as a package holds it: its normal form, empty for none."""
    return _text_or(_blank_to(scene))


def normal_package(package: Column, fallback_query: Column | None = None, fallback_scene: Column | None = None, rewrite_reason: Column | None = None) -> Column:
    """A package (struct of ``event_cue, key_objects, scene_context, hypothesis, negative_constraints, rewrite_reason``) with fallbacks and without repeats.

    Without a cue the fallback query stands in, and without a hypothesis the cue.
    """
    none = F.lit(None).cast("string")
    cue = _blank_to(package["event_cue"], _text_or(fallback_query if fallback_query is not None else none))
    return let(cue, lambda cue: F.struct(
        _text_or(cue).alias("event_cue"), _texts_or(package["key_objects"]).alias("key_objects"),
        _text_or(_blank_to(package["scene_context"], fallback_scene if fallback_scene is not None else none)).alias("scene_context"),
        _text_or(_blank_to(package["hypothesis"], cue)).alias("hypothesis"), _texts_or(package["negative_constraints"]).alias("negative_constraints"),
        _blank_to(package["rewrite_reason"], rewrite_reason if rewrite_reason is not None else none).alias("rewrite_reason"),
    ))


def rendered(package: Column) -> tuple[Column, Column]:
    """Positive and negative texts (``text, weight, source``) of a normal package; equal texts once, with the largest weight and the first source."""

    def entry(t: Column, w: float, source: str) -> Column:
        return F.struct(normal_query(t).alias("text"), F.lit(w).alias("weight"), F.lit(source).alias("source"))

    def once(entries: Column) -> Column:
        held = F.filter(entries, lambda e: e["text"] != "")
        same = lambda t: F.filter(held, lambda e: e["text"] == t)
        return F.transform(
            F.array_distinct(F.transform(held, lambda e: e["text"])),
            lambda t: F.struct(t.alias("text"), F.array_max(F.transform(same(t), lambda e: e["weight"])).alias("weight"), F.get(same(t), F.lit(0))["source"].alias("source")),
        )

    w = PACKAGE_WEIGHTS
    positive = F.concat(
        F.array(entry(package["event_cue"], w["event_cue"], "event_cue")), F.transform(package["key_objects"], lambda t: entry(t, w["key_objects"], "key_objects")),
        F.array(entry(package["scene_context"], w["scene_context"], "scene_context"), entry(package["hypothesis"], w["hypothesis"], "hypothesis")),
    )
    return once(positive), once(F.transform(package["negative_constraints"], lambda t: entry(t, NEGATIVE_WEIGHT, "negative_constraints")))


def _moment_words(m: Column) -> Column:
    return tokens(normal_query(F.concat_ws(" ", F.coalesce(m["description"], F.lit("")), F.coalesce(m["role"], F.lit("")))))


def supervision(phrases: Column, moments: Column) -> Column:
    """For each phrase: ``query_id, raw_text``, its queries, and the moments (``moment_id, role, start_sec, end_sec, description``) that share a word with one of them."""

    def one(p: Column, i: Column, told: Column) -> Column:
        def of(queries: Column, linked: Column) -> Column:
            named = lambda key: F.filter(F.transform(linked, lambda m: F.coalesce(m["moment"][key], F.lit(""))), lambda x: x != "")
            return F.struct(
                F.concat(F.lit("pq"), (i + 1).cast("string")).alias("query_id"), F.coalesce(p, F.lit("")).alias("raw_text"), queries.alias("queries"),
                named("moment_id").alias("linked_moment_ids"), named("role").alias("linked_roles"),
                F.transform(linked, lambda m: F.struct(F.coalesce(m["moment"]["start_sec"], F.lit(0.0)).alias("start_sec"), F.coalesce(m["moment"]["end_sec"], F.lit(0.0)).alias("end_sec"))).alias("linked_windows"),
            )

        said = lambda queries: F.flatten(F.transform(queries, lambda q: tokens(q["text"])))
        linked = lambda queries: let(said(queries), lambda words: F.filter(told, lambda m: F.arrays_overlap(m["words"], words)))
        return let(expand_phrases(F.array(p)), lambda queries: let(linked(queries), lambda found: of(queries, found)))

    with_words = F.transform(moments, lambda m: F.struct(m.alias("moment"), _moment_words(m).alias("words")))
    return let(with_words, lambda told: F.transform(phrases, lambda p, i: one(p, i, told)))


def query_for_moment(groups: Column, moment: Column, fallback: Column) -> Column:
    """``text`` and ``source``: the linked query of the largest weight plus share of its words in the moment (the first of equals); else the fallback."""
    id_, role = F.coalesce(moment["moment_id"], F.lit("")), F.coalesce(moment["role"], F.lit(""))
    open_ = lambda g: (id_ == "") | (F.size(g["linked_moment_ids"]) == 0) | F.array_contains(g["linked_moment_ids"], id_) | F.array_contains(g["linked_roles"], role)

    def scored(q: Column, words: Column) -> Column:
        share = lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, words)) / F.size(own)).otherwise(F.lit(0.0))
        return F.struct((q["weight"] + let(tokens(q["text"]), share)).alias("score"), q["text"].alias("text"))

    queries = F.filter(F.flatten(F.transform(F.filter(groups, open_), lambda g: g["queries"])), lambda q: q["text"] != "")
    scores = let(_moment_words(moment), lambda words: F.transform(queries, lambda q: scored(q, words)))
    first = lambda all_: let(F.array_max(F.transform(all_, lambda s: s["score"])), lambda top: F.get(F.filter(all_, lambda s: s["score"] == top), F.lit(0))["text"])
    return let(let(scores, first), lambda best: F.struct(
        F.coalesce(best, F.nullif(normal_query(fallback), F.lit("")), fallback, F.lit("")).alias("text"),
        F.when(best.isNull(), "role_fallback").otherwise("oracle_key_objects").alias("source"),
    ))


def _shares(q: Column, said: Column) -> Column:
    """A query's weight plus the share of its words that are said, stopwords too."""
    own = F.array_distinct(F.filter(F.split(normal_query(q["text"]), " "), lambda w: w != ""))
    return q["weight"] + let(own, lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, said)) / F.size(own)).otherwise(F.lit(0.0)))


def hypothesis_for(role: Column) -> Column:
    out = F.lit(OTHER_HYPOTHESIS)
    for r, text in HYPOTHESES.items():
        out = F.when(role == r, text).otherwise(out)
    return out


def with_package(df: DataFrame, groups: str, moment: str, query: Column, source: Column, scene: Column, name: str = "package") -> DataFrame:
    """Add the package that searches for a moment: cue and objects of its best linked group, and what its role lets one suppose.

    ``groups`` (of ``supervision``) and ``moment`` are columns. Groups linked to other moments alone don't count; the first of
    equals wins. Without an event the query is the cue.
    """
    c, m = F.col, F.col(moment)
    none = F.array().cast("array<string>")
    linked, by_role = lambda g: F.array_contains(g["linked_moment_ids"], c("_id")), lambda g: F.array_contains(g["linked_roles"], c("_role"))

    def scored(g: Column) -> Column:
        best = F.array_max(F.transform(F.filter(g["queries"], lambda q: q["text"] != ""), lambda q: _shares(q, c("_said"))))
        links = F.when((c("_id") != "") & linked(g), ID_LINK).otherwise(0.0) + F.when((c("_role") != "") & by_role(g), ROLE_LINK).otherwise(0.0)
        return F.struct((links + F.coalesce(best, F.lit(0.0))).alias("s"), g["queries"].alias("q"))

    said = F.filter(F.split(normal_query(F.concat_ws(" ", F.coalesce(m["description"], F.lit("")), F.coalesce(m["role"], F.lit("")))), " "), lambda w: w != "")
    out = df.withColumns({"_id": F.coalesce(m["moment_id"], F.lit("")), "_role": F.coalesce(m["role"], F.lit("")), "_said": said, "_asked": F.trim(F.coalesce(query, F.lit("")))})
    open_ = F.filter(groups, lambda g: (c("_id") == "") | (F.size(g["linked_moment_ids"]) == 0) | linked(g) | by_role(g))
    out = out.withColumn("_scored", F.transform(open_, scored)).withColumn("_top", F.array_max(F.transform("_scored", lambda x: x["s"])))
    out = out.withColumn("_queries", F.coalesce(F.get(F.filter("_scored", lambda x: x["s"] == c("_top")), F.lit(0))["q"], F.array().cast(f"array<{QUERY}>")))
    of = lambda *kinds: F.transform(F.filter("_queries", lambda q: q["kind"].isin(*kinds) & (F.trim(q["text"]) != "")), lambda q: F.trim(q["text"]))
    out = out.withColumns({"_cue": F.coalesce(F.get(of("event_relation"), F.lit(0)), c("_asked")), "_things": of("object", "attribute_object")})
    objects = F.when(F.size("_things") > 0, c("_things")).when((c("_asked") != "") & (c("_asked") != c("_cue")), F.array("_asked")).otherwise(none)
    out = out.withColumn("_package", F.struct(
        c("_cue").alias("event_cue"), F.slice(objects, 1, MOST_OBJECTS).alias("key_objects"), scene.cast("string").alias("scene_context"), hypothesis_for(c("_role")).alias("hypothesis"), none.alias("negative_constraints"),
        F.coalesce(F.nullif(source, F.lit("")), F.lit("role_fallback")).alias("rewrite_reason"),
    ))
    out = out.withColumn(name, normal_package(c("_package"), c("_cue"), scene.cast("string")))
    return out.drop("_id", "_role", "_said", "_asked", "_scored", "_top", "_queries", "_cue", "_things", "_package")
