"""Text expressions: normal forms, tokens, categories, tagged blocks, literals of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Words that carry no meaning in a query.
STOPWORDS = ["a", "an", "the", "and", "or", "of", "to", "in", "on", "at", "by", "for", "with", "before", "after", "near", "another", "other", "potential", "look"]

# Category labels and their other names.
CATEGORIES = ["assault", "robbery", "shooting", "fire", "explosion", "fighting", "people_falling", "traffic_accident", "object_falling", "vandalism", "water_incident"]
ALIASES = {
    "vehicle_collision": "traffic_accident", "vehicle_crash": "traffic_accident", "vehicle_accident": "traffic_accident", "collision": "traffic_accident", "car_crash": "traffic_accident", "traffic_collision": "traffic_accident",
    "physical_altercation": "fighting", "violent_confrontation": "fighting", "brawl": "fighting",
    "fall": "people_falling", "falling": "people_falling", "falling_or_tripping": "people_falling", "slip_and_fall": "people_falling",
    "person_with_weapon": "shooting", "gun_violence": "shooting", "armed_shooting": "shooting",
    "theft": "robbery", "bag_snatch": "robbery", "bag_theft": "robbery", "stealing": "robbery",
}
# Fixed values in order of precedence: a label holds if one of the parts is in the text; objects fall only if the text also says so.
SUBSTRINGS = [
    (("traffic", "collision", "crash", "vehicle_accident"), "traffic_accident"),
    (("rob", "snatch", "steal", "theft"), "robbery"),
    (("shoot", "gun", "weapon", "firearm"), "shooting"),
    (("vandal", "graffiti", "property_damage"), "vandalism"),
    (("fall", "drop"), "object_falling"),
    (("trip", "slip"), "people_falling"),
    (("fall",), "people_falling"),
    (("fight", "altercation", "brawl", "confrontation"), "fighting"),
    (("assault", "attack", "attacked", "punch", "kick", "beating"), "assault"),
    (("water", "drown", "drowning"), "water_incident"),
    (("explosion", "blast", "explode"), "explosion"),
    (("fire", "flame", "smoke"), "fire"),
]
COMBINED = "fire_or_explosion"


def normal_query(c: Column) -> Column:
    """Lower case, with a space for each run of marks, white space and articles."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(the|an|a)\b", " "), " +", " "))


def tokens(normal: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct words of a normal query, in order, without stopwords."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: (w != "") & ~w.isin(stopwords)))


def clean_category(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s/-]+", "_")
    return F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", "")


def category(c: Column, existence: Column | None = None) -> Column:
    """Normal, then exact names, aliases, and the substrings in order; else the cleaned text. Where ``existence`` says normal, normal."""
    t = clean_category(c)
    out = F.when(says(existence, "normal"), "normal") if existence is not None else F.when(t == "normal", "normal")
    out = out.when(t.isin("normal", *CATEGORIES), t)
    for name, label in ALIASES.items():
        out = out.when(t == name, F.lit(label))
    for parts, label in SUBSTRINGS:
        hit = t.rlike("|".join(parts))
        if label == "object_falling":
            hit = hit & t.contains("object")
        elif parts == ("fall",):
            hit = hit & ~t.contains("object")
        out = out.when(hit & (t != COMBINED) if label in ("explosion", "fire") else hit, F.lit(label))
    return out.otherwise(t)


def says(c: Column, word: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == word, F.lit(False))


def claim_error(existence: Column, label: Column, required: bool = False) -> Column:
    """What is wrong with a claim's canonical category (null: not given), or null.

    ``required``: a claim of an anomaly must name one.
    """
    blank = F.trim(F.coalesce(label, F.lit(""))) == ""
    anomaly = says(existence, "anomaly")
    return (
        F.when(blank, F.when(anomaly, "missing_category") if required else F.lit(None).cast("string")).when(~label.isin("normal", *CATEGORIES), "unknown_category")
        .when(says(existence, "normal") & (label != "normal"), "category_of_normal").when(anomaly & (label == "normal"), "normal_category_of_anomaly")
    )


def clip_text(c: Column, limit: int = 160) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def last_block(c: Column) -> Column:
    """The last tagged block outside the think section; without one, the last block anywhere; else empty."""
    block = r"(?s)<tool_call>.*?</tool_call>|<answer>.*?</answer>"
    outside = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    found = F.regexp_extract_all(outside, F.lit(block), 0)
    any_ = F.regexp_extract_all(c, F.lit(block), 0)
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.try_element_at(any_, F.lit(-1)), F.lit(""))


def first_block(c: Column) -> Column:
    """The text up to the end of its first tagged block; all of it without one."""
    cut = F.regexp_extract(c, r"(?s)^.*?(?:</tool_call>|</answer>)", 0)
    return F.when(cut == "", c).otherwise(cut)


def first_structured_block(c: Column) -> Column:
    """The first tagged block of the trimmed text, behind the thoughts if they come before it; all of it without one. What else was said is dropped."""
    t = F.trim(c, F.lit(" \t\n\x0b\x0c\r"))
    block = F.regexp_extract(t, r"(?s)<tool_call>.*?</tool_call>|<answer>.*?</answer>", 0)
    think = F.regexp_extract(t, r"(?s)<think>.*?</think>", 0)
    before = (think != "") & (F.instr(t, think) <= F.instr(t, block))
    return F.when(block == "", t).otherwise(F.concat(F.when(before, think).otherwise(""), block))


def is_timestamp(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^[0-9]+(\.[0-9]+)?s$"), F.lit(False))


def seconds(c: Column) -> Column:
    """``12.5``, ``12.5s``, ``mm:ss`` or ``hh:mm:ss`` as seconds; else null."""
    t = F.regexp_replace(F.trim(c), "s$", "")
    ok = t.rlike(r"^[0-9]+(\.[0-9]+)?(:[0-9]+(\.[0-9]+)?){0,2}$")
    folded = F.aggregate(F.split(t, ":"), F.lit(0.0), lambda n, p: n * 60 + F.coalesce(p.try_cast("double"), F.lit(0.0)))
    return F.when(ok, folded)


def case_id(c: Column) -> Column:
    return F.concat(F.lit("case_"), F.substring(F.sha1(c.cast("binary")), 1, 10))


def padded_id(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 4, "0"))


def entry_path(key: Column) -> Column:
    """Where an entry of a content-addressed store lies."""
    return F.concat(F.lit("entries/"), F.substring(key, 1, 2), F.lit("/"), key, F.lit(".pt"))


# Clothes, places, and what tells an event (any of the words, and the query for it).
CLOTHING_TERMS = ["shirt", "jacket", "coat", "hoodie", "vest", "uniform", "pants", "dress", "hat", "helmet"]
SCENE_TERMS = ["intersection", "shop", "store", "sidewalk", "road", "street", "restaurant", "terrace", "parking", "driveway", "workbench", "site"]
EVENTS = [
    (("attack", "attacked", "assault", "hit", "kick", "punch", "lunge", "fight", "altercation"), "physical struggle", 0.9),
    (("snatch", "rob", "robbery", "steal", "grab bag"), "bag snatch", 0.8),
    (("fall", "falls", "falling", "fell", "trip", "stumble"), "person falling", 0.8),
    (("ground", "lying", "fallen"), "person on ground", 0.9),
    (("fire", "flame", "flames"), "fire", 0.8),
    (("smoke",), "smoke", 0.8),
]


def query_kind(normal: Column) -> Column:
    """Of a normal query: a scene's word, then a part that is clothing, then a part that tells an event; else an object."""
    places = F.array(*[F.lit(t) for t in SCENE_TERMS])
    return let(tokens(normal), lambda known: (
        F.when(F.size(known) == 0, "object").when(F.arrays_overlap(known, places), "scene_context")
        .when(normal.rlike("|".join(CLOTHING_TERMS)), "attribute_object").when(normal.rlike("|".join(w for words, _, _ in EVENTS for w in words)), "event_relation").otherwise("object")
    ))
