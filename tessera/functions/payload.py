"""Payloads of tool calls and answers, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import seconds

# Alert types and the decisions they stand for.
ALERT_TYPES = {"soft": "soft_alert", "hard": "hard_alert", "normal": "declare_normal"}

def inside(block: Column) -> Column:
    """The text between a block's tags."""
    return F.trim(F.regexp_extract(block, r"(?s)^<(?:tool_call|answer)>(.*)</(?:tool_call|answer)>$", 1))


def repaired(text: Column) -> Column:
    """``{name: {...}}`` with an unquoted name gets its quotes."""
    return F.regexp_replace(text, r"^\{\s*([A-Za-z_]\w*)\s*:", r'{"$1":')


def tool_name(text: Column) -> Column:
    """From ``{"name": ..., "arguments": ...}``, or the only key of a map; null if it doesn't parse."""
    t = repaired(text)
    keys = F.json_object_keys(F.when(F.try_parse_json(t).isNotNull(), t))
    named = F.get_json_object(t, "$.name")
    return F.coalesce(named, F.when(F.size(keys) == 1, F.get(keys, 0)))


def arguments(text: Column) -> Column:
    """The arguments as JSON text: those of the named form, or the value of a map's only key."""
    t = repaired(text)
    only = F.call_function("get_json_object", t, F.concat(F.lit("$."), tool_name(text)))
    return F.coalesce(F.get_json_object(t, "$.arguments"), only)


def outer_object(text: Column) -> Column:
    """The text from the first brace to the last one, fences and chatter left out."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def is_object(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), F.lit(False))


def normal_arguments(tool: Column, args: Column) -> Column:
    """A call's arguments under their present names: times in seconds, and of an alert its decision, existence and reason.

    ``start_time`` and ``end_time`` stand in for ``start_sec`` and ``end_sec``; an alert's type tells its decision, and its
    decision what exists, where the call doesn't.
    """
    get = lambda k: F.get_json_object(args, f"$.{k}")
    keys = F.coalesce(F.json_object_keys(args), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    time = lambda now, then: seconds(F.when(has(now), get(now)).otherwise(get(then)))
    alert = tool == "emit_alert"
    kind = F.lower(F.trim(F.coalesce(get("alert_type"), F.lit(""))))
    told = kind
    for k, v in ALERT_TYPES.items():
        told = F.when(kind == k, v).otherwise(told)
    decision = F.when(alert & ~has("decision") & (kind != ""), told).otherwise(get("decision"))
    said = F.lower(F.trim(decision))
    implied = F.when(said.isin("soft_alert", "hard_alert"), "anomaly").when(said == "declare_normal", "normal")
    return F.struct(
        time("start_sec", "start_time").alias("start_sec"), time("end_sec", "end_time").alias("end_sec"), seconds(get("alert_sec")).alias("alert_sec"), seconds(get("earliest_alert_sec")).alias("earliest_alert_sec"),
        decision.alias("decision"), F.when(alert & ~has("existence"), implied).otherwise(get("existence")).alias("existence"), F.when(alert & ~has("reason"), get("description")).otherwise(get("reason")).alias("reason"),
    )
