"""Free-form values (VARIANT): one canonical text for all spellings of a value, its content key, and its leaves by path.

Objects and lists are walked by expressions, one level inside another, so a value never leaves the JVM and nothing is
shuffled. ``DEPTH`` bounds the expression; a value that is nested deeper is an error, never another value's key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 8
LEAVES = "array<struct<path:string,value:string>>"
#: Keys that start so are private: they take no part in a value's content.
PRIVATE = "_"


def _kind(v: Column) -> Column:
    """``object``, ``list`` or ``leaf``."""
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT<"), "object").when(kind.startswith("ARRAY<"), "list").otherwise("leaf")


def _by_name(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def _members(v: Column) -> Column:
    """Public members of an object (by name) or list (by place) as ``key, value``; null for a leaf."""
    members = F.array_sort(F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~e["key"].startswith(PRIVATE)), _by_name)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    return F.coalesce(members, items)


def canonical(v: Column, depth: int = DEPTH) -> Column:
    """JSON with sorted keys, no spaces, and without private keys at any depth; null for a null column."""
    kind = _kind(v)
    leaf = F.to_json(v)
    if not depth:
        return F.when(kind == "leaf", leaf).otherwise(F.raise_error(F.lit("a value is nested too deep for a canonical form")).cast("string"))

    def member(e: Column) -> Column:
        name = F.when(kind == "object", F.concat(F.substr(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"))).otherwise("")
        return F.concat(name, F.coalesce(canonical(e["value"], depth - 1), F.lit("null")))

    inside = F.array_join(F.transform(_members(v), member), ",")
    return F.when(kind == "object", F.concat(F.lit("{"), inside, F.lit("}"))).when(kind == "list", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(leaf)


def content_key(v: Column, depth: int = DEPTH) -> Column:
    """The hash of a value's canonical form, in 64 hex digits."""
    return F.sha2(canonical(v, depth).cast("binary"), 256)


def leaves(v: Column, depth: int = DEPTH, prefix: Column | None = None) -> Column:
    """``path, value`` of all public leaves: names and places joined by dots, values as text (strings without quotes). Empty objects and lists have none."""
    prefix = F.lit("") if prefix is None else prefix
    here = F.array(F.struct(prefix.alias("path"), F.try_variant_get(v, "$", "string").alias("value")))
    if not depth:
        return F.when(_kind(v) == "leaf", here).otherwise(F.raise_error(F.lit("a value is nested too deep for its leaves")).cast(LEAVES))
    below = F.flatten(F.transform(_members(v), lambda e: leaves(e["value"], depth - 1, F.when(prefix == "", e["key"]).otherwise(F.concat(prefix, F.lit("."), e["key"])))))
    return F.when(_kind(v) == "leaf", here).otherwise(below)
