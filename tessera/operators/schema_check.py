"""A subset of JSON Schema, as errors for each row. Schemas are small; texts are checked in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {
    "null": lambda v: v is None, "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
}


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What a value lacks: type, enum, oneOf, required, item counts, and the same inside properties and items."""
    out = []
    if "oneOf" in schema and sum(not problems(value, s, at) for s in schema["oneOf"]) != 1:
        out.append(f"{at}: not exactly one form fits")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(KINDS[k](value) for k in kinds):
        return [*out, f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of {schema['enum']}")
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, s in schema.get("properties", {}).items():
            if k in value:
                out += problems(value[k], s, f"{at}.{k}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: fewer than {schema['minItems']} items")
        if len(value) > schema.get("maxItems", len(value)):
            out.append(f"{at}: more than {schema['maxItems']} items")
        if "items" in schema:
            for i, x in enumerate(value):
                out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def schema_errors(text: Column, schema: dict) -> Column:
    """An array of errors for each JSON text; a text that isn't JSON has one."""
    held = json.dumps(schema)

    @F.pandas_udf("array<string>")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = json.loads(held)
        for texts in batches:
            out = []
            for t in texts:
                try:
                    out.append(problems(json.loads(t), s))
                except (TypeError, ValueError):
                    out.append(["$: not JSON"])
            yield pd.Series(out)

    return check(text)
