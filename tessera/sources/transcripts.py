"""Chat transcripts as Markdown."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fields that may wrap a message, and roles with a heading.
WRAPPERS = ("message", "payload", "item", "data", "event")
ROLES = ("user", "assistant", "system", "tool")


def flat_text(content: object) -> str:
    """All text inside nested content, in order."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(t for t in map(flat_text, content) if t)
    if isinstance(content, dict):
        for key in ("text", "content", "parts", "output"):
            if key in content:
                return flat_text(content[key])
    return ""


def message(record: object) -> tuple[str, str] | None:
    """Role and text of a record, or of the first wrapper in it that has them."""
    if not isinstance(record, dict):
        return None
    for layer in (record, *[record[w] for w in WRAPPERS if isinstance(record.get(w), dict)]):
        if layer.get("role") in ROLES and (text := flat_text(layer.get("content")).strip()):
            return layer["role"], text
    return None


def to_markdown(lines: DataFrame) -> DataFrame:
    """``line_number, markdown`` for each line (``line_number, line``) that holds a message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, line in zip(b["line_number"], b["line"], strict=True):
                try:
                    m = message(json.loads(line))
                except ValueError:
                    m = None
                if m:
                    out.append((n, f"## {m[0].title()}\n\n{m[1]}\n"))
            yield pd.DataFrame(out, columns=["line_number", "markdown"])

    return lines.select("line_number", "line").mapInPandas(run, "line_number long, markdown string")
