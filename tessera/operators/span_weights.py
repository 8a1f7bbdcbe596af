"""Weights of a response's characters by what they are: thought, tags, keys, values, punctuation."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights by kind of character.
WEIGHTS = {"punctuation": 0.2, "key": 0.8, "value": 1.15, "critical": 1.35, "think": 0.35, "tag": 0.15, "focus": 2.5, "other": 1.0}
CRITICAL = ("existence", "category", "decision", "severity")

_TAG = re.compile(r"</?(?:think|tool_call|answer)>")
_BODY = re.compile(r"<(think|tool_call|answer)>(.*?)(?:</\1>|$)", re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?')
_PLAIN = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def char_weights(text: str, focus: Sequence[str] = ()) -> list[float]:
    w = np.full(len(text), WEIGHTS["other"])
    for body in _BODY.finditer(text):
        s, e = body.span(2)
        if body[1] == "think":
            w[s:e] = WEIGHTS["think"]
            continue
        w[s:e] = WEIGHTS["punctuation"]
        key, at = "", s
        while at < e:
            if m := _STRING.match(text, at, e):
                if m[1]:
                    key = m[0][1 : m[0].rindex('"')]
                    w[at : m.start(1)] = WEIGHTS["key"]
                else:
                    w[at : m.end()] = WEIGHTS["critical" if key in CRITICAL else "value"]
                at = m.end()
            elif m := _PLAIN.match(text, at, e):
                w[at : m.end()] = WEIGHTS["critical" if key in CRITICAL else "value"]
                at = m.end()
            else:
                at += 1
    for t in _TAG.finditer(text):
        w[t.start() : t.end()] = WEIGHTS["tag"]
    for term in focus:
        for m in re.finditer(re.escape(term), text) if term else ():
            w[m.start() : m.end()] = WEIGHTS["focus"]
    return w.tolist()


def response_weights(text: Column, focus: Sequence[str] = ()) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([char_weights(t or "", focus) for t in texts])

    return of(text)
