"""Oracle trajectories: the steps a well-behaved agent would take on an annotated clip, and training examples from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLIP = "video_id string, duration_sec double, anomaly array<double>, precursor array<double>, moments array<struct<role:string,start:double,end:double>>"
STEP = "video_id string, step_index long, tool_name string, start_sec double, end_sec double, note string"

# The order of evidence roles, and how much of a span each spare window takes.
ROLES = {"precursor": 0, "trigger": 1, "peak_action": 2, "peak": 2, "confirmation": 3, "aftermath": 4}
INNER, TAIL, CONTEXT, LEAST = (0.15, 0.55), 0.35, 0.15, 0.5


def scan_stride(duration: float) -> float:
    return max(round(duration / 8, 6) or LEAST, LEAST)


def spare_windows(duration: float, anomaly: list[float], precursor: list[float] | None, used: set[tuple[float, float]], count: int) -> list[tuple[float, float]]:
    """Up to ``count`` windows that are not in use yet, in a fixed order of preference, inside the clip."""
    s, e = anomaly
    span = e - s
    pad = max(CONTEXT * span, LEAST)
    wanted = [tuple(precursor)] if precursor else []
    wanted += [(s + INNER[0] * span, s + INNER[1] * span), (e - max(TAIL * span, LEAST), e), (s - pad, e + pad), (s, e)]
    out: list[tuple[float, float]] = []
    for a, b in wanted:
        w = (round(max(a, 0.0), 6), round(min(b, duration), 6))
        if w[1] > w[0] and w not in used and w not in out:
            out.append(w)
    return out[:count]


def steps(duration: float, anomaly: list[float] | None, precursor: list[float] | None, moments: list[dict]) -> Iterator[tuple[str, float, float, str]]:
    """Tool, window and note of each step."""
    yield "scan_timeline", 0.0, duration, f"stride {scan_stride(duration):g}"
    if not anomaly:
        for i in range(3):
            yield "seek_evidence", round(duration * i / 3, 6), round(duration * (i + 1) / 3, 6), "segment"
        yield "verify_hypothesis", 0.0, duration, "final complete"
        yield "finalize_case", 0.0, duration, "normal"
        return
    order = sorted(moments, key=lambda m: (ROLES.get(m["role"], 5), m["start"], m["end"]))
    real = [(float(m["start"]), float(m["end"])) for m in order]
    used: set[tuple[float, float]] = set(real)

    def spare(n: int) -> list[tuple[float, float]]:
        got = spare_windows(duration, anomaly, precursor, used, n)
        used.update(got)
        return got

    first = real[:1] or spare(1)
    for w in first:
        yield "seek_evidence", *w, "first"
    yield "emit_alert", anomaly[0], anomaly[1], "soft"
    if len(real) > 1:
        yield "verify_hypothesis", *first[0], "soft misaligned"
    more = real[1:3]
    for w in more + spare(2 - len(more)):
        yield "seek_evidence", *w, "more"
    if real:
        yield "verify_hypothesis", *real[0], "full_keep_drop incomplete"
    for w in real[3:4] or spare(1):
        yield "seek_evidence", *w, "last"
    if len(real) >= 3 and spare(1):
        yield "verify_hypothesis", *real[0], "full_keep_drop redundant"
    yield "emit_alert", anomaly[0], anomaly[1], "hard"
    yield "verify_hypothesis", anomaly[0], anomaly[1], "hard complete"
    yield "finalize_case", anomaly[0], anomaly[1], "anomaly"


def trajectories(clips: DataFrame) -> DataFrame:
    """One row for each step of each clip. Clips are small and independent, so rows fan out where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                (c.video_id, i, *s)
                for c in b.itertuples(index=False)
                for i, s in enumerate(steps(c.duration_sec, None if c.anomaly is None else list(c.anomaly), None if c.precursor is None else list(c.precursor), [] if c.moments is None else list(c.moments)), 1)
            ]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in STEP.split(", ")])

    return clips.mapInPandas(run, STEP)


def examples(rows: DataFrame) -> DataFrame:
    """Each step as an example of weight one over its clip's steps, with the responses before it as history.

    History is built at the sink only, from a window over a clip's few steps.
    """
    own = Window.partitionBy("video_id")
    said = F.concat(F.lit("<think>"), "note", F.lit("</think><tool_call>"), F.to_json(F.struct(F.col("tool_name").alias("name"), F.struct("start_sec", "end_sec").alias("arguments"))), F.lit("</tool_call>"))
    r = rows.withColumn("target_response", said)
    past = F.collect_list("target_response").over(own.orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1))
    return r.withColumn("history", past).withColumn("sample_weight", 1 / F.count(F.lit(1)).over(own)).select("video_id", "step_index", "tool_name", "target_response", "history", "sample_weight")
