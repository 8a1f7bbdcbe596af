"""Oracle trajectories with their arguments: what an agent should have said at each step of an annotated clip, and what its verifier would answer.

Queries and packages are columns. Only the order of steps, where one depends on what the ones before used up, is a small function
on one clip's few moments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query_package import HYPOTHESES, OTHER_HYPOTHESIS, query_for_moment, scene_context, with_package
from .trajectory import ROLES, scan_stride

STEPS = "video_id string, step_index int, tool_name string, arguments string, feedback string"
# What is searched for by role, in broader stretches, and in the parts of a normal clip.
ROLE_QUERIES = {
    "precursor": "look for early cues, suspicious lead-up, or precursor evidence before a possible anomaly",
    "trigger": "look for the decisive trigger event or first clearly actionable moment",
    "peak_action": "look for the strongest visible anomalous action or interaction",
    "confirmation": "look for confirmation that the suspected anomaly has actually occurred",
}
OTHER_QUERY = "look for evidence relevant to the suspected anomaly"
BROAD_QUERY, FULL_QUERY = "look for broader temporal context around the suspected anomaly", "look for the full temporal context of the suspected anomaly"
SEGMENT_QUERY = "check whether segment {} contains any actionable anomaly evidence or supports a normal conclusion"
SEGMENTS, LEAST = 3, 0.5
# A verifier's answers by stage: mode, decision, action, and scores of sufficiency, necessity, alertability and faithfulness.
ANSWERS = {
    "soft": ("soft_alert_check", "misaligned", "revise_claim", (0.18, 0.24, 0.12, 0.21)), "incomplete": ("full_keep_drop", "insufficient", "continue_search", (0.47, 0.31, 0.34, 0.39)),
    "redundant": ("full_keep_drop", "redundant", "refine_evidence", (0.86, 0.18, 0.62, 0.52)), "hard": ("hard_alert_check", "sufficient", "finalize", (0.92, 0.71, 0.88, 0.82)),
    "normal": ("final_check", "sufficient", "finalize", (0.9, 0.58, 0.0, 0.74)),
}
SCORES = ("sufficiency_score", "necessity_score", "alertability_score", "counterfactual_faithfulness")


def role_query(role: Column) -> Column:
    out = F.lit(OTHER_QUERY)
    for r, text in ROLE_QUERIES.items():
        out = F.when(role == r, text).otherwise(out)
    return out


def _normal(text: str) -> str:
    """``functions.text.normal_query`` of a fixed text."""
    return " ".join(re.sub(r"\b(the|an|a)\b", " ", re.sub(r"[^a-z0-9]+", " ", text.lower())).split())


def _spares() -> dict[str, dict]:
    """Searches that stand in where moments don't suffice, and those of a normal clip's parts, by name; the same for all clips but for the scene."""

    def one(role: str, query: str, source: str) -> dict:
        package = {"event_cue": _normal(query), "key_objects": [], "scene_context": "", "hypothesis": _normal(HYPOTHESES.get(role, OTHER_HYPOTHESIS)), "negative_constraints": [], "rewrite_reason": source}
        return {"role": role, "query": query, "source": source, "package": package}

    by_role = {r: one(r, ROLE_QUERIES[r], "oracle_role_fallback") for r in ("precursor", "peak_action", "confirmation")}
    context = {"broad": one("context", BROAD_QUERY, "oracle_context_broad"), "full": one("context", FULL_QUERY, "oracle_context_full")}
    return by_role | context | {f"segment{i}": one("normal_check", SEGMENT_QUERY.format(i + 1), "oracle_normal_search") for i in range(SEGMENTS)}


SPARES = _spares()


class _Clip:
    """The steps of one clip, as they are taken."""

    def __init__(self, clip: dict) -> None:
        self.clip, self.steps = clip, []
        self.windows = 0
        self.duration = round(float(clip.get("duration") or 0.0), 6)
        self.category = clip.get("category")
        self.real: list[tuple[str, str | None]] = []  # window and moment of each search of a moment

    def look(self, tool: str, **arguments: object) -> str:
        self.windows += 1
        self.steps.append((tool, arguments, None))
        return f"w{self.windows:04d}"

    def seek(self, moment: dict) -> None:
        w = self.look("seek_evidence", query=moment["query"], query_package=moment["package"], start_sec=moment.get("start_sec"), end_sec=moment.get("end_sec"), moment_id=moment.get("moment_id"), role=moment.get("role") or "", query_source=moment["source"])
        self.real.append((w, moment.get("moment_id")))

    def seek_spare(self, name: str, start: float, end: float) -> str:
        s = SPARES[name]
        return self.look("seek_evidence", query=s["query"], query_package={**s["package"], "scene_context": self.clip["scene"]}, start_sec=start, end_sec=end, role=s["role"], query_source=s["source"])

    def alert(self, decision: str) -> None:
        self.steps.append(("emit_alert", {"decision": decision, "existence": "anomaly", "category": self.category, "earliest_alert_sec": self.clip.get("earliest_alert_sec")}, None))

    def verify(self, stage: str, windows: list[str], moments: list[str], claim: dict) -> None:
        mode, decision, action, scores = ANSWERS[stage]
        answer: dict = {"verification_mode": mode, "verification_decision": decision, "recommended_action": action, **dict(zip(SCORES, scores, strict=True))}
        if windows:
            answer["selected_window_ids"] = windows
        if moments:
            answer["selected_evidence_moment_ids"] = moments
        # The answer is merged into the call, which so reports on itself.
        said = {**answer, "claim": {k: v for k, v in claim.items() if v is not None and v != ""}}
        self.steps.append(("verify_hypothesis", said, answer))

    def spare_windows(self) -> Iterator[tuple[str, float, float]]:
        """Stretches around the anomaly by preference, whatever is used."""
        start, end = (self.clip.get("anomaly") or [0.0, self.duration])[:2]
        start, end = float(start or 0.0), float(end or self.duration)
        if end <= start:
            end = max(start + LEAST, self.duration)
        span = max(end - start, LEAST)
        if self.clip.get("precursor"):
            yield "precursor", *self.clip["precursor"][:2]
        yield "peak_action", start + 0.15 * span, start + 0.55 * span
        yield "confirmation", max(start, end - max(0.35 * span, LEAST)), end
        pad = max(0.15 * span, LEAST)
        yield "broad", max(0.0, start - pad), min(self.duration, end + pad)
        yield "full", start, end

    def fill(self, used: set[tuple[float, float]], count: int) -> list[str]:
        """Search up to ``count`` spare windows that aren't used yet."""
        added: list[str] = []
        for name, a, b in self.spare_windows() if count > 0 else ():
            start, end = round(float(a), 6), round(float(b), 6)
            if end <= start:
                end = round(min(self.duration, start + LEAST), 6)
            if (start, end) not in used:
                used.add((start, end))
                added.append(self.seek_spare(name, start, end))
            if len(added) >= count:
                break
        return added

    def anomaly(self) -> None:
        moments = self.clip["moments"]
        used = {(round(float(m["start_sec"]), 6), round(float(m["end_sec"]), 6)) for m in moments if m.get("start_sec") is not None and m.get("end_sec") is not None}
        early = {"existence": "anomaly", "category": self.category}
        claim = {**early, "earliest_alert_sec": self.clip.get("earliest_alert_sec")}
        named = lambda n=None: [str(m) for _, m in self.real[:n] if m is not None]
        seen = lambda n=None: [w for w, _ in self.real[:n]]
        first, rest = moments[:1], moments[1:]
        for m in first:
            self.seek(m)
        self.alert("soft_alert")
        if rest:
            self.verify("soft", seen(1), named(1), early)
        for m in rest[:2]:
            self.seek(m)
        self.fill(used, 2 - len(rest[:2]))
        if named(2):
            self.verify("incomplete", seen(2), named(2), claim)
        for m in rest[2:3]:
            self.seek(m)
        if not rest[2:3]:
            self.fill(used, 1)
        if len(self.real) >= 3 and (more := self.fill(used, 1)):
            self.verify("redundant", seen() + more, named(), claim)
        self.alert("hard_alert")
        self.verify("hard", seen(), named(), claim)

    def normal(self) -> None:
        bounds = [round(self.duration * i / SEGMENTS, 6) for i in range(SEGMENTS)] + [self.duration]
        windows = [self.seek_spare(f"segment{i}", a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
        self.verify("normal", windows, [], {"existence": "normal", "category": "normal"})

    def run(self) -> list[tuple[str, dict, dict | None]]:
        self.look("scan_timeline", start_sec=0.0, end_sec=self.duration, stride_sec=scan_stride(self.duration), purpose="global_overview")
        if self.clip.get("is_anomaly"):
            self.anomaly()
        else:
            self.normal()
        self.steps.append(("finalize_case", self.clip["target"], None))
        return self.steps


def trajectories(views: DataFrame) -> DataFrame:
    """One row for each step of each training view (``views.train_view``; ``video_id`` unique): tool, arguments and verifier's answer as JSON text.

    An anomaly's moments are searched by role, then time, with spare stretches where there are too few; alerts and
    verifications stand between them, and each verification's call holds its answer, as a policy would report it itself. A
    normal clip is searched in three parts.
    """
    c = F.col
    each = views.select("video_id", c("scene.scenario").alias("scene"), "proposal_supervision", F.explode("evidence.evidence_moments").alias("moment"))
    asked = each.withColumn("asked", query_for_moment(c("proposal_supervision"), c("moment"), role_query(F.coalesce(c("moment.role"), F.lit("")))))
    packed = with_package(asked, "proposal_supervision", "moment", c("asked.text"), c("asked.source"), c("scene"))
    rank = F.lit(5)
    for r, n in ROLES.items():
        rank = F.when(F.lower(F.coalesce(c("moment.role"), F.lit(""))) == r, n).otherwise(rank)
    order = F.struct(rank.alias("r"), F.coalesce("moment.start_sec", F.lit(0.0)).alias("s"), F.coalesce("moment.end_sec", F.lit(0.0)).alias("e"), F.coalesce("moment.moment_id", F.lit("")).alias("i"))
    told = F.struct("moment.moment_id", "moment.role", "moment.start_sec", "moment.end_sec", c("asked.text").alias("query"), c("asked.source").alias("source"), "package")
    by_order = F.array_sort(F.collect_list(F.struct(order.alias("o"), told.alias("m"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    moments = packed.groupBy(c("video_id").alias("_video")).agg(F.transform(by_order, lambda x: x["m"]).alias("moments"))
    rows = views.join(moments, c("video_id") == c("_video"), "left")
    clip = F.struct(
        c("video_meta.duration_sec").alias("duration"), c("label.is_anomaly").alias("is_anomaly"), c("label.category").alias("category"), c("temporal.earliest_alert_sec").alias("earliest_alert_sec"), c("temporal.anomaly_interval_sec").alias("anomaly"),
        c("temporal.precursor_interval_sec").alias("precursor"), F.coalesce("moments", F.array()).alias("moments"), scene_context(c("scene.scenario")).alias("scene"), c("structured_target").alias("target"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
        for b in batches:
            out = [(i, n, tool, text(arguments), text(answer)) for i, j in zip(b["video_id"], b["clip"], strict=True) for n, (tool, arguments, answer) in enumerate(_Clip(json.loads(j)).run(), 1)]
            yield pd.DataFrame(out, columns=["video_id", "step_index", "tool_name", "arguments", "feedback"])

    return rows.select("video_id", F.to_json(clip).alias("clip")).mapInPandas(run, STEPS)
