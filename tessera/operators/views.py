"""Views of clip records: times in seconds, the span before the onset, clean moments, and what an agent is trained on.

Records have a declared schema (``RECORD``) and views a version. An upgrade gives records of any age the same columns: what is
whole stays as it is, and what lacks a part is made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.intervals import frame_window
from tessera.functions.numeric import half_even
from tessera.functions.text import category

from .query_package import supervision
from .records import clean_questions, evidence_role

MOMENT = "struct<moment_id:string,role:string,description:string,start_frame:int,end_frame:int>"
RECORD = (
    "video_id string, split string, frame_index_base int, video_meta struct<fps:double,total_frames:int,duration_sec:double>, scene struct<scenario:string>, key_objects array<string>, "
    "label struct<is_anomaly:boolean,category:string,severity:int,hard_normal:boolean>, temporal struct<anomaly_interval_frames:array<int>,precursor_interval_frames:array<int>,earliest_alert_frame:int>, "
    f"evidence struct<evidence_moments:array<{MOMENT}>>, counterfactual struct<type:string,text:string>, language struct<summary:string,rationale:string>, qa_pairs array<struct<type:string,question:string,answer:string>>"
)
#: Version of the views' own layout.
VERSION = "view.v2"
# Tools an agent has, and the least span before an onset in seconds and as a share of the anomaly.
TOOLS = ["scan_timeline", "seek_evidence", "emit_alert", "verify_hypothesis", "finalize_case"]
LEAD_SECONDS, LEAD_SHARE = 2.0, 0.2
TRAIN_PARTS = ("agent_task", "structured_target", "tool_io")


def ordered(frames: Column) -> Column:
    """An interval of frames as two numbers in order; null for none."""
    a, b = F.get(frames, 0), F.get(frames, 1)
    return F.when(a.isNotNull() & b.isNotNull(), F.array(F.least(a, b), F.greatest(a, b)))


def _hull(intervals: Column) -> Column:
    return F.when(F.size(intervals) > 0, F.array(F.array_min(F.transform(intervals, lambda i: F.get(i, 0))), F.array_max(F.transform(intervals, lambda i: F.get(i, 1)))))


def precursor(is_anomaly: Column, anomaly: Column, annotated: Column, moments: Column, base: Column, fps: Column, seconds: float = LEAD_SECONDS, share: float = LEAD_SHARE) -> Column:
    """``frames, source, auto_completed`` of the span before an anomaly: the first of eight outcomes that applies.

    ``anomaly`` and ``annotated`` are ordered intervals of frames or null. A span that doesn't end before the onset is no
    precursor; if one was given, and no moment of that role is strict, none is made up.
    """
    onset = F.get(anomaly, 0)
    strict = lambda i: i.isNotNull() & (onset.isNull() | (F.get(i, 1) < onset))
    spans = F.transform(F.coalesce(moments, F.array().cast(f"array<{MOMENT}>")), lambda m: F.struct((F.coalesce(m["role"], F.lit("")) == "precursor").alias("told"), ordered(F.array(m["start_frame"], m["end_frame"])).alias("i")))
    told = F.transform(F.filter(spans, lambda s: s["told"]), lambda s: s["i"])
    role = _hull(F.filter(told, strict))
    loose = (annotated.isNotNull() & ~strict(annotated)) | F.exists(told, lambda i: ~strict(i))
    event = _hull(F.transform(F.filter(spans, lambda s: onset.isNotNull() & (F.get(s["i"], 1) < onset)), lambda s: s["i"]))
    length = F.get(anomaly, 1) - onset + 1
    lead = F.greatest(half_even(F.lit(seconds) * fps), half_even(F.lit(share) * length)).cast("int")
    start = F.greatest(base, onset - lead)
    guess = F.when(onset - 1 >= start, F.array(start, onset - 1))
    none = F.lit(None).cast("array<int>")

    def out(frames: Column, source: str, made_up: bool) -> Column:
        return F.struct(frames.alias("frames"), F.lit(source).alias("source"), F.lit(made_up).alias("auto_completed"))

    return (
        F.when(~F.coalesce(is_anomaly, F.lit(False)), out(none, "not_applicable_normal", False))
        .when(strict(annotated), out(annotated, "annotation", False))
        .when(role.isNotNull(), out(role, "evidence_precursor_role", False))
        .when(loose, out(none, "non_strict_precursor_dropped", False))
        .when(event.isNotNull(), out(event, "evidence_preceding_event", True))
        .when(onset.isNull(), out(none, "missing_without_anomaly_interval", True))
        .when(guess.isNotNull(), out(guess, "heuristic_preceding_window", True))
        .otherwise(out(none, "heuristic_unavailable", True))
    )


def base_view(df: DataFrame, version: str = VERSION, seconds: float = LEAD_SECONDS, share: float = LEAD_SHARE) -> DataFrame:
    """``RECORD`` rows with what follows from their frames: times, the span before the onset, clean roles, categories and questions, and search queries of key objects."""
    fps, length = F.col("video_meta.fps"), F.col("video_meta.duration_sec")
    base = F.coalesce("frame_index_base", F.lit(0))
    given = F.coalesce("evidence.evidence_moments", F.array().cast(f"array<{MOMENT}>"))
    d = df.withColumn("frame_index_base", base).withColumns({"_anomaly": ordered(F.col("temporal.anomaly_interval_frames")), "_annotated": ordered(F.col("temporal.precursor_interval_frames"))})
    d = d.withColumn("_lead", precursor(F.col("label.is_anomaly"), F.col("_anomaly"), F.col("_annotated"), given, F.col("frame_index_base"), fps, seconds, share))
    window = lambda i: F.when(i.isNotNull(), frame_window(F.get(i, 0), F.get(i, 1), F.col("frame_index_base"), fps, length))
    pair = lambda w: F.when(w.isNotNull(), F.array(w["start"], w["end"]))
    alert = F.col("temporal.earliest_alert_frame")
    alert_sec = F.when(alert.isNotNull(), F.round(F.least(F.greatest((alert - F.col("frame_index_base")) / fps, F.lit(0.0)), length), 6))

    def moment(m: Column) -> Column:
        role = evidence_role(m["role"], m["start_frame"], m["end_frame"], F.get("_anomaly", F.lit(0)))
        w = frame_window(m["start_frame"], m["end_frame"], F.col("frame_index_base"), fps, length)
        name = F.coalesce(m["moment_id"], F.concat_ws("_", role, m["start_frame"].cast("string"), m["end_frame"].cast("string")))
        return F.struct(name.alias("moment_id"), role.alias("role"), m["description"].alias("description"), m["start_frame"].alias("start_frame"), m["end_frame"].alias("end_frame"), w["start"].alias("start_sec"), w["end"].alias("end_sec"))

    existence = F.when(F.coalesce("label.is_anomaly", F.lit(False)), "anomaly").otherwise("normal")
    d = d.withColumn("_moments", F.transform(given, moment))
    lead = pair(window(F.col("_lead.frames")))
    temporal = F.struct(
        F.col("temporal.anomaly_interval_frames").alias("anomaly_interval_frames"), pair(window(F.col("_anomaly"))).alias("anomaly_interval_sec"), F.col("_lead.frames").alias("precursor_interval_frames"), lead.alias("precursor_interval_sec"),
        alert.alias("earliest_alert_frame"), alert_sec.alias("earliest_alert_sec"), F.struct(F.col("_lead.source").alias("source"), F.col("_lead.auto_completed").alias("auto_completed")).alias("precursor_resolution"),
    )
    questions = clean_questions(F.col("qa_pairs"), lead, F.col("_lead.source"))
    d = d.withColumns({
        "_temporal": temporal, "_label": F.col("label").withField("category", category(F.col("label.category"), existence)), "_questions": questions, "schema_version": F.lit(version),
        "proposal_supervision": supervision(F.coalesce("key_objects", F.array().cast("array<string>")), F.col("_moments")),
    })
    new = {"temporal": F.col("_temporal"), "label": F.col("_label"), "evidence": F.struct(F.col("_moments").alias("evidence_moments")), "qa_pairs": F.col("_questions")}
    return d.withColumns(new).drop("_anomaly", "_annotated", "_lead", "_moments", "_temporal", "_label", "_questions")


def train_parts(prompt: Column, final_schema: str = "{}") -> dict[str, Column]:
    """What an agent is trained on, from a base view: its task, the target it should reach, and what its tools start from."""
    label, temporal, moments = F.col("label"), F.col("temporal"), F.col("evidence.evidence_moments")
    existence = F.when(F.coalesce(label["is_anomaly"], F.lit(False)), "anomaly").otherwise("normal")
    seen = F.transform(moments, lambda m: F.struct(m["moment_id"].alias("moment_id"), m["role"].alias("role"), F.array(m["start_sec"], m["end_sec"]).alias("window_sec")))
    target = F.struct(
        existence.alias("existence"), label["category"].alias("category"), label["severity"].alias("severity"), label["hard_normal"].alias("hard_normal"), temporal["anomaly_interval_sec"].alias("anomaly_interval_sec"),
        temporal["precursor_interval_sec"].alias("precursor_interval_sec"), temporal["earliest_alert_sec"].alias("earliest_alert_sec"), F.transform(moments, lambda m: m["moment_id"]).alias("evidence_moment_ids"), seen.alias("evidence_windows_sec"),
        F.coalesce("counterfactual.type", F.lit("none")).alias("counterfactual_type"), F.col("counterfactual.text").alias("counterfactual_text"), F.col("language.summary").alias("summary"), F.col("language.rationale").alias("rationale"),
    )
    base, meta = F.col("frame_index_base"), F.col("video_meta")
    oracle = lambda a, b: F.transform(moments, lambda m: F.struct(m["moment_id"].alias("moment_id"), m["role"].alias("role"), F.array(m[a], m[b]).alias("window"), m["description"].alias("description")))
    tools = F.struct(
        F.array(*[F.lit(t) for t in TOOLS]).alias("allowed_tools"), F.array(base, meta["total_frames"] + base - 1).alias("initial_scan_window_frames"), F.array(F.lit(0.0), F.round(meta["duration_sec"], 6)).alias("initial_scan_window_sec"),
        oracle("start_frame", "end_frame").alias("oracle_windows_frames"), oracle("start_sec", "end_sec").alias("oracle_windows_sec"), F.lit(final_schema).alias("finalize_case_schema"),
    )
    return {"agent_task": F.struct(prompt.alias("task_prompt")), "structured_target": target, "tool_io": tools}


def train_view(df: DataFrame, prompt: Column | None = None, final_schema: str = "{}", **settings) -> DataFrame:
    """The base view and its training parts. ``prompt``: the task in the caller's words, of the base view's columns."""
    told = F.concat(F.lit("Scene: "), F.coalesce("scene.scenario", F.lit("unknown")), F.lit("; seconds: "), F.round("video_meta.duration_sec", 6).cast("string")) if prompt is None else prompt
    return base_view(df, **settings).withColumns(train_parts(told, final_schema))


def upgrade(df: DataFrame, prompt: Column | None = None, final_schema: str = "{}", **settings) -> DataFrame:
    """Records of any age as training views, with ``upgraded``: whether a row had to be made anew.

    A row that has all of ``TRAIN_PARTS`` (columns of a view's types, which may be missing from ``df``) keeps them; one that
    lacks a part gets all of them from its record, as its other parts may rest on another one.
    """
    held = [c for c in TRAIN_PARTS if c in df.columns]
    whole = F.lit(len(held) == len(TRAIN_PARTS))
    for c in held:
        whole = whole & F.col(c).isNotNull()
    kept = df.withColumns({f"_held_{c}": F.col(c) for c in held}).withColumn("_whole", whole).drop(*held)
    made = train_view(kept, prompt, final_schema, **settings)
    for c in held:
        kind = made.schema[c].dataType.simpleString()  # as text, so that fields may be null
        made = made.withColumn(c, F.when(F.col("_whole"), F.col(f"_held_{c}").cast(kind)).otherwise(F.col(c)))
    return made.withColumn("upgraded", ~F.col("_whole")).drop("_whole", *[f"_held_{c}" for c in held])
