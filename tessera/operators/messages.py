"""Nested chat messages: flattening, image references, follow-ups and replayable plans, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REF = "struct<video_path:string,sampled_frame_index:int,raw_frame_index:int,timestamp_sec:double>"
ITEM = f"struct<type:string,text:string,image:binary,image_ref:{REF}>"
MESSAGES = f"array<struct<role:string,name:string,content:array<{ITEM}>>>"

# What a tool's observation asks for next.
FOLLOW_UPS = {"scan_timeline": "Choose where to look closer.", "seek_evidence": "Judge whether the evidence suffices.", "emit_alert": "Verify the alert.", "verify_hypothesis": "Finalize, or keep searching.", "finalize_case": "Give the answer."}
ACTIONS = {"continue_search": "Search for the missing evidence.", "refine_evidence": "Drop what is redundant.", "revise_claim": "Revise the claim.", "finalize": "Finalize the case."}


def flat_text(messages: Column) -> Column:
    """``role: text`` lines of all messages, in order."""
    line = lambda m: F.concat(m["role"], F.lit(": "), F.array_join(F.transform(F.filter(m["content"], lambda c: c["type"] == "text"), lambda c: c["text"]), " "))
    return F.array_join(F.transform(messages, line), "\n")


def as_references(messages: Column) -> Column:
    """Pixels leave; references stay. An image without a reference becomes an empty one."""
    item = lambda c: F.when(c["type"] == "image", c.withField("image", F.lit(None).cast("binary")).withField("image_ref", F.coalesce(c["image_ref"], F.lit(None).cast(REF)))).otherwise(c)
    return F.transform(messages, lambda m: m.withField("content", F.transform(m["content"], item)))


def follow_up(content: Column, tool: Column, action: Column) -> Column:
    """The content and one more text: the recommended action's, else the tool's; none for other tools."""
    text = F.lit(None).cast("string")
    for name, t in FOLLOW_UPS.items():
        text = F.when(tool == name, F.lit(t)).otherwise(text)
    for name, t in ACTIONS.items():
        text = F.when((tool == "verify_hypothesis") & (action == name), F.lit(t)).otherwise(text)
    more = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("binary").alias("image"), F.lit(None).cast(REF).alias("image_ref"))
    return F.when(text.isNull(), content).otherwise(F.concat(content, F.array(more)))


def visual_content(indices: Column, fps: Column, frames: Column, n_frames: Column, video: Column, footer: Column) -> Column:
    """Frames as content: each one's time as text, then its image by reference, and ``footer`` last.

    ``indices`` are places in the sampled frames, of which ``frames`` holds the numbers in the video (it may be shorter) and
    ``n_frames`` counts those that are there: others show their time alone.
    """
    at = lambda i: F.round(i / F.greatest(F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(1.0)), F.lit(1e-6)), 6)
    none, blank = F.lit(None).cast("string"), F.lit(None).cast("binary")
    item = lambda kind, text, ref: F.struct(F.lit(kind).alias("type"), text.alias("text"), blank.alias("image"), ref.alias("image_ref"))
    no_ref = F.lit(None).cast(REF)

    def one(i: Column) -> Column:
        ref = F.struct(video.alias("video_path"), i.cast("int").alias("sampled_frame_index"), F.when(i >= 0, F.get(frames, i)).cast("int").alias("raw_frame_index"), at(i).alias("timestamp_sec"))
        time = item("text", F.format_string("%.3fs", F.bround(at(i), 3)), no_ref)
        return F.when((i >= 0) & (i < n_frames), F.array(time, item("image", none, ref.cast(REF)))).otherwise(F.array(time))

    return F.concat(F.flatten(F.transform(F.coalesce(indices, F.array().cast("array<int>")), one)), F.array(item("text", footer, no_ref)))


def initial_messages(system: Column, user: Column, preview: Column, fps: Column, frames: Column, n_frames: Column, video: Column) -> Column:
    """An episode's first two messages: the system's text, and the previewed frames (none for null) with the user's text behind them."""
    no_name = F.lit(None).cast("string")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), no_name.alias("name"), content.alias("content"))
    no_frames = F.array().cast("array<int>")
    return F.array(message("system", visual_content(no_frames, fps, frames, n_frames, video, system)), message("user", visual_content(F.coalesce(preview, no_frames), fps, frames, n_frames, video, user)))


def compact(payload: Column) -> Column:
    """A struct as JSON without null fields."""
    return F.to_json(payload, {"ignoreNullFields": "true"})


def plan(messages: Column, kept: Column) -> Column:
    """Places of the messages that a pruned copy kept: each kept one is matched to the first equal one after the last match."""
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("all"))
    places = F.sequence(F.lit(0), F.greatest(F.size(messages) - 1, F.lit(0)))

    def step(acc: Column, m: Column) -> Column:
        at = F.get(F.filter(places, lambda i: (i > acc["at"]) & (F.get(messages, i) == m)), 0)
        return F.struct(F.coalesce(at, acc["at"]).alias("at"), F.when(at.isNull(), acc["all"]).otherwise(F.array_append(acc["all"], at)).alias("all"))

    return F.aggregate(kept, start, step)["all"]


def apply_plan(messages: Column, places: Column) -> Column:
    return F.transform(F.filter(places, lambda i: i < F.size(messages)), lambda i: F.get(messages, i))


def signature(payload: Column) -> Column:
    """A content key of a struct; fields whose names start with an underscore should be left out by the caller."""
    return F.sha2(F.to_json(payload).cast("binary"), 256)


def example_errors(place: Column, messages: Column, target: Column) -> Column:
    """What is wrong with a training example (``MESSAGES`` and its target), each with its place: ``example[3]: message[0].content[2] ...``."""
    prefix = F.concat(F.lit("example["), place.cast("string"), F.lit("]: "))
    none = F.array().cast("array<string>")
    at = lambda j, k: F.concat(prefix, F.lit("message["), j.cast("string"), F.lit("].content["), k.cast("string"), F.lit("]: "))

    def item(c: Column, j: Column, k: Column) -> Column:
        ref = c["image_ref"]
        lost = ref["sampled_frame_index"].isNull() & ref["raw_frame_index"].isNull() & ref["timestamp_sec"].isNull()
        of_ref = F.array(
            F.when(F.trim(F.coalesce(ref["video_path"], F.lit(""))) == "", F.concat(at(j, k), F.lit("image_ref.video_path is missing"))),
            F.when(lost, F.concat(at(j, k), F.lit("image_ref needs sampled_frame_index, raw_frame_index, or timestamp_sec"))),
        )
        bare = F.array(F.when(c["image"].isNull(), F.concat(at(j, k), F.lit("image item is missing both image and image_ref"))))
        return F.when(c["type"] == "image", F.when(ref.isNotNull(), of_ref).otherwise(bare)).otherwise(none)

    def message(m: Column, j: Column) -> Column:
        items = F.flatten(F.transform(m["content"], lambda c, k: item(c, j, k)))
        return F.when(m["content"].isNull(), F.array(F.concat(prefix, F.lit("message["), j.cast("string"), F.lit("] content is not a list")))).otherwise(items)

    blank = F.when(F.trim(F.coalesce(target, F.lit(""))) == "", F.concat(prefix, F.lit("missing non-empty target_response")))
    found = F.concat(F.array(blank), F.flatten(F.transform(messages, message)))
    whole = F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.array(F.concat(prefix, F.lit("missing non-empty messages list")))).otherwise(found)
    return F.filter(whole, lambda e: e.isNotNull())


def image_counts(messages: Column) -> Column:
    """``refs`` and ``inline`` images of an example."""
    items = F.filter(F.flatten(F.transform(F.filter(messages, lambda m: m["content"].isNotNull()), lambda m: m["content"])), lambda c: c["type"] == "image")
    refs = F.filter(items, lambda c: c["image_ref"].isNotNull())
    inline = F.filter(items, lambda c: c["image_ref"].isNull() & c["image"].isNotNull())
    return F.struct(F.greatest(F.size(refs), F.lit(0)).alias("refs"), F.greatest(F.size(inline), F.lit(0)).alias("inline"))
