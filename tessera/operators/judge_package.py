"""What a second judge gets to see of a verification: four views of the searched windows, why the case is hard, and the images that fit.

Windows are in the order of their search: ``array<WINDOW>``. All expressions on one example's row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "struct<path:string,timestamp_sec:double>"
WINDOW = f"struct<window_id:string,evidence_id:string,moment_id:string,tool_name:string,role:string,query:string,timestamps_sec:array<double>,images:array<{IMAGE}>>"
ITEM = "struct<type:string,text:string,path:string>"
# The views in the order in which they are shown, what may be asked for, and decisions that make a case hard.
VIEWS = ("full", "keep", "drop", "alert_prefix")
MODES, HARD_DECISIONS = ("text_only", "multimodal_visual", "auto"), ("insufficient", "misaligned", "redundant")


def _id(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def resolved_windows(windows: Column, window_ids: Column, evidence_ids: Column, moment_ids: Column) -> Column:
    """Ids of the selected windows: those named that were searched, then those whose evidence or moment is named."""
    none = F.array().cast("array<string>")
    clean = lambda ids: F.filter(F.transform(F.coalesce(ids, none), _id), lambda i: i != "")
    known = F.transform(windows, lambda w: _id(w["window_id"]))
    named = F.filter(clean(window_ids), lambda i: F.array_contains(known, i))
    hit = lambda w, key, ids: (_id(w[key]) != "") & F.array_contains(clean(ids), _id(w[key]))
    more = F.transform(F.filter(windows, lambda w: hit(w, "evidence_id", evidence_ids) | hit(w, "moment_id", moment_ids)), lambda w: _id(w["window_id"]))
    return F.concat(named, F.array_distinct(F.filter(more, lambda i: (i != "") & ~F.array_contains(named, i))))


def views(windows: Column, selected: Column, alert_sec: Column) -> Column:
    """``full``, ``keep`` (selected), ``drop`` (the others), and ``alert_prefix``: the selected ones (else all) with the images up to the alert.

    Without an alert, or an image before it, the prefix is the first of them.
    """
    inside = lambda w: F.array_contains(selected, _id(w["window_id"])) & (_id(w["window_id"]) != "")
    keep, drop = F.filter(windows, inside), F.filter(windows, lambda w: ~inside(w))
    of = F.when(F.size(keep) > 0, keep).otherwise(windows)
    early = lambda w: F.filter(F.coalesce(w["images"], F.array().cast(f"array<{IMAGE}>")), lambda i: i["timestamp_sec"] <= alert_sec + 1e-6)
    cut = F.transform(of, lambda w: w.withField("images", early(w)).withField("timestamps_sec", F.transform(early(w), lambda i: i["timestamp_sec"])))
    shown = F.filter(cut, lambda w: F.size(w["images"]) > 0)
    prefix = F.when(alert_sec.isNotNull() & (F.size(shown) > 0), shown).otherwise(F.slice(of, 1, 1))
    return F.struct(windows.alias("full"), keep.alias("keep"), drop.alias("drop"), prefix.cast(f"array<{WINDOW}>").alias("alert_prefix"))


def spread_images(images: Column, most: int) -> Column:
    """Up to ``most`` images, evenly spread with both ends; the first alone for one. No limit for 0 or less."""
    if most <= 0:
        return images
    if most == 1:
        return F.slice(images, 1, 1)
    n = F.size(images)
    places = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(most - 1)), 0).cast("int"))))
    return F.when(n <= most, images).otherwise(F.transform(places, lambda p: F.get(images, p)))


def view_images(view: Column, most: int) -> Column:
    return spread_images(F.flatten(F.transform(view, lambda w: F.coalesce(w["images"], F.array().cast(f"array<{IMAGE}>")))), most)


def summary(view: Column, empty: Column) -> Column:
    """A line for each window: id, tool, and what is known of role, moment, query and times; ``empty`` for none."""

    def line(w: Column) -> Column:
        part = lambda name, key: F.when(F.coalesce(w[key], F.lit("")) != "", F.concat(F.lit(f" {name}="), w[key])).otherwise("")
        times = F.transform(F.coalesce(w["timestamps_sec"], F.array().cast("array<double>")), lambda t: F.round(t, 3).cast("string"))
        stamps = F.when(F.size(times) > 0, F.concat(F.lit(" timestamps=["), F.array_join(times, ", "), F.lit("]"))).otherwise("")
        return F.concat(F.coalesce(w["window_id"], F.lit("")), F.lit(" "), F.coalesce(w["tool_name"], F.lit("")), part("role", "role"), part("moment_id", "moment_id"), part("query", "query"), stamps)

    return F.when(F.size(view) > 0, F.array_join(F.transform(view, line), "\n")).otherwise(empty)


def case_reasons(decision: Column, action: Column, selected: Column, has_alert: Column) -> Column:
    """Why a case deserves images: a doubtful decision, an action other than finalizing, several windows, an alert."""
    d, a = F.coalesce(decision, F.lit("")), F.coalesce(action, F.lit(""))
    reasons = F.array(
        F.when(d.isin(*HARD_DECISIONS), F.concat(F.lit("verification_decision="), d)), F.when((a != "") & (a != "finalize"), F.concat(F.lit("recommended_action="), a)),
        F.when(F.size(selected) > 1, "multiple_selected_windows"), F.when(F.coalesce(has_alert, F.lit(False)), "alert_present"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def input_mode(wanted: Column, reasons: Column, n_images: Column, default: str = "auto") -> Column:
    """As asked for; what isn't known is ``default``, and ``auto`` takes images for hard cases that have some."""
    w = F.lower(F.trim(F.coalesce(wanted, F.lit(default))))
    w = F.when(w.isin(*MODES), w).otherwise(default)
    return F.when(w != "auto", w).when((F.size(reasons) > 0) & (n_images > 0), "multimodal_visual").otherwise("text_only")


def content(prompt: Column, summaries: dict[str, Column], images: dict[str, Column], mode: Column, most: int = 8) -> Column:
    """The judge's message (``array<ITEM>``): the prompt, and each view's summary and images, which are ``most`` in all.

    Once they are that many, later views aren't shown at all.
    """
    item = lambda kind, text, path: F.struct(F.lit(kind).alias("type"), text.alias("text"), path.alias("path"))
    none = F.lit(None).cast("string")
    said = F.array(*[F.struct(F.lit(v).alias("name"), F.trim(summaries[v]).alias("text"), F.when(mode == "multimodal_visual", images[v]).otherwise(F.array().cast(f"array<{IMAGE}>")).alias("images")) for v in VIEWS])

    def show(s: Column, v: Column) -> Column:
        shown = F.slice(v["images"], 1, F.greatest(F.lit(most) - s["n"], F.lit(0)))
        time = lambda i: F.when(i["timestamp_sec"].isNotNull(), F.array(item("text", F.concat(v["name"], F.format_string(" frame timestamp: %.3fs", i["timestamp_sec"])), none))).otherwise(F.array().cast(f"array<{ITEM}>"))
        pictures = F.flatten(F.transform(shown, lambda i: F.concat(time(i), F.array(item("image", none, i["path"])))))
        text = F.when(v["text"] != "", F.array(item("text", F.concat(v["name"], F.lit(" summary:\n"), v["text"]), none))).otherwise(F.array().cast(f"array<{ITEM}>"))
        n = s["n"] + F.size(shown)
        return F.when(s["done"], s).otherwise(F.struct(F.concat(s["items"], text, pictures).alias("items"), n.alias("n"), (n >= most).alias("done")))

    start = F.struct(F.array(item("text", prompt, none)).cast(f"array<{ITEM}>").alias("items"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(said, start, show)["items"]
