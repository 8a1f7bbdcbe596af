"""Chat formatting: typed content parts become one marked-up string, with placeholders for what is not text.

A visitor, one branch for each part type, turns parts into text in order. It records a reference for each
attachment and the tokens its placeholder expands to. Control strings inside texts are escaped and come
back unchanged; the loss mask is a list of spans of the output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens a placeholder expands to: a fixed count, or so many for each unit of the part's ``size``.
EXPANSION: dict[str, Callable[[Column], Column]] = {
    "image": lambda size: F.coalesce(F.ceil(size / 196), F.lit(256)),
    "audio": lambda size: F.coalesce(F.ceil(size * 25), F.lit(1)),
    "document": lambda size: F.coalesce(F.ceil(size * 512), F.lit(512)),
}
PARTS = "array<struct<type:string,text:string,uri:string,size:double>>"


def escape(c: Column) -> Column:
    """No ``<|`` is left, and ``unescape`` gives the text back."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\\n"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _visit(p: Column) -> Column:
    out = escape(F.coalesce(p["text"], F.lit("")))
    for kind, mark in PLACEHOLDER.items():
        out = F.when(p["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def _expanded(p: Column) -> Column:
    out = F.lit(0)
    for kind, count in EXPANSION.items():
        out = F.when(p["type"] == kind, count(p["size"])).otherwise(out)
    return out.cast("long")


def text_part(c: Column) -> Column:
    """The parts of a message that is plain text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text"), none.cast("string").alias("uri"), none.cast("double").alias("size")))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation: ``formatted``, ``loss_spans`` (code points, end exclusive), ``attachments``, ``expanded_tokens``.

    Turns are in order of ``turn_col``, nulls first; ties are in order of role, then of the formatted text.
    A null role is an empty one, null parts are none, an unknown type counts as text, repeated rows are
    turns of their own, null ids form one conversation, and an empty table gives no row. A conversation
    is one output string, so it has to fit in a row. Other columns are left out.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    role = F.coalesce(F.col(role_col), F.lit(""))
    attached = F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDER))
    turns = df.select(
        F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), role.alias("_r"),
        F.array_join(F.transform(parts, _visit), "").alias("_b"),
        F.transform(attached, lambda p: F.struct(p["type"].alias("type"), p["uri"].alias("uri"), _expanded(p).alias("tokens"))).alias("_a"),
    )
    turns = turns.withColumn("_head", F.concat(F.lit(START), escape_role(F.col("_r")), F.lit("\n")))
    turns = turns.withColumn("_n", F.length("_head") + F.length("_b") + len(END) + 1)
    order = Window.partitionBy("_c").orderBy(F.col("_t").asc_nulls_first(), "_r", "_b")
    before = F.coalesce(F.sum(F.col("_n").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.withColumn("_i", F.row_number().over(order)).withColumn("_from", before + F.length("_head"))
    rows = F.array_sort(F.collect_list(F.struct("_i", "_head", "_b", "_r", "_from", "_a"))).alias("_rows")
    whole = placed.groupBy("_c").agg(rows)
    spans = F.transform(F.filter("_rows", lambda t: t["_r"] == trained_role), lambda t: F.struct(t["_from"].alias("start"), (t["_from"] + F.length(t["_b"])).alias("end")))
    refs = F.flatten(F.transform("_rows", lambda t: t["_a"]))
    return whole.select(
        F.col("_c").alias(conv_col),
        F.array_join(F.transform("_rows", lambda t: F.concat(t["_head"], t["_b"], F.lit(END + "\n"))), "").alias("formatted"),
        spans.alias("loss_spans"), refs.alias("attachments"),
        F.aggregate(refs, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: role and body, unescaped; placeholders stay in the body."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"
    return F.transform(blocks, lambda b: F.struct(unescape(F.regexp_extract(b, head, 1)).alias("role"), unescape(F.regexp_extract(b, head, 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
