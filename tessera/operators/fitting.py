"""Fitting an example's messages to a size: the oldest images leave first, then the oldest messages of the history.

All expressions on one row's messages (``array<struct<role, content: array<struct<type, text, ...>>>>``). What leaves, and in
which order, follows from the messages alone; a fold takes from that list until the rest fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Messages of these roles never leave, and keep their place when they hold nothing more.
LASTING = ("system", "user")
INTS = "array<int>"
TIMESTAMP = r"^\d+(\.\d+)?s$"


def is_image(item: Column) -> Column:
    return item["type"] == "image"


def is_timestamp(item: Column) -> Column:
    return (item["type"] == "text") & F.trim(F.coalesce(item["text"], F.lit(""))).rlike(TIMESTAMP)


def _leaving(content: Column) -> Column:
    """For each image of a content, in order: ``at``, its place, and ``mark``, that of the timestamp which leaves with it (null if none).

    An image takes the timestamp right before it; what stood between them has left by then, as older images leave first.
    """
    start = F.struct(F.array().cast(INTS).alias("rest"), F.array().cast("array<struct<at:int,mark:int>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        last = F.try_element_at(s["rest"], F.lit(-1))
        paired = F.coalesce(is_timestamp(F.get(content, last)), F.lit(False))
        gone = F.struct(i.alias("at"), F.when(paired, last).alias("mark"))
        shorter = F.when(paired, F.slice(s["rest"], 1, F.greatest(F.size(s["rest"]) - 1, F.lit(0)))).otherwise(s["rest"])
        taken = F.struct(shorter.alias("rest"), F.array_append(s["out"], gone).alias("out"))
        return F.when(is_image(F.get(content, i)), taken).otherwise(F.struct(F.array_append(s["rest"], i).alias("rest"), s["out"].alias("out")))

    places = F.when(F.size(content) > 0, F.sequence(F.lit(0), F.size(content) - 1)).otherwise(F.array().cast(INTS))
    return F.aggregate(places, start, step)["out"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n + x)


def fit_messages(messages: Column, limit: Column, text_size: Callable[[Column], Column], image_size: int, message_size: int, reserved: Column) -> Column:
    """``messages`` that fit, ``size``, and how many images and messages left.

    The size is ``reserved`` (the response) plus, for each message, ``message_size`` and its items: ``text_size`` of a text,
    ``image_size`` for an image. While it exceeds ``limit``, the oldest image leaves with the timestamp before it, and its
    message too if nothing is left of it and it isn't the system's or the user's; once no image is left, the oldest message
    that isn't theirs. ``fit`` says what had to leave: ``whole`` nothing, ``images``, ``history``, and ``over`` if all that may
    leave isn't enough. A limit of 0 or less keeps all.
    """
    item_size = lambda c: F.when(is_image(c), F.lit(image_size)).otherwise(text_size(F.coalesce(c["text"], F.lit("")))).cast("long")
    content = lambda m: F.coalesce(m["content"], F.array())
    lasting = lambda m: m["role"].isin(*LASTING)
    sizes = F.transform(messages, lambda m: F.transform(content(m), item_size))
    leaving = F.transform(messages, lambda m: _leaving(content(m)))
    total = _sum(F.transform(sizes, lambda s: _sum(s) + message_size)) + reserved

    def image_drops(m: Column, i: Column) -> Column:
        own, mine = F.get(sizes, i), F.get(leaving, i)
        emptied = (F.size(own) == _sum(F.transform(mine, lambda d: F.when(d["mark"].isNull(), 1).otherwise(2)))) & ~lasting(m)

        def drop(d: Column, k: Column) -> Column:
            last = emptied & (k == F.size(mine) - 1)
            saved = F.get(own, d["at"]) + F.coalesce(F.get(own, d["mark"]), F.lit(0)) + F.when(last, message_size).otherwise(0)
            return F.struct(i.alias("m"), d["at"].alias("at"), d["mark"].alias("mark"), last.alias("whole"), saved.cast("long").alias("saved"))

        return F.transform(mine, drop)

    def history_drop(m: Column, i: Column) -> Column:
        gone = _sum(F.transform(F.get(leaving, i), lambda d: F.get(F.get(sizes, i), d["at"]) + F.coalesce(F.get(F.get(sizes, i), d["mark"]), F.lit(0))))
        left = _sum(F.get(sizes, i)) - gone
        none = F.size(F.get(sizes, i)) == _sum(F.transform(F.get(leaving, i), lambda d: F.when(d["mark"].isNull(), 1).otherwise(2)))
        had = (F.size(F.get(leaving, i)) > 0) & none  # it left with its last image
        return F.when(~lasting(m) & ~had, F.array(F.struct(i.alias("m"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("mark"), F.lit(True).alias("whole"), (left + message_size).cast("long").alias("saved")))).otherwise(
            F.array().cast("array<struct<m:int,at:int,mark:int,whole:boolean,saved:bigint>>")
        )

    drops = F.concat(F.flatten(F.transform(messages, image_drops)), F.flatten(F.transform(messages, history_drop)))

    def take(drops: Column, total: Column) -> Column:
        over = F.when(limit > 0, total - limit).otherwise(F.lit(0)).cast("long")
        # The fold: one more leaves while the rest is too large.
        n = F.aggregate(drops, F.struct(over.alias("over"), F.lit(0).alias("n")), lambda s, d: F.when(s["over"] > 0, F.struct((s["over"] - d["saved"]).alias("over"), (s["n"] + 1).alias("n"))).otherwise(s))
        return F.struct(F.slice(drops, 1, n["n"]).alias("gone"), n["over"].alias("over"), total.alias("total"))

    def result(t: Column) -> Column:
        gone = t["gone"]
        whole = F.transform(F.filter(gone, lambda d: d["whole"]), lambda d: d["m"])
        cut = F.filter(gone, lambda d: d["at"] >= 0)
        kept = F.filter(F.transform(messages, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: ~F.array_contains(whole, x["i"]))

        def rest(x: Column) -> Column:
            mine = F.filter(cut, lambda d: d["m"] == x["i"])
            places = F.concat(F.transform(mine, lambda d: d["at"]), F.transform(F.filter(mine, lambda d: d["mark"].isNotNull()), lambda d: d["mark"]))
            return F.when(F.size(mine) == 0, x["m"]).otherwise(x["m"].withField("content", F.filter(content(x["m"]), lambda c, k: ~F.array_contains(places, k))))

        fit = F.when(t["over"] > 0, "over").when(F.size(gone) == 0, "whole").when(F.size(cut) == F.size(gone), "images").otherwise("history")
        size = t["total"] - _sum(F.transform(gone, lambda d: d["saved"]))
        return F.struct(
            F.transform(kept, rest).alias("messages"), size.alias("size"), F.size(cut).alias("dropped_images"), F.size(whole).alias("dropped_messages"), fit.alias("fit"),
        )

    let = lambda v, f: F.get(F.transform(F.array(v), f), 0)
    return let(let(F.struct(drops.alias("d"), total.alias("t")), lambda x: take(x["d"], x["t"])), result)


def token_weights(char_weights: Column, offsets: Column) -> Column:
    """The mean weight of each token's characters (``start, end``, within the text); 1 for an empty one. Each token reads its own characters only."""

    def mean(o: Column) -> Column:
        start, end = F.greatest(o["start"], F.lit(0)), F.least(o["end"], F.size(char_weights))
        total = F.aggregate(F.sequence(start, end - 1), F.lit(0.0), lambda n, i: n + F.get(char_weights, i))  # by place: a slice would copy the whole list for each token
        return F.when(end > start, total / (end - start)).otherwise(F.lit(1.0))

    return F.transform(offsets, mean)


def aligned(values: Column, count: Column, base: Column) -> Column:
    """As many values as a response has tokens: cut, or padded with the last one; without any, ``base`` for all."""
    n = F.greatest(count, F.lit(0))
    longer = F.concat(values, F.array_repeat(F.try_element_at(values, F.lit(-1)), F.greatest(n - F.size(values), F.lit(0)).cast("int")))
    return F.when(F.size(values) == 0, F.array_repeat(base, n.cast("int"))).otherwise(F.slice(longer, 1, n.cast("int")))


def token_advantages(parts: Column, offsets: Column, count: Column, base: Column, plain_weights: Column) -> Column:
    """An advantage for each token of a response: the sum over components of advantage times the token's share of weight.

    ``parts``: ``advantage, weight`` of a component in its turn, and ``char_weights``, what each character counts for it
    (empty: all alike). Components of no effect are left out. Shares are divided by their mean over tokens, so that a
    component's mean over a response is its advantage. Without effective components ``base`` is spread by ``plain_weights``.
    """

    def spread(advantage: Column, char_weights: Column) -> Column:
        def normal(w: Column) -> Column:
            mean = F.aggregate(w, F.lit(0.0), lambda n, x: n + x) / F.size(w)
            factor = advantage / F.when(mean <= 1e-8, F.lit(1.0)).otherwise(mean)
            return F.get(F.transform(F.array(factor), lambda f: F.transform(w, lambda x: f * x)), 0)  # bound, so that it is computed once for all tokens

        flat = F.transform(offsets, lambda o: F.lit(1.0))
        w = F.when(F.size(char_weights) > 0, token_weights(char_weights, offsets)).otherwise(flat)
        return F.get(F.transform(F.array(w), normal), 0)

    active = F.filter(F.coalesce(parts, F.array()), lambda p: F.abs(p["advantage"] * p["weight"]) > 1e-8)
    zeros = F.transform(offsets, lambda o: F.lit(0.0))
    summed = F.aggregate(active, zeros, lambda t, p: F.zip_with(t, spread(p["advantage"] * p["weight"], p["char_weights"]), lambda a, b: a + b))
    values = F.when(F.size(active) > 0, summed).otherwise(spread(base, plain_weights))
    return aligned(F.when(F.size(offsets) > 0, values).otherwise(F.array().cast("array<double>")), count, base)
