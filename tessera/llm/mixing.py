"""Mixing sources to target weights by pivotal dependent rounding, with SQL functions only.

A source's target over its size is how often each of its words is wanted: a whole number of copies and a chance of one
more. Pairs of documents then play for their fractions: expected words move from one to the other until one has none or a
whole copy. Which way is random, so that no chance changes on average, while the words of a source keep their sum. What
remains open of a group of ``FAN_IN`` documents meets the remainders of other groups, level by level, up to one for each source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.shard import numbered

from .common import SPACE, Stored, col

#: Documents (then remainders) that one fold takes in order.
FAN_IN = 32
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Fractions nearer to a whole number than this are one.
WHOLE = 1e-12

DONE = "array<struct<row:bigint,up:boolean>>"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for a null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, f"[{SPACE}]+"))).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def fill_targets(sources: DataFrame, most: int) -> DataFrame:
    """Add ``target``: shares of all words by ``weight``, at most ``most`` times ``total``; what is over goes to the others by weight.

    A source is full if its limit for one unit of weight is below what the open ones get. That level only rises, so each
    round is one aggregate, and rounds end when no further source is full.
    """
    big = lambda c: c.cast("decimal(18,0)")
    words = sources.agg(F.sum("total").alias("t"), F.sum("weight").alias("w")).first()
    left, open_weight, full = words["t"] or 0, words["w"] or 0, -1
    cap = F.col("total") * most
    while True:
        over = big(cap) * big(F.lit(open_weight)) < big(F.col("weight")) * big(F.lit(left))
        got = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, cap).otherwise(0)).alias("c"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("w")).first()
        if got["n"] == full or not got["n"]:
            break
        full, left, open_weight = got["n"], (words["t"] or 0) - got["c"], got["w"]
    share = (big(F.col("weight")) * big(F.lit(left))).cast("double") / F.lit(float(open_weight or 1))
    return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(share))


def _sources(rows: DataFrame, weights: Sequence[int], most: int) -> Stored:
    """``source, place`` (by code point, null last), ``total`` words, rows with words from ``first`` on, and ``target``."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count_if(F.col("size") > 0).alias("n"))
    placed = numbered(sums.withColumn("absent", F.col("source").isNull()), ["absent", "source"], "place", {"upto": "n"})
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    known = Stored(placed.select("source", "place", "total", "n", (F.col("upto") - F.col("n")).alias("first"), weight.alias("weight")))
    out = Stored(fill_targets(known.df, most))
    known.drop()
    return out


def _fold(items: Column, seed: int) -> Column:
    """Decide all of a group's items (``at, row, h, a, m``) but one: ``done`` and the remainder's ``row, h, a, m``.

    ``a``: words of a document; ``m``: those expected of its one more copy.
    """
    held = ("row", "h", "a", "m")
    first = F.get(items, 0)

    def step(s: Column, x: Column) -> Column:
        both = s["m"] + x["m"]
        down, up = F.least(s["m"], x["a"] - x["m"]), F.least(s["a"] - s["m"], x["m"])
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), s["h"], x["h"]), 11) / F.lit(float(1 << 53))
        # Words go from the remainder to the newcomer, or the other way; the smaller step is the likelier one.
        give = _let(F.struct(down.alias("down"), up.alias("up")), lambda d: u * (d["down"] + d["up"]) < d["up"])

        def settled(g: Column) -> Column:
            out = F.when(g, both <= x["a"]).otherwise(s["a"] <= both)  # whether the remainder is decided, or the newcomer
            return _let(F.struct(out.alias("out"), (g != out).alias("up")), chosen)

        def chosen(c: Column) -> Column:
            left = both - F.when(c["up"], F.when(c["out"], s["a"]).otherwise(x["a"])).otherwise(0.0)
            done = F.array_append(s["done"], F.struct(F.when(c["out"], s["row"]).otherwise(x["row"]).alias("row"), c["up"].alias("up")))
            kept = [F.when(c["out"], x[k]).otherwise(s[k]).alias(k) for k in ("row", "h", "a")]
            return F.struct(done.alias("done"), *kept, F.greatest(left, F.lit(0.0)).alias("m"))

        return _let(give, settled)

    start = F.struct(F.array().cast(DONE).alias("done"), *[first[k].alias(k) for k in held])
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def pivotal(leaves: DataFrame, largest: int, seed: int, fan_in: int = FAN_IN) -> Stored:
    """``row, up`` for each of ``leaves`` (``s, at, row, h, a, m``), whose ``at`` counts from 0 in each ``s`` of ``largest`` rows at most.

    Groups are stretches of ``fan_in`` places, so none is larger, whatever ids, sizes or sources repeat. The last remainder of
    a source takes the nearer whole number.
    """
    levels: list[Stored] = []
    rows, reach = leaves, 1
    while reach < largest or not levels:
        grouped = rows.groupBy("s", F.expr(f"at div {fan_in}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("at", "row", "h", "a", "m"))).alias("items"))
        levels.append(Stored(grouped.select("s", F.col("g").alias("at"), _fold(F.col("items"), seed).alias("f")).select("s", "at", "f.*")))
        rows, reach = levels[-1].df.select("s", "at", "row", "h", "a", "m"), reach * fan_in
    decided = rows.select("row", (2 * F.col("m") >= F.col("a")).alias("up"))
    for level in levels:
        decided = decided.unionByName(level.df.select(F.explode("done").alias("d")).select("d.row", "d.up"))
    out = Stored(decided)
    for level in levels:
        level.drop()
    return out


def mix_sources(
    df: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 12, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row for each row: ``id_col``, ``source_col``, ``size`` (words), ``source_size``, ``target`` of its source, ``copies``, ``taken`` (copies times size).

    Sources, by code point with null last, weigh ``weights`` in turn and share the size of all rows; none is repeated more than
    ``most`` times on average, nor is any document more than ``most`` times. A source's taken words differ from its target
    by half of one document at most. Documents meet in order of size, then a hash of the id; the draws of a pair follow both ids,
    so reruns agree, and repeated rows, which are documents of their own, may swap copies among themselves only. Null texts
    have no words; rows without words take whole copies only. Null ids and sources are values like others, an
    empty table gives no row, and other columns are not read. Building the result runs jobs.
    """
    rows = Stored(df.select(col(id_col).alias("id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row")))
    sources = _sources(rows.df, weights, most)
    wanted = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    whole = F.floor(wanted + WHOLE)
    known = sources.df.select(
        F.col("source").alias("of"), "place", "first", "total", "target", whole.alias("whole"), F.when(wanted - whole > WHOLE, wanted - whole).otherwise(0.0).alias("part")
    )
    if sources.df.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    planned = rows.df.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    h = F.xxhash64(F.lit(seed), F.col("id"))
    open_rows = planned.where("size > 0 AND part > 0").select("place", (-F.col("size")).alias("less"), h.alias("h"), "id", "row", "part")
    ordered = numbered(open_rows, ["place", "less", "h", "id", "row"])
    # Sources without fractions are left out above, so places count from each source's own first one.
    starts = ordered.groupBy("place").agg(F.min("ordinal").alias("from"), F.count(F.lit(1)).alias("n"))
    starts = Stored(starts.select(F.col("place").alias("s"), "from", "n"))
    largest = starts.df.agg(F.max("n")).first()[0] or 0
    near = F.broadcast(starts.df) if starts.df.count() <= BROADCAST_SOURCES else starts.df
    size = (-F.col("less")).cast("double")
    leaves = ordered.join(near, F.col("place") == F.col("s")).select("s", (F.col("ordinal") - F.col("from")).alias("at"), "row", "h", size.alias("a"), (size * F.col("part")).alias("m"))
    decided = pivotal(leaves, largest, seed, fan_in)
    starts.drop()
    out = planned.join(decided.df.select(F.col("row").alias("r"), "up"), F.col("row") == F.col("r"), "left")
    copies = F.col("whole") + F.coalesce(F.col("up").cast("long"), F.lit(0))
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("total").alias("source_size"), "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )
