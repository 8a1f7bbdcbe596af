"""Benchmark decontamination by spaced seeds, with SQL functions only.

Fixed masks pick tokens and ignore the positions between them, so a seed survives substitutions. Seeds of
documents meet seeds of the benchmark in an equi-join; around each hit the aligned tokens are compared.

Hits in a row along one alignment are one stretch, and only its first hit is kept: a seed pair whose predecessors
are a pair too is no hit. So texts that repeat themselves give a hit for each alignment, not for each pair of places.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, words

#: Together these hit every window of 13 tokens that has at most two substitutions (all 78 pairs of places are tested).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW = 13
#: Benchmark seeds up to this many are broadcast (some 30 bytes each); more are joined by shuffle.
BROADCAST_SEEDS = 2_000_000


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(tokens: Column, at: Column, number: int, mask: Sequence[int]) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(tokens, at + o) for o in mask])


def check_masks(masks: Sequence[tuple[int, ...]], window: int, similarity: float) -> None:
    """Raise unless every window that is similar enough holds a seed whole, wherever its substitutions are."""
    places = [{o + k for o in mask} for mask in masks for k in range(window - mask[-1])]

    def missed(left: list[set[int]], changes: int) -> bool:
        """Whether so many substitutions can hit all that is left: one must fall into the first of them."""
        return not left or (changes > 0 and any(missed([p for p in left if x not in p], changes - 1) for x in left[0]))

    if missed(places, window - ceil(window * similarity - 1e-9)):
        raise ValueError(f"the masks overlook passages of {window} tokens that agree in {similarity:.0%}")


def _seeds(df: DataFrame, masks: Sequence[tuple[int, ...]]) -> DataFrame:
    """``_i``, ``_seed`` and ``_prev`` (the seed one place before, null at the start) for each place and mask, beside the columns of ``df``, of which ``_tok`` holds the token hashes.

    One generator gives place and mask together; everything after it is generated code in one stage, so the
    token array is not copied to each row.
    """
    m = len(masks)
    rows = df.select("*", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("_tok") * m - 1, F.lit(0)))).alias("_p")) if m else df.withColumn("_p", F.lit(None).cast("int")).where("false")
    rows = rows.withColumn("_i", F.expr(f"_p div {max(m, 1)}").cast("int"))
    seed, span, prev = F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, mask in enumerate(masks):
        here = F.pmod("_p", F.lit(m)) == k
        seed = F.when(here, _seed(F.col("_tok"), F.col("_i"), k, mask)).otherwise(seed)
        prev = F.when(here & (F.col("_i") > 0), _seed(F.col("_tok"), F.col("_i") - 1, k, mask)).otherwise(prev)
        span = F.when(here, F.lit(mask[-1] + 1)).otherwise(span)
    return rows.where(F.col("_p").isNotNull() & (F.col("_i") + span <= F.size("_tok"))).withColumns({"_seed": seed, "_prev": prev}).drop("_p")


def _verified(hits: DataFrame, window: int, similarity: float) -> DataFrame:
    """Hits around which a whole window (or the whole of a shorter item) agrees: ``_match`` of ``_of`` tokens at best.

    A stretch of as many hits as a window has tokens agrees wholly from its start on; every window that meets a shorter one
    lies within the 3 windows that are compared.
    """
    back = F.least(F.col("_i"), F.col("_j"), F.lit(window - 1))
    mine = F.slice("_tok", F.col("_i") - back + 1, F.lit(3 * window))
    theirs = F.slice("_item_tok", F.col("_j") - back + 1, F.lit(3 * window))
    of = F.least(F.lit(window), F.size("_item_tok"))
    near = hits.select("_doc", "_item", mine.alias("_mine"), theirs.alias("_theirs"), of.alias("_of"))
    same = F.zip_with("_mine", "_theirs", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    near = near.withColumn("_same", same)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_same") - F.col("_of"), F.lit(0)))
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice("_same", s + 1, F.col("_of")), F.lit(0), lambda n, x: n + x)))
    return near.select("_doc", "_item", best.alias("_match"), "_of").where(F.col("_match") >= F.ceil(F.col("_of") * similarity - 1e-9))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, similarity: float = 0.8, masks: Sequence[tuple[int, ...]] = MASKS, broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """One row for each document that shares a passage with a benchmark item: ``id_col``, ``items`` (sorted ids), ``best_match``.

    A passage is ``window`` aligned tokens (runs of letters and digits, lower case) of which a share of
    ``similarity`` agree; an item's passage may hang over a document's end, beyond which nothing agrees. Items shorter
    than the window must occur whole and unchanged. Null and empty texts
    share nothing, an empty table gives no row, rows that repeat an id give one row, and rows with a null id
    are left out. Only the named columns are read. Masks that would overlook such passages raise an error.
    """
    check_masks(masks, window, similarity)
    items = benchmark.select(col(item_col).alias("_item"), _hashes(col(item_text)).alias("_item_tok")).where(F.size("_item_tok") > 0)
    long = items.where(F.size("_item_tok") >= window)
    short = [r[0] for r in items.where(F.size("_item_tok") < window).select(F.size("_item_tok")).distinct().collect()]  # below the window, so a few numbers
    runs = [tuple(range(n)) for n in sorted(short)]
    every = [*masks, *runs]
    seeds = _seeds(long.withColumnRenamed("_item_tok", "_tok"), list(masks)).select("_item", F.col("_i").alias("_j"), "_seed", F.col("_prev").alias("_before"))
    for k, run in enumerate(runs, len(masks)):
        whole = items.where(F.size("_item_tok") == len(run))
        seeds = seeds.unionByName(whole.select("_item", F.lit(0).alias("_j"), _seed(F.col("_item_tok"), F.lit(0), k, run).alias("_seed"), F.lit(None).cast("long").alias("_before")))
    texts = docs.where(col(id_col).isNotNull()).select(col(id_col).alias("_doc"), _hashes(col(text_col)).alias("_tok"))
    seeds = seeds.withColumnRenamed("_seed", "_wanted")
    starts = (F.col("_seed") == F.col("_wanted")) & ~F.coalesce(F.col("_prev") == F.col("_before"), F.lit(False))
    if seeds.count() <= broadcast_seeds:
        hits = _seeds(texts, every).join(F.broadcast(seeds), starts).join(F.broadcast(items), "_item")
    else:
        # Only seeds and places are shuffled; the tokens of documents with hits are fetched again.
        places = _seeds(texts, every).select("_doc", "_i", "_seed", "_prev").join(seeds, starts).select("_doc", "_i", "_item", "_j")
        hits = places.join(items, "_item").join(texts, "_doc")
    found = _verified(hits, window, similarity)
    return found.groupBy("_doc").agg(F.array_sort(F.collect_set("_item")).alias("items"), F.max(F.col("_match") / F.col("_of")).alias("best_match")).withColumnRenamed("_doc", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept. Rows with a null id stay."""
    name = fresh(docs, "_bad")
    bad = contaminated(docs, benchmark, id_col, **kwargs).select(col(id_col).alias(name))
    return docs.join(bad, col(id_col) == F.col(name), "left_anti")
