"""Best-fit packing with several permitted sequence lengths.

A shard is packed longest piece first. A piece goes to the open bin it leaves least room in; else it opens the
length that costs least for each token it can come to hold. At the end each bin shrinks to the least permitted
length that takes its contents.

A sequence costs a fixed overhead, its length, and its length's square for attention. Long sequences save
overhead and take long pieces whole; short ones save attention. So no single length is best for all pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

LENGTHS = (1024, 2048, 4096, 8192)
#: What a bin costs besides its length, in tokens, and the length at which attention costs as much as all else (six times the width of a model of width 4096).
BIN_COST, ATTENTION = 16, 24_576
#: Pieces in a shard, on average; a shard holds only ids and sizes, some 24 bytes a piece.
SHARD_PIECES = 50_000


def cost(length: float, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> float:
    """Of one sequence of ``length``, in tokens of a sequence so short that attention costs nothing."""
    return bin_cost + length + length * length / attention


def pack(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each piece. ``sizes`` from 1 to ``max(lengths)``; ties keep their order."""
    lengths = sorted(lengths)
    costs = [cost(c, bin_cost, attention) for c in lengths]
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    falling = -ordered
    # Tokens of each piece and all later ones, which are no longer than it.
    rest = np.append(np.cumsum(ordered[::-1])[::-1], 0)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for at, i in enumerate(order):
        s = int(ordered[at])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            # What a longer bin could still take is the later pieces that fit beside this one.
            def price(j: int, at: int = at, s: int = s) -> float:
                fits = max(at + 1, int(np.searchsorted(falling, s - lengths[j])))
                return costs[j] / min(lengths[j], s + int(rest[fits]))

            free = lengths[min(range(bisect_left(lengths, s), len(lengths)), key=lambda j: (price(j), j))]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        if free > s:
            insort(room, (free - s, b))
    final = np.array([lengths[bisect_left(lengths, u)] for u in used], np.int64)
    return bins, offsets, final[bins] if len(used) else bins


def best_fit(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", lengths: Sequence[int] = LENGTHS, bin_cost: float = BIN_COST, attention: float = ATTENTION, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece of each document: id, ``piece``, ``n_tokens``, ``bin`` (``shard:number``), ``bin_offset``, ``bin_length``.

    A document longer than the longest length is cut into pieces of that length and a rest. Null, zero and
    negative sizes are one empty piece, which lies in no bin (null ``bin``, zero offset and length). Repeated rows are packed each, null ids like
    others, and an empty table gives no row. A hash of id and piece picks the shard, so a repeated run gives the
    same bins. Other columns are left out.
    """
    longest = max(lengths)
    kind = dict(df.dtypes)[id_col]
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    rows = Stored(df.select(F.col(id_col).cast("string").alias("_id"), size.alias("_size"))).df  # sizes may be costly, and are read twice
    n = F.greatest(F.ceil(F.col("_size") / longest), F.lit(1))
    pieces = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    pieces = pieces.select("_id", F.col("_piece"), F.least(F.lit(longest).cast("long"), F.col("_size") - F.col("_piece") * longest).alias("_size"))
    total = rows.agg(F.count(F.lit(1)), F.sum(F.floor(F.col("_size") / longest))).first()
    shards = max(1, -(-(total[0] + (total[1] or 0)) // shard_pieces))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_size", "_id", "_piece"], ascending=[False, True, True], kind="stable", na_position="first")
        sizes = part["_size"].to_numpy(np.int64)
        full = int((sizes > 0).sum())
        bins, offsets, final = pack(sizes[:full], lengths, bin_cost, attention)
        none = np.zeros(len(sizes) - full, np.int64)
        names = [f"{key[0]}:{b}" for b in bins] + [None] * len(none)
        return pd.DataFrame({"_id": part["_id"], "piece": part["_piece"], "n_tokens": sizes, "bin": names, "bin_offset": np.append(offsets, none), "bin_length": np.append(final, none)})

    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64("_id", "_piece"), F.lit(shards)))
    out = sharded.groupBy("_shard").applyInPandas(run, "_id string, piece long, n_tokens long, bin string, bin_offset long, bin_length long")
    return out.select(F.col("_id").cast(kind).alias(id_col), "piece", "n_tokens", "bin", "bin_offset", "bin_length")


def bins(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each bin: its length, tokens, and its pieces (no more than its length) in order of place."""
    return packed.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.max("bin_length").alias("bin_length"), F.sum("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("bin_offset", F.col(id_col), "piece"))).alias("pieces"),
    )

