"""Importance resampling towards a target distribution over hashed word n-grams.

Words of a partition's texts become numbers, and a suffix array of them brings equal n-grams together: stretches whose
neighbours share a prefix of n words are the occurrences of one n-gram, which is hashed once. Its bucket is then
scattered back to where it occurs, so texts get their features without a string for each occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.shard import numbered

from .common import Stored, col

#: Words of the texts that one suffix array holds; a longer text has one of its own.
BLOCK_WORDS = 1_000_000
# A-Z become a-z, digits and letters and all bytes of other characters stay, the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of word numbers in order of their first ``depth`` words, and for each length up to it the ranks of all places.

    Ranks of length k + 1 come from those of length k and the next word, as texts end in numbers (0) that lead nowhere.
    Places of one rank of length k share their first k words.
    """
    rank, ranks = ids.astype(np.int64), []
    width = int(ids.max(initial=0)) + 1
    order = np.argsort(rank, kind="stable")
    ranks.append(rank)
    for k in range(1, depth):
        nxt = np.zeros(len(ids), np.int64)
        nxt[:-k] = ids[k:] if k < len(ids) else 0
        pair = ranks[-1] * width + nxt
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        new = np.empty(len(ids), np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_pair[1:] != sorted_pair[:-1]])) if len(ids) else 0
        ranks.append(new)
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix shares with the one before it in order, up to the depth of ``ranks``."""
    shared = np.zeros(len(order), np.int64)
    for r in ranks:
        s = r[order]
        shared[1:] += s[1:] == s[:-1]
    return shared


def feature_buckets(texts: list[list[bytes]], longest: int, buckets: int) -> list[np.ndarray]:
    """The buckets of each text's features: its runs of 1 to ``longest`` words, in order of length, then place."""
    flat = [w for t in texts for w in (*t, b"")]  # an empty word ends each text
    sizes = np.array([len(t) for t in texts], np.int64)
    codes, names = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), np.zeros(0, object))
    end = int(np.flatnonzero(names == b"")[0]) if len(names) else 0
    # The end of a text is number 0.
    ids = np.where(codes == end, 0, np.where(codes < end, codes + 1, codes))
    word = np.empty(len(names) + 1, object)
    word[1 : end + 1], word[end + 1 : len(names)] = names[:end], names[end + 1 :]
    order, ranks = suffix_array(ids, longest)
    shared = common_prefixes(order, ranks)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(ids))  # words up to the end of its text
    held = []
    for n in range(1, longest + 1):
        whole = left[order] >= n
        at = np.flatnonzero(whole)
        # A run starts where a suffix shares fewer than n words with the one before it; all with n words come in one stretch.
        first = shared[at] < n
        if len(at):
            first[0] = True
        heads = order[at[first]]
        hashed = [crc32(word[ids[h]]) for h in heads.tolist()]
        for j in range(1, n):
            hashed = [crc32(b" " + w, c) for c, w in zip(hashed, word[ids[heads + j]], strict=True)]
        bucket = np.array(hashed, np.int64) % buckets
        of = np.full(len(ids), -1, np.int64)
        of[order[at]] = bucket[np.cumsum(first) - 1] if len(at) else 0
        held.append(of)
    return [np.concatenate([held[n][s : s + max(size - n, 0)] for n in range(longest)]) for s, size in zip(starts, sizes, strict=True)]


def _blocks(texts: Iterator[list[bytes]], most: int = BLOCK_WORDS) -> Iterator[list[list[bytes]]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield block


def features(df: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``buckets``, the features of a text as packed 16-bit numbers."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for block in _blocks(map(words_of, b["text"])):
                got = feature_buckets(block, longest, buckets)
                ids = b["id"].iloc[at : at + len(block)].to_numpy()
                at += len(block)
                yield pd.DataFrame({"id": ids, "n_words": [len(t) for t in block], "n_features": [len(g) for g in got], "buckets": [g.astype("<u2").tobytes() for g in got]})

    rows = df.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text"))
    return rows.mapInPandas(run, "id string, n_words long, n_features long, buckets binary").withColumn("id", F.col("id").cast(kind))


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket: partitions count for themselves, and ``buckets`` sums at most reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for packed in b["buckets"]:
                total += np.bincount(np.frombuffer(packed, "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    for b, n in rows.select("buckets").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    k = len(source)
    s, t = float(source.sum()), float(target.sum())
    ratios = ((target + 1.0) * (s + k)) / ((source + 1.0) * (t + k))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def gumbel(id_: Column, seed: int) -> Column:
    """A thousand times a Gumbel draw that follows the id alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 2, buckets: int = 10_000, seed: int = 7, percent: int = 25, min_words: int = 20,
) -> DataFrame:
    """One row for each row: ``id_col``, ``n_features``, ``weight``, ``score``, and ``rank`` of the ``percent`` of 100 that are drawn.

    Features are runs of 1 to ``longest`` words, hashed into ``buckets`` (65,536 at most). A text's weight is the mean gain of
    its features (0 without any); a Gumbel draw on top makes the highest scores a sample without replacement by weight.
    Texts of ``min_words`` or more take part. Of equal scores the smaller id comes first, null ids last. Null and empty texts
    have no words, rows that repeat an id are drawn each, an empty table gives no row, an empty target gives every bucket the
    same count, and other columns are not read. Building the result runs jobs.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must lie between 1 and 65,536")
    # A number of its own splits rows that repeat an id over ranges.
    rows = Stored(features(df, id_col, text_col, longest, buckets).withColumn("row", F.monotonically_increasing_id()))
    # The target's id is of no use: its text stands for it.
    wanted = features(target.select(F.lit(0).alias("id"), col(target_text).alias("text")), "id", "text", longest, buckets)
    gain = gains(bucket_counts(rows.df, buckets), bucket_counts(wanted, buckets))

    @F.pandas_udf("long")
    def weight(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in packed:
            yield pd.Series([int(gain[np.frombuffer(x, "<u2")].sum()) // max(len(x) // 2, 1) for x in p], dtype="int64")

    scored = rows.df.select("id", "row", "n_features", weight("buckets").alias("weight"), (F.col("n_words") < min_words).alias("out"))
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("less", -F.col("score")).withColumn("absent", F.col("id").isNull())
    n = rows.df.agg(F.count_if(F.col("n_words") >= min_words)).first()[0]
    ordered = numbered(scored, ["out", "less", "absent", "id", "n_features", "row"])
    drawn = ~F.col("out") & (F.col("ordinal") < percent * n // 100)
    rows.drop()
    return ordered.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(drawn, F.col("ordinal") + 1).alias("rank"))
