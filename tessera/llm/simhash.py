"""SimHash near-dedup by the general pigeonhole principle.

Distinct fingerprints are indexed by parts of their bits. Correlated bits share a part, and each part has its
own threshold: thresholds sum to ``distance - parts + 1``, so two fingerprints within ``distance`` agree within
the threshold of one part at least. Dynamic programming picks thresholds (and the number of parts) from
estimated candidate counts over all fingerprints.

Groups of near copies by similarity take their candidates from that index, over fingerprints of five-word shingle sets,
and from a second one for edits that a fingerprint doesn't survive (cut or added passages): texts that share a band of their
shingles' minima, and agree in a 64-bit sketch of them. Texts that candidates connect are compared by their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, col, fresh, stored
from .components import components

SEED = 42
#: Key groups with up to this many pairs are paired by a join. Larger ones are compared whole, and from ``CHUNK`` rows in cells of two chunks.
SMALL_GROUP, CHUNK = 16, 8192
#: Words of a verified shingle, and the least share of shingles (Jaccard) that near copies have in common.
VERIFIED_SHINGLE, SIMILARITY = 5, 0.8
#: Sketch bits that candidates may differ in. Sets of similarity 0.8 differ in 6.4 of 64 on average (deviation 2.4; in over 18 once in 100,000), unrelated ones in 32 (4).
SKETCH_DISTANCE = 18
#: Minima of a band, of 64. Sets of similarity s share one of 16 bands of 4 with chance 1 - (1 - s^4)^16: all but one in 4,500 at 0.8, however their texts were edited.
BAND = 4
#: Fingerprint bits that candidates of the pigeonhole index may differ in.
PRINT_DISTANCE = 3
#: Shingles in a chunk of texts that are compared whole; a task holds two chunks.
CHUNK_SHINGLES = 2_000_000

BANDS = [f"_band{k}" for k in range(64 // BAND)]

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3, distinct: bool = False) -> int:
    """Bits set in over half the XXH64 of all word shingles; zero without words. ``distinct``: each shingle counts once."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*[w[i:] for i in range(shingle)], strict=False)) if len(w) >= shingle else [b" ".join(w)]
    if distinct:
        grams = set(grams)
    n = left = len(grams) if distinct else max(1, len(w) - shingle + 1)
    digest, ones, it = xxhash.xxh64_intdigest, np.zeros(64, np.int64), iter(grams)
    while left:  # so a text of any length takes bounded memory
        take = min(left, 1 << 15)
        h = np.fromiter((digest(g, SEED) for g in _take(it, take)), np.uint64, take)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= take
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _take(it: Iterator[bytes], n: int) -> Iterator[bytes]:
    for _ in range(n):
        yield next(it)


def _word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in w), np.uint64, len(w))


def shingle_set(h: np.ndarray, shingle: int = VERIFIED_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles over word hashes ``h``; fewer words are one shingle, none are no shingle."""
    if not len(h):
        return h
    n = max(1, len(h) - shingle + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(min(shingle, len(h))):
        mixed = (mixed ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of the shingles under each of 64 multiplications."""
    least = np.full(64, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):  # so a text of any length takes bounded memory
        np.minimum(least, (shingles[i : i + 2048, None] * _ODD).min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each ``BAND`` minima."""
    rows = least.reshape(-1, BAND)
    mixed = np.zeros(len(rows), np.uint64)
    for j in range(BAND):
        mixed = (mixed ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def print_of(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles: bits set in over half of them, as one number in an array."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 15):  # so a text of any length takes bounded memory
        part = np.ascontiguousarray(shingles[i : i + (1 << 15)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def sketch(shingles: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """64 bits: one of each of the shingles' minima."""
    least = minima(shingles) if least is None else least
    return np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(bool), bitorder="little").view(np.uint64)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_doc``, ``_node`` (128-bit hash of the words), ``_id`` (64-bit), ``_fp``, ``_sketch``, ``_band0`` and on, ``_size`` (shingles)."""
    columns = ["_id", "_fp", "_sketch", *BANDS]

    def one(text: str | None) -> tuple[str, np.ndarray, int]:
        w = _split(text)
        shingles = shingle_set(_word_hashes(w))
        least, whole = minima(shingles), b" ".join(w)
        numbers = [np.array([xxhash.xxh64_intdigest(whole)], np.uint64), print_of(shingles), sketch(shingles, least), bands(least)]
        return xxhash.xxh3_128_hexdigest(whole), np.concatenate(numbers).view(np.int64), len(shingles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [one(t) for t in b["_text"]]
            numbers = np.array([r[1] for r in rows], np.int64).reshape(-1, len(columns))
            yield pd.DataFrame({"_doc": b["_doc"], "_node": [r[0] for r in rows], **{c: numbers[:, k] for k, c in enumerate(columns)}, "_size": [r[2] for r in rows]})

    kind = dict(df.dtypes)[id_col]
    schema = ", ".join(["_doc string", "_node string", *[f"{c} long" for c in columns], "_size long"])
    out = df.select(F.col(id_col).cast("string").alias("_doc"), F.col(text_col).alias("_text")).mapInPandas(run, schema)
    return out.withColumn("_doc", F.col("_doc").cast(kind))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, distinct: bool = False) -> DataFrame:
    """``_doc``, ``_fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, distinct) for t in b["_text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"_doc": b["_doc"], "_fp": fp})

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).cast("string").alias("_doc"), F.col(text_col).alias("_text")).mapInPandas(run, "_doc string, _fp long").withColumn("_doc", F.col("_doc").cast(kind))


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int  # -1: not probed


def _within(odds: np.ndarray, most: int) -> list[float]:
    """Chances that at most 0, 1, ... ``most`` of independent bits differ."""
    p = np.zeros(most + 2)
    p[0] = 1
    for q in odds:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return list(np.cumsum(p)[: most + 1])


def plan(n: int, ones: np.ndarray, together: np.ndarray, distance: int, parts: tuple[int, ...] = (2, 3, 4)) -> list[Part]:
    """Parts and thresholds of least estimated work: probes plus candidates.

    ``ones``: how many of ``n`` fingerprints set each bit; ``together``: how many set both bits of a pair.
    """
    n = max(n, 1)  # else every plan of an empty table would cost nothing
    p = ones / n
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / n - np.outer(p, p)) / np.outer(var, var)
    np.fill_diagonal(corr, 0)
    best: tuple[float, list[Part]] | None = None
    for m in parts:
        if m > distance + 1:
            continue
        left, groups = set(range(64)), []
        for g in range(m):
            size = 64 // m + (g < 64 % m)
            first = max(left, key=lambda b: (corr[b, list(left)].sum(), -b))
            own = [first]
            left.remove(first)
            while len(own) < size:
                nxt = max(left, key=lambda b: (corr[b, own].mean(), -b))
                own.append(nxt)
                left.remove(nxt)
            groups.append(tuple(sorted(own)))
        total = distance - m + 1
        cost = []
        for bits in groups:
            chance = _within(2 * p[list(bits)] * (1 - p[list(bits)]), total)
            row = [0.0]  # threshold -1
            for t in range(total + m):
                probes = 1 + (sum(comb(len(bits), k) for k in range(1, t + 1)) if t else 0)
                row.append(n * probes + (chance[t] if t <= total else 1) * n * n / 2)
            cost.append(row)
        # The least cost of the first parts whose thresholds sum to s; a skipped part counts as -1.
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in cost:
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, ts) in state.items():
                for t in range(-1, len(row) - 1):
                    new = (c + row[t + 1], (*ts, t))
                    if s + t not in nxt or new < nxt[s + t]:
                        nxt[s + t] = new
            state = nxt
        c, ts = state[total]
        if best is None or c < best[0]:
            best = (c, [Part(b, t) for b, t in zip(groups, ts, strict=True)])
    assert best is not None
    return best[1]


def _stats(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts over all distinct fingerprints: how many, bits set, pairs of bits set. 2081 sums reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((64, 64), np.int64)
        n = 0
        for b in batches:
            bits = np.unpackbits(b["_fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(b)
        i, j = np.triu_indices(64)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both[i, j], n)})

    both, n = np.zeros((64, 64), np.int64), 0
    for i, j, c in prints.select("_fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            n = c
        else:
            both[i, j] = both[j, i] = c
    return n, np.diag(both).copy(), both


def _forest(fp: np.ndarray, index: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that have an indexed end: breadth first, so no list of pairs is ever held."""
    left = np.ones(len(fp), bool)
    out: list[tuple[int, int]] = []
    for s in range(len(fp)):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            u = queue.pop()
            rest = np.flatnonzero(left if index[u] else left & index)
            if not len(rest):
                continue
            near = rest[np.bitwise_count(fp[rest] ^ fp[u]) <= distance]
            left[near] = False
            out.extend((int(u), int(v)) for v in near)
            queue.extend(near.tolist())
    return out


def _cells(batches: Iterator[pd.DataFrame], at: list[str], forest: Callable[[pd.DataFrame], Callable[[int, int], list[tuple[int, int]]]], name: str, kind: type) -> Iterator[pd.DataFrame]:
    """Links of each cell. Rows come sorted by cell (``at``); the last cell of a batch waits for the next batch."""
    held: pd.DataFrame | None = None
    for b in chain(batches, [None]):
        rows = held if b is None else b if held is None else pd.concat([held, b], ignore_index=True)
        if rows is None or not len(rows):
            continue
        cell = rows[at].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1, [len(rows)]])
        of, out = forest(rows), []
        for s, e in zip(cuts[:-1], cuts[1:] if b is None else cuts[1:-1], strict=b is None):
            out += [(s + u, s + v) for u, v in of(s, e)]
        held = None if b is None else rows.iloc[cuts[-2] :]
        both = np.array(out, np.int64).reshape(-1, 2)
        ids = rows[name].to_numpy(kind)
        yield pd.DataFrame({"a": ids[both[:, 0]], "b": ids[both[:, 1]]})


def links(prints: DataFrame, distance: int = 3, small_group: int = SMALL_GROUP, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``_fp``) that join the same components as all links within ``distance``."""
    n, ones, both = _stats(prints)
    probes = []
    for k, part in enumerate(plan(n, ones, both, distance)):
        if part.threshold < 0:
            continue
        mask = sum(1 << b for b in part.bits)
        signed = mask - (1 << 64) if mask >> 63 else mask
        flips = [sum(1 << b for b in c) for t in range(1, part.threshold + 1) for c in combinations(part.bits, t)]
        flips = [f - (1 << 64) if f >> 63 else f for f in flips]
        key = F.col("_fp").bitwiseAND(F.lit(signed))
        probes.append(prints.select(F.lit(k).alias("_part"), key.alias("_key"), "_fp", F.lit(True).alias("_own")))
        if flips:
            some = prints.select("_fp", key.alias("_exact"), F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("_flip"))
            probes.append(some.select(F.lit(k).alias("_part"), F.col("_exact").bitwiseXOR(F.col("_flip")).alias("_key"), "_fp", F.lit(False).alias("_own")))
    rows = probes[0]
    for p in probes[1:]:
        rows = rows.unionByName(p)
    return _key_links(rows, "_fp", "_fp", distance, small_group, chunk)


def band_links(texts: DataFrame, small_group: int = SMALL_GROUP, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between ``_id`` s that join the same components as all that share a band and have sketches within ``SKETCH_DISTANCE``."""
    rows = texts.select("_id", "_sketch", F.posexplode(F.array(*BANDS)).alias("_part", "_key")).withColumn("_own", F.lit(True))
    return _key_links(rows, "_id", "_sketch", SKETCH_DISTANCE, small_group, chunk)


def print_links(texts: DataFrame, distance: int = PRINT_DISTANCE, small_group: int = SMALL_GROUP, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between ``_id`` s that join the same components as all whose fingerprints are within ``distance``, by the pigeonhole index."""
    # Of equal fingerprints one text stands for all, so the index holds each once.
    prints = Stored(texts.groupBy("_fp").agg(F.min("_id").alias("_rep")))
    equal = texts.join(prints.df, "_fp").where("_id <> _rep").select(F.col("_id").alias("a"), F.col("_rep").alias("b"))
    end = lambda c: prints.df.select(F.col("_fp").alias(c), F.col("_rep").alias(f"_{c}"))
    near = links(prints.df, distance, small_group, chunk).join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return equal.unionByName(near)


def _key_links(rows: DataFrame, name: str, bits: str, distance: int, small_group: int, chunk: int) -> DataFrame:
    """Links ``a, b`` between ``name`` s of rows with one ``_part, _key``, an end of them ``_own``, whose ``bits`` are within ``distance``.

    Small key groups give every link; in larger ones the links of a cell are thinned to a spanning forest.
    """
    held = [name] if name == bits else [name, bits]
    sizes = rows.groupBy("_part", "_key").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_own").alias("_m")).where("_n > 1 AND _m > 0")
    # Aggregates are written before they are joined: then both sides are plain exchanges, which adaptive execution splits.
    grouped = Stored(rows.join(stored(sizes), ["_part", "_key"]))
    few = F.col("_n") * F.col("_m") <= small_group
    small, large = grouped.df.where(few), grouped.df.where(~few)
    a, b = small.where("_own").alias("a"), small.alias("b")
    same = (F.col("a._part") == F.col("b._part")) & (F.col("a._key") == F.col("b._key"))
    near = F.bit_count(F.col(f"a.{bits}").bitwiseXOR(F.col(f"b.{bits}"))) <= distance
    pairs = a.join(b, same & (F.col(f"a.{name}") != F.col(f"b.{name}")) & near).select(F.col(f"a.{name}").alias("a"), F.col(f"b.{name}").alias("b"))

    def forest(rows: pd.DataFrame) -> Callable[[int, int], list[tuple[int, int]]]:
        fp, own = rows[bits].to_numpy(np.int64).view(np.uint64), rows["_own"].to_numpy(bool)
        return lambda s, e: _forest(fp[s:e], own[s:e], distance)

    at = ["_part", "_key", "_lo", "_hi"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _cells(batches, at, forest, name, np.int64)

    # A group of k chunks is compared in k (k + 1) / 2 cells, each of two chunks at most.
    k = F.ceil(F.col("_n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64(name), k).cast("int")
    one = large.where(k == 1).select("_part", "_key", F.lit(0).alias("_lo"), F.lit(0).alias("_hi"), *held, "_own")
    cells = large.where(k > 1).withColumn("_k", k).withColumn("_c", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    cells = one.unionByName(cells.select("_part", "_key", F.least("_c", "_o").alias("_lo"), F.greatest("_c", "_o").alias("_hi"), *held, "_own"))
    far = cells.repartition(*at).sortWithinPartitions(*at).mapInPandas(compare, "a long, b long")
    return pairs.unionByName(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, distinct: bool = False) -> DataFrame:
    """One row for each document: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links).

    Fingerprints link at ``distance`` or fewer differing bits. Null and empty texts have fingerprint zero and
    link like any other; a text of fewer words than a shingle is one shingle. Repeated rows each give a row,
    null ids are never a component's id unless it has no other, and an empty table gives no row. Other columns
    are not read.
    """
    own = Stored(fingerprints(df, id_col, text_col, shingle, distinct))
    prints = Stored(own.df.groupBy("_fp").agg(F.min("_doc").alias("_least")))
    roots = components(links(prints.df, distance))
    placed = prints.df.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    ids = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of = placed.join(stored(ids), "_root").select("_fp", "component_id")
    out = own.df.join(of, "_fp")
    return out.select(F.col("_doc").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def verified_links(texts: DataFrame, roots: DataFrame, df: DataFrame, id_col: str, text_col: str, similarity: float, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """Links ``a, b`` between ``_node`` s that candidates connect, which join the same components as all links of ``similarity``.

    Texts are compared by whole shingle sets and nothing else, in cells of two chunks of a bounded number of shingles.
    """
    group = texts.where(F.col("_least").isNotNull()).join(roots, F.col("_id") == F.col("node")).select("root", "_node", "_least", "_size")
    group = Stored(group)
    sums = group.df.groupBy("root").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    k = F.ceil(F.col("_sum") / chunk).cast("int")
    asked = stored(group.df.join(stored(sums), "root").select("root", F.col("_node").alias("_want"), "_least", F.greatest(k, F.lit(1)).alias("_k")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [_split(t) for t in b["_text"]]
            right = [xxhash.xxh3_128_hexdigest(b" ".join(w)) == n for w, n in zip(words, b["_want"], strict=True)]
            sets = [shingle_set(_word_hashes(w)).view(np.int64) if r else None for w, r in zip(words, right, strict=True)]
            out = pd.DataFrame({"root": b["root"], "_k": b["_k"], "_node": b["_want"], "_set": sets})
            yield out[np.array(right, bool)]

    found = df.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(asked, F.col("_doc") == F.col("_least"))
    sets = found.select("root", "_k", "_want", "_text").mapInPandas(cut, "root long, _k int, _node string, _set array<long>")
    mine = F.pmod(F.xxhash64("_node"), F.col("_k")).cast("int")
    cells = sets.withColumn("_c", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    at = ["root", "_lo", "_hi"]
    cells = cells.select("root", F.least("_c", "_o").alias("_lo"), F.greatest("_c", "_o").alias("_hi"), "_node", "_set")

    def forest(rows: pd.DataFrame) -> Callable[[int, int], list[tuple[int, int]]]:
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in rows["_set"]]
        return lambda s, e: set_forest(sets[s:e], similarity)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _cells(batches, at, forest, "_node", object)

    return cells.repartition(*at).sortWithinPartitions(*at).mapInPandas(compare, "a string, b string")


def _postings(sets: list[np.ndarray], similarity: float) -> Callable[[int], np.ndarray]:
    """Which sets may be similar to a set: those that share one of its rarest shingles.

    Sets of ``similarity`` lack less than ``1 - similarity`` of their own shingles, so whatever the order, the first
    so many and one more of both share a shingle. Rarest first, few others do.
    """
    sizes = np.array([len(x) for x in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    first = sizes - np.ceil(similarity * sizes - 1e-6).astype(int) + 1
    rare = []
    for e, n, k in zip(ends, sizes, first, strict=True):
        at = place[e - n : e]
        rare.append(at[np.lexsort((at, counts[at]))[:k]])
    held = np.concatenate(rare)
    owner = np.repeat(np.arange(len(sets)), [len(r) for r in rare])[np.argsort(held, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(values)))])
    return lambda u: np.concatenate([owner[starts[t] : starts[t + 1]] for t in rare[u]] or [owner[:0]])


def set_forest(sets: list[np.ndarray], similarity: float = SIMILARITY, few: int = 64) -> list[tuple[int, int]]:
    """A spanning forest of the links of ``similarity`` between sets. Up to ``few`` sets are compared without an index."""
    sizes, left = np.array([len(x) for x in sets]), np.ones(len(sets), bool)
    may = _postings(sets, similarity) if len(sets) > few else None
    out: list[tuple[int, int]] = []
    for s in range(len(sets)):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            u = queue.pop()
            rest = np.flatnonzero(left)
            if may and sizes[u] and len(rest) > few:
                hit = np.zeros(len(sets), bool)
                hit[may(u)] = True
                rest = np.flatnonzero(left & hit)
            rest = rest[np.minimum(sizes[rest], sizes[u]) >= similarity * np.maximum(sizes[rest], sizes[u])]
            near = [int(v) for v in rest if similar(sets[u], sets[v], similarity)]
            left[near] = False
            out.extend((u, v) for v in near)
            queue.extend(near)
    return out


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets share ``similarity`` of their union."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1) if len(b) else np.zeros(0, int)
    both = int((b[at] == a).sum()) if len(b) else 0
    return both >= similarity * (len(a) + len(b) - both)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their group; of rows that repeat such an id, all stay. All columns are kept.

    Texts with the same words (A-Z lower-cased) are one group. Others link if they share ``similarity`` of their
    five-word shingles, whatever the edit. Candidates are fingerprints within ``PRINT_DISTANCE`` bits and texts that share a band
    of minima; ``BAND`` tells how many links at 0.8 the bands alone miss. A group is what
    links reach. Null and empty texts are one group; a text of fewer words is one shingle. A null id never
    stands for a group that has another, and texts that only null ids hold link to no other text.
    """
    own = Stored(sketches(df, id_col, text_col))
    once = own.df.groupBy("_node").agg(F.min("_doc").alias("_least"), *[F.min(c).alias(c) for c in ("_id", "_fp", "_sketch", *BANDS, "_size")])
    texts = Stored(once)
    rough = Stored(components(band_links(texts.df).unionByName(print_links(texts.df.select("_id", "_fp")))))
    roots = components(verified_links(texts.df, rough.df, df, id_col, text_col, similarity))
    placed = Stored(texts.df.join(roots, F.col("_node") == F.col("node"), "left").select("_node", "_least", F.coalesce("root", "_node").alias("_root")))
    # A text stays if its id is the least of its group; only groups of several texts need the second aggregate.
    lost = placed.df.where("_root <> _node").select("_root").distinct()
    ids = placed.df.join(stored(lost), "_root", "left_semi").groupBy("_root").agg(F.min("_least").alias("_min"))
    kept = fresh(df, "_keep")
    of = placed.df.join(stored(ids), "_root", "left").select(F.coalesce("_min", "_least").alias(kept)).distinct()
    return df.join(of, col(id_col).eqNullSafe(F.col(kept)), "left_semi")
