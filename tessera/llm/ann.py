"""Approximate nearest neighbours by collision counting with query-aware single projections.

Each block of vectors keeps one sorted array for each projection, and each vector's place in it. A query opens a
window around its own projection in every array and widens it step by step (virtual rehashing). A vector that falls
into enough windows is verified with the exact inner product, and widening ends when enough vectors are.

Projections are orthogonal, so misses of a vector add up to its distance without the noise that independent ones
have. What is verified grows with the square root of a block's size at every size: there is no switch to brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """``misses``: windows that a vector may miss (at ``projections`` in all); ``breadth``: vectors verified, in square roots of ``k`` times a block's size."""

    projections: int = 64
    misses: int = 6
    breadth: float = 1.25
    step: float = 1.03
    block: int = 16_384
    queries: int = 16_384
    batch: int = 64
    seed: int = 7


def directions(d: int, p: Params) -> np.ndarray:
    """``projections`` columns in sets of up to ``d`` orthogonal ones, of squared length ``d``."""
    rng = np.random.default_rng(p.seed)
    sets = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-p.projections // d))]
    return np.column_stack(sets)[:, : p.projections] * np.sqrt(d)


class Block:
    """The index of one block: for each projection a sorted array, and each row's place in it."""

    def __init__(self, x: np.ndarray, top: float, p: Params) -> None:
        self.p, self.n = p, len(x)
        self.norm = np.sqrt(top) or 1.0
        # One more component makes all norms equal, so the largest inner product is the least distance.
        self.a = directions(x.shape[1] + 1, p)
        at = np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]) @ self.a
        order = np.argsort(at, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(at.T, order, 1)
        self.kind = np.uint16 if self.n < 1 << 16 else np.uint32
        self.place = np.empty(order.shape, self.kind)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=self.kind)[None], 1)
        self.away, self.out = np.empty_like(self.place), np.empty(self.place.shape, bool)

    def windows(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and length of each query's window (row) in each array (column)."""
        lo = np.stack([s.searchsorted(v - w) for s, v in zip(self.sorted, h.T, strict=True)], 1)
        hi = np.stack([s.searchsorted(v + w, "right") for s, v in zip(self.sorted, h.T, strict=True)], 1)
        return lo, hi - lo

    def missed(self, lo: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many windows of one query each row misses."""
        # A place before the window wraps around to a large number.
        np.subtract(self.place, lo.astype(self.kind)[:, None], out=self.away)
        np.greater_equal(self.away, length.astype(self.kind)[:, None], out=self.out)
        return np.add.reduce(self.out.view(np.uint8), axis=0, dtype=np.uint16)

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query the rows that collide often enough, with windows as wide as it takes to have enough of them.

        Windows start from what the queries before needed, and shrink first where that is far too wide.
        """
        p, n = self.p, self.n
        enough = min(n, int(np.ceil(p.breadth * np.sqrt(k * n))))
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True) * self.norm
        h = np.column_stack([unit, np.zeros(len(unit))]) @ self.a
        usual, widest = 2.0 * self.norm, 8.0 * self.norm * np.sqrt(len(self.a))
        for start in range(0, len(h), p.batch):
            own = h[start : start + p.batch]
            w = np.full(len(own), usual)
            lo, length = self.windows(own, w)
            for i in range(len(own)):
                got, far = np.flatnonzero(self.missed(lo[i], length[i]) <= p.misses), p.step**8
                while len(got) > 2 * enough and far > 1 + 1e-3:  # too wide: narrow by ever smaller steps
                    at = self.windows(own[i : i + 1], w[i : i + 1] / far)
                    fewer = np.flatnonzero(self.missed(at[0][0], at[1][0]) <= p.misses)
                    if enough <= len(fewer) < len(got):
                        got, w[i] = fewer, w[i] / far
                    else:
                        far = np.sqrt(far)
                while len(got) < enough:
                    w[i] *= p.step if 2 * len(got) > enough else p.step**4
                    if not w[i] < widest:  # squares beyond the range of doubles
                        got = np.arange(n)
                        break
                    at = self.windows(own[i : i + 1], w[i : i + 1])
                    got = np.flatnonzero(self.missed(at[0][0], at[1][0]) <= p.misses)
                yield got
            usual = float(np.median(w))


def best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, got: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best verified rows, ties to smaller ids.

    Scores are summed row by row, so equal vectors get equal scores; a matrix product, whose last bits may
    differ, only leaves out rows that are clearly worse.
    """
    rough = x[got] @ q
    if len(got) > k:
        bar = np.partition(rough, len(got) - k)[len(got) - k]
        got = got[rough >= bar - 1e-9 * (1 + abs(bar))]
    s = (x[got] * q).sum(1)
    first = np.lexsort((ids[got], -s))[:k]
    return ids[got][first], s[first]


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", params: Params = Params()) -> DataFrame:  # noqa: B008
    """The ``k`` nearest rows to each query by inner product: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    All rows but the query's own id are candidates; ties go to the smaller id. Null, empty and zero vectors and
    those with null or non-finite components take no part, nor do null ids; vectors of another dimension than
    the query's aren't compared with it. Of rows that repeat an id each is a candidate, and the
    smallest vector is the query. Queries with no candidate give
    no row. Other columns are not read.
    """
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"  # floats cross shuffles as floats
    clean = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"), is_query.alias("q")).where(_usable(F.col("v")) & F.col("id").isNotNull())
    clean = clean.withColumn("d", F.size("v"))
    spread = clean.groupBy("d").agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if("q").alias("nq"))
    sized = clean.join(F.broadcast(spread), "d")  # a row for each dimension
    blocks, chunks = F.ceil(F.col("n") / params.block).cast("int"), F.greatest(F.ceil(F.col("nq") / params.queries), F.lit(1)).cast("int")
    h = F.xxhash64("id")
    # A cell is one block of vectors and one chunk of queries: every pair of them meets in one cell.
    stored = sized.select("id", "v", F.lit(False).alias("q"), "d", "top", F.pmod(h, blocks).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c"))
    one = sized.where("q").groupBy("id", "d").agg(F.min("v").alias("v"), F.first("top").alias("top"), F.first("n").alias("n"), F.first("nq").alias("nq"))
    asked = one.select("id", "v", F.lit(True).alias("q"), "d", "top", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"), F.pmod(h, chunks).cast("int").alias("c"))

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        mine, q = cell[~cell["q"]].sort_values("id"), cell[cell["q"]].sort_values("id")
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(mine) and len(q):
            x, ids = np.stack(mine["v"].to_list()).astype(float), mine["id"].to_numpy()
            index = Block(x, float(cell["top"].iloc[0]), params)
            asked_v = np.stack(q["v"].to_list()).astype(float)
            for qid, v, got in zip(q["id"], asked_v, index.candidates(asked_v, k), strict=True):
                found, scores = best_of(x, ids, v, got[ids[got] != qid], k)
                out["query_id"].append(np.full(len(found), qid))
                out["vec_id"].append(found)
                out["score"].append(scores)
        none = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        return pd.DataFrame({c: np.concatenate(v) if v else none[c] for c, v in out.items()})

    cells = stored.unionByName(asked).groupBy("d", "b", "c").applyInPandas(search, "query_id long, vec_id long, score double")
    # Each block gives k rows for a query at most, and a task hands on k of all its blocks: a rank that is cut is bounded before the shuffle.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
