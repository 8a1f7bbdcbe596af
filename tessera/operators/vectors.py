"""Vector retrieval: weighted scores, frame budgets, and diverse selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sharpness of quality, time scale in seconds, jitter, and candidates of a clip at most.
SHARPNESS, TIME_SCALE, JITTER, CANDIDATES = 6.0, 2.0, 1e-6, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda n, x: n + x)


def normalized(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 0)  # bound, so that it is computed once for all components


def weighted_scores(frames: DataFrame, queries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Sum over queries (``weight``, negative to push away, and ``q``) of weight times cosine, for each frame.

    The query set is a handful of texts of one package: it travels as one array in a single broadcast row.
    """
    package = queries.agg(F.collect_list(F.struct("weight", normalized(F.col("q")).alias("q"))).alias("_qs")).withColumn("_one", F.lit(1))
    own = frames.select("*", normalized(F.col(vec_col)).alias("_v"), F.lit(1).alias("_one"))
    score = F.aggregate("_qs", F.lit(0.0), lambda n, q: n + q["weight"] * dot(F.col("_v"), q["q"]))
    return own.join(F.broadcast(package), "_one").select(*frames.columns, score.alias("score"))


def frame_budget(span: Column, top1: Column, top5: Column, n: Column, windows: Column, requested: Column) -> Column:
    """How many frames a span deserves: more for long spans, flat scores and many windows."""
    base = F.when(span >= 2.0, 2).otherwise(1)
    flat = F.when((n >= 5) & (top1 - top5 < 0.08), 1).otherwise(0)
    many = F.when(windows >= 3, 1).otherwise(0)
    return F.least(base + flat + many, F.lit(8), requested)


def kernel(x: np.ndarray, times: np.ndarray, scores: np.ndarray) -> np.ndarray:
    spread = scores.max() - scores.min()
    q = np.exp(SHARPNESS * ((scores - scores.min()) / spread if spread > 1e-8 else np.ones_like(scores)))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    k = np.clip(unit @ unit.T, 0, 1) * np.exp(-np.abs(times[:, None] - times[None]) / TIME_SCALE) * np.outer(q, q)
    np.fill_diagonal(k, np.maximum(np.diag(k), JITTER))
    return k


def greedy_map(k: np.ndarray, n: int) -> list[int]:
    """Up to ``n`` rows of greatest determinant, one by one, by Cholesky updates; the first of equals wins.

    The gain of a row is its conditional variance given the chosen ones, so no determinant is recomputed.
    """
    gain = np.diag(k) + JITTER
    rows, chosen = np.zeros((min(n, len(k)), len(k))), []
    while len(chosen) < min(n, len(k)):
        free = np.where(np.isin(np.arange(len(k)), chosen), -np.inf, gain)
        best = int(np.argmax(free))
        if free[best] <= 0:
            break
        m = len(chosen)
        rows[m] = (k[best] - rows[:m].T @ rows[:m, best]) / np.sqrt(gain[best])
        gain = gain - rows[m] ** 2
        chosen.append(best)
    return chosen


def select_diverse(df: DataFrame, key: str, id_col: str, vec_col: str, time_col: str, score_col: str, n: int) -> DataFrame:
    """``n`` rows of each key that are good and unlike: ``key, id, order``. Each key holds at most ``CANDIDATES`` rows, best scores first."""
    kinds = dict(df.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([score_col, id_col], ascending=[False, True]).head(CANDIDATES)
        got = greedy_map(kernel(np.stack(part[vec_col]).astype(float), part[time_col].to_numpy(float), part[score_col].to_numpy(float)), n)
        return pd.DataFrame({key: part[key].iloc[got].to_numpy(), id_col: part[id_col].iloc[got].to_numpy(), "order": np.arange(len(got), dtype=np.int32)})

    return df.select(key, id_col, vec_col, time_col, score_col).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, order int")
