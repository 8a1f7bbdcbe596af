"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a labelled good document beats a labelled bad one) train a linear score by logistic loss on
feature differences. The decision threshold is a quantile of the training scores. Features describe form only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most, in order of a hash of the id: the documented bound of the sample.
MAX_FIT_ROWS = 20_000
PAIRS, EPOCHS, RIDGE = 60_000, 400, 1e-3

_KEEP_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_KEEP_LOWER = bytes(c for c in range(256) if not 97 <= c <= 122)
_KEEP_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_PLAIN_MARKS = b".,;:'\"()-"
_SYMBOLS = bytes(c for c in range(33, 127) if not (chr(c).isalnum() or c in _PLAIN_MARKS))
_KEEP_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOLS)
_KEEP_MARK = bytes(c for c in range(256) if c not in _PLAIN_MARKS)
FEATURES = 18


def features(text: str | None) -> list[float]:
    """Form of one whole text, in plain byte operations; a null or empty text gives zeros."""
    b = (text or "").encode("utf-8", "surrogatepass")
    w = b.split()
    n, size = len(w), len(b)
    if not n:
        return [0.0] * FEATURES
    lower = b.lower().split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper, small = len(b.translate(None, _KEEP_UPPER)), len(b.translate(None, _KEEP_LOWER))
    symbols = b.translate(None, _KEEP_SYMBOL)
    distinct = len(set(lower))
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    return [
        upper / size, upper / (upper + small + 1), len(b.translate(None, _KEEP_DIGIT)) / size, len(symbols) / n, len(set(symbols)) / (len(symbols) + 10),
        symbols.count(b"!") / n, symbols.count(b"|") / n, len(b.translate(None, _KEEP_MARK)) / n, distinct / n, distinct / n**0.7, (pairs + 1) / n,
        sum(map(eq, lower, lower[1:])) / n, size / n, np.log1p(n), len(lines) / n, len(set(lines)) / len(lines), max(map(len, w)) / 50, b.count(b".") / n,
    ]


@dataclass(frozen=True)
class Model:
    """Quantile-binned features with a weight for each bin; ``score`` is 0.5 at the threshold, the ``level`` quantile of the training scores."""

    edges: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    threshold: float = 0.0
    scale: float = 1.0
    level: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for j, (e, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            total += np.asarray(w)[np.searchsorted(e, x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.raw(x) - self.threshold), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 24, quantile: float | None = None) -> Model:
    """Learn from rows of features and 0/1 labels. Labels of a single class, or none, give a constant 0.5.

    ``quantile``: the share of training scores below the threshold; by default the share of bad labels among all.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model([np.array([])] * FEATURES, [np.zeros(1)] * FEATURES)
    # Edges of the rarer class's quantiles too, as its tails are where it differs.
    at = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.concatenate([np.quantile(x[:, j], at), np.quantile(x[bad, j], at[::3])])) for j in range(x.shape[1])]
    sizes = [len(e) + 1 for e in edges]
    start = np.concatenate([[0], np.cumsum(sizes)])
    cells = np.stack([start[j] + np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)
    rng = np.random.default_rng(0)
    pairs = max(PAIRS, 2 * len(y))
    i, k = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(start[-1])
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, EPOCHS + 1):  # Adam on mini-batches of pairs
        s = slice((t * 3000) % pairs, (t * 3000) % pairs + 3000)
        a, b = cells[i[s]], cells[k[s]]
        pull = 1 / (1 + np.exp(np.clip((w[a] - w[b]).sum(1), -30, 30)))
        g = np.bincount(b.ravel(), np.repeat(pull, b.shape[1]), len(w)) - np.bincount(a.ravel(), np.repeat(pull, a.shape[1]), len(w))
        g = g / max(len(a), 1) + RIDGE * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    raw = w[cells].sum(1)
    level = len(bad) / len(y) if quantile is None else quantile
    return Model([e.tolist() for e in edges], [w[start[j] : start[j + 1]].tolist() for j in range(len(sizes))], float(np.quantile(raw, level)), float(4 / (np.std(raw) + 1e-9)), level)


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_FIT_ROWS, quantile: float | None = None) -> Model:
    """Fit on labelled documents that are not held out: at most ``max_rows`` of them, by hash of the id.

    Labels other than 0 and 1 and null ids are left out. Of repeated ids the larger label and the features that
    sort first hold, so a repeated run gives the same model.
    """
    clean = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = clean.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # so the broadcast has max_rows rows at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["_id"].astype(str), "y": b["_y"], "x": [features(t) for t in b["_text"]]})

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    # One row for each id reaches the driver, however often documents repeat it.
    each = texts.mapInPandas(run, "id string, y int, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    rows = each.toPandas().sort_values("id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, FEATURES)
    return fit(x, rows["y"].to_numpy(int), quantile=quantile)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns and rows of ``docs``, plus ``score`` (0 to 1) and ``predicted``, which replace columns of those names.

    Null and empty texts score as texts without words.
    """

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(-1, FEATURES)))

    out = docs.withColumn("score", of(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
