"""Connected components of a link table, by smallest neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _jump(p: DataFrame) -> DataFrame:
    """Follow each pointer twice as far."""
    return p.join(p.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root").select("node", F.col("_r").alias("root"))


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, root`` for each end of a link (columns ``a``, ``b``); ``root`` is the smallest node reachable.

    A round points each node to its smallest neighbour, follows pointers, and contracts links to what their ends
    point to, so settled links leave. Minima combine before their shuffle, and joins are plain equi-joins whose hot
    keys adaptive execution splits. Each round at least halves the nodes, and is written to the shared folder.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = Stored(links.where("a <> b").select(*pair).distinct())
    placed: Stored | None = None
    for _ in range(max_rounds):
        both = left.df.unionByName(left.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = Stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root")))
        far = Stored(_jump(_jump(near.df)))
        near.drop()
        if placed is None:
            placed = far
        else:
            new = Stored(placed.df.join(far.df.select(F.col("node").alias("root"), F.col("root").alias("_r")), "root", "left").select("node", F.coalesce("_r", "root").alias("root")))
            placed.drop()
            placed = new
        end = lambda c: far.df.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))  # noqa: B023, E731
        moved = left.df.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        # A pointer that doesn't end in its own root yet stays a link.
        loose = far.df.select("root").distinct().join(far.df.select(F.col("node").alias("root"), F.col("root").alias("b")), "root").select(F.col("root").alias("a"), "b")
        rest = Stored(moved.unionByName(loose).where("a <> b").select(*pair).distinct())
        left.drop()
        left = rest
        if not left.df.limit(1).count():
            return placed.df
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
