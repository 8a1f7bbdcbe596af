"""Line dedup over whole documents, with SQL functions only.

Keys of lines are exploded as 128-bit hashes, counted by document, and the keys over the threshold are joined
back to the lines they came from. Only hashes and positions cross the network for that; a document's text
crosses once, to meet the list of positions it loses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, col, nested, stored


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """doc, text hash, pos, h1, h2 of each line whose key is long enough."""
    lines = rows.select("doc", "hash", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "hash", "pos", F.btrim(F.col("line"), F.lit(SPACE)).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc", "hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop the lines that ``min_docs`` or more documents share, but for those of the largest id holding them.

    Returns all columns of ``df`` with ``text_col`` rewritten, plus ``n_lines`` (before), ``n_dropped``, which
    replace columns of those names. A null or empty text is one empty line. Empty and short keys are never
    dropped, nor are lines of an empty table. Rows that repeat an id count as one document, and each loses its
    own shared lines only; a null id never counts as the largest, and lines of null ids are kept. Columns may
    have any name.
    """
    body = F.coalesce(col(text_col), F.lit(""))
    rows = nested(df, without=(text_col,), doc=col(id_col), text=body, hash=F.xxhash64(body))
    keys = _keys(rows.where(F.col("doc").isNotNull()), min_chars)
    # One row for each key and document, then one for each key: both combine before their shuffle.
    common = (
        keys.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc").alias("keep"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keep")
    )
    # Written first, so that both sides of the join are plain exchanges and adaptive execution splits a key with many lines.
    lost = keys.join(stored(common), ["h1", "h2"]).where(F.col("doc") != F.col("keep")).select("doc", "hash", "pos")
    # Rows of one id and one text are alike in all that counts here, and rows of one id and other texts are told apart.
    by_doc = lost.groupBy("doc", "hash").agg(F.collect_set("pos").alias("lost"))
    cut = rows.join(by_doc, ["doc", "hash"], "left").withColumn("all", F.split("text", "\n", -1)).withColumn("n", F.size("all"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("lost"))
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("all"), i)), "\n"))
    rest = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns if c not in ("n_lines", "n_dropped")]
    gone = F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost"))
    return cut.select(*rest, F.col("n").cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))
