"""A corpus pipeline: five of the operators in a row, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, packing, quality, simhash, token_counts
from tessera.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    A null or empty text scores as one without words. Rows are judged each by its text, so repeated ones stay or go alike; an
    empty table gives no row.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; ``n_chars`` follows.

    A null text becomes an empty one. Of equal lines those of the largest id stay; rows that repeat an id count once and each
    loses its own shared lines; an empty table gives no row.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null and empty texts are one group. Rows that repeat the id that stays all stay; an empty table gives no row.
    """
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts, and rows with a null id, stay. An id goes with all its rows if one of them holds a passage; an empty
    table gives no row, and an empty benchmark takes none.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a training sequence.

    A text without tokens is one empty piece in no sequence. Repeated rows are packed each, in order of size, then id; an
    empty table gives no row.
    """
    return packing.best_fit(token_counts.count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: SQL has no SimHash and no learned model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
