"""Queries of content keys, builds and free-form payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical as cn
from tessera.functions.text import entry_path

from .registry import query, table


@query("""
WITH x AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
now AS (SELECT *, sha256('{"doc_id":' || doc_id || ',"marks":[' || coalesce(CAST(quality AS VARCHAR), 'null') || ',' || coalesce(CAST(toxic AS VARCHAR), 'null') || '],"origin":{"lang":"' || lang || '","source":"' || source || '"}}') AS cache_key FROM x),
held AS (SELECT DISTINCT sha256('{"doc_id":' || doc_id || ',"marks":[' || quality || ',' || toxic || '],"origin":{"lang":"' || CASE WHEN toxic = 1 THEN 'xx' ELSE lang END || '","source":"' || source || '"}}') AS k FROM x WHERE quality IS NOT NULL)
SELECT doc_id, cache_key, 'entries/' || substr(cache_key, 1, 2) || '/' || cache_key || '.pt' AS cache_path, CASE WHEN k IS NULL THEN 'build' ELSE 'skip' END AS status FROM now LEFT JOIN held ON cache_key = k""")
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build of all documents has to do, when the labelled ones were built before and toxic ones had another language then.

    Old payloads have their keys in another order, other spacing and other private fields, which change no content.
    """
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    text = lambda form, *parts: F.parse_json(F.format_string(form, *parts))
    lang = F.when(F.col("toxic") == 1, "xx").otherwise(F.col("lang"))
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    now = text('{"doc_id":%d,"_row":%d,"origin":{"source":"%s","lang":"%s"},"marks":[%s,%s]}', F.col("doc_id"), F.col("n_chars"), F.col("source"), F.col("lang"), mark("quality"), mark("toxic"))
    then = text('{ "origin": {"lang": "%s", "_seen": {"at": 1}, "source": "%s"}, "marks": [%s, %s], "doc_id": %d }', lang, F.col("source"), mark("quality"), mark("toxic"), F.col("doc_id"))
    held = x.where("quality IS NOT NULL").select(cn.content_key(then, 3).alias("k")).distinct()
    keyed = x.select("doc_id", cn.content_key(now, 3).alias("cache_key"))
    status = F.when(F.col("k").isNull(), "build").otherwise("skip")
    return keyed.join(held, F.col("cache_key") == F.col("k"), "left").select("doc_id", "cache_key", entry_path(F.col("cache_key")).alias("cache_path"), status.alias("status"))
