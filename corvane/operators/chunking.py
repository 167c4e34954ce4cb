"""Overlapping character chunks of documents, and statistics over chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: ``chunk_id, doc_id, text, start, end, index``; offsets are into the normalised text.

    Null, empty and blank texts give no chunk. One narrow pass: no shuffle, no Python.
    """
    check_chunking(size, overlap)
    t = docs.select(F.col(id_col).alias("doc_id"), T.normalize_text(text_col).alias("_t")).where("length(_t) > 0")
    starts = F.sequence(F.lit(0), F.length("_t") - 1, F.lit(size - overlap))
    rows = t.select("doc_id", "_t", F.posexplode(starts).alias("index", "start"))
    rows = rows.select("doc_id", F.substring("_t", F.col("start") + 1, F.lit(size)).alias("text"), "start", F.least(F.col("start") + size, F.length("_t")).alias("end"), "index")
    # Normalised text has no two spaces in a row: only a chunk of one character can be blank.
    rows = rows.where(F.trim("text") != "")
    return rows.select(T.chunk_id("doc_id", "index", "text").alias("chunk_id"), "doc_id", "text", "start", "end", "index")


def chunk_statistics(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    n = F.length(text_col)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.agg(F.count(F.lit(1)).alias("num_chunks"), zero(F.sum(n)).alias("total_chars"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_chunk_size"), zero(F.min(n)).alias("min_chunk_size"), zero(F.max(n)).alias("max_chunk_size"))


def document_statistics(docs: DataFrame, size_col: str = "size", by: tuple[str, ...] = ()) -> DataFrame:
    n = F.col(size_col)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("num_documents"), zero(F.sum(n)).alias("total_chars"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_size"), zero(F.min(n)).alias("min_size"), zero(F.max(n)).alias("max_size"))


def chunk_preview(chunks: DataFrame, n: int = 3, length: int = 100) -> DataFrame:
    """The first ``n`` chunks of each document, cut for display."""
    return chunks.where(F.col("index") < n).select("doc_id", "index", F.length("text").alias("chars"), T.preview("text", length).alias("preview"))


def register_sql(spark) -> None:
    """``chunk_text(text, doc_id, size, overlap)`` as a table function for SQL."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(t STRING, id STRING, size INT, overlap INT)
        RETURNS TABLE (chunk_id STRING, text STRING, start INT, index INT)
        RETURN SELECT concat(id, '_chunk_', CAST(p AS STRING), '_', substr(md5(c), 1, 7)), c, s, p FROM (
          SELECT p, s, substr(trim(regexp_replace(t, '(?U)[\\\\s\\\\x1c-\\\\x1f]+', ' ')), s + 1, size) AS c
          FROM posexplode(CASE WHEN length(trim(regexp_replace(t, '(?U)[\\\\s\\\\x1c-\\\\x1f]+', ' '))) = 0 THEN CAST(array() AS ARRAY<INT>)
            ELSE sequence(0, length(trim(regexp_replace(t, '(?U)[\\\\s\\\\x1c-\\\\x1f]+', ' '))) - 1, size - overlap) END) AS x(p, s))"""
    )
