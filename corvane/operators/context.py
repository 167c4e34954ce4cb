"""Contexts with numbered citations, marked sources, and confidence, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers as A


def sources(results: DataFrame, max_context_length: int | None = 4000, text_col: str = "text") -> DataFrame:
    """``results`` with ``citation_num`` and ``cited_text`` (``[n] text``), up to the context limit.

    Results are taken in rank order until one would overflow the limit, which
    counts the cited texts without separators; 0 or None is no limit.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = results.withColumn("citation_num", F.row_number().over(order))
    rows = rows.withColumn("cited_text", F.concat(F.lit("["), F.col("citation_num").cast("string"), F.lit("] "), F.col(text_col)))
    if not max_context_length:
        return rows
    used = F.sum(F.length("cited_text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", used).where(F.col("_used") <= max_context_length).drop("_used")


def contexts(results: DataFrame, max_context_length: int | None = 4000, text_col: str = "text") -> DataFrame:
    """``query_id, context, num_sources``; a query whose first source overflows has no row."""
    rows = sources(results, max_context_length, text_col)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("citation_num", "cited_text"))), lambda x: x["cited_text"])
    return rows.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"), F.count(F.lit(1)).alias("num_sources"))


def mark_cited(source_rows: DataFrame, answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """``source_rows`` with ``cited``: whether the query's answer cites the source."""
    found = answers.select("query_id", A.citations(answer_col).alias("_cited"))
    rows = source_rows.join(found, "query_id", "left")
    return rows.withColumn("cited", F.coalesce(F.array_contains("_cited", F.col("citation_num")), F.lit(False))).drop("_cited")


def cited_only(source_rows: DataFrame) -> DataFrame:
    return source_rows.where("cited")


def format_sources(source_rows: DataFrame, only_cited: bool = False, length: int = 150) -> DataFrame:
    """``query_id, display``: a line per source."""
    rows = cited_only(source_rows) if only_cited else source_rows
    line = A.source_line("citation_num", "doc_id", "score", "text", "cited", length)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("citation_num", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("query_id").agg(F.array_join(lines, "\n").alias("display"))


def source_statistics(source_rows: DataFrame, *by: str) -> DataFrame:
    """Sources, cited ones, their rate in percent, and average, least and largest score."""
    cited = F.sum(F.col("cited").cast("int"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return source_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_sources"), F.coalesce(cited, F.lit(0)).alias("num_cited"),
        zero(100 * cited / F.count(F.lit(1))).alias("citation_rate"),
        zero(F.avg("score")).alias("avg_score"), zero(F.min("score")).alias("min_score"), zero(F.max("score")).alias("max_score"),
    )


def confidence(results: DataFrame, queries: DataFrame | None = None, high_score: float = A.HIGH_SCORE) -> DataFrame:
    """``query_id, confidence, level``; with ``queries``, those without results have 0."""
    rows = results.groupBy("query_id").agg(A.confidence_aggregate("score", high_score).alias("confidence"))
    if queries is not None:
        rows = queries.select("query_id").join(rows, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return rows.withColumn("level", A.confidence_level("confidence"))
