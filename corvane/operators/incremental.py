"""Incremental processing: what changed, what is missing, and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def manifest_of(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What a chunking was made from: ``doc_id, source_hash, chunk_size, chunk_overlap``."""
    return docs.select(F.col(id_col).alias("doc_id"), content_hash(text_col).alias("source_hash"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"))


def rechunk_decisions(docs: DataFrame, manifest: DataFrame, size: int | None = None, overlap: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, reason, rechunk``: new, changed, other parameters (if given), or unchanged."""
    now = docs.select(F.col(id_col).alias("doc_id"), content_hash(text_col).alias("now_hash"))
    rows = now.join(manifest.withColumn("_known", F.lit(True)), "doc_id", "left")
    other = F.lit(False)
    if size is not None:
        other = other | ~F.col("chunk_size").eqNullSafe(F.lit(size))
    if overlap is not None:
        other = other | ~F.col("chunk_overlap").eqNullSafe(F.lit(overlap))
    reason = F.when(F.col("_known").isNull(), "new").when(~F.col("now_hash").eqNullSafe(F.col("source_hash")), "changed").when(other, "parameters").otherwise("unchanged")
    return rows.select("doc_id", reason.alias("reason")).withColumn("rechunk", F.col("reason") != "unchanged")


def changed_documents(docs: DataFrame, manifest: DataFrame, size: int | None = None, overlap: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    todo = rechunk_decisions(docs, manifest, size, overlap, id_col, text_col).where("rechunk").select(F.col("doc_id").alias(id_col))
    return docs.join(todo, id_col, "left_semi")


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without an embedding, each id once."""
    return chunks.dropDuplicates(["chunk_id"]).join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def with_chunks(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings with their chunk's columns; those without a chunk are left out (see :func:`orphans`)."""
    return embeddings.join(chunks.dropDuplicates(["chunk_id"]), "chunk_id")


def orphans(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def lookup(requested: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requested ids that exist, with their rows, and those that do not."""
    ids = requested.select("chunk_id").distinct()
    return embeddings.join(ids, "chunk_id", "left_semi"), ids.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Of rows of equal key the one that comes last by its columns written as JSON."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(row, F.to_json(row)).alias("_row")).select("_row.*")


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of equal key, or added; of equal keys in ``new``, see :func:`one_per_key`."""
    new = one_per_key(new, key)
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))


def superseded(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks of documents that are chunked again: they and their vectors are to go."""
    return chunks.join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")


def ingest_counters(decisions: DataFrame, new_chunks: DataFrame, new_embeddings: DataFrame) -> DataFrame:
    """One row: documents in all, new and updated, and new chunks and embeddings."""
    one = decisions.agg(
        F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.sum((F.col("reason") == "new").cast("int")), F.lit(0)).alias("new_documents"),
        F.coalesce(F.sum(F.col("reason").isin("changed", "parameters").cast("int")), F.lit(0)).alias("updated_documents"),
    )
    return one.join(new_chunks.agg(F.count(F.lit(1)).alias("new_chunks"))).join(new_embeddings.agg(F.count(F.lit(1)).alias("new_embeddings")))
