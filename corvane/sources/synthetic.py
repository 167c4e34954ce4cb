"""Synthetic vectors, queries and labelled chunks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..shipping import ship

FLOOR = 1e-8


def _normal(spark: SparkSession, n: int, dimension: int, seed: int | None, partitions: int | None = None) -> DataFrame:
    """(node_id, x): standard normal rows. Row i depends on the seed and i alone, however rows are dealt."""
    ship(spark)
    base = seed if seed is not None else int.from_bytes(os.urandom(6), "little")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [np.random.default_rng([base, i]).standard_normal(dimension, np.float32) for i in ids]
            flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dimension), pa.array(flat))], ["node_id", "x"])

    return spark.range(0, n, 1, partitions).toDF("node_id").mapInArrow(work, "node_id long, x array<float>")


def _unit(x):
    n = F.greatest(V.norm(x), F.lit(FLOOR))
    return F.transform(x, lambda v: (v / n).cast("float"))


def random_vectors(spark: SparkSession, n: int, dimension: int = 384, normalize: bool = True, seed: int | None = None) -> DataFrame:
    if n < 0 or dimension <= 0:
        raise ValueError("n must not be negative and dimension must be positive")
    rows = _normal(spark, n, dimension, seed)
    return rows.select("node_id", (_unit(F.col("x")) if normalize else F.col("x")).alias("embedding"))


def queries(spark: SparkSession, n: int, dimension: int = 384, normalize: bool = True, seed: int | None = None, dataset: DataFrame | None = None, noise: float = 0.0, relative: bool = False) -> DataFrame:
    """Random queries, or rows of ``dataset`` drawn with replacement and moved by Gaussian noise.

    ``noise`` is the deviation of each coordinate; with ``relative`` the expected
    length of the whole displacement. ``dataset`` has the ids 0 to n - 1, as
    :func:`random_vectors` gives them. Moved rows are normalised again.
    """
    rows = _normal(spark, n, dimension, seed)
    if dataset is None:
        return rows.select(F.col("node_id").alias("query_id"), (_unit(F.col("x")) if normalize else F.col("x")).alias("embedding"))
    size = dataset.count()
    pick = F.pmod(F.xxhash64("node_id", F.lit(seed if seed is not None else 0)), F.lit(max(size, 1)))
    drawn = rows.select(F.col("node_id").alias("query_id"), "x", pick.alias("node_id")).join(dataset.select("node_id", "embedding"), "node_id")
    if noise <= 0:
        return drawn.select("query_id", "embedding")
    step = noise / dimension**0.5 if relative else noise
    moved = drawn.select("query_id", F.zip_with("embedding", "x", lambda a, b: a + b * step).alias("x"))
    return moved.select("query_id", (_unit(F.col("x")) if normalize else F.col("x")).alias("embedding"))


def labelled(vectors: DataFrame) -> DataFrame:
    """Ten chunks a document: ``doc_id, chunk_id, text, index`` by the vector's number."""
    i = F.col("node_id")
    doc = F.concat(F.lit("bench_doc_"), F.floor(i / 10).cast("string"))
    part = (i % 10).cast("string")
    return vectors.select("*", doc.alias("doc_id"), F.concat(doc, F.lit("_chunk_"), part).alias("chunk_id"), F.concat(F.lit("Benchmark text "), i.cast("string")).alias("text"), i.cast("int").alias("index"))
