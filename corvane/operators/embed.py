"""Text embedding: a built-in hashed projection, and a frame for any model in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import normalize_text
from ..shipping import ship


class HashEmbedder:
    """Words are hashed to coordinates with a sign; the vector has unit length. All in the JVM, no model file.

    Equal texts have equal vectors everywhere; texts that share words are near.
    """

    def __init__(self, dimension: int = 64, normalize: bool = True):
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        self.dimension, self.normalize, self.name = dimension, normalize, f"hash-{dimension}"

    def column(self, text: str | Column) -> Column:
        words = F.filter(F.split(F.lower(normalize_text(text)), " "), lambda w: w != "")
        number = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")
        hashes = F.transform(words, number)
        zero = F.array_repeat(F.lit(0.0), self.dimension)

        def add(acc: Column, h: Column) -> Column:
            at = F.pmod(h, F.lit(self.dimension)) + 1
            sign = F.when(F.pmod(F.floor(h / self.dimension), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
            return F.transform(acc, lambda x, i: F.when(i + 1 == at, x + sign).otherwise(x))

        v = F.aggregate(hashes, zero, add)
        if self.normalize:
            v = V.normalize(v)
        return F.transform(v, lambda x: x.cast("float"))

    def embed(self, rows: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        # Summed per coordinate after an explode this would shuffle; as an expression it stays in one pass.
        return rows.withColumn(out, self.column(F.col(text_col)))


class PythonEmbedder:
    """Any model: ``load()`` gives a function from a list of texts to a matrix, once for each worker."""

    def __init__(self, name: str, dimension: int, load: Callable[[], Callable], batch_size: int = 32, normalize: bool = True):
        self.name, self.dimension, self.load, self.batch_size, self.normalize = name, dimension, load, batch_size, normalize

    def embed(self, rows: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        ship(rows.sparkSession)
        name, dimension, load, size, unit = self.name, self.dimension, self.load, self.batch_size, self.normalize

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import numpy as np

            model = cached(name, load)
            for texts in batches:
                parts = [np.asarray(model(texts.iloc[a : a + size].fillna("").tolist()), np.float64) for a in range(0, len(texts), size)]
                m = np.concatenate(parts) if parts else np.empty((0, dimension))
                if m.ndim != 2 or len(m) != len(texts) or m.shape[1] != dimension:
                    raise RuntimeError(f"model {name} gave shape {m.shape} for {len(texts)} texts of dimension {dimension}")
                if unit:
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    m = m / np.where(n == 0, 1, n)
                yield pd.Series(list(m.astype(np.float32)))

        return rows.withColumn(out, encode(F.col(text_col)))


_MODELS: dict[str, Callable] = {}


def cached(name: str, load: Callable[[], Callable]) -> Callable:
    """The worker's model of this name, loaded once."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def clear_cache() -> None:
    _MODELS.clear()


def embed_texts(spark, embedder, texts: list[str]) -> DataFrame:
    return embedder.embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))


def verify_determinism(embedder, rows: DataFrame, runs: int = 3, rtol: float = 1e-7, atol: float = 1e-9, key: str = "id") -> bool:
    """Whether several runs give the same vectors, within the tolerances."""
    first = embedder.embed(rows).select(key, F.col("embedding").alias("a"))
    for _ in range(max(0, runs - 1)):
        again = embedder.embed(rows).select(key, F.col("embedding").alias("b"))
        far = F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x - y) > atol + rtol * F.abs(y)), lambda z: z)
        if not first.join(again, key).where((F.size("a") != F.size("b")) | far).isEmpty():
            return False
    return True
