"""Evaluation of search results and the benchmark of exact against approximate search."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..sources import synthetic
from .ann import HNSWIndex
from .knn import knn_join


def ranked_lists(results: DataFrame, name: str, key: str | Column = "node_id", by: str = "query_id") -> DataFrame:
    """One array per query, in rank order. ``key`` may be any column expression."""
    k = F.col(key) if isinstance(key, str) else key
    return results.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", k.alias("k")))), lambda x: x["k"]).alias(name))


def intersection(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def recall_at_k(truth: str, found: str, k: int) -> Column:
    """Share of ``k`` that both lists have among their first ``k``."""
    if k <= 0:
        raise ValueError("k must be positive")
    return F.size(F.array_intersect(F.slice(truth, 1, k), F.slice(found, 1, k))) / F.lit(k)


def precision_at_k(truth: str, found: str, k: int) -> Column:
    """Share of the first ``k`` found that are true; 0 if nothing was found."""
    if k <= 0:
        raise ValueError("k must be positive")
    got = F.slice(found, 1, k)
    return F.when(F.size(got) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.slice(truth, 1, k), got)) / F.size(got))


def recall_table(truth: DataFrame, found: DataFrame, k: int, key: str | Column = "node_id") -> DataFrame:
    """``query_id, recall, precision`` of every query of ``truth``; a query without results has 0."""
    both = ranked_lists(truth, "t", key).join(ranked_lists(found, "f", key), "query_id", "left")
    both = both.withColumn("f", F.coalesce("f", F.array().cast(both.schema["t"].dataType)))
    return both.select("query_id", recall_at_k("t", "f", k).alias("recall"), precision_at_k("t", "f", k).alias("precision"))


def recall_statistics(recalls: DataFrame, column: str = "recall") -> DataFrame:
    """Mean, population deviation, minimum, maximum and median; zeros without queries."""
    c = F.col(column)
    named = {"mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c), "max": F.max(c), "median": F.median(c)}
    return recalls.agg(*[F.coalesce(v, F.lit(0.0)).alias(f"recall_{n}") for n, v in named.items()])


@dataclass
class BenchmarkConfig:
    n_vectors: int = 1000
    dimension: int = 384
    n_queries: int = 100
    k_values: list[int] = field(default_factory=lambda: [1, 5, 10])
    ef_values: list[int] = field(default_factory=lambda: [10, 50, 100])
    m: int = 16
    ef_construction: int = 200
    noise: float = 0.1
    seed: int = 42
    metric: str = "cosine"
    realistic: bool = True


@dataclass
class BenchmarkResults:
    config: BenchmarkConfig
    build_seconds: dict[str, float]
    rows: list[dict]

    def to_dict(self) -> dict:
        slow, fast = self.build_seconds.get("hnsw", 0.0), self.build_seconds.get("brute_force", 0.0)
        return asdict(self) | {"build_speedup": fast / slow if slow else 0.0}

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], "algorithm string, n int, k int, ef_search int, recall_mean double, recall_std double, recall_min double, recall_max double, recall_median double, mean_ms double, qps double, speedup double")


def run_benchmark(spark, config: BenchmarkConfig | None = None) -> BenchmarkResults:
    """Recall and batched latency of the graph index against exact search."""
    c = config or BenchmarkConfig()
    data = synthetic.random_vectors(spark, c.n_vectors, c.dimension, seed=c.seed).cache()
    queries = synthetic.queries(spark, c.n_queries, c.dimension, seed=c.seed + 1, dataset=data if c.realistic else None, noise=c.noise).cache()
    data.count(), queries.count()
    # What either algorithm searches is stored first: the vectors, or their graphs.
    t = time.time()
    stored = Scratch(spark, "benchmark").save(data, "vectors")
    exact_built = time.time() - t
    t = time.time()
    index = HNSWIndex.build(data, c.metric, c.m, c.ef_construction)
    built = time.time() - t
    rows = []
    for k in c.k_values:
        t = time.time()
        truth = knn_join(queries, stored, k, c.metric).cache()
        truth.count()
        exact = (time.time() - t) / c.n_queries
        rows.append({"algorithm": "brute_force", "n": c.n_vectors, "k": k, "ef_search": None, "recall_mean": 1.0, "recall_std": 0.0, "recall_min": 1.0, "recall_max": 1.0, "recall_median": 1.0, "mean_ms": exact * 1000, "qps": 1 / exact, "speedup": 1.0})
        for ef in c.ef_values:
            t = time.time()
            found = index.search(queries, k, ef).cache()
            found.count()
            took = (time.time() - t) / c.n_queries
            stats = recall_statistics(recall_table(truth, found, k)).first().asDict()
            rows.append({"algorithm": "hnsw", "n": c.n_vectors, "k": k, "ef_search": ef, **stats, "mean_ms": took * 1000, "qps": 1 / took, "speedup": exact / took})
            found.unpersist()
        truth.unpersist()
    for df in (data, queries):
        df.unpersist()
    return BenchmarkResults(c, {"brute_force": exact_built, "hnsw": built}, rows)


def compare_algorithms(spark, sizes: tuple[int, ...] = (100, 1000, 5000), **options) -> list[BenchmarkResults]:
    return [run_benchmark(spark, BenchmarkConfig(n_vectors=n, **options)) for n in sizes]
