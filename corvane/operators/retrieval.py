"""From questions to ranked, filtered and formatted results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import knn_join


def min_score(results: DataFrame, least: float) -> DataFrame:
    """Rows of at least this score; only a positive limit filters. It is applied after top-k."""
    return results.where(F.col("score") >= least) if least > 0 else results


def max_distance(results: DataFrame, most: float) -> DataFrame:
    return results.where(F.col("distance") <= most)


def with_metadata(results: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Attaches what is shown, such as text, to the few rows that are left."""
    return results.join(nodes.select("node_id", *columns), "node_id", "left")


def format_results(results: DataFrame, include_vector: bool = False, include_distance: bool = True) -> DataFrame:
    columns = [F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("node_id").cast("long").alias("node_id"), F.col("score").cast("double").alias("score")]
    if include_distance:
        columns.append(F.col("distance").cast("double").alias("distance"))
    columns += [F.col(c) for c in ("chunk_id", "doc_id", "text") if c in results.columns]
    if include_vector:
        columns.append(F.col("embedding"))
    return results.select(*columns)


def results_to_json(queries: DataFrame, results: DataFrame, query_text: str = "query", *fields: str) -> DataFrame:
    """One JSON document per query: ``query, num_results, results[]`` in rank order."""
    fields = fields or ("rank", "node_id", "score", "distance")
    lists = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("r")))).alias("rows"))
    rows = F.coalesce(F.transform("rows", lambda x: x["r"]), F.array())
    joined = queries.select("query_id", query_text).join(lists, "query_id", "left")
    return joined.select("query_id", F.to_json(F.struct(F.col(query_text).alias("query"), F.greatest(F.size("rows"), F.lit(0)).alias("num_results"), rows.alias("results"))).alias("json"))


class Retriever:
    """Text search over an index of any kind: an object with ``search(queries, k)``, or a table of vectors."""

    def __init__(self, embedder, index, nodes: DataFrame, metric: str = "cosine", default_k: int = 5):
        self.embedder, self.index, self.nodes, self.metric, self.default_k = embedder, index, nodes, metric, default_k

    def embed(self, queries: DataFrame, text_col: str = "query") -> DataFrame:
        return self.embedder.embed(queries.where(F.length(F.trim(text_col)) > 0), text_col)

    def search(self, queries: DataFrame, k: int | None = None, least: float = 0.0, **options) -> DataFrame:
        k = k or self.default_k
        if hasattr(self.index, "search"):
            found = self.index.search(queries, k, **options)
        else:
            found = knn_join(queries, self.index, k, self.metric)
        return min_score(found.select("query_id", "rank", "node_id", "score", "distance"), least)

    def query(self, queries: DataFrame, k: int | None = None, least: float = 0.0, text_col: str = "query", **options) -> DataFrame:
        found = self.search(self.embed(queries, text_col).select("query_id", "embedding"), k, least, **options)
        extra = [c for c in ("chunk_id", "doc_id", "text") if c in self.nodes.columns]
        return format_results(with_metadata(found, self.nodes, *extra))

    def query_to_json(self, queries: DataFrame, k: int | None = None, least: float = 0.0, text_col: str = "query") -> DataFrame:
        return results_to_json(queries, self.query(queries, k, least, text_col), text_col)


def create_retriever(embedder, index, nodes: DataFrame, **options) -> Retriever:
    return Retriever(embedder, index, nodes, **options)
