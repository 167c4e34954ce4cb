"""Collections: documents indexed incrementally, searched, and asked questions of."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers as A
from .operators import chunking, context, incremental, prompts
from .operators.ann import SHARD_VECTORS, HNSWIndex, build_hnsw
from .operators.cache import AnswerCache
from .operators.embed import HashEmbedder
from .operators.knn import knn_join
from .operators.retrieval import min_score, with_metadata
from .sources.tables import Tables

ALGORITHMS = ("brute_force", "hnsw")
#: Part of replaced vectors, and shards beyond those that size asks for, above which an index is built anew.
MOST_STALE, MOST_SMALL_SHARDS = 0.1, 32
_CATALOG = "name string, algorithm string, created_at string, num_documents long, num_chunks long, num_embeddings long, metric string, model string"


class Collection:
    """A named set of documents with chunks, embeddings and an index in stored tables."""

    def __init__(self, spark: SparkSession, root: str, name: str, algorithm: str = "hnsw", metric: str = "cosine", chunk_size: int = 512, chunk_overlap: int = 50, embedder=None, cache: AnswerCache | None = None):
        if algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {ALGORITHMS}")
        chunking.check_chunking(chunk_size, chunk_overlap)
        self.spark, self.tables, self.name, self.algorithm, self.metric = spark, Tables(spark, root), name, algorithm, metric
        self.size, self.overlap, self.embedder, self.cache = chunk_size, chunk_overlap, embedder or HashEmbedder(), cache

    def _stored(self, kind: str) -> DataFrame | None:
        return self.tables.load(kind, self.name) if self.tables.exists(kind, self.name) else None

    def add_documents(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
        """Chunks and embeds what is new or changed, and drops what it replaces; a second run adds nothing.

        Rows without an id are left out; of rows of one id, the greatest text counts.
        """
        docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("doc_id").agg(F.max("text").alias("text"))
        manifest, chunks, vectors = self._stored("manifests"), self._stored("chunks"), self._stored("embeddings")
        if manifest is None:
            manifest = incremental.manifest_of(docs.limit(0), self.size, self.overlap)
        decisions = incremental.rechunk_decisions(docs, manifest, self.size, self.overlap)
        todo = incremental.changed_documents(docs, manifest, self.size, self.overlap).persist()
        made = chunking.chunk_documents(todo, self.size, self.overlap).persist()
        gone, fresh = None, made
        if chunks is not None:
            gone = incremental.superseded(chunks, todo).select("chunk_id").join(made.select("chunk_id"), "chunk_id", "left_anti")
            fresh = incremental.missing_embeddings(made, vectors)
        new_vectors = self.embedder.embed(fresh.select("chunk_id", "text")).select("chunk_id", "embedding").persist()
        counts = incremental.ingest_counters(decisions, made, new_vectors).first().asDict()
        if counts["new_documents"] or counts["updated_documents"]:
            # Only what is new is written. The manifest comes last: a run that fails before is simply done again.
            stale = 0 if gone is None else gone.count()
            self.tables.change("embeddings", self.name, new_vectors, gone, "chunk_id", "embedding", model=self.embedder.name)
            self.tables.change("chunks", self.name, made, todo, "doc_id")
            self._extend_index(new_vectors, stale)
            self.tables.change("manifests", self.name, incremental.manifest_of(todo, self.size, self.overlap), todo, "doc_id")
        for df in (new_vectors, made, todo):
            df.unpersist()
        self._catalog()
        return counts

    def vectors(self, verify: bool = False) -> DataFrame:
        """``node_id`` (the chunk's id), ``embedding``; embeddings without a chunk are left out."""
        rows = incremental.with_chunks(self.tables.load("embeddings", self.name, verify), self.tables.load("chunks", self.name))
        return rows.select(F.col("chunk_id").alias("node_id"), "embedding")

    def _build(self) -> None:
        if self.algorithm == "hnsw":
            self.tables.save("indexes", self.name, build_hnsw(self.vectors(), self.metric), metric=self.metric, ef_search=50, m=16, ef_construction=200, stale=0)

    def _extend_index(self, new_vectors: DataFrame, stale: int) -> None:
        """New vectors become shards of their own; too many shards or replaced vectors have the index built anew."""
        if self.algorithm != "hnsw":
            return
        info = self.tables.info("indexes", self.name)
        stale += int(info["properties"].get("stale", 0)) if info else 0
        live = self.tables.info("embeddings", self.name)["rows"]
        if info is None or stale > MOST_STALE * live or info["rows"] > MOST_SMALL_SHARDS + live // SHARD_VECTORS:
            self._build()
        else:
            fresh = build_hnsw(new_vectors.select(F.col("chunk_id").alias("node_id"), "embedding"), self.metric)
            self.tables.change("indexes", self.name, fresh, stale=stale)

    def index(self, verify: bool = True):
        """The stored index, built anew if it is missing; for brute force the vectors.

        What is stored is compared with its manifest, unless ``verify`` is off; each
        part once for each collection object.
        """
        if self.algorithm == "brute_force":
            return self.vectors(verify)
        if not self.tables.exists("indexes", self.name):
            self._build()
        info = self.tables.info("indexes", self.name)["properties"]
        return HNSWIndex(self.tables.load("indexes", self.name, verify), info["metric"], int(info["ef_search"]), int(info["m"]), int(info["ef_construction"]))

    def search(self, queries: DataFrame, k: int = 5, least: float = 0.0, ef_search: int | None = None, text_col: str = "query") -> DataFrame:
        """``query_id, rank, node_id, score, distance, chunk_id, doc_id, text`` for rows of ``query_id, query``."""
        if not self.tables.exists("chunks", self.name):
            return self.spark.createDataFrame([], "query_id long, rank int, node_id string, score double, distance double, chunk_id string, doc_id string, text string")
        asked = self.embedder.embed(queries.where(F.length(F.trim(text_col)) > 0), text_col)
        index = self.index()
        chunks = self.tables.load("chunks", self.name).select(F.col("chunk_id").alias("node_id"), "chunk_id", "doc_id", "text")
        if isinstance(index, DataFrame):
            found = knn_join(asked, index, k, self.metric)
        else:
            # A graph may still hold replaced vectors: it is searched on until k with a chunk are found.
            stale = int(self.tables.info("indexes", self.name)["properties"].get("stale", 0))
            found = index.search(asked, k, ef_search, live=chunks.select("node_id") if stale else None)
        found = with_metadata(min_score(found, least), chunks, "chunk_id", "doc_id", "text")
        return found.select("query_id", "rank", "node_id", "score", "distance", "chunk_id", "doc_id", "text")

    def prompts(self, queries: DataFrame, k: int = 5, template: str = "qa", max_context_length: int = 4000, history: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """Prompts of many questions, and their sources."""
        results = self.search(queries, k, **options)
        rows = queries.join(context.contexts(results, max_context_length), "query_id", "left")
        if history is not None:
            rows = rows.join(history.select("query_id", "history"), "query_id", "left")
        built = rows.withColumn("prompt", prompts.prompt(template, "context", "query", "history" if history is not None else None))
        return built, context.sources(results, max_context_length)

    def generate_answers(self, queries: DataFrame, generate, k: int = 5, template: str = "qa", high_score: float = A.HIGH_SCORE, **options) -> DataFrame:
        """``query_id, query, answer, sources, confidence, level, warnings`` by ``generate``, a function of a prompt table that adds ``answer``."""
        built, source_rows = self.prompts(queries, k, template, **options)
        answered = generate(built)
        marked = context.mark_cited(source_rows, answered)
        lists = marked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("citation_num", "chunk_id", "doc_id", "text", "score", "cited"))).alias("sources"), A.confidence_aggregate("score", high_score).alias("confidence"))
        out = answered.join(lists, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        answer = F.when(F.col("sources").isNull(), "No relevant sources were found.").otherwise(F.col("answer"))
        return out.select("query_id", "query", answer.alias("answer"), "sources", "confidence", A.confidence_level("confidence").alias("level"), A.citation_warnings("answer", F.coalesce(F.size("sources"), F.lit(0))).alias("warnings"))

    def answer(self, question: str, client, k: int = 5, template: str = "qa", history: str | None = None, **options) -> dict:
        """One question, through the cache if there is one."""
        key = None
        if self.cache is not None and history is None:
            key = f"{self.name}\x1f{k}\x1f{template}\x1f{sorted(options.items())}\x1f{question.strip().lower()}"
            if (hit := self.cache.get(key)) is not None:
                return hit | {"cached": True}
        q = self.spark.createDataFrame([(0, question)], "query_id long, query string")
        past = None if history is None else self.spark.createDataFrame([(0, history)], "query_id long, history string")
        built, _ = self.prompts(q, k, template, history=past, **options)
        prompt = built.first()["prompt"]
        try:
            text, error = client.generate(prompt), None
        except Exception as e:
            text, error = "", f"{type(e).__name__}: {e}"
        done = self.generate_answers(q, lambda rows: rows.withColumn("answer", F.lit(text)), k, template, **options).first().asDict(recursive=True)
        done |= {"cached": False, "error": error, "confidence": 0.0 if error else done["confidence"]}
        if key is not None and error is None:
            self.cache.set(key, done, self.name)
        return done

    def info(self) -> dict:
        """Counts of this collection alone."""
        chunks, vectors, manifest = self._stored("chunks"), self._stored("embeddings"), self._stored("manifests")
        return {
            "name": self.name, "algorithm": self.algorithm, "metric": self.metric, "model": self.embedder.name,
            "num_documents": manifest.count() if manifest is not None else 0,
            "num_chunks": chunks.count() if chunks is not None else 0,
            "num_embeddings": vectors.count() if vectors is not None else 0,
        }

    def _catalog(self) -> None:
        i = self.info()
        row = self.spark.createDataFrame([(i["name"], i["algorithm"], datetime.now(timezone.utc).isoformat(), i["num_documents"], i["num_chunks"], i["num_embeddings"], i["metric"], i["model"])], _CATALOG)
        self.tables.upsert("catalog", "collections", row, "name")

    def delete(self) -> None:
        for kind in ("chunks", "embeddings", "manifests", "indexes"):
            self.tables.delete(kind, self.name)
        if self.tables.exists("catalog", "collections"):
            self.tables.save("catalog", "collections", self.tables.load("catalog", "collections").where(F.col("name") != self.name))
        if self.cache is not None:
            self.cache.invalidate_collection(self.name)


def create_collection(spark: SparkSession, root: str, name: str, algorithm: str = "brute_force", **options) -> Collection:
    c = Collection(spark, root, name, algorithm, **options)
    c._catalog()
    return c


def list_collections(spark: SparkSession, root: str) -> DataFrame:
    t = Tables(spark, root)
    return t.load("catalog", "collections").orderBy("name") if t.exists("catalog", "collections") else spark.createDataFrame([], _CATALOG)


def collection_metadata(spark: SparkSession, root: str, name: str) -> dict | None:
    r = list_collections(spark, root).where(F.col("name") == name).first()
    return None if r is None else r.asDict()


def load_collection(spark: SparkSession, root: str, name: str, **options) -> Collection:
    meta = collection_metadata(spark, root, name)
    if meta is None:
        raise ValueError(f"no collection named {name!r}")
    return Collection(spark, root, name, meta["algorithm"], meta["metric"], **options)


def delete_collection(spark: SparkSession, root: str, name: str) -> None:
    load_collection(spark, root, name).delete()


def search_export(query: str, collection: str, results: DataFrame) -> DataFrame:
    """One JSON document: ``query, collection, num_results, results[{score, chunk_id, text}]``."""
    lists = results.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score", "chunk_id", "text"))), lambda x: F.struct(x["score"].alias("score"), x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))).alias("results"))
    return lists.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(collection).alias("collection"), F.size("results").alias("num_results"), "results")).alias("json"))

