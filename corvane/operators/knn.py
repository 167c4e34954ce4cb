"""Exact nearest neighbours for many queries at once.

Queries are worked off in blocks of bounded bytes and rows, each sent to the
executors on its own, and vectors in slices of bounded size, so that no matrix of
scores has more than ``CELLS`` numbers. A product of matrices finds the candidates;
their scores are then computed pair by pair, so that equal vectors have equal scores
wherever they stand, and ties go to the smaller id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..scratch import Scratch
from ..shipping import ship

#: Bytes and rows of a block of queries, and numbers in a matrix of scores.
QUERY_BYTES, QUERY_ROWS, CELLS = 8 << 20, 8192, 1 << 18
#: A block of more queries has the vectors dealt to all cores first; for fewer that would be more work than it spares.
DEALT_QUERIES = 256


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "node_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; ties by id. Spark keeps k rows a task before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "cosine", query_id: str = "query_id", query_vector: str = "embedding", node_id: str = "node_id", vector: str = "embedding", assume_normalized: bool = False, strategy: str = "auto") -> DataFrame:
    """``query_id, rank, node_id, score, distance``: each query's ``k`` nearest vectors.

    A larger score is nearer for every metric (Euclidean: minus the distance). Empty
    sides give an empty result; cosine with a zero vector raises. ``blas`` (and
    ``auto``) multiplies blocks of vectors with blocks of queries in Python and keeps
    k rows a task; ``expression`` scores all pairs in the JVM, for small query sets.
    Several blocks of queries are one job each, whose results are stored.
    """
    V.check_metric(metric)
    if k <= 0:
        raise ValueError("k must be positive")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv"))
    v = vectors.select(F.col(node_id).alias("node_id"), F.col(vector).alias("v"))
    if strategy == "expression":
        scored = v.join(q).select("query_id", "node_id", V.score("qv", "v", metric, assume_normalized).alias("score"))
    elif strategy in ("auto", "blas"):
        scored = _blas(q, v, k, metric, assume_normalized)
    else:
        raise ValueError("strategy must be auto, expression or blas")
    best = top_k(scored, k)
    return best.select("query_id", "rank", "node_id", "score", V.score_to_distance("score", metric).alias("distance"))


def scores(queries, block, metric: str):
    """A matrix that ranks vectors (columns) for queries (rows) like their scores."""
    dots = queries @ block.T
    if metric == "euclidean":
        dots *= 2
        dots -= (block**2).sum(1)[None, :]
    return dots


def pair_scores(q, v, metric: str, assume_normalized: bool):
    """The scores of rows of ``q`` and ``v``; the same numbers for the same pair, whatever stands beside it."""
    import numpy as np

    if metric == "euclidean":
        return -np.sqrt(((q - v) ** 2).sum(1))
    dots = (q * v).sum(1)
    if metric == "dot" or assume_normalized:
        return dots
    return dots / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def first_copies(nodes, block, k: int):
    """The rows without those of which ``k`` copies with smaller ids are there: no search for ``k`` finds them."""
    import numpy as np

    bits = np.ascontiguousarray(block).view(np.uint64)
    odd = np.random.default_rng(0).integers(0, 1 << 63, bits.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    key = (bits * odd[None, :]).sum(1, dtype=np.uint64)
    if len(np.unique(key)) == len(key):
        return nodes, block
    order = np.lexsort((nodes, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (block[order[1:]] != block[order[:-1]]).any(1)
    at = np.arange(len(order))
    kept = np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < k])
    return nodes[kept], block[kept]


class Best:
    """The ``k`` best (score, id) of each query over slices of vectors; ties by id.

    A vector is a candidate if it may reach the ``k``-th best score that its query has
    so far; candidates are held back and merged in bulk. Products for cosine and dot are
    those of rows no longer than 1 in single precision, with a bound of their error.
    """

    #: Candidates that are held back.
    HELD = 1 << 15

    def __init__(self, queries, k: int, metric: str, assume_normalized: bool = False):
        import numpy as np

        self.queries, self.k, self.metric, self.assume = np.asarray(queries, float), k, metric, assume_normalized
        self._best, self._held, self._n = None, [], 0
        #: The ``k``-th best score, for Euclidean in the unit of ``scores``; and lengths.
        self.least, self._length = np.full(len(self.queries), -np.inf), np.sqrt((self.queries**2).sum(1))
        self._ranked = self.queries
        if metric != "euclidean":
            self._ranked = (self.queries / np.where(self._length == 0, 1.0, self._length)[:, None]).astype(np.float32)

    def _scaled(self, block):
        """The block as ``scores`` takes it, what its numbers must be multiplied with for queries of length 1, and their error."""
        import numpy as np

        length = np.sqrt((block**2).sum(1))
        if self.metric == "euclidean":
            return block, 1.0, 1e-12 * (self._length**2 + length.max() ** 2)
        if self.metric == "cosine" and not self.assume:
            if (self._length == 0).any() or (length == 0).any():
                raise ValueError("cosine of a zero vector")
            unit = length[:, None]
        else:
            unit = float(length.max()) or 1.0
        # Each of the products and sums, and the rounding of rows and bounds, errs by 2 ** -24 at most; both sides of a comparison may.
        error = np.full(len(self.queries), 2.0 * (block.shape[1] + 8) * 2.0**-24)
        return (block / unit).astype(np.float32), 1.0 if isinstance(unit, np.ndarray) else unit, error

    def add(self, nodes, block, who=None) -> None:
        """``nodes`` are the ids (an array) of the rows of ``block``, which the queries ``who`` (numbers; all, if None) look at."""
        import numpy as np

        if not len(block) or not len(self.queries) or who is not None and not len(who):
            return
        nodes, block = first_copies(nodes, block, self.k)
        ranked, unit, error = self._scaled(block)
        height = min(len(self.queries), max(1, 2 * math.isqrt(CELLS)))
        for top in range(0, len(self.queries) if who is None else len(who), height):
            own = np.arange(top, min(top + height, len(self.queries))) if who is None else who[top : top + height]
            asked, slack = self._ranked[own], error[own]
            scale = unit * np.where(self._length[own] == 0, 1.0, self._length[own]) if self.metric == "dot" or self.metric == "cosine" and self.assume else 1.0
            step = max(1, CELLS // len(own))
            for at in range(0, len(block), step):
                got = scores(asked, ranked[at : at + step], self.metric)
                least = self.least[own] / scale
                if self.k < got.shape[1] and len(fresh := np.flatnonzero(np.isneginf(least))):
                    least[fresh] = np.partition(got[fresh], got.shape[1] - self.k, axis=1)[:, got.shape[1] - self.k]
                row, col = np.divmod(np.flatnonzero(got >= (least - slack).astype(got.dtype)[:, None]), got.shape[1])
                if not len(row):
                    continue
                row, col = own[row], col + at
                exact = np.empty(len(row))
                for i in range(0, len(row), 65536):
                    r, c = row[i : i + 65536], col[i : i + 65536]
                    exact[i : i + 65536] = pair_scores(self.queries[r], block[c], self.metric, self.assume)
                self._held.append((row, exact, nodes[col]))
                self._n += len(row)
                if self._n >= max(self.HELD, len(self._best[0]) if self._best else 0):
                    self._merge()

    def _merge(self) -> None:
        import numpy as np

        if not self._held:
            return
        row, score, node = (np.concatenate(x) for x in zip(*([self._best] if self._best else []), *self._held, strict=True))
        order = np.lexsort((node, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = place < self.k
        self._best, self._held, self._n = (row[keep], score[order][keep], node[order][keep]), [], 0
        last = place == self.k - 1
        row, score = row[last], score[order][last]
        if self.metric == "euclidean":
            score = (self.queries[row] ** 2).sum(1) - score**2
        self.least[row] = score

    @property
    def row(self):
        import numpy as np

        self._merge()
        return self._best[0] if self._best else np.empty(0, np.int64)

    @property
    def score(self):
        import numpy as np

        self._merge()
        return self._best[1] if self._best else np.empty(0)

    @property
    def node(self):
        self._merge()
        return self._best[2] if self._best else None


def query_blocks(q: DataFrame, most: int | None = None):
    """Bounded blocks of the query set, as (ids, matrix); a row streams to the driver only while its block fills."""
    import numpy as np

    ids, rows, size = [], [], 0
    for r in q.toLocalIterator(prefetchPartitions=True):
        ids.append(r["query_id"])
        rows.append(r["qv"])
        size += 8 * len(r["qv"])
        if size >= QUERY_BYTES or len(ids) >= min(QUERY_ROWS, most or QUERY_ROWS):
            yield ids, np.array(rows, float)
            ids, rows, size = [], [], 0
    if ids:
        yield ids, np.array(rows, float)


def by_query_block(q: DataFrame, search, schema: str, reduce, prepare=None, most: int | None = None) -> DataFrame:
    """What ``search(shared)`` finds for each block of queries, where ``shared`` is its broadcast (ids, matrix).

    ``prepare`` makes what is broadcast instead; blocks have at most ``most`` rows, if given.

    A single block stays a lazy plan. Of several, each is a job of its own: what
    ``reduce`` leaves of it is stored and its queries leave the executors before the
    next block is sent.
    """
    spark = q.sparkSession
    held, tmp, n = None, None, 0
    for block in query_blocks(q, most):
        if held is not None:
            tmp = tmp or Scratch(spark, "queries")
            tmp.append(reduce(search(held)), "found")
            held.destroy()
            n += 1
        held = spark.sparkContext.broadcast(prepare(*block) if prepare else block)
    if held is None:
        return spark.createDataFrame([], schema)
    if not n:
        return search(held)
    tmp.append(reduce(search(held)), "found")
    held.destroy()
    return tmp.table("found")


def _blas(q: DataFrame, v: DataFrame, k: int, metric: str, assume_normalized: bool) -> DataFrame:
    spark = v.sparkSession
    ship(spark)
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, node_id {v.schema['node_id'].dataType.simpleString()}, score double"

    def search(shared) -> DataFrame:
        def work(batches):
            import numpy as np
            import pyarrow as pa

            names, queries = shared.value
            best, kind = Best(queries, k, metric, assume_normalized), None
            for batch in batches:
                if batch.num_rows:
                    kind = batch.column(0).type
                    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                    best.add(np.array(batch.column(0).to_pylist()), flat.astype(float).reshape(batch.num_rows, -1))
            for at in range(0, len(best.row), 10_000):
                rows = best.row[at : at + 10_000].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in rows]), pa.array(best.node[at : at + 10_000].tolist(), kind), pa.array(best.score[at : at + 10_000])], ["query_id", "node_id", "score"])

        rows = v.select("node_id", "v")
        if len(shared.value[0]) > DEALT_QUERIES:
            # A file whose rows are one group is read by one task, however many splits it has.
            rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, "node_id")
        return rows.mapInArrow(work, schema)

    return by_query_block(q, search, schema, lambda found: top_k(found, k).drop("rank"))


class VectorStore:
    """An exact store: vectors with metadata, one dimension, ids in order of addition."""

    def __init__(self, spark, dimension: int, metric: str = "cosine", assume_normalized: bool = False):
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        self.spark, self.dimension, self.metric, self.assume_normalized = spark, dimension, V.check_metric(metric), assume_normalized
        self.rows = spark.createDataFrame([], "node_id long, embedding array<float>, metadata map<string,string>")
        self._n = 0

    def __len__(self) -> int:
        return self._n

    def __repr__(self) -> str:
        return f"VectorStore(dimension={self.dimension}, metric={self.metric!r}, vectors={self._n})"

    def add(self, vector, metadata: dict | None = None) -> int:
        return self.add_batch([vector], [metadata or {}])[0]

    def add_batch(self, vectors, metadata=None) -> list[int]:
        vectors = [[float(x) for x in v] for v in vectors]
        metadata = list(metadata) if metadata is not None else [{}] * len(vectors)
        if len(metadata) != len(vectors):
            raise ValueError("vectors and metadata differ in number")
        if any(len(v) != self.dimension for v in vectors):
            raise ValueError(f"vectors must have dimension {self.dimension}")
        ids = list(range(self._n, self._n + len(vectors)))
        new = self.spark.createDataFrame([(i, v, {str(a): str(b) for a, b in m.items()}) for i, v, m in zip(ids, vectors, metadata, strict=True)], self.rows.schema)
        self.rows, self._n = self.rows.unionByName(new), self._n + len(vectors)
        return ids

    def add_table(self, rows: DataFrame, vector: str = "embedding", metadata: str | None = None, order: str | None = None) -> None:
        """Appends a whole table; ids follow ``order`` within ranges of it (gaps are possible)."""
        new = rows.select(V.checked_vector(F.col(vector).cast("array<float>"), self.dimension).alias("embedding"), (F.col(metadata) if metadata else F.create_map().cast("map<string,string>")).alias("metadata"), *([F.col(order).alias("_o")] if order else []))
        new = new.orderBy("_o").drop("_o") if order else new
        new = new.select((F.monotonically_increasing_id() + self._n).alias("node_id"), "embedding", "metadata")
        self.rows = self.rows.unionByName(new)
        self._n = (self.rows.agg(F.max("node_id")).first()[0] or -1) + 1

    def search(self, queries: DataFrame, k: int = 5, query_id: str = "query_id", query_vector: str = "embedding", return_scores: bool = True, return_vectors: bool = False) -> DataFrame:
        found = knn_join(queries, self.rows, k, self.metric, query_id, query_vector, assume_normalized=self.assume_normalized)
        extra = ["metadata"] + ["embedding"] * return_vectors
        found = found.join(self.rows.select("node_id", *extra), "node_id")
        return found.select("query_id", "rank", "node_id", *(["score", "distance"] if return_scores else []), *extra)

    def get(self, node_id: int):
        if not 0 <= node_id < self._n:
            raise IndexError(f"no vector {node_id}")
        return self.rows.where(F.col("node_id") == node_id).first()

    def statistics(self) -> DataFrame:
        return store_statistics(self.rows, self.dimension, self.metric)


def store_statistics(rows: DataFrame, dimension: int, metric: str, metadata: str = "metadata") -> DataFrame:
    size = F.size("embedding") * 4 + F.length(F.to_json(metadata))
    return rows.agg(F.count(F.lit(1)).alias("num_vectors"), F.lit(dimension).alias("dimension"), F.lit(metric).alias("metric"), F.coalesce(F.sum(size), F.lit(0)).alias("memory_bytes"))


def create_vector_store(spark, dimension: int, algorithm: str = "brute_force", **options) -> VectorStore:
    if algorithm != "brute_force":
        raise ValueError("the exact store is brute_force; use corvane.operators.ann for graph indexes")
    return VectorStore(spark, dimension, **options)


def embedding_statistics(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Counts, dimension, norms, and the mean and population deviation over all elements."""
    x = rows.select(F.col(vector).alias("v"))
    norms = x.select(V.norm("v").alias("n"), F.size("v").alias("d"))
    elements = x.select(F.explode("v").alias("e")).select(F.col("e").cast("double").alias("e"))
    a = norms.agg(F.count(F.lit(1)).alias("num_embeddings"), F.coalesce(F.max("d"), F.lit(0)).alias("dimension"), F.avg("n").alias("mean_norm"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm"))
    return a.join(elements.agg(F.avg("e").alias("mean_value"), F.stddev_pop("e").alias("std_value")))
