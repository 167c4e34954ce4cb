"""Approximate nearest neighbours: sharded HNSW graphs and inverted lists.

Vectors are dealt to shards by a hash of their id. Each shard builds one graph
(Malkov and Yashunin, 2016) in a Python worker and stores it as one row of node
and edge arrays; a search runs all queries through all shards and merges exactly.
Shards are of bounded size, so more data means more shards, never larger ones.

A graph is built in bulk: nodes are inserted in order, and the candidates of a node
are the nearest of those before it on its layer, found by products of matrices over
blocks of nodes instead of a search of the graph so far. Neighbours are chosen and
lists are shortened as in single insertions.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..scratch import Scratch
from ..shipping import ship
from .knn import CELLS, Best, by_query_block, knn_join, top_k

SHARD_VECTORS = 20_000
#: Nodes that a search holds for each one that ``ef_search`` asks for: queries far from all vectors need them.
BEAM = 3
#: Nodes whose distances to all before them are computed at once.
BLOCK_NODES = 256
#: Bytes of the cell centres of inverted lists, and queries from which the number of probes is learned, at least.
CENTRE_BYTES, TUNING_QUERIES = 64 << 20, 1024
#: Standard errors by which the recall of those queries, unless they are all, must exceed what is asked for.
MARGIN = 3
#: Rows of a part of the inverted lists, and numbers in the table of a block's queries and cells.
LIST_ROWS, QUERY_CELLS = 1 << 16, 1 << 24


class _Lists:
    """Neighbours of one layer in two flat lists."""

    def __init__(self, start: list[int], ends: list[int]):
        self.start, self.ends = start, ends

    def get(self, node: int, default=()) -> list[int]:
        return self.ends[self.start[node] : self.start[node + 1]]

    def items(self):
        return ((n, self.get(n)) for n in range(len(self.start) - 1))


def _scattered(nodes):
    """An order of equally near nodes that favours none: else the first ones would get all links, the last ones none."""
    import numpy as np

    return (nodes.astype(np.int64) + 1) * 0x9E3779B1 & 0xFFFFFFFF


class Graph:
    """One HNSW graph over a matrix. ``links[layer].get(node)`` are the neighbours."""

    def __init__(self, dimension: int, metric: str = "cosine", m: int = 16, ef_construction: int = 200, ef_search: int = 50, seed: int = 42):
        import numpy as np

        if dimension <= 0 or m < 2 or ef_construction < 1:
            raise ValueError("dimension, m and ef_construction must be positive, m at least 2")
        self.metric, self.m, self.ef_construction, self.ef_search = V.check_metric(metric), m, ef_construction, ef_search
        self._hold(np.empty((0, dimension)))
        self.links: list = []
        self.levels: list[int] = []
        self.entry = -1
        self.rng = np.random.default_rng(seed)

    def __len__(self) -> int:
        return len(self.levels)

    def _hold(self, matrix) -> None:
        """Keeps vectors, and beside them those that distances are computed from: of unit length for cosine."""
        import numpy as np

        self.vectors = matrix
        self.scaled = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30) if self.metric == "cosine" else matrix

    def _asked(self, q):
        import numpy as np

        q = np.asarray(q, np.float64)
        if q.shape != self.vectors.shape[1:]:
            raise ValueError(f"vectors must have dimension {self.vectors.shape[1]}")
        return q / max(float(np.linalg.norm(q)), 1e-30) if self.metric == "cosine" else q

    def _level(self) -> int:
        """A level of at least l has the probability 2 ** -l."""
        return int(-math.log(1.0 - self.rng.random()) / math.log(2))

    def _most(self, layer: int) -> int:
        return 2 * self.m if layer == 0 else self.m

    def _distances(self, q, nodes):
        """Distances of nodes from ``q``, of unit length for cosine."""
        import numpy as np

        v = self.scaled[nodes]
        if self.metric == "euclidean":
            return np.sqrt(((v - q) ** 2).sum(1))
        return 1 - v @ q if self.metric == "cosine" else -(v @ q)

    def _matrix(self, a, b):
        """Distances of the nodes ``a`` from the nodes ``b``."""
        import numpy as np

        x, y = self.scaled[a], self.scaled[b]
        dots = x @ y.T
        if self.metric == "euclidean":
            return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * dots, 0))
        return 1 - dots if self.metric == "cosine" else -dots

    def _beam(self, q, start: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found from ``start``, nearest first."""
        seen = {n for _, n in start}
        near = list(start)
        heapq.heapify(near)
        best = [(-d, n) for d, n in start]
        heapq.heapify(best)
        links, push, distances = self.links[layer].get, heapq.heappush, self._distances
        while near:
            d, node = heapq.heappop(near)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [n for n in links(node, ()) if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            least = -best[0][0] if len(best) >= width else math.inf
            for e, n in zip(distances(q, fresh).tolist(), fresh, strict=True):
                if e < least:
                    if len(best) < width:
                        push(best, (-e, n))
                    else:
                        heapq.heapreplace(best, (-e, n))
                    if len(best) >= width:
                        least = -best[0][0]
                    push(near, (e, n))
        return sorted((-d, n) for d, n in best)[:width]

    def _diverse(self, distances, nodes, most: int) -> list[int]:
        """Of nodes from the nearest on: those nearer to the new node than to those taken already; filled up with the nearest."""
        import numpy as np

        if len(nodes) <= most:
            return [int(n) for n in nodes]
        between = self._matrix(nodes, nodes)
        near, taken, left = np.full(len(nodes), math.inf), [], []
        for i, d in enumerate(distances.tolist()):
            if len(taken) == most:
                break
            if d < near[i]:
                taken.append(i)
                np.minimum(near, between[i], out=near)
            else:
                left.append(i)
        return [int(n) for n in nodes[taken + left[: most - len(taken)]]]

    def _shorten(self, layer: int, node: int) -> None:
        import numpy as np

        theirs = np.array(self.links[layer][node])
        d = self._matrix([node], theirs)[0]
        order = np.lexsort((_scattered(theirs), d))
        self.links[layer][node] = self._diverse(d[order], theirs[order], self._most(layer))

    def _link(self, layer: int, node: int, distances, nodes, slack: int = 1) -> None:
        """Links a node with the best of its candidates, nearest first, both ways; lists may outgrow their length by ``slack`` times."""
        most, links = self._most(layer), self.links[layer]
        links[node] = self._diverse(distances, nodes, most)
        for n in links[node]:
            theirs = links.setdefault(n, [])
            theirs.append(node)
            if len(theirs) > slack * most:
                self._shorten(layer, n)

    def insert(self, vector) -> int:
        import numpy as np

        node, level = len(self.levels), self._level()
        q = self._asked(vector)
        self.links = [x if isinstance(x, dict) else dict(x.items()) for x in self.links]
        if node == len(self.scaled):
            # Room for as many again; rows beyond ``levels`` are not read.
            room = np.zeros((max(16, len(self.scaled)), len(q)))
            self.vectors, self.scaled = np.concatenate([self.vectors, room]), np.concatenate([self.scaled, room])
        self.vectors[node], self.scaled[node] = np.asarray(vector, np.float64), q
        top = len(self.links) - 1
        self.levels.append(level)
        while len(self.links) <= level:
            self.links.append({})
        if node:
            at = [(float(self._distances(q, [self.entry])[0]), self.entry)]
            for layer in range(top, level, -1):
                at = self._beam(q, at, layer, 1)
            for layer in range(min(level, top), -1, -1):
                at = self._beam(q, at, layer, self.ef_construction)
                self._link(layer, node, np.array([d for d, _ in at]), np.array([n for _, n in at]))
        for layer in range(level + 1):
            self.links[layer].setdefault(node, [])
        if level > top or not node:
            self.entry = node
        return node

    @staticmethod
    def bulk(matrix, metric: str = "cosine", m: int = 16, ef_construction: int = 200, ef_search: int = 50, seed: int = 42) -> Graph:
        """The graph of all rows of a matrix, inserted in order."""
        import numpy as np

        g = Graph(matrix.shape[1], metric, m, ef_construction, ef_search, seed)
        g._hold(np.asarray(matrix, np.float64))
        g.levels = [g._level() for _ in range(len(matrix))]
        levels = np.array(g.levels, np.int64)
        for layer in range(int(levels.max(initial=-1)) + 1):
            nodes = np.flatnonzero(levels >= layer)
            g.links.append({int(n): [] for n in nodes})
            for at in range(0, len(nodes), BLOCK_NODES):
                block = nodes[at : at + BLOCK_NODES]
                d = g._matrix(block, nodes[: at + len(block)])
                for i, node in enumerate(block.tolist()):
                    if not (before := at + i):
                        continue
                    own = d[i, :before]
                    near = np.argpartition(own, ef_construction)[:ef_construction] if before > ef_construction else np.arange(before)
                    near = near[np.lexsort((_scattered(near), own[near]))]
                    g._link(layer, node, own[near], nodes[near], slack=2)
            for node, theirs in g.links[layer].items():
                if len(theirs) > g._most(layer):
                    g._shorten(layer, node)
        g.entry = int(np.argmax(levels)) if len(levels) else -1
        return g

    def search(self, q, k: int = 5, ef_search: int | None = None, live: set[int] | None = None) -> list[tuple[float, int]]:
        """(distance, node) of the ``k`` nearest found; an empty graph gives nothing.

        With ``live`` other nodes only lead the way. The beam is widened until ``k``
        nodes that count are found, or all.
        """
        if k <= 0:
            raise ValueError("k must be positive")
        if not self.levels:
            return []
        q = self._asked(q)
        at = [(float(self._distances(q, [self.entry])[0]), self.entry)]
        for layer in range(len(self.links) - 1, 0, -1):
            at = self._beam(q, at, layer, 1)
        width = BEAM * max(ef_search or self.ef_search, k)
        wanted = min(k, len(self) if live is None else len(live))
        while True:
            found = self._beam(q, at, 0, width)
            if live is not None:
                found = [x for x in found if x[1] in live]
            if len(found) >= wanted:
                return found[:k]
            if width >= len(self):
                break
            width *= 2
        # Nodes that no link leads to are compared one by one.
        met = {n for _, n in found}
        rest = [n for n in (range(len(self)) if live is None else sorted(live)) if n not in met]
        return sorted(found + list(zip(self._distances(q, rest).tolist(), rest, strict=True)))[:k]

    def edges(self) -> tuple[list[int], list[int], list[int]]:
        """Layers, sources and ends of all links, in this order."""
        layer, src, dst = [], [], []
        for i, links in enumerate(self.links):
            for a, ns in sorted(links.items()):
                layer += [i] * len(ns)
                src += [a] * len(ns)
                dst += ns
        return layer, src, dst

    @staticmethod
    def restore(matrix, levels, layer, src, dst, **options) -> Graph:
        """A graph from its arrays, as :meth:`edges` gives them."""
        import numpy as np

        g = Graph(matrix.shape[1], **options)
        g._hold(np.asarray(matrix, np.float64))
        levels, layer, src, dst = (np.asarray(x, np.int64) for x in (levels, layer, src, dst))
        g.levels = levels.tolist()
        for i in range(int(levels.max(initial=-1)) + 1):
            a, b = np.searchsorted(layer, [i, i + 1])
            g.links.append(_Lists(np.searchsorted(src[a:b], np.arange(len(levels) + 1)).tolist(), dst[a:b].tolist()))
        g.entry = int(np.argmax(levels)) if len(levels) else -1
        return g


_GRAPHS = "shard int, ids array<{id}>, dimension int, vectors array<float>, levels array<int>, layer array<int>, src array<int>, dst array<int>"


def _partition(key: int, n: int) -> int:
    """The partition of ``n`` that Spark's hash partitioning (Murmur3 of a long, seed 42) deals a key to."""
    rotated = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    h = 42
    for part in (key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF):
        h ^= rotated(part * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rotated(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % n


def _spread(n: int) -> list[int]:
    """``n`` keys that fall into ``n`` different partitions; beyond a thousand, chance is even enough."""
    if n > 1000:
        return list(range(n))
    keys: dict[int, int] = {}
    key = 0
    while len(keys) < n:
        keys.setdefault(_partition(key, n), key)
        key += 1
    return [keys[p] for p in range(n)]


def _dealt(rows: DataFrame, number, n: int) -> DataFrame:
    """``rows`` with ``_key``, in ``n`` partitions by it: one for each ``number`` from 0 to n - 1, whatever adaptive execution merges."""
    keys = F.array(*[F.lit(int(x)) for x in _spread(n)]).cast("array<bigint>")
    return rows.withColumn("_key", F.get(keys, number)).repartition(n, "_key")


def build_hnsw(vectors: DataFrame, metric: str = "cosine", m: int = 16, ef_construction: int = 200, shards: int | None = None, seed: int = 42, node_id: str = "node_id", vector: str = "embedding") -> DataFrame:
    """One row per shard: its graph. Rows are dealt by the hash of the id and inserted in order of it; an empty table has no graph."""
    V.check_metric(metric)
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(node_id).alias("node_id"), F.col(vector).cast("array<float>").alias("embedding"))
    shards = shards or max(1, -(-rows.count() // SHARD_VECTORS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("node_id"), F.lit(shards)).cast("int"))
    kind = rows.schema["node_id"].dataType.simpleString()

    def build(table):
        import pyarrow as pa

        table = table.sort_by("node_id")
        matrix = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        g = Graph.bulk(matrix, metric, m, ef_construction, seed=seed)
        layer, src, dst = g.edges()
        columns = [table["shard"][0].as_py(), table["node_id"].to_pylist(), matrix.shape[1], matrix.ravel(), g.levels, layer, src, dst]
        id_type = table.schema.field("node_id").type
        ints = pa.list_(pa.int32())
        types = [pa.int32(), pa.list_(id_type), pa.int32(), pa.list_(pa.float32()), ints, ints, ints, ints]
        names = ["shard", "ids", "dimension", "vectors", "levels", "layer", "src", "dst"]
        return pa.Table.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], names)

    return _dealt(rows, F.col("shard"), shards).groupBy("_key").applyInArrow(build, _GRAPHS.format(id=kind))


def search_hnsw(graphs: DataFrame, queries: DataFrame, k: int = 5, ef_search: int = 50, metric: str = "cosine", query_id: str = "query_id", query_vector: str = "embedding", shards: int | None = None, blocks: int | None = None, live: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, node_id, score, distance``; an empty index gives an empty result.

    With fewer ``shards`` than cores, ``blocks`` copies of each graph share its queries.
    With ``live``, a table of ``node_id``, only those are found, each once if several
    graphs hold it; every shard still gives ``k`` if it has them.
    """
    if k <= 0 or blocks is not None and blocks <= 0:
        raise ValueError("k and blocks must be positive")
    spark = graphs.sparkSession
    ship(spark)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv"))
    kind = graphs.schema["ids"].dataType.elementType.simpleString()
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, node_id {kind}, distance double"
    blocks = blocks or max(1, spark.sparkContext.defaultParallelism // (shards or graphs.count() or 1))
    if live is not None:
        # A shard's nodes are bounded, and so is the list of those that count.
        graphs = graphs.withColumn("_graph", F.xxhash64("shard", "ids"))
        nodes = graphs.select("_graph", F.posexplode("ids").alias("pos", "node_id")).join(live.select("node_id").distinct(), "node_id", "left_semi")
        graphs = graphs.join(nodes.groupBy("_graph").agg(F.collect_list("pos").alias("live")), "_graph")
    else:
        graphs = graphs.withColumn("live", F.lit(None).cast("array<int>"))
    dealt = graphs.select("ids", "vectors", "levels", "layer", "src", "dst", "live", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard")
    if blocks > 1 and shards:
        dealt = _dealt(dealt, F.col("shard") * blocks + F.col("block"), shards * blocks)
    elif blocks > 1:
        dealt = dealt.repartition("shard", "block")

    def search(shared) -> DataFrame:
        def work(batches):
            import numpy as np
            import pyarrow as pa

            names, rows = shared.value
            for batch in batches:
                for r in range(batch.num_rows):
                    one = {n: batch.column(n)[r].values.to_numpy(zero_copy_only=False) for n in ("vectors", "levels", "layer", "src", "dst")}
                    nodes = batch.column("ids")[r].as_py()
                    matrix = one.pop("vectors").astype(np.float64).reshape(len(nodes), -1)
                    g = Graph.restore(matrix, **one, metric=metric, ef_search=ef_search)
                    own, some = range(batch.column("block")[r].as_py(), len(names), blocks), batch.column("live")[r].as_py()
                    some = None if some is None else set(some)
                    hits = [(names[i], nodes[n], d) for i in own for d, n in g.search(rows[i], k, ef_search, some)]
                    if not hits:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits]), pa.array([h[1] for h in hits], batch.column("ids").type.value_type), pa.array([h[2] for h in hits], pa.float64())], ["query_id", "node_id", "distance"])

        return dealt.mapInArrow(work, schema).withColumn("score", V.distance_to_score("distance", metric))

    found = by_query_block(q, search, schema + ", score double", lambda x: top_k(x, k).drop("rank") if live is None else x)
    if live is not None:
        found = found.groupBy("query_id", "node_id").agg(F.max("score").alias("score"), F.min("distance").alias("distance"))
    return top_k(found, k).select("query_id", "rank", "node_id", "score", "distance")


def hnsw_nodes(graphs: DataFrame) -> DataFrame:
    """(shard, node_id, level)"""
    rows = graphs.select("shard", F.posexplode(F.arrays_zip("ids", "levels")).alias("n", "x"))
    return rows.select("shard", F.col("x.ids").alias("node_id"), F.col("x.levels").alias("level"))


def hnsw_edges(graphs: DataFrame) -> DataFrame:
    """(shard, layer, src, dst) with the nodes' ids."""
    rows = graphs.select("shard", "ids", F.explode(F.arrays_zip("layer", "src", "dst")).alias("x"))
    return rows.select("shard", F.col("x.layer").alias("layer"), F.get("ids", F.col("x.src")).alias("src"), F.get("ids", F.col("x.dst")).alias("dst"))


def hnsw_statistics(graphs: DataFrame) -> DataFrame:
    """Per layer: nodes on it or above, edges, mean neighbours; and the index's estimated bytes."""
    per = hnsw_nodes(graphs).select(F.explode(F.sequence(F.lit(0), "level")).alias("layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("num_nodes"))
    links = graphs.select(F.explode("layer").alias("layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("num_edges"))
    size = graphs.agg(F.sum(F.size("vectors") * 4 + F.size("ids") * 1024 + F.size("src") * 4).alias("memory_bytes"))
    both = per.join(links, "layer", "left").withColumn("num_edges", F.coalesce("num_edges", F.lit(0)))
    return both.withColumn("avg_neighbors", F.col("num_edges") / F.col("num_nodes")).join(size)


class HNSWIndex:
    """A sharded index with its parameters, which a saved index keeps."""

    def __init__(self, graphs: DataFrame, metric: str, ef_search: int = 50, m: int = 16, ef_construction: int = 200, shards: int | None = None):
        self.graphs, self.metric, self.ef_search, self.m, self.ef_construction, self.shards = graphs, metric, ef_search, m, ef_construction, shards

    @staticmethod
    def build(vectors: DataFrame, metric: str = "cosine", m: int = 16, ef_construction: int = 200, ef_search: int = 50, shards: int | None = None, **options) -> HNSWIndex:
        """Builds all graphs and stores them, so that no search builds them again."""
        shards = shards or max(1, -(-vectors.count() // SHARD_VECTORS))
        graphs = build_hnsw(vectors, metric, m, ef_construction, shards, **options)
        return HNSWIndex(Scratch(vectors.sparkSession, "hnsw").save(graphs, "graphs"), metric, ef_search, m, ef_construction, shards)

    def search(self, queries: DataFrame, k: int = 5, ef_search: int | None = None, **options) -> DataFrame:
        return search_hnsw(self.graphs, queries, k, ef_search or self.ef_search, self.metric, **({"shards": self.shards} | options))

    def statistics(self) -> DataFrame:
        return hnsw_statistics(self.graphs)


def centroids(vectors: DataFrame, cells: int, rounds: int = 5, seed: int = 42, sample: int = 20_000, vector: str = "embedding", metric: str = "cosine", key: str | None = None):
    """K-means cell centres of a sample of at most about ``sample`` vectors (of unit length for cosine); None without vectors.

    The sample is drawn by a hash of the column ``key``, which tells copies apart, or of the vector.
    """
    import numpy as np

    n = vectors.count()
    part = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64(key or vector), F.lit(n // sample + 1)) == 0)
    x = np.array([r[0] for r in part.select(vector).where(F.col(vector).isNotNull()).collect()], float)
    if not len(x):
        return None
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30) if metric == "cosine" else v
    x = unit(x)
    x = x[np.lexsort(x.T[::-1])]
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = _cell_order(x, c, metric if metric == "cosine" else "euclidean", 1)[:, 0]
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c = unit(c)
    return c


def _cell_order(x, centers, metric: str, most: int):
    """The ``most`` best cells of each row, best first; ties by number."""
    import numpy as np

    far = -(x @ centers.T)
    if metric == "euclidean":
        far = 2 * far + (centers**2).sum(1)[None, :]
    return np.argmin(far, axis=1)[:, None] if most == 1 else np.argsort(far, axis=1, kind="stable")[:, :most]


def _with_cells(rows: DataFrame, centers, metric: str, most: int, vector: str, out: str = "cells") -> DataFrame:
    """``rows`` with an array of the numbers of their ``most`` best cells; null vectors have none."""
    spark = rows.sparkSession
    ship(spark)
    if centers.nbytes > CENTRE_BYTES:
        raise ValueError(f"the centres would be larger than {CENTRE_BYTES} bytes")
    shared, at = spark.sparkContext.broadcast(centers), rows.columns.index(vector)
    names = [*rows.columns, out]

    def work(batches):
        import numpy as np
        import pyarrow as pa

        step = max(1, min(1024, CELLS // len(shared.value)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                x, known = part.column(at), np.flatnonzero(part.column(at).is_valid().to_numpy(zero_copy_only=False))
                flat = x.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(known), -1) if len(known) else None
                own = [[] for _ in range(part.num_rows)]
                if flat is not None:
                    for k, cells in zip(known.tolist(), _cell_order(flat, shared.value, metric, most).tolist(), strict=True):
                        own[k] = cells
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.list_(pa.int32()))], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{fields}, `{out}` array<int>")


def _probes(asked, cells, truth, centers, metric: str, recall: float, population: int) -> int:
    """The least number of probes with which ``asked``, a sample of ``population`` queries, finds ``recall`` of the truth, with a margin.

    ``truth`` are numbers of queries, ``cells`` where the true neighbours of those are.
    """
    import numpy as np

    place = np.empty(len(truth), np.int64)
    for i in range(0, len(asked), step := max(1, CELLS // len(centers))):
        order = _cell_order(asked[i : i + step], centers, metric, len(centers))
        own = np.flatnonzero((truth >= i) & (truth < i + step))
        place[own] = np.argsort(order, axis=1)[truth[own] - i, cells[own]]
    total = np.bincount(truth, minlength=len(asked))
    known = total > 0
    n, size, found = int(known.sum()), len(centers), np.zeros(len(asked))
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(size), "right")
    for p in range(size):
        found += np.bincount(truth[order[ends[p - 1] if p else 0 : ends[p]]], minlength=len(asked))
        share = found[known] / total[known]
        if not n or share.mean() - MARGIN * share.std() * math.sqrt(max(0, 1 - n / population) / n) >= recall:
            return p + 1
    return size


def _askers(asked, centers, sizes, metric: str, probes: int, k: int):
    """For each cell the numbers of the queries that look into it, as (start, queries): their ``probes`` best cells, and more until ``k`` vectors are there."""
    import numpy as np

    order = _cell_order(asked, centers, metric, len(centers))
    met = np.cumsum(sizes[order], axis=1)
    need = (met < min(k, int(sizes.sum()))).sum(1) + 1
    row, at = np.nonzero(np.arange(len(centers))[None, :] < np.maximum(need, probes)[:, None])
    cell = order[row, at]
    return np.searchsorted(np.sort(cell), np.arange(len(centers) + 1)), row[np.argsort(cell, kind="stable")].astype(np.int32)


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int = 5, cells: int | None = None, probes: int | None = None, metric: str = "cosine", node_id: str = "node_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", recall: float = 0.95) -> DataFrame:
    """Inverted lists: each vector is in its nearest cell, and a query looks into its ``probes`` best cells, and more until it has met ``k`` vectors.

    ``cells`` is the square root of the number of vectors unless given. ``probes``,
    unless given, is the least number with which a sample of ``TUNING_QUERIES`` to
    twice as many queries finds ``recall`` of its true neighbours and three standard
    errors more; of fewer queries all count, without a margin. The lists are stored by
    cell; a task multiplies a cell's vectors with the queries that look into it and
    keeps ``k`` rows of each query. Null vectors are in no cell. An empty side gives an
    empty result.
    """
    import numpy as np

    V.check_metric(metric)
    if k <= 0 or probes is not None and probes <= 0:
        raise ValueError("k and probes must be positive")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(node_id).alias("node_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    asks = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv")).where(F.col("qv").isNotNull())
    ids = asks.schema["query_id"].dataType.simpleString(), rows.schema["node_id"].dataType.simpleString()
    n = rows.count()
    centers = centroids(rows, min(cells or max(1, math.isqrt(n)), 1 << 16), vector="v", metric=metric, key="node_id") if n else None
    if centers is None:
        return spark.createDataFrame([], f"query_id {ids[0]}, rank int, node_id {ids[1]}, score double, distance double")
    placed = _with_cells(rows, centers, metric if metric == "cosine" else "euclidean", 1, "v", "own").select("node_id", "v", F.get("own", F.lit(0)).alias("cell"))
    # Copies lie side by side, where all but k of them are put aside, and a crowded cell is in several parts.
    by = ["cell", F.xxhash64("v"), "node_id"]
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-n // LIST_ROWS))
    lists = Scratch(spark, "ivf").save(placed.repartitionByRange(parts, *by).sortWithinPartitions(*by), "lists")
    sizes = np.zeros(len(centers), np.int64)
    for r in lists.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    if probes is None:
        population = asks.count()
        some = asks.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, population // TUNING_QUERIES))) == 0)
        truth = knn_join(some, lists, k, metric, query_vector="qv", vector="v").select("query_id", "node_id")
        where = lists.select("node_id", "cell").join(F.broadcast(truth), "node_id").select("query_id", "cell").collect()
        asked = {r["query_id"]: r["qv"] for r in some.collect()}
        number = {q: i for i, q in enumerate(asked)}
        own = [np.array(x, np.int64) for x in ([r["cell"] for r in where], [number[r["query_id"]] for r in where])]
        probes = _probes(np.array(list(asked.values()), float), *own, centers, metric, recall, population) if asked else len(centers)
    schema = f"query_id {ids[0]}, node_id {ids[1]}, score double"

    def search(shared) -> DataFrame:
        def work(batches):
            import numpy as np
            import pyarrow as pa

            names, asked, start, askers = shared.value
            best, kind = Best(asked, k, metric), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind, cell = batch.column(0).type, batch.column(2).to_numpy(zero_copy_only=False)
                block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                nodes, order = np.array(batch.column(0).to_pylist()), np.argsort(cell, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    c = cell[own[0]]
                    best.add(nodes[own], block[own], askers[start[c] : start[c + 1]])
            for at in range(0, len(best.row), 10_000):
                found = best.row[at : at + 10_000].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in found]), pa.array(best.node[at : at + 10_000].tolist(), kind), pa.array(best.score[at : at + 10_000])], ["query_id", "node_id", "score"])

        return lists.select("node_id", "v", "cell").mapInArrow(work, schema)

    scored = by_query_block(asks, search, schema, lambda x: top_k(x, k).drop("rank"), lambda names, asked: (names, asked, *_askers(asked, centers, sizes, metric, probes, k)), max(1, QUERY_CELLS // len(centers)))
    return top_k(scored, k).select("query_id", "rank", "node_id", "score", V.score_to_distance("score", metric).alias("distance"))


def nearest_cells(vectors: DataFrame, cells: int, vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """``vectors`` with the number of their cell; without any vector it is null."""
    centers = centroids(vectors, cells, vector=vector, metric=metric)
    if centers is None:
        return vectors.withColumn("cell", F.lit(None).cast("int"))
    return _with_cells(vectors, centers, metric if metric == "cosine" else "euclidean", 1, vector, "_cells").withColumn("cell", F.get("_cells", F.lit(0))).drop("_cells")
