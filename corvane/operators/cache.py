"""An answer cache with least-recently-used eviction and expiry, for serving and for replayed logs."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


class AnswerCache:
    """Answers by key; ``get`` of an expired one is a miss. Safe for threads."""

    def __init__(self, max_size: int = 100, ttl_seconds: float = 3600, clock: Callable[[], float] = time.time):
        if max_size <= 0 or ttl_seconds <= 0:
            raise ValueError("max_size and ttl_seconds must be positive")
        self.max_size, self.ttl, self.clock = max_size, ttl_seconds, clock
        self._rows: OrderedDict[str, tuple[object, float, str | None]] = OrderedDict()
        self._lock = threading.RLock()
        self.hits = self.misses = self.evictions = 0

    def __len__(self) -> int:
        return len(self._rows)

    def __contains__(self, key: str) -> bool:
        with self._lock:
            return key in self._rows and self.clock() - self._rows[key][1] <= self.ttl

    def get(self, key: str):
        with self._lock:
            row = self._rows.get(key)
            if row is not None and self.clock() - row[1] > self.ttl:
                del self._rows[key]
                row = None
            if row is None:
                self.misses += 1
                return None
            self._rows.move_to_end(key)
            self.hits += 1
            return row[0]

    def set(self, key: str, value, collection: str | None = None) -> None:
        with self._lock:
            self._rows[key] = (value, self.clock(), collection)
            self._rows.move_to_end(key)
            while len(self._rows) > self.max_size:
                self._rows.popitem(last=False)
                self.evictions += 1

    def invalidate(self, key: str) -> bool:
        with self._lock:
            return self._rows.pop(key, None) is not None

    def invalidate_collection(self, collection: str) -> int:
        with self._lock:
            gone = [k for k, r in self._rows.items() if r[2] == collection]
            for k in gone:
                del self._rows[k]
            return len(gone)

    def clear(self) -> None:
        with self._lock:
            self._rows.clear()

    def stats(self) -> dict:
        total = self.hits + self.misses
        return {"size": len(self), "max_size": self.max_size, "hits": self.hits, "misses": self.misses, "total": total, "evictions": self.evictions, "hit_rate": self.hits / total if total else 0.0}

    def reset_stats(self) -> None:
        self.hits = self.misses = self.evictions = 0


_SHARED: dict[str, AnswerCache] = {}


def global_cache(**options) -> AnswerCache:
    if "cache" not in _SHARED:
        _SHARED["cache"] = AnswerCache(**options)
    return _SHARED["cache"]


def clear_global_cache() -> None:
    _SHARED.clear()


def _folded(rows: DataFrame, groups: list[str], schema: str, start, step, result) -> DataFrame:
    """One row per group from its rows in order of ``at`` and ``ord``, which stream through ``step`` and are never held together."""
    ship(rows.sparkSession)
    rows = rows.repartition(*groups).sortWithinPartitions(*groups, "at", "ord").select(*groups, "key", "at")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [rows.schema[g].dataType for g in groups]

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(k) for k in kinds] + [pa.int64()] * (len(names) - len(kinds))
        group, state, done = None, None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            for *own, key, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or own != group:
                    if state is not None:
                        done.append((*group, *result(state)))
                    group, state = own, start()
                step(state, key, at)
            if len(done) >= 10_000:
                yield made()
                done.clear()
        if state is not None:
            done.append((*group, *result(state)))
            yield made()

    return rows.mapInArrow(work, schema)


def _log(log: DataFrame, by: str, key: str, at: str, order: str) -> DataFrame:
    return log.select(F.col(by).alias("by"), F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(order).alias("ord"))


def _rates(counts: DataFrame, by: str) -> DataFrame:
    return counts.select(F.col("by").alias(by), "hits", (F.col("total") - F.col("hits")).alias("misses"), "total", (F.col("hits") / F.col("total")).alias("hit_rate"))


def replay(log: DataFrame, by: str, key: str, at: str, order: str, max_size: int = 100, ttl_seconds: float = 3600) -> DataFrame:
    """What a cache of its own for each ``by`` would have done with a log of requests.

    ``by, hits, misses, total, hit_rate``. A missed key is stored at once. A cache is
    ordered, so one cache is one task's work, which holds no more than the cache;
    caches of other users or collections run side by side.
    """
    rows = _log(log, by, key, at, order)

    def start():
        now = [0.0]
        return AnswerCache(max_size, ttl_seconds, lambda: now[0]), now

    def step(state, request, micros):
        cache, now = state
        now[0] = micros / 1e6
        if cache.get(request) is None:
            cache.set(request, True)

    counts = _folded(rows, ["by"], f"by {rows.schema['by'].dataType.simpleString()}, hits long, total long", start, step, lambda s: (s[0].hits, s[0].hits + s[0].misses))
    return _rates(counts, by)


def ttl_hits(log: DataFrame, by: str, key: str, at: str, order: str, ttl_seconds: float) -> DataFrame:
    """Hits of an unbounded cache whose entries expire ``ttl_seconds`` after they were stored, per ``by``.

    Without eviction a request hits if the entry stored last for its key is young
    enough; entries are stored on misses only, so runs of requests are folded in order.
    """
    ttl = int(ttl_seconds * 1_000_000)
    rows = _log(log, by, key, at, order).withColumn("one", F.col("key"))

    def step(state, _, micros):
        hit = state[0] is not None and micros - state[0] <= ttl
        state[0] = state[0] if hit else micros
        state[1] += hit
        state[2] += 1

    schema = f"by {rows.schema['by'].dataType.simpleString()}, one string, hits long, total long"
    per = _folded(rows, ["by", "one"], schema, lambda: [None, 0, 0], step, lambda s: (s[1], s[2]))
    return _rates(per.groupBy("by").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total")), by)
