"""Shared helpers of the text operators: scratch tables, tokenizer files, hashing."""

from __future__ import annotations

import heapq
import importlib
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch, exists, scratch_root

__all__ = ["Interned", "Scratch", "exists", "keep_rows", "merge_in_order", "mix", "partitions", "scratch_root", "slices", "tokenizer_path", "word_hashes"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer file; ``folder`` overrides the installed package."""
    if folder:
        return os.path.join(folder, name)
    return importlib.import_module("public_tokenizers").path(name)


#: Bytes of a slice's columns, above which it is halved until it holds a single row.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow record batches cut to at most ``rows`` rows and ``SLICE_BYTES`` bytes, so that Python holds few texts.

    A worker that begins a task gives back to the system what its last one has freed.
    """
    _trim()
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def _trim() -> None:
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def merge_in_order(symbols: list[int], pair) -> list[int]:
    """Byte-pair merging as defined: the pair of lowest rank, of those the leftmost, again and again.

    ``pair(a, b)`` is (rank, merged symbol) or None. Symbols are linked and pairs
    wait in a heap, so a run of any length takes n log n steps.
    """
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for k in range(n - 1):
        if (found := pair(symbols[k], symbols[k + 1])) is not None:
            heap.append((found[0], k, symbols[k], symbols[k + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, k, a, b, into = heapq.heappop(heap)
        right = after[k]
        if symbols[k] != a or right >= n or symbols[right] != b:
            continue  # one of the two has been merged since
        symbols[k], symbols[right] = into, None
        after[k] = right = after[right]
        if right < n:
            before[right] = k
            if (found := pair(into, symbols[right])) is not None:
                heapq.heappush(heap, (found[0], k, into, symbols[right], found[1]))
        left = before[k]
        if left >= 0 and (found := pair(symbols[left], into)) is not None:
            heapq.heappush(heap, (found[0], left, symbols[left], into, found[1]))
    return [x for x in symbols if x is not None]


def keep_rows(docs: DataFrame, id_col: str, content: Column, kept: DataFrame, once: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and content hash are in ``kept``; of the equal ones in ``once``, one each.

    ``kept`` and ``once``, a part of it, are stored tables of distinct (_kept_id,
    _kept_content); null ids equal each other. Whole rows come back as they were.
    """
    # Numbers stand for the columns of ``docs``, so that none of them can clash with ours.
    own = [f"_{i}" for i in range(len(docs.columns))]
    id_own = own[docs.columns.index(id_col)]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, own, strict=True)], content.alias("_content"))

    def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
        same = (rows["_content"] == keys["_kept_content"]) & rows[id_own].eqNullSafe(keys["_kept_id"])
        return rows.join(keys.hint("merge"), same, "left_semi")

    if once.isEmpty():
        found = among(rows, kept)
    else:
        same = (kept["_kept_content"] == once["_kept_content"]) & kept["_kept_id"].eqNullSafe(once["_kept_id"])
        # Each task keeps the first of equal rows before the shuffle, so that a hot row is not dealt to one task.
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_content", id_own).orderBy("_content"))).where("_n = 1").drop("_n")
        found = among(rows, kept.join(once, same, "left_anti")).unionByName(among(first, once))
    return found.select(*own).toDF(*docs.columns)


class Interned(dict):
    """Numbers for keys, with what ``compute`` makes of new keys, kept by a worker between batches.

    ``index(keys)`` gives a number per key; ``self.values[number]`` is its row.
    The table is emptied when it holds more than ``limit`` keys, so numbers hold
    only until the next call.
    """

    def __init__(self, compute, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.values, self._new = compute, limit, None, []

    def __missing__(self, key):
        n = self[key] = len(self)
        self._new.append(key)
        return n

    def index(self, keys):
        import numpy as np

        if len(self) > self.limit:
            self.clear()
            self.values = None
        got = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        if self._new:
            new, self._new = self._new, []
            made = self.compute(new)
            if self.values is None:
                self._room, self._used = made, len(made)
            else:
                need = self._used + len(made)
                if need > len(self._room):
                    room = np.empty((max(need, 2 * len(self._room)), *self._room.shape[1:]), self._room.dtype)
                    room[: self._used] = self._room[: self._used]
                    self._room = room
                self._room[self._used : need] = made
                self._used = need
            self.values = self._room[: self._used]
        return got


def word_hashes(words: list[bytes]):
    """64-bit hashes of words, for :class:`Interned`."""
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def mix(x):
    """A bijective 64-bit mixer over an array."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
