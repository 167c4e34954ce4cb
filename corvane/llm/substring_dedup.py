"""Substring deduplication with compressed FM-indexes.

A window is a fixed number of consecutive words. All words are removed that lie in
a window whose words also start somewhere else, in the same document or another.

Equal windows have to meet in one shard without sending every document to every
shard. Each window has an anchor, the smallest hash among its short word runs;
neighbouring windows with one anchor form a segment, and the anchor decides the
shard. Only segments whose anchor occurs at least twice go on, one copy of each
with its number of occurrences. Segments of a crowded anchor, such as the edges of
a passage that very many documents share, are taken apart into windows; equal ones
are one row with their number of occurrences, and each goes to the shard of its own
hash, so that no anchor fills a shard.

Each shard is an FM-index of its segments: the Burrows-Wheeler transform in a
wavelet matrix of packed bits with block ranks. All segments are streamed through
it in step by backward search, which gives the matching statistics: the longest
run from each word that occurs at least twice, up to the window. Runs that reach
the window are the reported intervals. Inside a shard words are compared, not
hashes. Two things rest on hashes: segments are one copy if the 128 bits of their
anchor and digest agree, and words behind the 64 bits of a word hash; both would have
to collide for the same 35 words to remove anything wrongly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Interned, Scratch, mix, partitions, slices, word_hashes

#: Words of a run that can be an anchor; words of a shard; distinct segments above which an anchor is crowded: with
#: some fifty words each, they are a tenth of a shard.
ANCHOR_WORDS, SHARD_WORDS, CROWDED = 8, 1 << 19, 1024
_BASE = 0x9E3779B97F4A7C15


def check_window(window: int) -> None:
    if not ANCHOR_WORDS < window < FMIndex.DEPTH:
        raise ValueError(f"the window must be above {ANCHOR_WORDS} and below {FMIndex.DEPTH} words")


class Segmenter:
    """Segments of whole texts and hashes of word runs."""

    def __init__(self, window: int):
        import numpy as np

        self.window, self.hashes = window, Interned(word_hashes)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int):
        import numpy as np

        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            base, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
            base[0] = back[0] = 1
            with np.errstate(over="ignore"):
                self.power, self.inverse = np.cumprod(base), np.cumprod(back)
        return self.power, self.inverse

    def __call__(self, words: list[bytes]):
        """(start, windows, anchor, digest, window digest function) of a text's segments, or None below a window."""
        import numpy as np

        n = len(words)
        if n < self.window:
            return None
        numbers = self.hashes.index(words)
        h = mix(self.hashes.values[numbers])
        with np.errstate(over="ignore"):
            g, size = h, 1
            while size < ANCHOR_WORDS:
                g = mix(g[:-size] * np.uint64(3) + g[size:])
                size *= 2
            width = self.window - ANCHOR_WORDS + 1
            at, size = np.arange(len(g)), 1
            while 2 * size <= width:
                a, b = at[:-size], at[size:]
                at, size = np.where(g[a] <= g[b], a, b), 2 * size
            if size < width:
                a, b = at[: len(at) - (width - size)], at[width - size :]
                at = np.where(g[a] <= g[b], a, b)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            runs = np.diff(np.r_[starts, len(at)])
            power, inverse = self._powers(n + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])

            def digest(first, count):
                return mix((sums[first + count] - sums[first]) * inverse[first] + count.astype(np.uint64)).view(np.int64)

            return starts, runs, mix(g[at[starts]]).view(np.int64), digest(starts, runs + self.window - 1), digest


def _segments(window: int):
    def work(batches):
        import numpy as np
        import pyarrow as pa

        cut = Segmenter(window)
        for batch in slices(batches):
            cols = [[] for _ in range(6)]
            for rid, rid2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if (got := cut((text or b"").split())) is not None:
                    n = len(got[0])
                    for c, x in zip(cols, (np.full(n, rid, np.int64), np.full(n, rid2, np.int64), got[0].astype(np.int32), got[1].astype(np.int32), got[2], got[3]), strict=True):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["rid", "rid2", "start", "windows", "anchor", "digest"])

    return work


def _texts(window: int):
    """The words of the segments that a document stands for; of crowded anchors, its windows one by one."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        cut = Segmenter(window)
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["crowded", "key", "anchor", "digest", "at", "times", "words"]
        for batch in slices(batches, 128):
            out = [[] for _ in names]
            for text, wanted in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or b"").split()
                want = {(x["anchor"], x["digest"]): (x["times"], x["crowded"]) for x in wanted}
                if (got := cut(words)) is None:
                    continue
                starts, runs, anchors, digests, digest = got
                for s, n, a, d in zip(starts.tolist(), runs.tolist(), anchors.tolist(), digests.tolist(), strict=True):
                    if (found := want.pop((a, d), None)) is None:
                        continue
                    times, crowded = found
                    if not crowded:
                        rows = [(False, a, a, d, 0, times, b" ".join(words[s : s + n + window - 1]))]
                    else:
                        keys = digest(np.arange(s, s + n), np.full(n, window)).tolist()
                        rows = [(True, k, a, d, i, times, b" ".join(words[s + i : s + i + window])) for i, k in enumerate(keys)]
                    for row in rows:
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return work


class WaveletMatrix:
    """Ranks of symbols in a sequence; bits are packed, with a count for each 64."""

    def __init__(self, symbols, size: int):
        import numpy as np

        self.levels = max(1, (size - 1).bit_length())
        self.rows, n = [], len(symbols)
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            blocks = packed.view(np.uint64)
            counts = np.zeros(len(blocks), np.int64)
            counts[1:] = np.cumsum(np.bitwise_count(blocks))[:-1]
            self.rows.append((level, blocks, counts, n - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.base = self._map(np.arange(size), np.zeros(size, np.int64))

    def _map(self, symbols, at):
        import numpy as np

        for level, blocks, counts, zeros in self.rows:
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(blocks[block] & below)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols, at):
        """How often each symbol occurs before each place."""
        return self._map(symbols, at) - self.base[symbols]


class FMIndex:
    """FM-index of segments of word numbers (1 and up), each with a number of occurrences."""

    DEPTH = 64  #: suffixes are sorted by so many words, enough for patterns of fewer

    def __init__(self, words, lengths, times):
        import numpy as np

        s = len(lengths)
        ends = np.cumsum(lengths + 1) - 1  # each segment is followed by a separator of its own
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = words
        self.text, self.first = text, ends - lengths
        own = text + s
        own[ends] = np.arange(s)
        weight = np.zeros(n, np.int64)
        weight[inside] = np.repeat(times, lengths)
        ranks, k = [np.unique(own, return_inverse=True)[1].astype(np.int64)], 1
        while True:
            r = ranks[-1]
            after = np.zeros(n, np.int64)
            after[:-k] = r[k:] + 1
            key = r * (n + 1) + after
            order = np.argsort(key, kind="stable")
            k *= 2
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if k >= self.DEPTH or new[-1] == n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[order] = new
            ranks.append(rank)
        same = np.zeros(n, np.int64)  # words that a suffix shares with the one before it
        a, b = order[:-1], order[1:]
        for j in range(len(ranks) - 1, -1, -1):
            x, y = a + same[1:], b + same[1:]
            inner = (x < n) & (y < n)
            same[1:] += np.where(inner & (ranks[j][np.minimum(x, n - 1)] == ranks[j][np.minimum(y, n - 1)]), 1 << j, 0)
        del ranks
        self.low = [np.minimum(same, 255).astype(np.uint8)]
        size = 1
        while 2 * size <= n:
            p = self.low[-1]
            self.low.append(np.minimum(p[:-size], p[size:]))
            size *= 2
        self.n = n
        bwt = text[order - 1]
        bwt[order == 0] = 0
        alphabet = int(text.max()) + 1
        self.wavelet = WaveletMatrix(bwt, alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])[:-1]
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])

    def extend(self, symbols, left, right):
        """The intervals of a word put before each pattern."""
        import numpy as np

        two = np.concatenate([symbols, symbols])
        got = self.wavelet.rank(two, np.concatenate([left, right])) + self.before[two]
        return got[: len(left)], got[len(left) :]

    def widen(self, depth, left, right):
        """The intervals of the patterns' first ``depth`` words."""
        import numpy as np

        left, right = left.copy(), right.copy()
        for j in range(len(self.low) - 1, -1, -1):
            p, step = self.low[j], 1 << j
            at = left - step + 1
            ok = at >= 1
            ok &= p[np.where(ok, at, 0)] >= depth
            left[ok] -= step
            ok = right + step <= self.n
            ok &= p[np.where(ok, right, 0)] >= depth
            right[ok] += step
        root = depth <= 0
        left[root], right[root] = 0, self.n
        return left, right

    def repeated_windows(self, lengths, window: int):
        """(segment, place) of all windows that occur at least twice, by matching statistics from right to left."""
        import numpy as np

        row = np.flatnonzero(lengths >= window)
        begin, end = lengths[row].copy(), lengths[row].copy()
        left, right = np.zeros(len(row), np.int64), np.full(len(row), self.n)
        found = []
        while len(row):
            symbols = self.text[self.first[row] + begin - 1]
            nl, nr = self.extend(symbols, left, right)
            ok = self.weight[nr] - self.weight[nl] >= 2
            left, right = np.where(ok, nl, left), np.where(ok, nr, right)
            alone = ~ok & (begin == end)  # a word that occurs once: the pattern starts afresh before it
            begin = begin - (ok | alone)
            full = ok & (end - begin == window)
            if full.any():
                found.append((row[full], begin[full]))
            shrink = full | ~ok
            end = end - shrink
            if shrink.any():
                left[shrink], right[shrink] = self.widen((end - begin)[shrink], left[shrink], right[shrink])
            alive = (begin > 0) & (end >= window)
            if not alive.all():
                row, begin, end, left, right = (x[alive] for x in (row, begin, end, left, right))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _shards(window: int):
    """One FM-index for each partition; rows are (s1, s2, times, words)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        seen, names, lengths, times, parts = set(), [], [], [], []
        number: dict[bytes, int] = {}
        for batch in slices(batches, 4096):
            for crowded, s1, s2, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (crowded, s1, s2, text if crowded else None) in seen:  # of repeated rows, one stands for all
                    continue
                seen.add((crowded, s1, s2, text if crowded else None))
                words = text.split(b" ")
                names.append((crowded, s1, s2))
                lengths.append(len(words)), times.append(t)
                parts.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int32, len(words)))
        if not parts:
            return
        del seen
        lengths = np.array(lengths, np.int64)
        index = FMIndex(np.concatenate(parts).astype(np.int64), lengths, np.array(times, np.int64))
        row, at = index.repeated_windows(lengths, window)
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        if not len(row):
            return
        cut = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(row)] - 1
        for k in range(0, len(first), 10_000):
            a, b = first[k : k + 10_000], last[k : k + 10_000]
            own = [names[i] for i in row[a].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in own], pa.bool_()), pa.array([x[1] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.int64()), pa.array(at[a].astype(np.int32)), pa.array((at[b] + 1).astype(np.int32))],
                ["crowded", "s1", "s2", "w0", "w1"],
            )

    return work


def _keys(id_col: str, text_col: str) -> list:
    # A row's key follows from its content, so that it is the same in every reading of the input.
    return [F.xxhash64(id_col, text_col).alias("rid"), F.xxhash64(text_col, id_col).alias("rid2")]


def repeated_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, rid2, spans): word ranges to remove, for each document that has any, by the hashes of :func:`_keys`.

    Spans may overlap. Null, empty and short texts have none. Repeated rows count as
    places of their own, so a row that comes twice is a repeat; an empty table gives
    an empty result.
    """
    check_window(window)
    spark = docs.sparkSession
    ship(spark)
    tmp = Scratch(spark, "substring")
    source = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))
    every = tmp.save(source.mapInArrow(_segments(window), "rid long, rid2 long, start int, windows int, anchor long, digest long"), "segments")
    twice = tmp.save(every.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    every = tmp.save(every.join(twice, "anchor", "left_semi"), "repeated")
    tmp.drop("segments", "anchors")

    one = tmp.save(every.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("times"), F.min("rid").alias("rid"), F.max("windows").alias("windows")), "distinct")
    crowd = tmp.save(one.groupBy("anchor").count().where(F.col("count") > CROWDED).select("anchor", F.lit(True).alias("crowded")), "crowded")
    marked = one.join(crowd, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    total = marked.agg(F.sum(F.when(F.col("crowded"), F.col("windows") * (window + 1)).otherwise(F.col("windows") + window))).first()[0] or 0
    wanted = marked.groupBy("rid").agg(F.collect_list(F.struct("anchor", "digest", "times", "crowded")).alias("wanted"))
    texts = source.join(wanted.hint("merge"), "rid").select("text", "wanted").mapInArrow(_texts(window), "crowded boolean, key long, anchor long, digest long, at int, times long, words binary")
    texts = tmp.save(texts, "texts")

    windows = texts.where("crowded")
    some = windows.groupBy("key", "words").agg(F.sum("times").alias("times"))
    rows = texts.where("not crowded").select("crowded", F.col("anchor").alias("s1"), F.col("digest").alias("s2"), "times", "words")
    rows = rows.unionByName(some.select(F.lit(True).alias("crowded"), F.col("key").alias("s1"), F.lit(0).cast("long").alias("s2"), "times", "words"))
    shards = max(partitions(spark), -(-total // SHARD_WORDS))
    found = tmp.save(rows.repartition(shards, "s1").mapInArrow(_shards(window), "crowded boolean, s1 long, s2 long, w0 int, w1 int"), "found")
    of_windows = windows.select("key", "anchor", "digest", "at").join(found.where("crowded").select(F.col("s1").alias("key")).distinct(), "key", "left_semi")
    hits = found.where("not crowded").select(F.col("s1").alias("anchor"), F.col("s2").alias("digest"), "w0", "w1")
    hits = tmp.save(hits.unionByName(of_windows.select("anchor", "digest", F.col("at").alias("w0"), (F.col("at") + 1).alias("w1"))), "hits")
    tmp.drop("texts")
    placed = every.join(hits, ["anchor", "digest"]).select("rid", "rid2", (F.col("start") + F.col("w0")).alias("a"), (F.col("start") + F.col("w1") + (window - 1)).alias("b"))
    # A set: rows that are repeated with their id have one list, not one for each repetition.
    return tmp.result(placed.groupBy("rid", "rid2").agg(F.collect_set(F.struct("a", "b")).alias("spans")))


def _covered(n: int, spans):
    """Which of n words lie in a span; ``spans`` is an Arrow array of structs or None."""
    import numpy as np

    edge = np.zeros(n + 1, np.int64)
    a, b = spans.field(0).to_numpy(zero_copy_only=False), spans.field(1).to_numpy(zero_copy_only=False)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge[:-1]) > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(data: bytes, gone) -> bytes:
    """``data`` without the marked words and the white space behind each; what stays is unchanged."""
    out, at, words = [], 0, list(_WORD.finditer(data))
    for k, m in enumerate(words):
        if gone[k]:
            out.append(data[at : m.start()])
            at = words[k + 1].start() if k + 1 < len(words) else len(data)
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut out of the text, with the white space behind each.

    Null, empty and short texts and all other columns stay as they were. Rows that
    are repeated, with or without their id, are repeats of each other and lose every
    window; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    key = {"rid": "__corvane_rid", "rid2": "__corvane_rid2", "spans": "__corvane_spans"}
    keyed = docs.select("*", *[c.alias(key[n]) for n, c in zip(("rid", "rid2"), _keys(id_col, text_col), strict=True)])
    rows = keyed.join(spans.withColumnsRenamed(key).hint("merge"), ["__corvane_rid", "__corvane_rid2"], "left").select(*docs.columns, "__corvane_spans")
    names = list(docs.columns)
    at, width = names.index(text_col), len(names)

    def work(batches):
        import pyarrow as pa

        for batch in slices(batches, 256):
            texts, spans = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(width)
            for i, t in enumerate(texts):
                if spans[i].is_valid:
                    texts[i] = _cut(t, _covered(len(t.split()), spans[i].values))
            cols = [pa.array(texts, pa.binary()).cast(batch.column(at).type) if k == at else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(work, docs.schema)


def removal_rows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_words, n_removed, kept_sha256`` (of the kept words joined by one space).

    Null and empty texts have no words. Rows that are repeated, with or without
    their id, are repeats of each other; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, window, id_col, text_col)
    rows = docs.select(id_col, F.col(text_col).alias("text"), *_keys(id_col, text_col)).join(spans.hint("merge"), ["rid", "rid2"], "left").select(id_col, "text", "spans")

    def work(batches):
        import hashlib
        from itertools import compress

        import pyarrow as pa

        for batch in slices(batches, 256):
            total, gone, sha = [], [], []
            spans = batch.column(2)
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = (t or b"").split()
                total.append(len(words))
                if spans[i].is_valid:
                    words = list(compress(words, ~_covered(len(words), spans[i].values)))
                gone.append(total[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(work, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words and removed words of every document; odd rows as in :func:`removal_rows`."""
    return removal_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE c > 1),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ps, k)), lambda k: w[k]), ' ') END) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""
