"""Hierarchical packing of documents into sequences of several lengths.

Each document becomes token ids and an end mark. Documents longer than the
longest window are cut into whole windows; every rest is routed to the shortest
tier that holds it. Tiers are packed from the longest: a window takes one
document of its tier, and its gap is filled with the largest fitting documents of
shorter tiers; what then is open is closed with a cut. Every sequence is exactly
as long as its tier, so nothing is padded; what is left at the end of a partition
is split into sequences of powers of two.

Partitions are packed on their own, in buffers of bounded size: no shuffle, no
sort, and a lost task is simply packed again.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from functools import lru_cache

from pyspark.sql import DataFrame

from ..shipping import ship
from .common import Interned, slices, tokenizer_path

MAX_LEN, TIERS = 2048, (256, 512, 1024, 2048)
#: Ids that a task holds before it packs them; sequences of a tier that make up one step.
BUFFER_IDS, GROUP_IDS = 1 << 20, 32 * 2048
END_ID = 1
#: Distinct words that a worker keeps between tasks.
KEPT_WORDS = 800_000


#: ASCII and Latin-1 letters, with or without one stop behind them: the tokenizer splits there in any case.
_LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]?)")


class WordTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, which sees each distinct word once in a while.

    The tokenizer drops white space, lower-cases, and never joins words over white
    space or a letter with a stop, so a text's ids are those of its words in order.
    Words are split at ASCII white space only; anything else is left to the library.
    New words of letters are encoded as one text, and their ends are known by their
    ids; one with a stop behind known letters takes the ids of both. Other words are
    encoded one by one.
    """

    def __init__(self, name: str, folder: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.lib = np, Tokenizer.from_file(tokenizer_path(name, folder))
        self.words = Interned(self._encode, limit=500_000)
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        # Letters are one pre-token and a stop is one, and the last id of each is one of an end.
        ends = [i for t, i in self.lib.get_vocab().items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.lib.get_vocab_size() + 1, bool)
        self.is_end[ends] = True
        self.plain = _LETTERS.fullmatch if ends else lambda w: None
        self.stop = {c: np.array(self.lib.encode(c.decode(), add_special_tokens=False).ids, np.uint32) for c in (b".", b",")}

    def _encode(self, words: list[bytes]):
        np, out = self.np, self.np.empty((len(words), 2), self.np.int64)
        if self.words.values is None:
            self.used = 0
        known, number, done = self.words.values, self.words.get, 0 if self.words.values is None else len(self.words.values)
        plain, ends, rest, parts = [], [], [], []
        used = self.used
        for i, w in enumerate(words):
            m = self.plain(w)
            if m is None:
                rest.append(i)
                continue
            letters, stop = m.groups()
            if stop and (n := number(letters)) is not None and n < done:
                start, size = known[n].tolist()
                parts += [self.flat[start : start + size], self.stop[stop]]
                size += len(self.stop[stop])
                out[i] = used, size
                used += size
                continue
            plain.append(i)
            ends.append(2 if stop else 1)
        if parts:
            self._keep(np.concatenate(parts))
        for k in range(0, len(plain), 2048):
            part = plain[k : k + 2048]
            joined = b" ".join([words[i] for i in part]).decode()
            ids = np.array(self.lib.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            after = (np.flatnonzero(self.is_end[ids]) + 1)[np.cumsum(ends[k : k + 2048]) - 1]
            first = np.concatenate([[0], after[:-1]])
            out[part, 0] = first + self.used
            out[part, 1] = after - first
            self._keep(ids)
        for k in range(0, len(rest), 2048):
            part = rest[k : k + 2048]
            got = [e.ids for e in self.lib.encode_batch_fast([words[i].decode(errors="replace") for i in part], add_special_tokens=False)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            out[part, 0] = np.cumsum(lens) - lens + self.used
            out[part, 1] = lens
            self._keep(np.array([i for ids in got for i in ids], np.uint32))
        return out

    def _keep(self, ids) -> None:
        if self.used + len(ids) > len(self.flat):
            room = self.np.empty(2 * (self.used + len(ids)), self.np.uint32)
            room[: self.used] = self.flat[: self.used]
            self.flat = room
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def batch(self, texts: list[bytes | None], end_id: int) -> list:
        """The ids of each text and the end mark."""
        np, every, counts = self.np, [], []
        for t in texts:
            # A special string is only one in lower case, so a text that may hold one keeps its case.
            words = (t if b"<|" in t else t.lower()).split() if t else []
            every += words
            counts.append(len(words))
        numbers = self.words.index(every)
        starts, lens = self.words.values[numbers].T if every else (numbers, numbers)
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = self.flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lens)]
        cuts = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        end = np.array([end_id], np.uint32)
        return [np.concatenate([flat[a:b], end]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=1)
def _kept(name: str, folder: str | None) -> WordTokenizer:
    """A worker's tokenizer with the words that it has encoded, kept for its next tasks."""
    kept = WordTokenizer(name, folder)
    kept.words.limit = KEPT_WORDS
    return kept


class Packer:
    """Packs (key, start, length) items of one partition; ``out`` gets (key, start, length, sequence, offset, tier, group)."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, group_ids: int = GROUP_IDS):
        if list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
            raise ValueError("tiers must be rising powers of two")
        self.tiers, self.group_ids = tiers, group_ids
        self.seq = self.base = partition << 36
        self.waiting: list[tuple[int, int, int]] = []  # key, start, length
        self.total, self.made, self.out = 0, dict.fromkeys(tiers, 0), []

    def add(self, key: int, length: int) -> None:
        top, at = self.tiers[-1], 0
        while length - at >= top:
            self._emit([(key, at, top)], top)
            at += top
        if length > at:
            self.waiting.append((key, at, length - at))
            self.total += length - at

    def _emit(self, items: list[tuple[int, int, int]], tier: int) -> None:
        n = self.made.get(tier, 0)
        self.made[tier] = n + 1
        # Groups hold equal numbers of ids: more sequences of a shorter tier.
        group = (n // max(1, self.group_ids // tier)) * 64 + tier.bit_length()
        at = 0
        for key, start, length in items:
            self.out.append((key, start, length, self.seq, at, tier, self.base + group))
            at += length
        self.seq += 1

    def pack(self, last: bool = False) -> list[tuple]:
        """Packs what waits. Items that don't fill a window wait on, or with ``last`` become powers of two."""
        pools = {t: [] for t in self.tiers}
        for key, start, length in self.waiting:
            pools[next(t for t in self.tiers if t >= length)].append((length, key, start))
        self.waiting, self.total = [], 0
        for p in pools.values():
            p.sort()
        shorter = list(self.tiers)
        rest: list[tuple[int, int, int]] = []
        for tier in reversed(self.tiers):
            shorter.remove(tier)
            own = pools[tier]
            window, gap = [], tier
            while own:
                if not window:
                    length, key, start = own.pop()
                else:
                    found = next((p for p in (own, *(pools[t] for t in reversed(shorter))) if p and p[0][0] <= gap), None)
                    if found is not None:
                        length, key, start = found.pop(bisect_right(found, (gap, float("inf"))) - 1)
                    else:  # nothing fits: the shortest of this tier is cut
                        length, key, start = own.pop(0)
                        insort(own if length - gap > (shorter[-1] if shorter else 0) else pools[next(t for t in self.tiers if t >= length - gap)], (length - gap, key, start + gap))
                        length = gap
                window.append((key, start, length))
                gap -= length
                if not gap:
                    self._emit(window, tier)
                    window, gap = [], tier
            # The last window of a tier is filled from shorter tiers, cut if need be.
            while window and any(pools[t] for t in shorter):
                found = next((pools[t] for t in reversed(shorter) if pools[t] and pools[t][0][0] <= gap), None)
                if found is not None:
                    length, key, start = found.pop(bisect_right(found, (gap, float("inf"))) - 1)
                else:
                    found = next(pools[t] for t in shorter if pools[t])
                    length, key, start = found.pop(0)
                    insort(pools[next(t for t in self.tiers if t >= length - gap)], (length - gap, key, start + gap))
                    length = gap
                window.append((key, start, length))
                gap -= length
                if not gap:
                    self._emit(window, tier)
                    window, gap = [], tier
            rest += window
        if last:
            left, total = list(reversed(rest)), sum(x[2] for x in rest)
            for bit in range(total.bit_length() - 1, -1, -1):
                size = 1 << bit
                if not total & size:
                    continue
                window, gap = [], size
                while gap:
                    key, start, length = left.pop()
                    if length > gap:
                        left.append((key, start + gap, length - gap))
                        length = gap
                    window.append((key, start, length))
                    gap -= length
                self._emit(window, size)
        else:
            self.waiting, self.total = rest, sum(x[2] for x in rest)
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", folder: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group`` and, if asked for, ``ids``.

    A null or empty text is the end mark alone. Repeated rows are packed each. Each
    id lies in exactly one piece; an empty table gives an empty result; other columns
    are not read. A step group's sequences are of one tier and hold the same number of
    ids, but for the last group of a tier in a partition. With ``keep_words`` workers
    hold their encoded words between tasks, which takes memory from other operators.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, packer = (_kept if keep_words else WordTokenizer)(tokenizer, folder), Packer(TaskContext.get().partitionId(), tiers)
        held: dict[int, tuple] = {}  # key -> id, ids
        id_type, n = None, 0

        def rows(last: bool):
            made = packer.pack(last)
            waits = {x[0] for x in packer.waiting}
            cols: list[list] = [[] for _ in names]
            for key, start, length, seq, offset, tier, group in made:
                doc, ids = held[key]
                part = ids[start : start + length]
                for c, v in zip(cols, (doc, start, length, zlib.crc32(part.tobytes()), len(ids), seq, offset, tier, group, part), strict=False):
                    c.append(v)
            for key in [k for k in held if k not in waits]:
                del held[key]
            kinds = [id_type] + [pa.int64()] * 6 + [pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            for at in range(0, len(cols[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000], k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in slices(batches, 256):
            id_type = batch.column(0).type
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), encode.batch(texts, end_id), strict=True):
                held[n] = (doc, ids)
                packer.add(n, len(ids))
                n += 1
                if packer.total >= BUFFER_IDS or len(packer.out) >= 8192:
                    yield from rows(False)
        if n:
            yield from rows(True)

    types = ["long"] * 6 + ["int", "long"] + ["array<long>"] * with_ids
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{a}` {b}" for a, b in zip(names[1:], types, strict=True))
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents; null, empty and repeated ones as in :func:`pack`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
