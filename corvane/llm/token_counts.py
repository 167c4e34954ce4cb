"""Token counts by rank-synchronous array merging.

Texts become pre-tokens: a run of spaces with the word behind it, or what stands
behind a line break or a stop. No merge can cross those borders, which is checked against
the vocabulary. The distinct new pre-tokens of a batch are held as one ragged
array of symbols; in each round every pre-token merges its leftmost pair of lowest
rank at once, until no pair is left. The survivors are the tokens; a character
outside the vocabulary counts one token per UTF-8 byte.

A round takes one merge of every sequence, so a sequence of n symbols takes up to n
rounds. Those of more than ``RUN`` symbols without a border (a megabyte of one
letter) are merged by a heap in the same order, in n log n steps.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..shipping import ship
from .common import Interned, merge_in_order, slices, tokenizer_path

_MARK = "▁"
_PRE = re.compile(rb" +[^ \n]*|[^ \n]+")
#: The same, but letters before a stop stand alone; for vocabularies without a piece over that border.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_PRE_STOPS = re.compile(rb" *[A-Za-z\xc3\x80-\x96\x98-\xb6\xb8-\xbf]+(?=[.,])| +[^ \n]*|[^ \n]+")
#: Pre-tokens of more symbols are cut where no piece spans the cut, before they are merged.
LONG = 64
#: Symbols above which a sequence is merged on its own, by a heap.
RUN = 1024


class MergeTable:
    """Pieces of a SentencePiece BPE model with byte fallback, as arrays of pairs that merge."""

    def __init__(self, name: str, folder: str | None = None):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name, folder))
        probe = "ﬁ Å  ½ á"
        if sp.decode(sp.encode(probe)) != probe or not sp.is_byte(sp.piece_to_id("<0x0A>")):
            raise ValueError("only models with an identity normaliser and byte fallback are supported")
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in self.id):
            raise ValueError("a piece spans the borders of pre-tokens")
        score = {i: sp.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = []
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, order[score[i]], i))
        pairs.sort()
        self.keys = np.array([x[0] for x in pairs], np.int64)
        self.rank = np.array([x[1] for x in pairs], np.int64)
        self.into = np.array([x[2] for x in pairs], np.int64)
        self.none = np.int64(1 << 40)
        self.inner = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.pair = {k: (r, i) for k, r, i in pairs}

    def pair_ranks(self, a, b):
        """Rank and result of merging symbols a and b; ``none`` where they don't merge."""
        import numpy as np

        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], self.none), self.into[at]

    def cut(self, chars: str) -> list[str]:
        """A long pre-token, cut between characters that no piece has side by side."""
        if len(chars) <= LONG:
            return [chars]
        cuts = [0, *(k for k in range(1, len(chars)) if chars[k - 1 : k + 1] not in self.inner), len(chars)]
        return [chars[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def count_run(self, chars: str) -> int:
        """Tokens of one long sequence."""
        left = merge_in_order([self.id.get(c, -1 - ord(c)) for c in chars], lambda a, b: self.pair.get(a << 32 | b) if a >= 0 <= b else None)
        return sum(1 if x >= 0 else len(chr(-1 - x).encode(errors="replace")) for x in left)

    def counts(self, chunks: list[str]):
        """Tokens of each chunk of symbols, all merged in step."""
        import numpy as np

        if any(len(c) > RUN for c in chunks):
            out = self.counts([c if len(c) <= RUN else "" for c in chunks])
            for k, c in enumerate(chunks):
                if len(c) > RUN:
                    out[k] = self.count_run(c)
            return out
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = "".join(chunks)
        symbols = np.fromiter((self.id.get(c, -1) for c in text), np.int64, len(text))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        tokens = np.where(symbols < 0, width, 1)
        owner = np.repeat(np.arange(len(chunks)), lens)
        out = np.bincount(owner, tokens, len(chunks)).astype(np.int64)
        if not len(symbols):
            return out

        def ranks(sym, own):
            r = np.full(len(sym), self.none)
            into = np.zeros(len(sym), np.int64)
            r[:-1], into[:-1] = self.pair_ranks(sym[:-1], sym[1:])
            last = np.r_[own[1:] != own[:-1], True]
            r[last] = self.none
            return r, into

        rank, into = ranks(symbols, owner)
        while True:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(owner)])
            low_all = np.repeat(low, size)
            alive = low_all < self.none
            if not alive.any():
                return out
            if not alive.all():
                symbols, owner, rank, into, low_all = (x[alive] for x in (symbols, owner, rank, into, low_all))
            at = np.flatnonzero(rank == low_all)
            own = owner[at]
            at = at[np.r_[True, own[1:] != own[:-1]]]
            out[owner[at]] -= 1
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol fewer for each merge to the left
            symbols, owner, rank, into = (x[keep] for x in (symbols, owner, rank, into))
            for i in (at, at[at > 0] - 1):
                nxt = np.minimum(i + 1, len(symbols) - 1)
                r, t = self.pair_ranks(symbols[i], symbols[nxt])
                rank[i] = np.where((owner[nxt] == owner[i]) & (nxt > i), r, self.none)
                into[i] = t


class PieceCounter:
    """Tokens of whole texts as the model's library counts them, without begin or end tokens."""

    def __init__(self, name: str, folder: str | None = None):
        self.table = MergeTable(name, folder)
        self.known = Interned(self._count, limit=500_000)
        stops = any(c + s in self.table.inner for c in _LETTERS for s in ".,")
        self.find = (_PRE if stops else _PRE_STOPS).findall

    def _count(self, pre: list[bytes]):
        import numpy as np

        parts, owner = [], []
        for k, p in enumerate(pre):
            for c in self.table.cut(p.decode(errors="replace").replace(" ", _MARK)):
                parts.append(c)
                owner.append(k)
        return np.bincount(owner, self.table.counts(parts), len(pre)).astype(np.int64)

    def batch(self, texts: list[bytes]) -> list[int]:
        """Tokens of texts in UTF-8. A space stands before each, unless it is empty."""
        import numpy as np

        every, sizes, breaks = [], [], []
        for data in texts:
            pre = self.find(b" " + data.replace(b"\xe2\x96\x81", b" ")) if data else []
            every += pre
            sizes.append(len(pre))
            breaks.append(data.count(b"\n"))
        if not every:
            return breaks
        numbers = self.known.index(every)
        owner = np.repeat(np.arange(len(texts)), sizes)
        return (np.bincount(owner, self.known.values[numbers], len(texts)).astype(np.int64) + breaks).tolist()


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_tokens, over_limit``.

    A null or empty text has none of either. Repeated rows get a row each; an empty
    table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        count = PieceCounter(model, folder)
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n = count.batch([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document; null and empty texts as in :func:`token_counts`."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
