"""SentencePiece encoding and decoding by weighted finite-state transducers.

From a model file four machines are compiled to arc tables over characters, with
weights in the tropical semiring (sums along a path, the least of all paths):

* the normaliser puts a mark in front of a text and turns spaces into marks;
* the pieces are a trie that emits a piece's id where it ends and starts anew;
* the fallback takes any character without a piece and emits its UTF-8 bytes;
* the acceptor of pairs weighs neighbouring pieces.

Normaliser, pieces and fallback are composed once, when a model is loaded. Their
composition with a text and the acceptor has a state for each place of the text
and piece that ends there; it is unfolded while the shortest path is searched.

For unigram models a piece weighs minus its score and the acceptor accepts all
pairs with weight 0, so the last piece makes no difference. For BPE models a sum
of scores is not what the model computes: pieces weigh 0, and the acceptor weighs
a pair 0 if byte-pair merging of their concatenation leaves just that pair, and
infinity otherwise. A segmentation is the one that merging produces if and only if
all its neighbours are such pairs. So the path of least weight is the encoding, of
any beginning of the text as well: one state per place has a finite weight.

The search settles states by rising weight, of equal ones the farthest place first,
and asks the acceptor only for arcs that are next to be settled. For both kinds of
models a place is settled once, so the search is linear in the arcs.

Texts are composed piecewise: no piece crosses the front of a run of marks or a
line break, which is checked against the vocabulary.
"""

from __future__ import annotations

import codecs
import re
import zlib
from functools import lru_cache
from heapq import heappop, heappush

from pyspark.sql import DataFrame

from ..shipping import ship
from .common import Interned, slices, tokenizer_path

_MARK = "▁"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_PRE_PLAIN = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
_PRE_STOPS = re.compile(rb" *[A-Za-z\xc3\x80-\x96\x98-\xb6\xb8-\xbf]+(?=[.,])| +[^ \n]*|[^ \n]+|\n")
INFINITE = float("inf")
#: The weight of a character that is spelled in bytes: more than any path of pieces.
SPELLED = 1e6
codecs.register_error("corvane_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Machine:
    """A transducer from characters to pieces: arcs by state and character, what a state emits, and its weight.

    State 0 is the start; ``rest`` is the weight of the arc that spells a character
    in bytes, where no single-character piece begins at a place.
    """

    def __init__(self, pieces: dict[str, int], weight: dict[int, float], normal: dict[str, str]):
        inverse: dict[str, list[str]] = {}
        for char, to in normal.items():
            inverse.setdefault(to, []).append(char)
        self.step: list[dict[str, int]] = [{}]
        self.emits: list[int] = [-1]
        self.weight: list[float] = [0.0]
        for text, piece in pieces.items():
            state = 0
            for c in text:
                to = self.step[state].get(c)
                if to is None:
                    to = len(self.step)
                    self.step.append({}), self.emits.append(-1), self.weight.append(0.0)
                    # Composed with the normaliser: every character that becomes c takes the same arc.
                    for char in (c, *inverse.get(c, ())):
                        self.step[state][char] = to
                state = to
            self.emits[state], self.weight[state] = piece, weight[piece]
        self.rest = SPELLED


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, name: str, folder: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name, folder))
        n = sp.get_piece_size()
        piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte = {int(piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        probe = "ﬁ Å  ½ á"
        if sp.decode(sp.encode(probe)) != probe or len(byte) != 256:
            raise ValueError("only models with an identity normaliser and byte fallback are supported")
        if any(_MARK in piece[i].lstrip(_MARK) or "\n" in piece[i] for i in plain):
            raise ValueError("a piece spans the borders of words")
        self.compile({piece[i]: i for i in plain}, {i: sp.get_score(i) for i in plain}, byte, {i for i in range(n) if sp.is_control(i)})
        inner = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.find = (_PRE_PLAIN if any(c + s in inner for c in _LETTERS for s in ".,") else _PRE_STOPS).findall

    def compile(self, pieces: dict[str, int], score: dict[int, float], byte: dict[int, int], skipped: set[int]) -> None:
        """The machines of pieces with their scores, byte pieces, and ids that decode to nothing."""
        self.id, self.piece = pieces, {i: p for p, i in pieces.items()}
        # BPE scores are minus the rank of a merge, unigram scores are logarithms with fractions.
        self.bpe = all(float(x).is_integer() for x in score.values())
        ranked = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {self.piece[i]: ranked[x] for i, x in score.items()}
        self.machine = Machine(pieces, {i: 0.0 if self.bpe else -x for i, x in score.items()}, {" ": _MARK})
        self.byte = byte
        self.out = {i: p.replace(_MARK, " ").encode() for p, i in pieces.items()} | {i: bytes([b]) for b, i in byte.items()} | dict.fromkeys(skipped, b"")
        self._pair: dict[int, float] = {}
        self._known = Interned(self._encode_words, limit=800_000)
        self._flat, self._used = None, 0

    # The acceptor of pairs: its arcs are made when they are first met.

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a few characters as defined: the best pair, of those the leftmost, again and again."""
        parts, rank = list(text), self.rank.get
        ranks = [rank(a + b, INFINITE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != INFINITE:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], INFINITE)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], INFINITE)
        return parts

    def pair_weight(self, a: int, b: int) -> float:
        """0 if merging leaves the two pieces side by side, else infinite."""
        x, y = self.piece[a], self.piece[b]
        w = 0.0 if x + y not in self.id and self.merged(x + y) == [x, y] else INFINITE
        if len(self._pair) > 1_000_000:
            self._pair.clear()
        self._pair[a << 32 | b] = w
        return w

    def shortest_path(self, text: str) -> list[int]:
        """Ids of the path of least weight through the composition of ``text``, the machine and the acceptor of pairs.

        ``text`` has its mark in front already. A settled place has its piece in
        ``last`` and the place that this piece begins at in ``before``.
        """
        n = len(text)
        step, emits, weights, rest = self.machine.step, self.machine.emits, self.machine.weight, self.machine.rest
        pair, bpe = self._pair.get, self.bpe
        last, before = [-1] * (n + 1), [-1] * (n + 1)
        place, own, here = 0, -1, 0.0
        waiting: list[tuple[float, int, int, int]] = []  # weight, minus the place reached, piece, place left
        while place < n:
            # The arcs of the piece machine out of here: paths back to its start.
            state, stop, alone = 0, place, False
            while stop < n and (state := step[state].get(text[stop])) is not None:
                stop += 1
                if (piece := emits[state]) >= 0:
                    alone = alone or stop == place + 1
                    if before[stop] < 0:
                        heappush(waiting, (here + weights[state], -stop, piece, place))
            if not alone and before[place + 1] < 0:
                heappush(waiting, (here + rest, -place - 1, -1, place))
            while True:
                here, stop, piece, left = heappop(waiting)
                if before[-stop] >= 0:
                    continue
                own = last[left]
                if bpe and own >= 0 <= piece:
                    between = pair(own << 32 | piece)
                    if (self.pair_weight(own, piece) if between is None else between) == INFINITE:
                        continue
                break
            place = -stop
            last[place], before[place] = piece, left
        path, stop = [], n
        while stop:
            place = before[stop]
            if last[stop] >= 0:
                path.append(last[stop])
            else:
                path += [self.byte[b] for b in reversed(text[place:stop].encode(errors="replace"))]
            stop = place
        return path[::-1]

    def _encode_words(self, words: list[bytes]):
        import numpy as np

        if self._known.values is None:
            self._flat, self._used = np.empty(1 << 20, np.int32), 0
        made = [self.shortest_path(w.decode(errors="replace")) for w in words]
        out = np.empty((len(words), 2), np.int64)
        out[:, 1] = [len(x) for x in made]
        ends = np.cumsum(out[:, 1]) + self._used
        out[:, 0] = ends - out[:, 1]
        if ends[-1] > len(self._flat):
            room = np.empty(2 * int(ends[-1]), np.int32)
            room[: self._used] = self._flat[: self._used]
            self._flat = room
        self._flat[self._used : ends[-1]] = [i for x in made for i in x]
        self._used = int(ends[-1])
        return out

    def encode_flat(self, texts: list[bytes]):
        """The ids of texts in UTF-8 in one array, and where each text's begin, with the end of the last."""
        import numpy as np

        every, sizes = [], []
        for data in texts:
            # The normaliser's arc out of its start; marks of the text itself are cut like spaces.
            words = self.find(b" " + data.replace(b"\xe2\x96\x81", b" ")) if data else []
            every += words
            sizes.append(len(words))
        numbers = self._known.index(every)
        starts, lens = self._known.values[numbers].T if every else (numbers, numbers)
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = self._flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lens)] if every else np.empty(0, np.int32)
        return flat, ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]

    def encode(self, data: bytes) -> list[int]:
        """Ids of a text in UTF-8."""
        return self.encode_flat([data])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the output side of the pieces, marks to spaces, without the space in front."""
        return b"".join(map(self.out.__getitem__, ids)).decode(errors="corvane_each_byte").removeprefix(" ")

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The same in UTF-8, for ids of a whole text, whose bytes are complete."""
        return b"".join(map(self.out.__getitem__, ids)).removeprefix(b" ")


@lru_cache(maxsize=1)
def _compiled(name: str, folder: str | None) -> Transducer:
    """A worker compiles a model once and keeps it, with the paths that it has found, for its next tasks."""
    return Transducer(name, folder)


def encode_rows(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per input row: ``id, n_pieces, ids_crc32, round_trip`` and, if asked for, ``ids`` and ``decoded``.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit numbers; ``round_trip``
    says whether decoding gives the text again (marks in a text come back as spaces).
    A null or empty text has no pieces. Repeated rows get a row each; an empty table
    gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_pieces", "ids_crc32", "round_trip"] + ["ids", "decoded"] * with_ids

    def work(batches):
        import numpy as np
        import pyarrow as pa

        machine = _compiled(model, folder)
        for batch in slices(batches, 256):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            flat, cuts = machine.encode_flat([t or b"" for t in texts])
            ids, at = flat.astype("<u4"), cuts.tolist()
            back = [machine.decode_bytes(part) for part in (flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True))]
            cols = [
                pa.array(cuts[1:] - cuts[:-1], pa.int64()),
                pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                pa.array([x == (t or b"").replace(b"\xe2\x96\x81", b" ") for x, t in zip(back, texts, strict=True)], pa.bool_()),
            ]
            if with_ids:
                cols += [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat)), pa.array(back, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    schema = f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * with_ids
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def decode_rows(rows: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids", folder: str | None = None) -> DataFrame:
    """``id, text`` of rows with ids; null ids give a null text."""
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def work(batches):
        import pyarrow as pa

        machine = _compiled(model, folder)
        for batch in slices(batches, 256):
            texts = [None if ids is None else machine.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(work, f"`{id_col}` {kind}, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Pieces, decoded text and digests of every document; null and empty texts as in :func:`encode_rows`."""
    return encode_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
