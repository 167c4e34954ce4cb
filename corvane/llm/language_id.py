"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is shared by all languages; each language has
its own probability for every piece. A word's likelihood in a language is the sum
over all its segmentations into pieces, found by the forward algorithm; a text's
is the product over its words. Piece probabilities are trained by expectation
maximisation (forward and backward) on all words of a bounded sample of the rows
of each language; every text is then scored whole.

A word is a run without white space, in lower case, with a stop behind letters cut
off; a run of more than ``WORD_CHARS`` characters, as in scripts without spaces, is
several words of so many. Training and scoring cut words by the same function.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Interned, slices, tokenizer_path

_MARK = "▁"
#: About so many rows of each language (at most about twice) are read for training: the one bound of the fit.
SAMPLE_ROWS = 1000
#: Characters of a word: no product of so many probabilities underflows.
WORD_CHARS = 32
ROUNDS = 3
#: Probability mass that every language gives to pieces it has not seen, and of a character outside the vocabulary.
UNSEEN, OUTSIDE = 0.01, 1e-6
UNKNOWN = "und"
#: Bytes of a model, above which training fails: some 8,000 languages with a vocabulary of 32,000 pieces.
MODEL_BYTES = 1 << 30
#: Numbers that a worker keeps for the words it has scored.
KEPT_SCORES = 4_000_000


class Lattice:
    """All segmentations of words into pieces of a vocabulary, in groups of words of one length."""

    def __init__(self, name: str, folder: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name, folder))
        self.id: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id.setdefault(sp.id_to_piece(i), len(self.id))
        self.outside = len(self.id)  # a single character that is no piece
        self.never = self.outside + 1
        self.longest = max(map(len, self.id))
        #: Every beginning of a piece; a mere beginning has the number ``never``.
        self.starts = {p[:k]: self.never for p in self.id for k in range(1, len(p))} | self.id

    def groups(self, words: list[str]):
        """(numbers of the words, pieces[word, end, length]) for each length of word."""
        import numpy as np

        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        get, never, longest = self.starts.get, self.never, self.longest
        for n, members in by.items():
            width = min(n, longest)
            step = max(1, 2_000_000 // (n * width + 1))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                pieces = np.full((len(part), n + 1, width + 1), never, np.int32)
                where, piece, cell = [], [], width + 1
                for r, k in enumerate(part):
                    w, row = words[k], r * (n + 1) * cell
                    for start in range(n):
                        p = get(w[start])
                        where.append(row + (start + 1) * cell + 1)
                        piece.append(self.outside if p is None or p == never else p)
                        if p is None:
                            continue
                        at_stop = row + (start + 2) * cell + 2
                        for stop in range(start + 2, min(n, start + longest) + 1):
                            if (p := get(w[start:stop])) is None:
                                break
                            if p != never:
                                where.append(at_stop)
                                piece.append(p)
                            at_stop += cell + 1
                pieces.reshape(-1)[where] = piece
                yield np.array(part), pieces

    def forward(self, pieces, prob):
        """Per word and language, the log of the probability summed over all segmentations."""
        import numpy as np

        n, width = pieces.shape[1] - 1, pieces.shape[2] - 1
        alpha = np.zeros((n + 1, len(pieces), prob.shape[1]))
        alpha[0] = 1
        for end in range(1, n + 1):
            for size in range(1, min(end, width) + 1):
                alpha[end] += alpha[end - size] * prob[pieces[:, end, size]]
        return np.log(alpha[n])

    def expected(self, pieces, prob, weight):
        """Expected counts of the pieces in words of the given weight, for one language."""
        import numpy as np

        n, width = pieces.shape[1] - 1, pieces.shape[2] - 1
        p = prob[pieces]  # word, end, size
        alpha, beta = np.zeros((n + 1, len(pieces))), np.zeros((n + 1, len(pieces)))
        alpha[0], beta[n] = 1, 1
        for end in range(1, n + 1):
            for size in range(1, min(end, width) + 1):
                alpha[end] += alpha[end - size] * p[:, end, size]
        for start in range(n - 1, -1, -1):
            for size in range(1, min(n - start, width) + 1):
                beta[start] += beta[start + size] * p[:, start + size, size]
        out = np.zeros(len(prob))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(alpha[n] > 0, weight / alpha[n], 0)
        for end in range(1, n + 1):
            for size in range(1, min(end, width) + 1):
                out += np.bincount(pieces[:, end, size], alpha[end - size] * p[:, end, size] * beta[end] * share, len(prob))
        return out


#: Words, with letters before a stop apart; what begins with a stop takes no mark of a word.
_PRE = re.compile(rb"[a-z\xc3\x80-\x96\x98-\xb6\xb8-\xbf]+(?=[.,])|[^\x20\x09-\x0D]+")


def _runs(data: bytes) -> list[bytes]:
    return _PRE.findall(data.lower())


def _words(run: bytes) -> list[str]:
    """The words of a run: itself with a mark, or pieces of ``WORD_CHARS`` characters where it is longer."""
    word = run.decode(errors="replace").lower()
    word = word if word[0] in ".," else _MARK + word
    return [word[k : k + WORD_CHARS] for k in range(0, len(word), WORD_CHARS)]


def _counted(batches):
    """(lang, w, n): the runs of texts, counted per slice."""
    from collections import Counter

    import pyarrow as pa

    for batch in slices(batches):
        counts = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            counts.update((lang, w) for w in _runs(text))
        rows = [(lang, w, n) for (lang, w), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], ["lang", "w", "n"])


def train(docs: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang", model: str = "piece_bpe_32k.model", folder: str | None = None, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Languages, their shares of the rows and the piece probabilities, from rows with a language and a text.

    Of each language about ``sample_rows`` rows are read, all if it has fewer,
    chosen by a hash of the text; equal texts of a language count once. All words
    of those rows are learned from. Shares are counted over all rows.
    """
    import numpy as np

    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(shares)
    lattice = Lattice(model, folder)
    size = lattice.never + 1
    if 4 * size * len(langs) > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages: the model would be larger than {MODEL_BYTES} bytes")
    by: dict[str, dict[str, int]] = {k: {} for k in langs}
    if langs:
        every = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(max(1, shares[k] // sample_rows)))])
        # Copies of a text are one row, so that a hot one does not fill the sample.
        part = rows.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.element_at(every, F.col("lang"))) == 0)
        part = part.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
        words = part.mapInArrow(_counted, "lang string, w binary, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
        for r in words.collect():
            own = by[r["lang"]]
            for w in _words(bytes(r["w"])):
                own[w] = own.get(w, 0) + r["n"]
    probs = np.zeros((size, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        words_k = sorted(by[lang])
        weight = np.array([by[lang][w] for w in words_k], float)
        groups = list(lattice.groups(words_k))
        p = np.full(size, 1.0 / size)
        p[lattice.never] = 0
        for _ in range(ROUNDS):
            counts = np.zeros(size)
            for members, pieces in groups:
                counts += lattice.expected(pieces, p, weight[members])
            counts[lattice.never] = counts[lattice.outside] = 0
            total = counts.sum()
            p = (1 - UNSEEN) * counts / total + UNSEEN / size if total else np.full(size, 1.0 / size)
            p[lattice.outside], p[lattice.never] = OUTSIDE, 0
        probs[:, k] = p
    total = sum(shares.values())
    return {"model": model, "folder": folder, "langs": langs, "prior": [shares[k] / total for k in langs], "prob": probs}


class Identifier:
    """Language and its posterior probability for single texts."""

    def __init__(self, trained: dict):
        import numpy as np

        self.np, self.langs = np, trained["langs"]
        self.lattice = Lattice(trained["model"], trained["folder"])
        self.prob = trained["prob"].astype(float)
        self.prior = np.log(trained["prior"])
        self.runs = Interned(self._score, limit=max(1000, KEPT_SCORES // (len(self.langs) + 1)))

    def _score(self, runs: list[bytes]):
        """Per run, its log-likelihood in each language, and whether it has a letter."""
        np = self.np
        words = [_words(r) for r in runs]
        owner = np.repeat(np.arange(len(runs)), [len(x) for x in words])
        out = np.zeros((len(runs), len(self.langs) + 1))
        for members, pieces in self.lattice.groups([w for x in words for w in x]):
            np.add.at(out, (owner[members], slice(0, -1)), self.lattice.forward(pieces, self.prob))
        out[:, -1] = [any(c.isalpha() for w in x for c in w) for x in words]
        return out

    def batch(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        np = self.np
        runs = [_runs(t) if t else [] for t in texts]
        every = [w for x in runs for w in x]
        if not every or not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        numbers = self.runs.index(every)
        out, at = [], 0
        for x in runs:
            sums = self.runs.values[numbers[at : at + len(x)]].sum(0)
            at += len(x)
            if not sums[-1]:
                out.append((UNKNOWN, 0.0))
                continue
            s = sums[:-1] + self.prior
            k = int(np.argmax(s))
            out.append((self.langs[k], float(1 / np.exp(s - s[k]).sum())))
        return out


def identify(docs: DataFrame, trained: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, lang_pred, score``.

    ``lang_pred`` is a trained language, or ``und`` with score 0 where the text is
    null or has no letter, or nothing was trained. Of languages with equal scores
    the first by name wins. Repeated rows get a row each; an empty table gives an
    empty result; other columns are not read. What is broadcast, the model, has
    four bytes for each piece and language, at most ``MODEL_BYTES``.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(trained)

    def work(batches):
        import pyarrow as pa

        identifier = Identifier(shared.value)
        for batch in slices(batches):
            got = identifier.batch(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out; null and empty texts as in :func:`identify`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    found = identify(docs, train(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
