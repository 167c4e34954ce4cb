"""Quality rules: base counts and the divergence of a text from its language.

A text's histograms of character classes and of common words are compared with
references of each language by the Jensen-Shannon distance (the square root of
the divergence in bits). A text is kept if some language is near enough in both;
texts below a minimum length are not judged on words.

References are counted on all rows with a language and on whole texts. A language
of fewer than ``LEAST_REFERENCE_WORDS`` words gets none, and the base rules alone
judge its texts; rows without a language are judged by the nearest reference.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import Interned, Scratch, slices

#: Common words of a language that its reference holds, and words that it is counted on at least: the reference
#: then strays by less than a tenth of the largest word distance.
COMMON_WORDS, LEAST_REFERENCE_WORDS = 50, 5000
#: Distinct words that a task counts before it passes its counts on.
COUNTED_WORDS = 200_000
#: Largest distances that are kept. A histogram of n words strays from its language by about 1 / sqrt(n) of
#: itself, so the word limit is wider for shorter texts; below LEAST_WORDS only characters are judged.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE, WORD_NOISE, LEAST_WORDS = 0.30, 0.235, 1.6, 60
#: The same widening of the character limit, by the number of characters, for texts below BASE_WORDS words.
CHAR_NOISE, BASE_WORDS = 1.0, 50

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other ASCII", "beyond ASCII")


def _class_table():
    import numpy as np

    table = np.full(256, 6, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", _SPACE, b".,;:!?'\"-()", _SYMBOLS)):
        table[list(chars)] = k
    table[0xC0:] = 7
    table[0x80:0xC0] = 8  # later bytes of a character aren't counted
    return table


def _plain(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?'\"-()[]#*$%&|<>")


def _counts_of(batches):
    """Per task and language: counts of character classes (keys c0 to c7) and words (w and the word)."""
    import numpy as np
    import pyarrow as pa

    table = _class_table()
    chars, words = defaultdict(lambda: np.zeros(8, np.int64)), defaultdict(Counter)

    def counted():
        flat = [(lang, f"c{k}", int(n)) for lang, hist in chars.items() for k, n in enumerate(hist)]
        for lang, raw in words.items():
            plain = Counter()
            for w, n in raw.items():
                plain[_plain(w)] += n
            flat += [(lang, "w" + w.decode(errors="replace"), n) for w, n in plain.items()]
        chars.clear()
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "key", "n"])

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode()
            chars[lang] += np.bincount(table[np.frombuffer(data, np.uint8)], minlength=9)[:8]
            words[lang].update(data.split())
        if sum(map(len, words.values())) > COUNTED_WORDS:
            yield counted()
    if chars:
        yield counted()


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> str:
    """JSON of the histograms of each language with enough words; ``COMMON_WORDS`` words each."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counts_of, "lang string, key string, n bigint")
    tmp = Scratch(docs.sparkSession, "references")
    counts = tmp.save(counts.groupBy("lang", "key").agg(F.sum("n").alias("n")), "counts")
    word = F.col("key").startswith("w")
    total = counts.groupBy("lang").agg(F.sum(F.when(word, F.col("n"))).alias("w"), F.sum(F.when(~word, F.col("n"))).alias("c"))
    total = tmp.save(total.where(F.col("w") >= LEAST_REFERENCE_WORDS), "totals")
    counts = counts.join(F.broadcast(total), "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = counts.where(word & (F.col("key") != "w")).withColumn("r", rank).where(F.col("r") <= COMMON_WORDS).drop("r")
    found: dict[str, dict] = {}
    for r in top.unionByName(counts.where(~word)).collect():
        x, share = found.setdefault(r["lang"], {"char": [0.0] * 8, "word": {}}), r["n"] / max(1, r[r["key"][0]])
        if r["key"][0] == "c":
            x["char"][int(r["key"][1:])] = share
        else:
            x["word"][r["key"][1:]] = share
    tmp.drop("counts", "totals")
    return json.dumps(found, sort_keys=True)


def js_distance(p, q):
    """Jensen-Shannon distances, base 2, along the last axis of two arrays of probabilities."""
    import numpy as np

    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.maximum(0.0, (a + b) / 2))


class Judge:
    """Counts and distances of single texts."""

    def __init__(self, references: str):
        import numpy as np

        ref = json.loads(references)
        self.langs, self.known = sorted(ref), set(ref)
        vocabulary = sorted({w for x in ref.values() for w in x["word"]})
        self.number = {w.encode(): i for i, w in enumerate(vocabulary)}
        self.char = np.array([ref[k]["char"] for k in self.langs], float).reshape(-1, 8)
        self.word = np.zeros((len(self.langs), len(vocabulary) + 1))
        for k, lang in enumerate(self.langs):
            for w, p in ref[lang]["word"].items():
                self.word[k, self.number[w.encode()]] = p
        self.own = self.word > 0
        self.word[:, -1] = np.maximum(0.0, 1 - self.word.sum(1))
        self.table = _class_table()
        other = len(vocabulary)
        self.common = Interned(lambda words: np.fromiter((self.number.get(_plain(w), other) for w in words), np.int64, len(words)))

    @staticmethod
    def repeated(ids) -> int:
        """Words in 3-word windows that occur twice or more."""
        import numpy as np

        if len(ids) < 3:
            return 0
        if ids.max() >= 1 << 21:
            ids = np.unique(ids, return_inverse=True)[1]
        if ids.max() < 1 << 21:
            keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            two = np.unique(np.stack([ids[:-2], ids[1:-1]], 1), axis=0, return_inverse=True)[1].ravel()
            keys = np.unique(np.stack([two, ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        covered = np.zeros(len(ids), bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        return int(covered.sum())

    def distances(self, data: bytes, ids, n_words: int) -> tuple[float, float, str | None]:
        """Character and word distance of the nearest language, and its name."""
        import numpy as np

        if not n_words or not self.langs:
            return 1.0, 1.0, None
        c = np.bincount(self.table[np.frombuffer(data, np.uint8)], minlength=9)[:8].astype(float)
        char = js_distance(c / c.sum(), self.char)
        w = np.bincount(self.common.values[ids], minlength=self.word.shape[1]).astype(float)
        p = np.where(self.own, w / n_words, 0.0)
        p[:, -1] = np.maximum(0.0, 1 - p[:, :-1].sum(1))
        word = js_distance(p, self.word)
        k = int(np.argmin(char + word))
        return float(char[k]), float(word[k]), self.langs[k]

    def row(self, text: str | None, own: str | None = None, judge_short: bool = False) -> tuple:
        """The columns of a text whose language is ``own``.

        With ``judge_short`` a text is not rejected for having few words, but by its
        repetitions and characters; one without any word is rejected all the same.
        """
        data = (text or "").encode(errors="replace")
        words = data.split()
        n = len(words)
        word_bytes = len(data.translate(None, _SPACE))
        word_chars = len(text or "") - (len(data) - word_bytes)
        lines = [x for x in data.split(b"\n") if x.strip()]
        ids = self.common.index(words)
        repeat = self.repeated(ids)
        failed = n < BASE_WORDS or 100 * repeat > 50 * n
        char, word, lang = self.distances(data, ids, n)
        near = char <= MOST_CHAR_DISTANCE and (n < LEAST_WORDS or word <= MOST_WORD_DISTANCE + WORD_NOISE / n**0.5)
        if judge_short and 0 < n < BASE_WORDS:
            rejected = 100 * repeat > 50 * n
            near = char <= MOST_CHAR_DISTANCE + CHAR_NOISE / (len(text) or 1) ** 0.5
        else:
            rejected = failed
        symbols = len(data) - len(data.translate(None, _SYMBOLS))
        return n, word_chars, symbols, len(lines) - len(set(lines)), repeat, failed, char, word, lang, not rejected and (near or not self.langs or own is not None and own not in self.known)


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, nearest_lang string, kept boolean"


def quality_rows(docs: DataFrame, references: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: the id and the columns of :data:`_COLUMNS`.

    Null and empty texts have no words and fail the base rules. Only the base
    rules judge texts of a language without a reference, and all texts if there is
    no reference at all. Repeated rows get a row each; an empty table gives an
    empty result.
    """

    def work(batches):
        import pyarrow as pa

        judge = Judge(references)
        for batch in slices(batches):
            rows = [judge.row(t, own) for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
            names = [c.split()[0] for c in _COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, lang_col).mapInArrow(work, f"`{id_col}` {kind}, {_COLUMNS}")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", judge_short: bool = False) -> DataFrame:
    """The documents that the rules keep, all columns as they were.

    The verdict is made in the same pass over the rows, so nothing is joined or
    shuffled. Documents of fewer than ``BASE_WORDS`` words go, or with
    ``judge_short`` are judged by what can be told of them (see :meth:`Judge.row`).
    Null and empty texts go; repeated rows are judged each; null ids make no
    difference; an empty table gives an empty result.
    """
    references = language_references(docs, text_col, lang_col)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def work(batches):
        import pyarrow as pa

        judge = Judge(references)
        for batch in slices(batches):
            kept = [judge.row(t, own, judge_short)[-1] for t, own in zip(batch.column(at).to_pylist(), batch.column(lang_at).to_pylist(), strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document, distances to six digits; odd rows as in :func:`quality_rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality_rows(docs, language_references(docs))
    return rows.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _oracle() -> str:
    classes = ("[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x20\x09-\x0D]", r"[^.,;:!?''\x22\-()]", "[^#*$%&|<>]")
    counts = ", ".join(f"length(regexp_replace(t, '{c}', '', 'g'))" for c in classes)
    ends = r"[.,;:!?''\x22\-()\[\]#*$%&|<>]+"
    js = "sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda x: (CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END) / 2))))"
    return f"""
WITH d AS (SELECT doc_id, lang, text IS NULL AS absent, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS ws FROM documents),
counted AS (SELECT *, [{counts}] AS c, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) AS beyond, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
x AS (SELECT *, list_transform(list_concat(c, [length(t) - list_sum(c)::BIGINT - beyond, beyond]), lambda n: n::DOUBLE) AS h FROM counted),
words AS (SELECT doc_id, lang, absent, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM x),
triples AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM triples WHERE w3 IS NOT NULL),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM grams WHERE n > 1) GROUP BY doc_id),
plain AS (SELECT doc_id, lang, absent, regexp_replace(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^{ends}|{ends}$', '', 'g') AS w FROM words),
total AS (SELECT lang, count(*) AS n FROM plain WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_REFERENCE_WORDS}),
top AS (SELECT lang, w, count(*) / any_value(total.n) AS q FROM plain JOIN total USING (lang) WHERE w != '' GROUP BY lang, w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) <= {COMMON_WORDS}),
chars AS (SELECT lang, list(s / z ORDER BY k) AS q FROM (SELECT lang, k, sum(v) AS s, sum(sum(v)) OVER (PARTITION BY lang) AS z FROM (SELECT lang, unnest(h) AS v, generate_subscripts(h, 1) AS k FROM x JOIN total USING (lang) WHERE NOT absent) GROUP BY lang, k) GROUP BY lang),
own AS (SELECT doc_id, w, count(*) AS n FROM plain GROUP BY ALL),
hits AS (SELECT doc_id, top.lang AS ref, w, own.n FROM own JOIN top USING (w)),
pairs AS (SELECT doc_id, total.lang AS ref, h, len(ws) AS n FROM x CROSS JOIN total WHERE len(ws) > 0),
shares AS (SELECT pairs.doc_id, ref, list(coalesce(hits.n, 0) / pairs.n ORDER BY top.w) AS p, list(top.q ORDER BY top.w) AS q
           FROM pairs JOIN top ON top.lang = ref LEFT JOIN hits USING (doc_id, ref, w) GROUP BY ALL),
rest AS (SELECT doc_id, ref, list_append(p, greatest(0, 1 - list_sum(p))) AS p, list_append(q, greatest(0, 1 - list_sum(q))) AS q FROM shares),
far AS (SELECT doc_id, ref, {js.format(p="list_transform(h, lambda v: v / list_sum(h))", q="chars.q")} AS char, {js.format(p="rest.p", q="rest.q")} AS word
        FROM pairs JOIN rest USING (doc_id, ref) JOIN chars ON chars.lang = ref),
near AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY char + word, ref) = 1),
y AS (SELECT x.doc_id, x.lang, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS dup, coalesce(repeats.n, 0) AS rep, coalesce(char, 1) AS char, coalesce(word, 1) AS word, ref
      FROM x LEFT JOIN repeats USING (doc_id) LEFT JOIN near USING (doc_id)),
z AS (SELECT *, n < {BASE_WORDS} OR 100 * rep > 50 * n AS failed FROM y)
SELECT doc_id, n::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, failed AS base_failed,
  round(char, 6)::DOUBLE AS char_distance, round(word, 6)::DOUBLE AS word_distance, ref AS nearest_lang,
  NOT failed AND (char <= {MOST_CHAR_DISTANCE} AND (n < {LEAST_WORDS} OR word <= {MOST_WORD_DISTANCE} + {WORD_NOISE} / sqrt(n))
    OR (SELECT count(*) FROM total) = 0 OR lang IS NOT NULL AND lang NOT IN (SELECT lang FROM total)) AS kept
FROM z
"""


ORACLE = _oracle()
