"""Near-duplicate groups by fast similarity sketches, banding and exact checks.

A document is the set of its distinct word shingles. Its sketch fills T
coordinates in rounds: in each of the first T rounds every element falls into one
random bin with a random value, in the next T rounds into the bin of the round,
so that every coordinate fills; the first round to reach a bin counts, and the
smallest value in it. Coordinates of two sets agree with the probability of their
Jaccard similarity, with concentration as for independent ones. Bands of
coordinates are hashed to buckets. At a similarity of 0.8 two sets share no
bucket with a probability of (1 - 0.8 ** 8) ** 64, below 1e-5, and less above it.

Documents of equal sets are one class, which a single row stands for from then
on. Candidates are first the pairs of each bucket's members with its hub; links
are confirmed on full sets, and connected components are contracted. What a bucket
then still holds apart is compared with a second hub, and at last exhaustively:
every pair that shares a bucket is either in one component, or compared, or ruled
out by exact bounds on what it can share. Pairs inside a component are never
listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import Interned, Scratch, keep_rows, mix, slices, word_hashes

BANDS, ROWS = 64, 8
#: Buckets of more classes get a second hub before their rest is compared exhaustively.
LARGE_BUCKET = 32


def shingle_set(hashes, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle together."""
    import numpy as np

    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        k_own = min(k, n)
        out = np.zeros(n - k_own + 1, np.uint64)
        for i in range(k_own):
            out = mix(out + hashes[i : n - k_own + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
        if k_own < k:
            out = mix(out + np.uint64(n))
    return np.unique(out)


class Sketcher:
    """Fast similarity sketches with ``coordinates`` bins, a power of two."""

    def __init__(self, coordinates: int = BANDS * ROWS):
        import numpy as np

        if coordinates & (coordinates - 1):
            raise ValueError("coordinates must be a power of two")
        self.t, self.shift = coordinates, np.uint64(64 - coordinates.bit_length() + 1)
        rounds = np.arange(2 * coordinates, dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.seed = mix(rounds * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))

    def __call__(self, elements):
        import numpy as np

        t, n = self.t, len(elements)
        full = np.uint64(2**64 - 1)
        out = np.full(t, full)
        at = 0
        while at < 2 * t and (out == full).any():
            # Small sets need many rounds; they are done in blocks, which changes no value.
            stop = min(2 * t, at + max(1, t // n), t if at < t else 2 * t)
            with np.errstate(over="ignore"):
                h = mix(elements[None, :] + self.seed[at:stop, None])
                value = ((mix(h + np.uint64(1)) >> np.uint64(16)) | (np.arange(at, stop, dtype=np.uint64) << np.uint64(48))[:, None])
            if at < t:
                np.minimum.at(out, (h >> self.shift).astype(np.int64).ravel(), value.ravel())
            else:
                out[at - t : stop - t] = np.minimum(out[at - t : stop - t], value.min(1))
            at = stop
        return out

    def bands(self, sketch, rows: int):
        """One 64-bit key for each band; the band's number is part of it."""
        import numpy as np

        with np.errstate(over="ignore"):
            key = np.arange(self.t // rows, dtype=np.uint64)
            for r in range(rows):
                key = mix(key + sketch.reshape(-1, rows)[:, r] * np.uint64(0x9E3779B97F4A7C15))
        return key.astype(np.int64)


def _sets(texts, hashes: Interned, k: int):
    for t in texts:
        words = (t or b"").lower().split()  # bytes: A-Z only, ASCII white space only
        at = hashes.index(words)
        yield shingle_set(hashes.values[at] if len(at) else at, k)


def _signatures(k: int, bands: int, rows: int):
    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        hashes, sketcher = Interned(word_hashes), Sketcher(bands * rows)
        for batch in slices(batches):
            n, d1, d2, keys = [], [], [], []
            for s in _sets(batch.column(2).cast(pa.binary()).to_pylist(), hashes, k):
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                n.append(len(s)), d1.append(a), d2.append(b)
                keys.append(sketcher.bands(sketcher(s), rows) if len(s) else None)
            flat = np.concatenate([x for x in keys if x is not None] or [np.empty(0, np.int64)])
            ends = np.cumsum([0] + [0 if x is None else len(x) for x in keys]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "rid", "n", "d1", "d2", "bands"])

    return work


def _full_sets(k: int):
    def work(batches):
        import pyarrow as pa

        hashes = Interned(word_hashes)
        for batch in slices(batches):
            sets = [s.tobytes() for s in _sets(batch.column(1).cast(pa.binary()).to_pylist(), hashes, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rid", "items"])

    return work


def _items(batches):
    """One row for each shingle of a set."""
    import numpy as np
    import pyarrow as pa

    for batch in slices(batches, 256):
        sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        rid = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid, [len(x) for x in sets])), pa.array(np.concatenate(sets))], ["rid", "item"])


def _linked(percent: int):
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 256):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return work


def components(edges: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): equal roots if and only if connected.

    In each round every vertex points to its smallest neighbour, pointers are
    shortened twice, and the edges are contracted; at least half of the vertices
    of a component go, so the rounds are logarithmic in its size.
    """
    edges = tmp.save(edges, f"{name}_edges0")
    labels, k = None, 0
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        to = tmp.save(low.select("v", F.least("v", "m").alias("p")), f"{name}_to{k}")
        for j in range(2):
            nxt = to.select(F.col("v").alias("p"), F.col("p").alias("q"))
            to = to.join(nxt, "p").select("v", F.col("q").alias("p"))
        to = tmp.save(to, f"{name}_roots{k}")
        if labels is None:
            labels = to.select("v", F.col("p").alias("root"))
        else:
            moved = to.select(F.col("v").alias("root"), "p")
            labels = labels.join(moved, "root", "left").select("v", F.coalesce("p", "root").alias("root"))
        labels = tmp.save(labels, f"{name}_labels{k}")
        ra, rb = to.select(F.col("v").alias("a"), F.col("p").alias("pa")), to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = edges.join(ra, "a").join(rb, "b").where("pa != pb")
        k += 1
        edges = tmp.save(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}_edges{k}")
    if labels is None:
        labels = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels


def _row_key(id_col: str, text_col: str, salt: int) -> Column:
    """A row's key follows from its content, so that it is the same in every reading of the input."""
    return F.xxhash64(id_col, text_col, F.lit(salt))


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, Scratch, int]:
    """(doc_id, rid, n, root, component_id) of each row: equal roots if and only if in one component; no root without shingles.

    Also the salt of the rows' keys: it is raised until no two different sets share one.
    """
    spark = docs.sparkSession
    ship(spark)
    tmp = Scratch(spark, "near")
    kind = docs.schema[id_col].dataType.simpleString()
    salt = 0
    while True:
        source = docs.select(F.col(id_col).alias("doc_id"), _row_key(id_col, text_col, salt).alias("rid"), F.col(text_col).alias("text"))
        every = tmp.save(source.mapInArrow(_signatures(shingle_words, bands, rows), f"doc_id {kind}, rid long, n long, d1 long, d2 long, bands array<long>"), f"signatures{salt}")
        some = every.where("n > 0")
        digests = some.groupBy("rid").agg(*[f(d).alias(f"{d}{k}") for d in ("d1", "d2") for k, f in enumerate((F.min, F.max))])
        if digests.where("d10 != d11 or d20 != d21").isEmpty():
            break
        tmp.drop(f"signatures{salt}")
        salt += 1

    classes = tmp.save(some.groupBy("d1", "d2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("low")), "classes")
    reps = some.select("rid", "n", "bands").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").dropDuplicates(["rid"])
    member = reps.select("rid", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    found = tmp.save(member.join(shared, "bucket"), "found")
    # A class that meets many others is in the middle of them: such make hubs.
    central = found.groupBy("rid").agg(F.sum("size").alias("met"))
    order = F.shiftleft(F.least("met", F.lit((1 << 20) - 1)), 43) + F.col("rid").bitwiseAND(F.lit((1 << 43) - 1))
    member = tmp.save(found.join(central, "rid").select("bucket", "rid", "n", "size", order.alias("order")), "members")
    tmp.drop("found")

    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  else the sizes forbid a link
    needed = member.select("rid").distinct()
    # Texts are joined in one way at every size, so that a small run tells what a large one needs.
    full = source.select("rid", "text").join(needed.hint("merge"), "rid", "left_semi").mapInArrow(_full_sets(shingle_words), "rid long, items binary")
    full = tmp.save(full.dropDuplicates(["rid"]), "sets")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        with_b = pairs.join(full.select(F.col("rid").alias("b"), F.col("items").alias("items_b")), "b")
        with_a = with_b.join(full.select(F.col("rid").alias("a"), F.col("items").alias("items_a")), "a")
        return tmp.save(with_a.select("a", "b", "items_a", "items_b").mapInArrow(_linked(percent), "a long, b long"), name)

    def could_link(now: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of ``others`` with any row of ``now`` in another component that may be links, by prefix and position.

        Shingles are ordered from the rarest. Two sets that are linked share one among
        their first n - percent * n + 1; the first that they share bounds, by its places,
        all that they can share. Both bounds are exact: no link is lost.
        """
        rows = now.select("rid", "n", "root").distinct().join(others.select("rid", F.lit(True).alias("other")).distinct(), "rid", "left")
        each = full.join(rows.select("rid"), "rid", "left_semi").mapInArrow(_items, "rid long, item long")
        each = tmp.save(each, "items")
        often = tmp.save(each.groupBy("item").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
        place = F.row_number().over(Window.partitionBy("rid").orderBy(F.coalesce("often", F.lit(1)), "item"))
        first = each.join(often, "item", "left").withColumn("place", place).join(rows, "rid")
        prefix = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
        # A shingle that no other set has counts for the places but meets nothing.
        first = tmp.save(first.where((F.col("place") <= prefix) & F.col("often").isNotNull()).select("item", "rid", "n", "root", "other", "place"), "prefixes")
        x = first.where("other").select("item", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("place").alias("pa"))
        both = 1 + F.least(F.col("n") - F.col("place"), F.col("na") - F.col("pa"))
        can = ((100 + percent) * both >= percent * (F.col("n") + F.col("na"))) & (F.col("root") != F.col("ra")) & fits(F.col("n"), F.col("na"))
        met = first.join(x, "item").where(can)
        return met.select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b")).distinct()

    def with_hub(rows: DataFrame, choice: DataFrame, name: str) -> DataFrame:
        """``rows`` beside the hub (a, na, ra) of their bucket: the most central row of ``choice``.

        What is joined is stored first, so that both sides are shuffled and a hot bucket can be split.
        """
        top = tmp.save(choice.groupBy("bucket").agg(F.max("order").alias("order")), f"{name}_top")
        hub = choice.join(top, ["bucket", "order"]).select("bucket", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
        return rows.join(tmp.save(hub, f"{name}_hubs"), "bucket")

    own = member.withColumn("root", F.col("rid"))
    pairs = with_hub(own, own, "first").where((F.col("rid") != F.col("a")) & fits(F.col("n"), F.col("na")))
    pairs = pairs.select("a", F.col("rid").alias("b")).distinct()
    tested = tmp.save(pairs, "pairs0")
    labels = components(links(tested, "links0"), tmp, "c0")

    for k in (1, 2):
        at = labels.select(F.col("v").alias("rid"), "root")
        # Buckets of two have had their only pair compared.
        now = member.where("size > 2").join(at, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        open_ = now.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
        open_ = tmp.save(open_, f"apart{k}")
        now = now.join(open_, "bucket", "left_semi")
        if k == 1:
            now = now.where(F.col("size") > LARGE_BUCKET)
        now = tmp.save(now, f"open{k}")
        if now.isEmpty():
            continue
        held = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
        most = held.groupBy("bucket").agg(F.max("c").alias("c")).join(held, ["bucket", "c"]).groupBy("bucket").agg(F.min("root").alias("most"))
        most = tmp.save(most, f"most{k}")
        others = tmp.save(now.join(most, "bucket").where("root != most").drop("most"), f"others{k}")
        if k == 1:
            met = with_hub(now, others, "second").where((F.col("root") != F.col("ra")) & fits(F.col("n"), F.col("na")))
            pairs = met.select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b")).distinct()
        else:
            # All but the largest component of each bucket are compared with every other.
            pairs = could_link(now, others)
        before = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = tmp.save(pairs.join(before, ["a", "b"], "left_anti"), f"pairs{k}")
        tested = tested.unionByName(pairs)
        new = links(pairs, f"links{k}")
        # The new links join whole components, so they are contracted over the roots.
        ra = at.select(F.col("rid").alias("a"), F.col("root").alias("pa"))
        rb = at.select(F.col("rid").alias("b"), F.col("root").alias("pb"))
        new = new.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a != b").distinct()
        merged = components(new, tmp, f"c{k}")
        roots = merged.select(F.col("v").alias("root"), F.col("root").alias("top"))
        grown = labels.join(roots, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
        fresh = merged.join(labels.select("v"), "v", "left_anti")
        labels = tmp.save(grown.unionByName(fresh), f"labels{k}")

    classes = classes.join(labels.select(F.col("v").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = tmp.save(classes, "class_roots")
    lows = tmp.save(classes.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    classes = tmp.save(classes.join(lows, "root").select("d1", "d2", "root", "component_id"), "class_components")
    out = every.select("doc_id", "rid", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    some = F.col("n") > 0
    return out.select("doc_id", "rid", "n", F.when(some, F.col("root")).alias("root"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), tmp, salt


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Links: ``100 * intersection >= percent * union`` of the full shingle sets.
    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is
    the row's own. Null texts and texts without words have no shingles and are
    linked with nothing, not even with each other. Repeated rows are in one
    component (rows that also share the id are all kept or all not). An empty table
    gives an empty result; null ids never name a component unless nothing else is there.
    """
    rows_, tmp, _ = _grouped(docs, id_col, text_col, shingle_words, percent, bands, rows)
    return tmp.result(rows_.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group, all columns as they were: that of the smallest id, a null one only if there is no other.

    The row is found by its id, null or not, and the hash of its id and text; of
    repeated rows with both, one stays. Rows without shingles, null and empty texts
    among them, all stay; an empty table gives an empty result.
    """
    rows, tmp, salt = _grouped(docs, id_col, text_col, **options)
    keys = rows.groupBy("doc_id", "rid", "root").agg(F.count(F.lit(1)).alias("times"))
    keys = tmp.save(keys.select("root", F.col("doc_id").alias("_kept_id"), F.col("rid").alias("_kept_content"), "times"), "keys")
    least = F.min(F.struct(F.col("_kept_id").isNull(), "_kept_id", "_kept_content", "times")).alias("x")
    one = keys.where("root is not null").groupBy("root").agg(least).select("x._kept_id", "x._kept_content", "x.times")
    kept = tmp.result(one.unionByName(keys.where("root is null").select("_kept_id", "_kept_content", F.lit(1).cast("long").alias("times"))))
    return keep_rows(docs, id_col, _row_key(id_col, text_col, salt), kept.drop("times"), kept.where("times > 1").drop("times"))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents; odd rows as in :func:`near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2, percent=80)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.v)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.r) AS component_id, s.doc_id = min(r.r) AS kept
FROM sets s JOIN reach r ON r.v = s.doc_id GROUP BY s.doc_id, s.s
"""
