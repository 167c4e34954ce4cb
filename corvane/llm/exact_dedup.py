"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of a fixed number of UTF-8 bytes. The distinct
blocks are sorted and get integer names; then pairs of adjacent names are sorted
and named, again and again, until one name is left of every document. Equal
names at the same level mean equal texts: no step trusts a hash. A block's hash
only serves to send its name back to the occurrences, and blocks whose hash also
belongs to another block are told apart by their bytes.

All of it is DataFrame operations. Hot texts are pre-aggregated before every
shuffle that names blocks or pairs; the joins that carry names back are plain
sort-merge joins, which Spark splits when one name is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_rows

BLOCK_BYTES = 4096


def _blocks(data: Column, block: int) -> Column:
    last = F.greatest(F.lit(0), F.ceil(F.length(data) / F.lit(block)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block + 1, F.lit(block)))


def _hash(x: Column, bits: int) -> Column:
    h = F.xxhash64(x)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Integer names by sorted order within the partitions of ``distinct``."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def text_identities(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK_BYTES, hash_bits: int = 64) -> tuple[DataFrame, Scratch]:
    """(rid, level, name, sha256, kept columns): equal (level, name) if and only if the texts are equal.

    Null texts count as empty. ``rid`` numbers the rows, repeated rows too.
    ``hash_bits`` below 64 forces hash collisions, for tests.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "naming")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    heads = tmp.save(
        docs.select(*keep, data.alias("_data")).select(
            F.monotonically_increasing_id().alias("rid"), *keep,
            F.sha2("_data", 256).alias("sha256"),
            F.transform(_blocks(F.col("_data"), block), lambda b: _hash(b, hash_bits)).alias("hashes"),
        ),
        "heads",
    )
    blocks = docs.select(F.explode(_blocks(data, block)).alias("b")).select(_hash(F.col("b"), hash_bits).alias("h"), "b")
    names = tmp.save(_named(blocks.distinct(), "h", "b").select("h", "name"), "names")
    shared = names.groupBy("h").count().where("count > 1").select("h")
    places = heads.select("rid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    if shared.isEmpty():
        level = places.join(names, "h").select("rid", "n", "pos", "name")
    else:
        shared = tmp.save(shared, "shared")
        own = blocks.join(shared, "h", "left_semi").distinct()
        renamed = tmp.save(_named(own, "h", "b").withColumn("name", -1 - F.col("name")), "renamed")
        whole = (
            docs.select(data.alias("_data")).select(F.monotonically_increasing_id().alias("_row"), "_data")
            .select("_data", F.posexplode(_blocks(F.col("_data"), block)).alias("pos", "b"))
            .select(F.sha2("_data", 256).alias("sha256"), F.length("_data").alias("bytes"), "pos", "b", _hash(F.col("b"), hash_bits).alias("h"))
            .join(shared, "h", "left_semi").distinct().join(renamed, ["h", "b"]).select("sha256", "pos", "name")
        )
        level = (
            places.join(names.join(shared, "h", "left_anti"), "h").select("rid", "n", "pos", "name")
            .unionByName(
                places.join(shared, "h", "left_semi").join(heads.select("rid", "sha256"), "rid")
                .join(whole, ["sha256", "pos"]).select("rid", "n", "pos", "name"))
        )
    done, depth = None, 0
    level = tmp.save(level, "level0")
    while True:
        one = level.where("n = 1").select("rid", F.lit(depth).alias("level"), "name")
        done = one if done is None else done.unionByName(one)
        rest = level.where("n > 1")
        if rest.isEmpty():
            break
        depth += 1
        half = F.shiftright("pos", 1)
        pairs = tmp.save(
            rest.groupBy("rid", half.alias("pos")).agg(
                F.ceil(F.max("n") / 2).cast("int").alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"),
            ),
            f"pairs{depth}",
        )
        # An odd last name stands alone; the flag keeps it apart from every pair.
        pairs = pairs.select("rid", "pos", "n", "a", F.coalesce("b", F.lit(0)).alias("b"), F.col("b").isNull().alias("alone"))
        named = tmp.save(_named(pairs.select("a", "b", "alone").distinct(), "a", "b", "alone"), f"pair_names{depth}")
        level = tmp.save(pairs.join(named, ["a", "b", "alone"]).select("rid", "n", "pos", "name"), f"level{depth}")
        tmp.drop(f"pairs{depth}", f"pair_names{depth}")
    rows = done.join(heads.drop("hashes"), "rid")
    return rows, tmp


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; of repeated rows with that
    id, one. Null texts count as empty, a null id is the smallest, an empty table
    gives an empty result, and other columns are ignored.
    """
    rows, tmp = text_identities(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), block=block, hash_bits=hash_bits)
    rows = tmp.save(rows, "rows")
    # Stored, so that both sides of the join are shuffled and a hot group's can be split.
    groups = tmp.save(rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    # Among repeated rows of the kept id, the first stays.
    first = rows.join(groups, ["level", "name"])
    repeated = rows.groupBy("doc_id", "level", "name").agg(F.min("rid").alias("first_rid"), F.count(F.lit(1)).alias("times")).where("times > 1")
    if repeated.isEmpty():
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    else:
        repeated = repeated.select(F.col("first_rid"), F.col("doc_id").alias("_id"), F.col("level").alias("_level"), F.col("name").alias("_name"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("level") == F.col("_level")) & (F.col("name") == F.col("_name"))
        first = first.join(repeated, same, "left")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("rid") == F.col("first_rid"), F.lit(True))
    return tmp.result(first.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns as they were.

    Of equal texts the row of the largest id stays, a null id only if there is no
    other. The row is found by its id, null or not, and the SHA-256 of its text; of
    repeated rows with both, one stays. Null and empty texts are equal; an empty
    table gives an empty result.
    """
    tmp = Scratch(docs.sparkSession, "copies")
    groups = exact_groups(docs, id_col, text_col).select(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_content"), "kept")
    keys = groups.groupBy("_kept_id", "_kept_content").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    keys = tmp.save(keys.where("kept"), "kept")
    content = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return keep_rows(docs, id_col, content, keys.drop("kept", "times"), keys.where("times > 1").drop("kept", "times"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; odd rows as in :func:`exact_groups`."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
