"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, sizes are summed per slot, and a
versioned map says which shard holds a slot. Only the map changes when shards
are rebalanced or added. The driver sees one row per slot (``slots`` of them,
whatever the input), never a record.

A slot that one id (or null ids) makes heavy is dealt again by id and text. Copies of
one row that are heavy even so are dealt to all slots in turn; as they are alike, they
are counted and written anew with their numbers. So the result is the same however the
input is split. The map holds both lists, and a stored map places the same rows again.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, exists, scratch_root

SLOTS = 8192
#: A slot that holds more than this part of a shard is dealt again.
HEAVY_PART = 1 / 16
#: Copies of a row that are written at once.
COPIES = 1 << 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot; ``heavy`` slots are dealt again by id and text, rows of the hashes ``copies`` in turn."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    heavy: tuple[int, ...] = field(default=())
    copies: tuple[int, ...] = field(default=())

    @staticmethod
    def build(weights: list[int], shards: int, heavy: tuple[int, ...] = (), copies: tuple[int, ...] = ()) -> SlotMap:
        """Largest slot first to the lightest shard; ties by slot and shard number."""
        if shards < 1:
            raise ValueError("shards must be positive")
        shard_of, load = [0] * len(weights), [(0, s) for s in range(shards)]
        for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            w, s = heapq.heappop(load)
            shard_of[slot] = s
            heapq.heappush(load, (w + weights[slot], s))
        return SlotMap(1, shards, tuple(shard_of), heavy, copies)

    def rebalance(self, weights: list[int], shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
        """The next version: slots leave shards that are above the mean, and only as many as it takes.

        New shards only receive; slots of shards that are gone move to the others.
        """
        shards = shards or self.shards
        load, held = [0] * shards, [[] for _ in range(shards)]
        shard_of, free = list(self.shard_of), []
        for slot, s in enumerate(self.shard_of):
            if s < shards:
                load[s] += weights[slot]
                held[s].append(slot)
            else:
                free.append(slot)
        mean = sum(weights) / shards
        gave = set()
        for s in range(shards):
            for slot in sorted(held[s], key=lambda i: (-weights[i], i)):
                if load[s] <= (1 + tolerance) * mean:
                    break
                if weights[slot] and load[s] - weights[slot] >= mean:
                    load[s] -= weights[slot]
                    free.append(slot)
                    gave.add(s)
        heap = [(w, s) for s, w in enumerate(load) if s not in gave]
        heapq.heapify(heap)
        for slot in sorted(free, key=lambda i: (-weights[i], i)):
            w, s = heapq.heappop(heap)
            shard_of[slot] = s
            heapq.heappush(heap, (w + weights[slot], s))
        return SlotMap(self.version + 1, shards, tuple(shard_of), self.heavy, self.copies)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version under ``path``; earlier versions stay."""
        lists = [F.lit(",".join(map(str, getattr(self, n)))).alias(n) for n in ("shard_of", "heavy", "copies")]
        spark.range(1).select(F.lit(self.version).alias("version"), F.lit(self.shards).alias("shards"), *lists).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, or the latest."""
        found = spark.read.parquet(path)
        found = found.where(F.col("version") == version) if version else found.orderBy(F.desc("version")).limit(1)
        r = found.first()
        if r is None:
            raise ValueError(f"no version {version} of a slot map in {path}")
        ints = lambda s: tuple(int(x) for x in s.split(",") if x)
        return SlotMap(r.version, r.shards, ints(r.shard_of), ints(r.heavy), ints(r.copies))


def _lookup(values: list[int], index: Column, kind: str) -> Column:
    """A literal table of ``values`` in the plan: no join, no collected rows on executors."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), index)


def _slot(slots: int, heavy: tuple[int, ...], copies: tuple[int, ...]) -> Column:
    by_id = F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")
    if not heavy:
        return by_id
    again = F.pmod(F.xxhash64("content", F.lit(1)), F.lit(slots)).cast("int")
    if copies:
        turn = F.pmod(F.pmod(F.xxhash64("content", F.lit(2)), F.lit(slots)) + F.col("copy"), F.lit(slots)).cast("int")
        again = F.when(F.col("content").isin(*copies), turn).otherwise(again)
    return F.when(by_id.isin(*heavy), again).otherwise(by_id)


def _numbered(rows: DataFrame, copies: tuple[int, ...]) -> DataFrame:
    """``rows`` with the copies of the given hashes numbered from 0, in parts of bounded size."""
    if not copies:
        return rows
    hot = F.col("content").isin(*copies)
    one = rows.where(hot).groupBy("content").agg(*[F.min(c).alias(c) for c in ("doc_id", "size", "text_crc32")], F.count(F.lit(1)).alias("n"))
    part = one.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))).alias("first")).repartition("content", "first")
    each = part.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + (COPIES - 1), F.col("n") - 1))))
    return rows.where(~hot).unionByName(each.select(*rows.columns))


def _totals(rows: DataFrame, slots: int, heavy: tuple[int, ...] = (), copies: tuple[int, ...] = ()) -> tuple[list[int], list[int]]:
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy(_slot(slots, heavy, copies).alias("s")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r.s], count[r.s] = r.b, r.n
    return size, count


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, overhead: int = 16, slot_map: SlotMap | None = None, map_path: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot, virtual_slot, map_version``.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``; shards get
    near equal sizes. ``slot`` is the row's place in its shard, gapless from 0, by
    slot, id and text. Null ids are one id; rows that are repeated are placed each.
    An empty table gives an empty result; other columns are not read.

    With ``slot_map`` that map decides. Else the latest map under ``map_path`` is
    edited where the sizes ask for it, or the first one is built there; what is
    then applied is read back from that path.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = tmp.save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(id_col, text_col).alias("content"),
            F.lit(0).cast("long").alias("copy"),
        ),
        "rows",
    )
    if slot_map is None:
        stored = SlotMap.load(spark, map_path) if map_path and exists(spark, map_path) else None
        if stored is not None:
            slots = len(stored.shard_of)
            size, count = _totals(_numbered(rows, stored.copies), slots, stored.heavy, stored.copies)
            slot_map = stored.rebalance(size, shards)
            slot_map = stored if slot_map.shard_of == stored.shard_of and shards == stored.shards else slot_map
        else:
            size, count = _totals(rows, slots)
            total = sum(size)
            most = max(HEAVY_PART * total / shards, 4 * total / slots)
            heavy, copies = tuple(i for i in range(slots) if count[i] > 1 and size[i] > most), ()
            if heavy:
                hot = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)).isin(*heavy)).groupBy("content").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
                # They are heavier than ``most`` each, so there are few.
                copies = tuple(sorted(r["content"] for r in hot.where((F.col("n") > 1) & (F.col("b") > most)).collect()))
                size, count = _totals(_numbered(rows, copies), slots, heavy, copies)
            slot_map = SlotMap.build(size, shards, heavy, copies)
        if map_path and slot_map is not stored:
            slot_map.save(spark, map_path)
            slot_map = SlotMap.load(spark, map_path, slot_map.version)
    slots, rows = len(slot_map.shard_of), _numbered(rows, slot_map.copies)
    size, count = _totals(rows, slots, slot_map.heavy, slot_map.copies)
    before, filled = [0] * slots, [0] * slot_map.shards
    for i, s in enumerate(slot_map.shard_of):
        before[i] = filled[s]
        filled[s] += count[i]
    v = F.col("virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "content", "copy"))
    return (
        rows.withColumn("virtual_slot", _slot(slots, slot_map.heavy, slot_map.copies))
        .withColumn("place", place)
        .select(
            F.col("doc_id").alias(id_col), "size", "text_crc32",
            _lookup(list(slot_map.shard_of), v, "int").alias("shard"),
            (_lookup(before, v, "bigint") + F.col("place") - 1).alias("slot"),
            "virtual_slot", F.lit(slot_map.version).alias("map_version"),
        )
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards of all documents by a map that is stored and read back; odd rows as in :func:`shard`."""
    path = f"{scratch_root(spark)}/corvane/slot-map-{uuid.uuid4().hex[:12]}"
    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40, map_path=path)
    return rows.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
