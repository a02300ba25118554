"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, never to change; a small versioned table maps each slot to a shard. The map
is made from the bytes of each slot and is edited, not rebuilt, when shards are added or loads drift: only the moved
slots' records travel. What reaches the driver are the slots' totals, as many as there are slots at any input size.

Defined cases: a null text has size 8 and CRC 0; null ids hash like any value; rows that repeat the same id and text
share a slot; rows that only repeat the id spread, as the text's CRC is hashed too. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveil.llm.shared import documents, new_table_path

SLOTS = 4096
SHARDS = 24
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: the shard of each slot, with the totals it was made from."""

    version: int
    shard: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]
    n_shards: int

    @classmethod
    def build(cls, size: list[int], rows: list[int], n_shards: int) -> SlotMap:
        """Version 1: the largest slot first, each to the shard with the fewest bytes."""
        loads = [(0, 0, s) for s in range(n_shards)]
        shard = [0] * len(size)
        for slot in sorted(range(len(size)), key=lambda k: (-size[k], -rows[k], k)):
            bytes_, n, s = heapq.heappop(loads)
            shard[slot] = s
            heapq.heappush(loads, (bytes_ + size[slot], n + rows[slot], s))
        return cls(1, tuple(shard), tuple(size), tuple(rows), n_shards)

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, s in enumerate(self.shard):
            out[s] += self.size[slot]
        return out

    def rebalanced(self, n_shards: int | None = None, size: list[int] | None = None, rows: list[int] | None = None, slack: float = 0.01) -> SlotMap:
        """The next version for new totals or more shards, by moving slots from the fullest to the emptiest shard.

        A move must narrow the gap between the two; it ends when the gap is within slack of the mean or no slot fits.
        """
        n = n_shards or self.n_shards
        if n < self.n_shards:
            raise ValueError("shards can be added, not removed")
        size, rows = list(size or self.size), list(rows or self.rows)
        shard, loads = list(self.shard), [0] * n
        members: list[set[int]] = [set() for _ in range(n)]
        for slot, s in enumerate(shard):
            loads[s] += size[slot]
            members[s].add(slot)
        mean = sum(loads) / n
        while True:
            full, empty = max(range(n), key=lambda s: (loads[s], -s)), min(range(n), key=lambda s: (loads[s], s))
            gap = loads[full] - loads[empty]
            fits = [k for k in members[full] if 0 < size[k] < gap]
            if gap <= slack * mean or not fits:
                break
            slot = min(fits, key=lambda k: (abs(gap / 2 - size[k]), k))
            members[full].remove(slot)
            members[empty].add(slot)
            loads[full] -= size[slot]
            loads[empty] += size[slot]
            shard[slot] = empty
        return SlotMap(self.version + 1, tuple(shard), tuple(size), tuple(rows), n)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, k, s, self.size[k], self.rows[k]) for k, s in enumerate(self.shard)]
        return spark.createDataFrame(rows, MAP_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored map; earlier versions stay."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored rows of one version, the latest by default: as many as there are slots."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def records(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_totals(rows: DataFrame, n_slots: int = SLOTS) -> tuple[list[int], list[int]]:
    size, count = [0] * n_slots, [0] * n_slots
    for slot, b, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        size[slot], count[slot] = b, n
    return size, count


def assign(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Shard and gapless place in it for each row. slots: one version of the map, its size fixed by the slot count.

    A place is the rows of the shard's earlier slots plus the row's rank in its own slot, so that ranking is dealt over
    thousands of slots and no task holds a shard.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select(F.col("slot").alias("virtual_slot"), "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("first") + F.col("rank") - 1)


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Shards docs with a first version of the map, which it stores at map_path and reads back."""
    spark = docs.sparkSession
    rows = records(docs, n_slots)
    path = map_path or new_table_path(spark, "slot_map")
    SlotMap.build(*slot_totals(rows, n_slots), n_shards).save(spark, path)
    return assign(rows, load_map(spark, path, 1))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")
