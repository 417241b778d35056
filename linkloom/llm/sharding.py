"""Sharding by fixed virtual slots.

Rows are hashed into a fixed number of virtual slots; the bytes of each slot are summed, and a versioned
map says which shard holds which slot. Rebalancing edits the map, never the hash. Every step is built in:
no Python touches a row. The map has `n_slots` entries whatever the input, so it may be collected and broadcast.

The law is `bytes`: copies with different ids are dealt apart, as no shard could hold a very large group of them whole. Rows that are
alike in id and text fall into one slot, unless together they outweigh a mean slot: then each is hashed with its place in the written
table of ids, sizes and checksums. At most `n_slots` such groups can exist, so they may be broadcast.

Nulls: a null text has no bytes and no checksum; a null id hashes like any other value. Repeated rows are
placed one by one, ties in a slot in any order, since they are alike. A text longer than a mean shard makes its shard the largest. An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from linkloom.llm.spark_util import cut, stage_folder

ROW_OVERHEAD = 8
N_SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. Editing it makes a new version."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def even(cls, n_slots: int, n_shards: int) -> SlotMap:
        """A first map, made before any sizes are known: slots in turn."""
        return cls(1, n_shards, tuple(i % n_shards for i in range(n_slots)))

    @classmethod
    def balanced(cls, sizes: list[int], n_shards: int) -> SlotMap:
        """Largest slot first, each to the shard that is lightest so far."""
        heap = [(0, s) for s in range(n_shards)]
        shard_of = [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + sizes[slot], shard))
        return cls(1, n_shards, tuple(shard_of))

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes[slot]
        return out

    def rebalanced(self, sizes: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """A new version for new sizes or another shard count, moving few slots: the heaviest shard gives the
        largest slot that fits to the lightest one, until loads are within `tolerance` of the mean."""
        n = n_shards or self.n_shards
        shard_of = [s if s < n else -1 for s in self.shard_of]
        loads, held = [0] * n, [[] for _ in range(n)]
        for slot, shard in enumerate(shard_of):
            if shard >= 0:
                loads[shard] += sizes[slot]
                held[shard].append(slot)
        for slot in sorted((i for i, s in enumerate(shard_of) if s < 0), key=lambda i: (-sizes[i], i)):
            light = min(range(n), key=lambda s: (loads[s], s))
            shard_of[slot] = light
            loads[light] += sizes[slot]
            held[light].append(slot)
        mean = sum(loads) / n
        for _ in range(len(sizes)):
            heavy, light = max(range(n), key=lambda s: loads[s]), min(range(n), key=lambda s: loads[s])
            if loads[heavy] <= mean * (1 + tolerance) and loads[light] >= mean * (1 - tolerance):
                break
            gap = loads[heavy] - loads[light]
            fits = [i for i in held[heavy] if 0 < sizes[i] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda i: (abs(gap / 2 - sizes[i]), i))
            held[heavy].remove(slot)
            held[light].append(slot)
            shard_of[slot] = light
            loads[heavy] -= sizes[slot]
            loads[light] += sizes[slot]
        return replace(self, version=self.version + 1, n_shards=n, shard_of=tuple(shard_of))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.n_shards, i, s) for i, s in enumerate(self.shard_of)], "version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table of maps at `path`."""
        self.to_df(spark).coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def stored(spark: SparkSession, path: str) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        df = spark.read.parquet(path)
        version = version or df.agg(F.max("version")).first()[0]
        rows = df.where(F.col("version") == version).orderBy("virtual_slot").collect()  # n_slots rows
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def with_virtual_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row. The texts are read once; what follows reads the slim table."""
    crc = F.crc32(F.col("text").cast("binary"))
    slim = cut(docs.select("doc_id", size_of().alias("size"), crc.alias("text_crc32")).withColumn("name", F.xxhash64("doc_id", "text_crc32")).withColumn("place", F.monotonically_increasing_id()))
    total = slim.agg(F.sum("size").alias("b")).first()["b"] or 0
    heavy = cut(slim.groupBy("name").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("b") * F.lit(n_slots) > F.lit(total))).select("name", F.lit(True).alias("heavy")))
    return slim.join(F.broadcast(heavy), "name", "left").select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("name", F.when(F.col("heavy"), F.col("place"))), F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_totals(slotted: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; the result is bounded by n_slots."""
    sizes, rows = [0] * n_slots, [0] * n_slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return sizes, rows


def assign(slotted: DataFrame, slot_map: SlotMap, rows: list[int]) -> DataFrame:
    """Adds shard and the row's gapless position in its shard: the rows of the shard's earlier slots, then the
    position in its own slot. A slot is a fixed share of the rows, so no task orders a whole shard."""
    spark = slotted.sparkSession
    base, seen = [0] * len(rows), [0] * slot_map.n_shards
    for i, s in enumerate(slot_map.shard_of):
        base[i] = seen[s]
        seen[s] += rows[i]
    table = spark.createDataFrame([(i, s, base[i]) for i, s in enumerate(slot_map.shard_of) if rows[i]], "virtual_slot int, shard int, base long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return slotted.withColumn("rank", F.row_number().over(order)).join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("base") + F.col("rank") - 1)


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, maps: str | None = None, tolerance: float = 0.002) -> tuple[DataFrame, SlotMap]:
    """Rows with shard and slot, near equal in bytes over the shards, and the map that says so. maps: the table of stored maps; its last
    version is loaded, or a first one made, and edited for the sizes found and for n_shards; the new version is stored and used."""
    spark = docs.sparkSession
    slotted = with_virtual_slots(docs, n_slots)
    sizes, rows = slot_totals(slotted, n_slots)
    maps = maps or stage_folder(spark)
    if not SlotMap.stored(spark, maps):
        SlotMap.even(n_slots, n_shards).save(spark, maps)
    SlotMap.load(spark, maps).rebalanced(sizes, n_shards, tolerance).save(spark, maps)
    slot_map = SlotMap.load(spark, maps)
    return assign(slotted, slot_map, rows), slot_map


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slot_map = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"))
