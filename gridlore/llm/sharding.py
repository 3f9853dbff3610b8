"""Sharding over fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots. Bytes and rows are summed per slot, and a small
versioned map says which shard owns each slot. Rebalancing edits the map and moves whole slots; records never rehash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.llm.common import read, shared_path, staged

N_SLOTS = 8192
OVERHEAD = 8  # bytes a record counts besides its text
MAP_SCHEMA = "version int, n_shards int, virtual_slot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Owner shard of each virtual slot; every edit returns the next version."""

    version: int
    n_shards: int
    owner: tuple[int, ...]

    @classmethod
    def balanced(cls, load: list[int], n_shards: int) -> SlotMap:
        """Version 1: slots by falling load, each to the shard that is lightest so far."""
        heap = [(0, s) for s in range(n_shards)]
        owner = [0] * len(load)
        for slot in sorted(range(len(load)), key=lambda k: (-load[k], k)):
            weight, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (weight + load[slot], shard))
        return cls(1, n_shards, tuple(owner))

    def loads(self, load: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.owner):
            out[shard] += load[slot]
        return out

    def _drained(self, load: list[int], n_shards: int, tolerance: float) -> SlotMap:
        """Move slots from shards above the mean to the lightest shard while that narrows the gap."""
        owner, mean = list(self.owner), sum(load) / n_shards
        now = [0] * n_shards
        held: list[list[int]] = [[] for _ in range(n_shards)]
        for slot, shard in enumerate(owner):
            now[shard] += load[slot]
            held[shard].append(slot)
        for shard in sorted(range(n_shards), key=lambda s: -now[s]):
            for slot in sorted(held[shard], key=lambda k: (-load[k], k)):
                if now[shard] <= mean * (1 + tolerance):
                    break
                to = min(range(n_shards), key=lambda s: (now[s], s))
                if load[slot] and now[to] + load[slot] < now[shard]:
                    owner[slot] = to
                    now[shard] -= load[slot]
                    now[to] += load[slot]
        return replace(self, version=self.version + 1, n_shards=n_shards, owner=tuple(owner))

    def rebalance(self, load: list[int], tolerance: float = 0.02) -> SlotMap:
        """Next version for changed loads: only slots of overfull shards move."""
        return self._drained(load, self.n_shards, tolerance)

    def add_shard(self, load: list[int]) -> SlotMap:
        """Next version with one more shard: slots move only into it, until it holds its share."""
        new, share = self.n_shards, sum(load) / (self.n_shards + 1)
        owner, now, gained = list(self.owner), self.loads(load), 0
        for slot in sorted(range(len(load)), key=lambda k: (-load[k], k)):
            shard = owner[slot]
            if load[slot] and gained + load[slot] <= share and now[shard] - load[slot] >= share:
                owner[slot] = new
                now[shard] -= load[slot]
                gained += load[slot]
        return replace(self, version=self.version + 1, n_shards=new + 1, owner=tuple(owner))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version beside the earlier ones; a version is never overwritten."""
        rows = [(self.version, self.n_shards, k, s) for k, s in enumerate(self.owner)]
        spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/v={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v={version}").orderBy("virtual_slot").collect()
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def virtual_slot(keys: list[Column], n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_loads(records: DataFrame, size: str, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most n_slots rows reach the driver, however large the input."""
    load, count = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect():
        load[r["virtual_slot"]], count[r["virtual_slot"]] = r["b"], r["n"]
    return load, count


def place(records: DataFrame, slots: SlotMap, count: list[int], order: list[str]) -> DataFrame:
    """Add shard and slot, the record's gapless place in its shard.

    Rows are numbered inside a virtual slot (a few rows in ten thousand) and shifted by the rows of the shard's earlier
    slots, so no task holds a shard. The map has a fixed number of rows and is broadcast.
    """
    before, rows = [0] * slots.n_shards, []
    for k, shard in enumerate(slots.owner):
        rows.append((k, shard, before[shard]))
        before[shard] += count[k]
    table = records.sparkSession.createDataFrame(rows, "virtual_slot int, shard int, first long")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    return (
        records.withColumn("place", inside)
        .join(F.broadcast(table), "virtual_slot")
        .withColumn("slot", F.col("first") + F.col("place") - 1)
        .drop("first", "place")
    )


def salted(records: DataFrame, keys: list[str], n_slots: int) -> DataFrame:
    """records with virtual_slot, the hash of the keys; rows whose keys repeat more often than a slot's share get a salt too."""
    total = records.count()
    heavy = records.groupBy(*keys).count().where(F.col("count") * n_slots > total).where("count > 1")  # fewer than n_slots rows
    heavy = heavy.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("count") * n_slots / max(1, total)).alias("__salts"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = records.join(F.broadcast(heavy), same, "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1)))
    return joined.withColumn("virtual_slot", virtual_slot([*map(F.col, keys), salt], n_slots)).drop("__salts", *[f"__{k}" for k in keys])


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, text: str = "text", key: str = "doc_id", map_path: str | None = None, version: int | None = None) -> DataFrame:
    """Shard rows of docs under the law `bytes`: sizes near equal.

    The slot key is (key, text checksum, size): one key that holds many different texts spreads over many slots, and a
    row repeated more often than a slot has rows is salted over as many slots as it fills. Null text counts as empty;
    null keys hash like any other value; repeated rows get places of their own; an empty table gives an empty result.
    Other columns are not read. With map_path and version, that stored map is rebalanced for the loads there are now and
    saved as the next version; else a fresh map becomes version 1 (below map_path, if given).
    """
    spark, body = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    records = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    records = staged(salted(records, ["doc_id", "text_crc32", "size"], n_slots), "shard-records")
    load, count = slot_loads(records, "size", n_slots)
    path = map_path or shared_path(spark, "slot-map")
    now = SlotMap.balanced(load, n_shards) if version is None else SlotMap.load(spark, path, version).rebalance(load)
    now.save(spark, path)
    slots = SlotMap.load(spark, path, now.version)
    return place(records, slots, count, ["doc_id", "text_crc32", "size"])


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
