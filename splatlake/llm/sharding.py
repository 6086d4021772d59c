"""Sharding by fixed virtual slots.

Every record is hashed into one of ``n_slots`` fixed virtual slots by its key alone. A slot map, an
array from slot to shard with a version, says where slots live. Growing by a shard or rebalancing
edits the map, never the hash, so only the rows of edited slots move. The map of version 1 for n
shards is made by growing from one shard, so key and shard count decide a row's shard.

Defined results: a null key hashes like the empty string; null or empty texts have size 1 and the
CRC of no bytes (0); repeated rows keep a place each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot, with the version that edits raise."""

    shards: tuple[int, ...]
    version: int = 1

    @staticmethod
    def initial(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        """The map for n shards: one shard, grown n - 1 times."""
        if not 1 <= n_shards <= n_slots:
            raise ValueError("from 1 shard to as many as there are slots")
        out = SlotMap((0,) * n_slots)
        for _ in range(n_shards - 1):
            out = out.grown()
        return SlotMap(out.shards)

    @property
    def n_shards(self) -> int:
        return max(self.shards) + 1

    def grown(self) -> SlotMap:
        """One more shard, which takes its share of slots from the fullest shards; no other slot moves."""
        new, owned = self.n_shards, self.owned()
        shards = list(self.shards)
        for _ in range(len(shards) // (new + 1)):
            fullest = max(range(new), key=lambda s: (len(owned[s]), -s))
            shards[owned[fullest].pop()] = new
        return SlotMap(tuple(shards), self.version + 1)

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """Move slots from the heaviest to the lightest shard until sizes differ by at most ``tolerance`` of the mean, or no move helps."""
        shards, owned = list(self.shards), self.owned()
        load = [sum(slot_bytes.get(i, 0) for i in own) for own in owned]
        mean = sum(load) / len(load)
        for _ in range(len(shards)):
            heavy, light = max(range(len(load)), key=lambda s: load[s]), min(range(len(load)), key=lambda s: load[s])
            gap = load[heavy] - load[light]
            fits = [i for i in owned[heavy] if 0 < slot_bytes.get(i, 0) < gap]
            if gap <= tolerance * mean or not fits:
                break
            slot = min(fits, key=lambda i: (abs(slot_bytes[i] - gap / 2), i))
            owned[heavy].remove(slot)
            owned[light].append(slot)
            load[heavy] -= slot_bytes[slot]
            load[light] += slot_bytes[slot]
            shards[slot] = light
        return SlotMap(tuple(shards), self.version + 1)

    def owned(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(self.shards):
            out[shard].append(slot)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The map as a table, to be stored beside the shards."""
        return spark.createDataFrame([(self.version, i, s) for i, s in enumerate(self.shards)], "version int, virtual_slot int, shard int")

    @staticmethod
    def from_table(table: DataFrame) -> SlotMap:
        """The newest version in a stored table (at most one row per slot and version is read)."""
        version = table.agg(F.max("version")).head()[0]
        rows = table.where(F.col("version") == version).orderBy("virtual_slot").select("shard").collect()
        return SlotMap(tuple(r[0] for r in rows), version)

    def shard_of(self, slot: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.shards)), slot + 1) if len(self.shards) <= 64 else F.get(F.from_json(F.lit(str(list(self.shards))), "array<int>"), slot)


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    """Slot of a key, from the first 8 hexadecimal digits of its MD5."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1 (null: none)."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_sizes(docs: DataFrame, key: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """Rows and bytes of each virtual slot: what a rebalancing reads."""
    return docs.groupBy(virtual_slot(F.col(key), n_slots).alias("virtual_slot")).agg(F.count("*").alias("n_rows"), F.sum(text_size(F.col("text"))).alias("bytes"))


def assign_shards(docs: DataFrame, slot_map: SlotMap, grown: SlotMap | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and gapless place of every row; rows equal in key, size and CRC are counted before the shuffle and expanded after it.

    The place within a shard is the number of rows in the shard's earlier virtual slots (from a table of
    at most ``n_slots`` counts) plus the row's rank in its own slot, so no task ranks a whole shard.
    """
    n_slots = len(slot_map.shards)
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), text_size(F.col(text)).alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("virtual_slot", virtual_slot(F.col(key), n_slots))
    same = rows.groupBy("virtual_slot", key, "size", "text_crc32").agg(F.count("*").alias("copies"))
    counts = docs.groupBy(virtual_slot(F.col(key), n_slots).alias("virtual_slot")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("shard", slot_map.shard_of(F.col("virtual_slot")))
    if grown is not None:
        counts = counts.withColumn("grown_shard", grown.shard_of(F.col("virtual_slot")))
    else:
        counts = counts.withColumn("grown_shard", F.lit(None).cast("int"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("slot_begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # At most n_slots rows of five numbers: safe to broadcast at any input size.
    placed = same.join(F.broadcast(counts.drop("n")), "virtual_slot")
    earlier = Window.partitionBy("virtual_slot").orderBy(key, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("first", F.col("slot_begin") + F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth"))
    return each.select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard", "virtual_slot")


def rebalance(docs: DataFrame, slot_map: SlotMap, key: str = "doc_id", tolerance: float = 0.02) -> SlotMap:
    """A new version of the map with nearly equal bytes in each shard; reads one aggregated row per slot."""
    sizes = slot_sizes(docs, key, len(slot_map.shards)).collect()
    return slot_map.rebalanced({r["virtual_slot"]: r["bytes"] for r in sizes}, tolerance)
