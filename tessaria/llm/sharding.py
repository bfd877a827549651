"""Sharding by fixed virtual slots, with native operators only.

Records are hashed into some thousands of virtual slots; bytes are summed per
slot; a versioned map says which shard holds a slot. Only the map is edited
when shards are added or grow uneven: slots move, records are never rehashed.
The map has a row per slot, whatever the input's size, and is stored as a
table in the shared folder under its version.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.llm.common import keep

SHARDS, SLOTS = 24, 4096
#: Each slot is counted in so many cells, by further bits of the same hash: places within a slot come from small groups.
CELLS = 16


def assign(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A new map: the heaviest slot first, each to the shard with fewest bytes."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        total, held, s = heapq.heappop(heap)
        out[slot] = s
        heapq.heappush(heap, (total + slot_bytes.get(slot, 0), held + 1, s))
    return out


def rebalance(old: dict[int, int], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """Edits a map for another number of shards or other bytes; slots move only out of overfull or closed shards.

    Every shard above the mean by more than the tolerance gives its lightest-fitting
    slots to the emptiest shard, until none is above or no move would help.
    """
    out, held = dict(old), {s: set() for s in range(shards)}
    total = {s: 0 for s in range(shards)}
    closed = []
    for slot, s in old.items():
        if s < shards:
            held[s].add(slot)
            total[s] += slot_bytes.get(slot, 0)
        else:
            closed.append(slot)

    def move(slot: int, to: int) -> None:
        out[slot] = to
        held[to].add(slot)
        total[to] += slot_bytes.get(slot, 0)

    for slot in sorted(closed, key=lambda x: (-slot_bytes.get(x, 0), x)):
        move(slot, min(total, key=lambda s: (total[s], s)))
    goal = sum(total.values()) / max(1, shards)
    for _ in range(len(old)):
        full, free = max(total, key=lambda s: (total[s], -s)), min(total, key=lambda s: (total[s], s))
        if total[full] <= goal * (1 + tolerance) and total[free] >= goal * (1 - tolerance):
            break
        fits = [x for x in held[full] if 0 < slot_bytes.get(x, 0) < total[full] - total[free]]
        if not fits:
            break
        room = min(total[full] - goal, goal - total[free])
        slot = min(fits, key=lambda x: (abs(slot_bytes[x] - room), x))
        held[full].discard(slot)
        total[full] -= slot_bytes[slot]
        move(slot, free)
    return out


def store_map(spark: SparkSession, mapping: dict[int, int], version: int, where: str | None = None) -> DataFrame:
    """Writes one version of the map (version, slot, shard); earlier versions stay as they are."""
    df = spark.createDataFrame([(version, k, v) for k, v in sorted(mapping.items())], "version int, slot int, shard int").coalesce(1)
    if where is None:
        return keep(df, "slot-map")[0]
    df.write.mode("errorifexists").parquet(f"{where}/version={version}")
    return spark.read.schema(df.schema).parquet(f"{where}/version={version}")


def load_map(spark: SparkSession, where: str, version: int) -> dict[int, int]:
    return {r["slot"]: r["shard"] for r in spark.read.parquet(f"{where}/version={version}").collect()}


def records(docs: DataFrame, slots: int = SLOTS, cells: int = CELLS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    ).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots * cells)).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, cells: int = CELLS, version: int = 1, old: dict[int, int] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is ``bytes``: shards are near equal in bytes. ``slot`` is the record's
    place in its shard, gapless from 0; ``virtual_slot`` is the slot it hashes to.
    size is the text's UTF-8 bytes plus 8; a null text has no bytes. With ``old``
    that map is edited, else a new one is made. Documents of any id, null too, are
    placed; rows repeated in full have places of their own. Columns other than
    doc_id and text are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = records(docs, slots, cells)
    cell_counts, _ = keep(base.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "slot-bytes")
    per_slot = cell_counts.groupBy((F.col("cell") / cells).cast("int").alias("slot")).agg(F.sum("bytes").alias("bytes"))
    slot_bytes = {r["slot"]: r["bytes"] for r in per_slot.collect()}  # at most `slots` rows
    mapping = assign(slot_bytes, shards, slots) if old is None else rebalance(old, slot_bytes, shards)
    placed = store_map(spark, mapping, version)
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cell_counts.withColumn("virtual_slot", (F.col("cell") / cells).cast("int"))
        .join(F.broadcast(placed.select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version"))), "virtual_slot")
        .select("cell", "virtual_slot", "shard", "map_version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )  # at most slots * cells rows
    within = Window.partitionBy("cell").orderBy("doc_id", "size", "text_crc32")
    return (
        base.withColumn("place", F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(offsets), "cell")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
        )
    )


