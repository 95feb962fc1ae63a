"""Sharding by fixed virtual slots.

Every record hashes to one of thousands of slots, for ever. Bytes are added up by slot, and a small versioned
table says which shard has which slot. Rebalancing edits that table, a new version for each edit; records are
never hashed anew. The slot comes from the text, so equal texts stay together. A heavy slot is dealt into parts
by a second hash of the text; only where the copies of one text are more than a shard's fair share (a third of
all rows, say) are they parted by id.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm import store

SHARDS = 16
SLOTS = 8192
PARTS_A_SHARD = 16  # a slot has at most 1/16 of a shard's fair share, or it is parted
PARTS = 64  # parts of a heavy slot
LANES = 16  # by which the rows of a slot are numbered side by side
MAP = "slot long, part long, bytes long, shard int, version int"


def first_map(units: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(slot, part, bytes, shard): heaviest first, each to the lightest shard."""
    load = [(0, s) for s in range(shards)]
    out = []
    for slot, part, size in sorted(units, key=lambda u: (-u[2], u[0], u[1])):
        have, shard = heapq.heappop(load)
        out.append((slot, part, size, shard))
        heapq.heappush(load, (have + size, shard))
    return out


def rebalanced(units: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The map with as few slots moved as it takes: from the heaviest shard to the lightest, always the slot
    that brings the two nearest to each other, until no move helps. Shards may be new and empty."""
    load = [0] * shards
    held: list[dict[tuple[int, int], int]] = [{} for _ in range(shards)]
    for slot, part, size, shard in units:
        load[shard] += size
        held[shard][(slot, part)] = size
    while True:
        heavy, light = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        move = min((k for k, size in held[heavy].items() if 0 < size < gap), key=lambda k: (abs(gap - 2 * held[heavy][k]), k), default=None)
        if move is None:
            return sorted((slot, part, size, s) for s in range(shards) for (slot, part), size in held[s].items())
        size = held[heavy].pop(move)
        held[light][move] = size
        load[heavy] -= size
        load[light] += size


def records(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``id``, ``size`` (UTF-8 bytes and one), ``text_crc32`` and the virtual slot of each record."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return documents.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("long").alias("slot"),
        F.pmod(F.xxhash64(text, F.lit(1)), F.lit(PARTS)).cast("long").alias("text_part"),
    )


def shard_documents(documents: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each record with ``virtual_slot``, ``part``, ``shard`` and ``slot``, its number in the shard from 0 on
    without gaps, and the map, whose versions are stored in ``folder``.

    Bytes are spread as evenly as whole units (slot and part) allow. A null text has size 1. Null ids and repeated rows are
    records as any other; an empty table gives an empty map.
    """
    spark = documents.sparkSession
    rows = store.stored(records(documents, id_col, text_col, slots), "records")
    weight = rows.groupBy("slot").agg(F.sum("size").alias("bytes")).collect()  # at most ``slots`` rows
    shard_share = max(1, sum(r.bytes for r in weight) // shards)
    fair = max(1, shard_share // PARTS_A_SHARD)
    heavy = spark.createDataFrame([(r.slot,) for r in weight if r.bytes > fair], "slot long").withColumn("heavy", F.lit(True))  # at most shards * PARTS_A_SHARD
    rows = rows.join(F.broadcast(heavy), "slot", "left").withColumn("part", F.when(F.col("heavy"), F.col("text_part")).otherwise(F.lit(0)).cast("long")).drop("heavy", "text_part")
    parted = rows.groupBy("slot", "part").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > shard_share)  # fewer than ``shards``
    parted = parted.select("slot", "part", F.ceil(F.col("bytes") / fair).cast("long").alias("parts"))
    by_id = F.pmod(F.xxhash64(F.lit(1), "id"), "parts").cast("long") * PARTS
    rows = rows.join(F.broadcast(parted), ["slot", "part"], "left").withColumn("part", F.col("part") + F.coalesce(by_id, F.lit(0))).drop("parts")
    units = [(r.slot, r.part, r.bytes) for r in rows.groupBy("slot", "part").agg(F.sum("size").alias("bytes")).collect()]
    first = first_map(units, shards)
    versions = [(*u, 1) for u in first] + [(*u, 2) for u in rebalanced(first, shards)]
    folder = folder or store.shared(spark, "slot-map")
    spark.createDataFrame(versions, MAP).coalesce(1).write.partitionBy("version").parquet(folder)
    slot_map = spark.read.schema(MAP).parquet(folder)
    current = slot_map.where("version = 2").select("slot", "part", "shard")
    # At most slots + shards * PARTS_A_SHARD * (PARTS + 1) rows are broadcast.
    rows = rows.join(F.broadcast(current), ["slot", "part"]).withColumn("lane", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(LANES)).cast("int"))
    rows = rows.withColumnRenamed("slot", "virtual_slot")
    cell = ["shard", "virtual_slot", "part", "lane"]
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part", "lane")
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(before) - F.col("n")).drop("n")
    inside = Window.partitionBy(*cell).orderBy("id", "text_crc32", "size")
    rows = rows.withColumn("k", F.row_number().over(inside) - 1).join(cells, cell)
    return rows.select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"), "virtual_slot", "part"), slot_map


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
