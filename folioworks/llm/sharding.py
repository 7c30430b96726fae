"""Sharding by fixed virtual slots.

A record's key and its text's size and checksum hash into one of thousands of slots, for ever. A small versioned table says
which shard holds each slot; bytes are summed per slot, and rebalancing edits that table only, so a change moves whole
slots and nothing else.

The law is `bytes`: the shards' sizes are nearly equal. Groups of equal texts under different keys are dealt like any other
records; equal rows (one key and one text) share a slot, and so a shard, however many they are.

Defined results: a null text counts as no bytes and has checksum 0; a null key is hashed like any value; repeated rows are
rows of their own and follow one another in their slot, as do rows with equal key, size and checksum, in any order; a very
long text is one record, whose shard is as much larger; an empty table gives no rows. Other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.llm.common import hold, read_table, shared_dir

#: Virtual slots. Fixed for the life of a data set; also the bound of every table that the driver holds here.
N_SLOTS = 8192
N_SHARDS = 24
RECORD_OVERHEAD = 8


def measures(key: str, text: str, n_slots: int) -> list:
    """size (UTF-8 bytes plus overhead), text_crc32 and virtual_slot of a record."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(RECORD_OVERHEAD)
    crc = F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long")
    return [size.alias("size"), crc.alias("text_crc32"), F.pmod(F.xxhash64(F.col(key), size, crc), F.lit(n_slots)).cast("int").alias("virtual_slot")]


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """key and measures of each record."""
    return docs.select(F.col(key), *measures(key, text, n_slots))


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot: at most n_slots rows, pre-aggregated by each task."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0 of a map: slots dealt in turn."""
    return [s % n_shards for s in range(n_slots)]


def rebalanced(shard_of: list[int], sizes: dict[int, int], n_shards: int, tolerance: float = 0.0005) -> list[int]:
    """The next version of a map: slots move, or change places, between the fullest and the emptiest shard.

    It ends once both are within tolerance of the mean size, or no edit between them brings them nearer.
    """
    shard_of = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shard_of):
        held[shard].append((sizes.get(slot, 0), slot))
    for x in held:
        x.sort()
    load = [sum(b for b, _ in x) for x in held]
    mean = sum(load) / n_shards

    def move(entry: tuple[int, int], a: int, b: int) -> None:
        held[a].pop(bisect.bisect_left(held[a], entry))
        bisect.insort(held[b], entry)
        load[a] -= entry[0]
        load[b] += entry[0]
        shard_of[entry[1]] = b

    stuck: set[int] = set()
    for _ in range(50 * n_shards + len(shard_of)):
        free = [s for s in range(n_shards) if s not in stuck]
        full, least = max(free, key=lambda s: load[s], default=0), min(range(n_shards), key=lambda s: load[s])
        gap = load[full] - load[least]
        if not free or full == least or gap <= 2 * tolerance * mean:
            break
        best: tuple[int, tuple | None, tuple | None] = (gap, None, None)
        i = bisect.bisect_left(held[full], (gap // 2, -1))
        for entry in held[full][max(0, i - 1) : i + 1]:
            best = min(best, (abs(gap - 2 * entry[0]), entry, None), key=lambda x: x[0])
        for entry in held[full]:
            j = bisect.bisect_left(held[least], (entry[0] - gap // 2, -1))
            for other in held[least][max(0, j - 1) : j + 1]:
                best = min(best, (abs(gap - 2 * (entry[0] - other[0])), entry, other), key=lambda x: x[0])
        if best[1] is None or best[0] >= gap:
            stuck.add(full)
            continue
        move(best[1], full, least)
        if best[2] is not None:
            move(best[2], least, full)
        stuck.clear()
    return shard_of


def grown(shard_of: list[int], n_shards: int) -> list[int]:
    """A map for one more shard: every (n_shards + 1)th slot of each old shard goes to the new one, no other moves."""
    seen = [0] * n_shards
    out = []
    for shard in shard_of:
        seen[shard] += 1
        out.append(n_shards if seen[shard] % (n_shards + 1) == 0 else shard)
    return out


def write_map(spark: SparkSession, path: str, shard_of: list[int], version: int) -> None:
    """Appends a version of the slot-to-shard map to the table at path."""
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A version of the map (the last by default); it has n_slots rows, whatever the data's size."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return [r.shard for r in sorted(table.where(F.col("version") == version).collect(), key=lambda r: r.virtual_slot)]


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text", map_path: str | None = None) -> DataFrame:
    """key, size, text_crc32, virtual_slot, shard and slot (a record's place in its shard) of each record.

    The map's first version and its rebalanced second are stored at map_path. Places are counted per virtual slot and
    added to the slot's base, so no task holds more than a slot's narrow rows.
    """
    spark = docs.sparkSession
    records = hold(slotted(docs, key, text, n_slots), "slotted")
    found = {r.virtual_slot: (r.bytes, r.rows) for r in slot_sizes(records).collect()}
    map_path = map_path or shared_dir(spark, "slot-map")
    start = first_map(n_slots, n_shards)
    write_map(spark, map_path, start, 0)
    write_map(spark, map_path, rebalanced(start, {k: b for k, (b, _) in found.items()}, n_shards), 1)
    base, filled = [], [0] * n_shards
    for slot, s in enumerate(read_map(spark, map_path)):
        base.append((slot, s, filled[s]))
        filled[s] += found.get(slot, (0, 0))[1]
    places = spark.createDataFrame(base, "virtual_slot int, shard int, base long")
    in_slot = Window.partitionBy("virtual_slot").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    return (
        records.withColumn("_n", F.row_number().over(in_slot) - 1)
        .join(F.broadcast(places), "virtual_slot")
        .select(key, "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("_n")).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, shard_of: list[int], path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes the records, with all their columns, into one folder per shard of a map. Each row finds its shard by its own
    slot, so null and repeated keys are written too; the rows of a shard are spread over tasks by slot. A column `shard`
    of docs gives way to the folders' one."""
    places = docs.sparkSession.createDataFrame(list(enumerate(shard_of)), "_slot int, shard int")
    rows = docs.drop("shard").withColumn("_slot", measures(key, text, len(shard_of))[2])
    rows.join(F.broadcast(places), "_slot").repartition("shard", F.pmod("_slot", F.lit(64))).drop("_slot").write.partitionBy("shard").parquet(path)


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
