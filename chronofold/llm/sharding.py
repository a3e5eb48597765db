"""Sharding by fixed virtual slots, in DataFrame expressions only.

Records are hashed into a few thousand slots, a number that never changes.  The
bytes of each slot are added up, and a versioned map, a table in the shared
folder, says which shard a slot belongs to.  Version 1 knows no sizes; every
later version is an edit of the one before and is written beside it: rebalancing
moves slots from the heaviest to the lightest shard while that narrows the gap,
growing moves slots to the new shard only.  The map has one row per slot, so
editing it is work of a bounded size.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm.common import drop, save, scratch, text_of

SLOTS = 4096
SHARDS = 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual of every row, as a written table.

    The slot is a hash of all three.  Where equal rows are so many that one slot
    could not hold them beside its share (more than a slot's average, and 1000 at
    least, so there are fewer such keys than slots), each takes a slot by its
    number, too.
    """
    text = text_of(docs)
    key = F.xxhash64("doc_id", "text_crc32", "size")
    rows = save(docs.select(docs["doc_id"].alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).withColumn("key", key), "sizes")
    often = max(1000, rows.count() // slots)
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select("key", F.lit(True).alias("hot"))
    number = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(slots)))
    virtual = F.pmod(F.xxhash64("key", F.coalesce(number, F.lit(-1).cast("bigint"))), F.lit(slots)).cast("int")
    out = save(rows.join(F.broadcast(hot), "key", "left").withColumn("virtual", virtual).select("doc_id", "size", "text_crc32", "virtual"), "records")
    drop(rows)
    return out


def slot_sizes(rows: DataFrame) -> DataFrame:
    """virtual, bytes and rows of the slots that have rows: as many as there are slots at most."""
    return rows.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> dict[int, int]:
    """Version 1 of a map, made before any size is known: slots in turn."""
    return {virtual: virtual % shards for virtual in range(slots)}


def rebalance(owner: dict[int, int], sizes: list[tuple[int, int, int]], shards: int = SHARDS) -> dict[int, int]:
    """Edits a map for new sizes (virtual, bytes, rows) and a number of shards.

    Slots of shards that are no more go to the lightest shard, largest first;
    then slots move from the heaviest shard to the lightest while that narrows the gap.
    """
    size_of = {virtual: size for virtual, size, _ in sizes}
    out, loads, members = dict(owner), [0] * shards, [[] for _ in range(shards)]
    for virtual, shard in sorted(owner.items(), key=lambda x: (x[1] >= shards, -size_of.get(x[0], 0), x[0])):
        size = size_of.get(virtual, 0)
        out[virtual] = shard = shard if shard < shards else min(range(shards), key=loads.__getitem__)
        loads[shard] += size
        members[shard].append((size, virtual))
    while True:
        high, low = max(range(shards), key=loads.__getitem__), min(range(shards), key=loads.__getitem__)
        gap = loads[high] - loads[low]
        fitting = [m for m in members[high] if 0 < m[0] < gap]
        if not fitting:
            return out
        size, virtual = move = min(fitting, key=lambda m: (abs(2 * m[0] - gap), m[1]))
        if loads[high] - size < loads[low] + size and (loads[low] + size) - (loads[high] - size) >= gap:
            return out
        members[high].remove(move)
        members[low].append(move)
        loads[high] -= size
        loads[low] += size
        out[virtual] = low


def grow(owner: dict[int, int], sizes: list[tuple[int, int, int]], shards: int = SHARDS) -> dict[int, int]:
    """A map for one more shard: slots move to the new shard only, from the heaviest shards, until it holds its share."""
    size_of = {virtual: size for virtual, size, _ in sizes}
    out, loads, members = dict(owner), [0] * shards, [[] for _ in range(shards)]
    for virtual, shard in owner.items():
        loads[shard] += size_of.get(virtual, 0)
        members[shard].append((size_of.get(virtual, 0), virtual))
    for own in members:
        own.sort(reverse=True)
    share, load = sum(loads) / (shards + 1), 0
    while True:
        # the heaviest shard that has a slot small enough gives its largest such one
        fitting = [(loads[shard], shard, next((m for m in members[shard] if 0 < m[0] and load + m[0] <= share), None)) for shard in range(shards)]
        fitting = [x for x in fitting if x[2] is not None]
        if not fitting:
            return out
        _, high, move = max(fitting)
        members[high].remove(move)
        loads[high] -= move[0]
        load += move[0]
        out[move[1]] = shards


def write_map(spark: SparkSession, folder: str, owner: dict[int, int], version: int) -> None:
    """Adds a version of a map to its table: version, virtual, shard."""
    rows = [{"virtual": virtual, "shard": shard} for virtual, shard in sorted(owner.items())]
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<virtual:int,shard:int>>")).alias("m")).select("m.*")
    made.coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """A version of a map (the newest if none is named), or None if nothing is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    stored = spark.read.schema("virtual int, shard int, version int").parquet(folder)
    version = version or stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds shard, version and slot (the row's place in its shard, gapless from 0) to rows of `records`.

    A slot's rows are numbered by themselves, after all rows of the shard's slots
    before it.
    """
    filled = slot_sizes(rows).join(mapping, "virtual")
    before = filled.select("virtual", "shard", "version", (F.sum("rows").over(W.partitionBy("shard").orderBy("virtual")) - F.col("rows")).alias("before"))
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("virtual").orderBy("doc_id", "text_crc32", "size")) - 1)
    return placed.join(F.broadcast(before), "virtual").withColumn("slot", F.col("before") + F.col("place"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual, version.

    `folder` holds the map from call to call; without it a new one is made in the
    shared folder.  A call edits the newest version for the sizes it finds and
    stores the edit as the next version, if it moves anything.

    A null text has size 1.  Repeated rows take places of their own, very long
    texts count like any other; places in a slot go by doc_id, checksum and size,
    equal rows in any order; an empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch(spark)}/chronofold/shard-map-{uuid.uuid4().hex}"
    rows = records(docs, slots)
    mapping = read_map(spark, folder)
    if mapping is None:
        write_map(spark, folder, first_map(slots, shards), 1)
        mapping = read_map(spark, folder)
    stored = mapping.collect()
    owner, version = {r.virtual: r.shard for r in stored}, stored[0].version
    edited = rebalance(owner, [tuple(r) for r in slot_sizes(rows).collect()], shards)
    if edited != owner:
        version += 1
        write_map(spark, folder, edited, version)
    placed = assign(rows, read_map(spark, folder, version))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual", "version")


def grow_map(spark: SparkSession, folder: str, rows: DataFrame, shards: int = SHARDS) -> int:
    """Edits a stored map of `shards` shards for one more, which alone gets slots; the new version's number."""
    stored = read_map(spark, folder).collect()
    version = stored[0].version + 1
    write_map(spark, folder, grow({r.virtual: r.shard for r in stored}, [tuple(r) for r in slot_sizes(rows).collect()], shards), version)
    return version
