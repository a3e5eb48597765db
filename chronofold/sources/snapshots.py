"""Snapshots and partitioned block tables on Parquet, payload normalisation, and tool functions over the block tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.scalars import space_kind
from chronofold.operators import spatial
from chronofold.plans import vql
from chronofold.session import ship

#: Keys of a payload that are no attributes.
SYSTEM_KEYS = ("type", "id", "actor", "space", "occur_time", "evidence", "corrects", "idempotency_key", "writes")


def save_snapshot(folded: DataFrame, path: str, seq: int) -> None:
    """A projection as of a seq; saving it again replaces it."""
    folded.write.mode("overwrite").parquet(f"{path}/event_seq={seq}")


def latest_snapshot(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest projection (not after a seq): only its own partition is read."""
    whole = spark.read.parquet(path)
    seqs = whole.select("event_seq").distinct()
    top = (seqs if upto is None else seqs.where(F.col("event_seq") <= upto)).agg(F.max("event_seq")).first()[0]
    return whole.where(F.col("event_seq") == (top if top is not None else -1)).drop("event_seq")


def save_shards(blocks: DataFrame, path: str, size: float, slot: int) -> None:
    """Blocks as Parquet partitioned by level and time slot and sorted by cell, so region queries skip files and row groups."""
    keyed = spatial.block_key(blocks, size, slot)
    keyed.repartition("level", "time_slot").sortWithinPartitions("cell_x", "cell_y").write.mode("overwrite").partitionBy("level", "time_slot").parquet(path)


def read_shards(spark: SparkSession, path: str, first: int, last: int, slot: int) -> DataFrame:
    """Blocks of the partitions that a time range meets."""
    return spark.read.parquet(path).where(F.col("time_slot").between(first // slot, last // slot))


def normalise_payload(rows: DataFrame, column: str = "payload") -> DataFrame:
    """JSON payloads as candidates: type, actor, targets, attributes (map of JSON text), space kind.

    `id` may be one value or a list; a payload that is no JSON object gives nulls.
    """
    whole = F.from_json(column, "map<string,string>")
    rows = rows.withColumn("_m", whole)
    one = F.get(F.array(F.col("_m")["id"]), F.lit(0))
    targets = F.when(one.startswith("["), F.from_json(one, "array<string>")).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    space = F.col("_m")["space"]
    return rows.select("*", F.col("_m")["type"].alias("type"), F.col("_m")["actor"].alias("actor"), targets.alias("targets"), F.map_filter("_m", lambda k, _: ~k.isin(*SYSTEM_KEYS)).alias("attributes"), F.when(space.isNotNull(), space_kind(space)).alias("space_kind")).drop("_m")


def digest(folded: DataFrame, value: Column) -> DataFrame:
    """One row: a digest of a projection that no order of rows changes: count and sums of two hashes of (entity, key, value)."""
    a, b = F.xxhash64("entity", "key", value), F.hash("entity", "key", value)
    return folded.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.pmod(a, F.lit(1 << 40))).alias("a"), F.sum(b.cast("bigint")).alias("b"))


def ordered_digest(folded: DataFrame, value: Column) -> DataFrame:
    """One row (cells, digest): 64-bit FNV-1a over the cells in the order of entity and key.

    Fields are entity, key, value text and source_event, each followed by 0x1f, the
    last by 0x1e.  Every byte depends on all before it, so one task reads the sorted
    cells, in batches and holding nothing but the hash; it is a check of two
    projections, not a step of any query.
    """
    ship(folded.sparkSession)

    def run(batches):
        digest, cells = 14695981039346656037, 0
        for batch in batches:
            for fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for byte in ("\x1f".join(fields) + "\x1e").encode():
                    digest = (digest ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
                cells += 1
        yield pa.RecordBatch.from_pydict({"cells": pa.array([cells], pa.int64()), "digest": [f"{digest:016x}"]})

    ordered = folded.select("entity", "key", F.coalesce(value, F.lit("null")).alias("value"), F.col("source_event").cast("string").alias("source_event")).orderBy("entity", "key")
    return ordered.coalesce(1).mapInArrow(run, "cells bigint, digest string")


def tools(blocks: DataFrame, versions: DataFrame, tracks: DataFrame, levels: int = 1) -> dict[str, Callable[..., DataFrame]]:
    """Named functions over the block tables, each returning a DataFrame."""
    area = lambda region: "REGION(" + ",".join(map(str, region)) + ")"
    run = lambda text: vql.execute(text, blocks, versions, tracks, levels)
    return {
        "query": lambda region, first, last, level=-1: run(f"FIND BLOCKS IN {area(region)} DURING({first},{last}) LEVEL {level}"),
        "query_at": lambda region, first, last, at: run(f"FIND BLOCKS IN {area(region)} DURING({first},{last}) AT {at}"),
        "history": lambda block: run(f"FIND HISTORY OF {block}"),
        "dynamic_query": lambda region, first, last: run(f"FIND DYNAMIC IN {area(region)} DURING({first},{last})"),
        "trajectory": lambda track: run(f"FIND TRAJECTORY OF {track}"),
        "stats": lambda: run("STATS"),
    }
