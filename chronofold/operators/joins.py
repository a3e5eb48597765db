"""Lookups that are joins: phases, longest prefixes, floors, links, coordinates of anchors; and ordered timelines."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.session import ship


def match_phase(events: DataFrame, phases: DataFrame) -> DataFrame:
    """Adds the phase of an event's entity that holds its time: bounds of the link, else of the phase itself, closed; ties to the least phase.

    events (id, entity, ts); phases (entity, phase, edge_start, edge_end, start, end).
    """
    low = F.coalesce("edge_start", "start", F.lit(0))
    high = F.coalesce("edge_end", "end", F.lit(2**62))
    hit = events.join(phases, "entity").where(F.col("ts").between(low, high)).groupBy("id").agg(F.min("phase").alias("phase"))
    return events.join(hit, "id", "left")


def longest_prefix(paths: DataFrame, roots: DataFrame, separator: str = "/") -> DataFrame:
    """Adds the owner of the longest root that is a prefix of each path (whole segments): one equal key per prefix."""
    parts = F.split("path", separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    spread = paths.select("id", F.explode(prefixes).alias("root"))
    owner = spread.join(roots, "root").groupBy("id").agg(F.max_by("owner", F.length("root")).alias("owner"))
    return paths.join(owner, "id", "left")


def floor_lookup(probes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Adds the newest snapshot not after each probe's seq, by a union and one running maximum.

    The running maximum goes over ranges of seq: each range is scanned on its
    own and starts from the last snapshot of the ranges before it.
    """
    parts = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = probes.select("id", "seq", F.lit(None).cast("bigint").alias("snap")).unionByName(snapshots.select(F.lit(None).cast("bigint").alias("id"), "seq", F.col("seq").alias("snap")))
    span = both.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    width = max(1, -(-((span["b"] or 0) - (span["a"] or 0) + 1) // parts))
    ranged = both.withColumn("_r", F.floor((F.col("seq") - (span["a"] or 0)) / width))
    tops = ranged.groupBy("_r").agg(F.max("snap").alias("top"))  # one row a range
    before = tops.withColumn("before", F.max("top").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1))).select("_r", "before")
    w = W.partitionBy("_r").orderBy("seq", F.col("snap").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    found = ranged.withColumn("_s", F.max("snap").over(w)).join(F.broadcast(before), "_r", "left")
    return found.where("id is not null").select("id", "seq", F.coalesce("_s", "before").alias("snapshot"))


def synchronised_links(links: DataFrame, ingested: DataFrame) -> DataFrame:
    """Causes and before links whose ends are both ingested, summed per pair."""
    known = ingested.select("node").distinct()
    kept = links.where(F.col("type").isin("causes", "before")).join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    return kept.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"))


def top_class(closure: DataFrame) -> DataFrame:
    """The class of each node: its ancestor just below the root, or itself if it is that deep."""
    deepest = closure.groupBy("node").agg(F.max("depth").alias("top"))
    found = closure.join(deepest, "node").where("depth = top - 1").groupBy("node").agg(F.min("ancestor").alias("class"))
    return deepest.join(found, "node", "left").select("node", F.coalesce("class", "node").alias("class"))


def timeline(items: DataFrame, links: DataFrame) -> DataFrame:
    """A topological order of items (narrative, id, seq) by links (narrative, src, dst); of ready items the least seq comes first.

    One narrative is one ordered walk; a cycle is an error.
    """
    ship(items.sparkSession)

    def walk(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        seq = dict(zip(one["id"], one["seq"], strict=True))
        after: dict = {i: set() for i in seq}
        waits = dict.fromkeys(seq, 0)
        for a, b in zip(two["src"], two["dst"], strict=True):
            if a in seq and b in seq and b not in after[a]:
                after[a].add(b)
                waits[b] += 1
        ready, out = [(seq[i], i) for i in seq if not waits[i]], []
        heapq.heapify(ready)
        while ready:
            _, i = heapq.heappop(ready)
            out.append(i)
            for b in after[i]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, (seq[b], b))
        if len(out) < len(seq):
            raise ValueError("the links of a narrative form a cycle")
        return pd.DataFrame({"narrative": one["narrative"].iloc[:1].repeat(len(out)).to_numpy(), "id": out, "place": range(1, len(out) + 1)})

    kind = items.schema
    return items.groupBy("narrative").cogroup(links.groupBy("narrative")).applyInPandas(walk, f"narrative {kind['narrative'].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, place long")


def anchor_regions(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds the box of each row's anchor (min_x..max_z), zeros where the anchor has none."""
    sides = [f"{s}_{a}" for s in ("min", "max") for a in "xyz"]
    box = anchors.select("anchor", *[F.get("region", F.lit(i)).alias(n) for i, n in enumerate(sides)])
    return rows.join(box, "anchor", "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in sides})
