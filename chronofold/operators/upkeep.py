"""Upkeep of blocks and moving instances: window sweeps, promotion, archive, purging, association, sealing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators import signals, spatial
from chronofold.sources import records
from chronofold.sources.scratch import written

RESTING = "Stationary"
#: Instances of the first slice that observations meet, how much larger each further one is, and rows by cells that are broadcast at most.
SLICE, GROWTH, SPREAD = 50_000, 8, 500_000
#: Ids that the bounds of slices are taken from, about; all instances are met whatever the bounds are.
MARKS = 20_000


def sweep(blocks: DataFrame, now: int, window: int) -> DataFrame:
    """Drops candidates whose observation window has run out: blocks after the sweep, with `swept`.

    blocks (..., state, pending_payload, window_start, window_weight, last_update).  A
    changing block with an open window strictly older than `window` becomes stable
    again and forgets its candidate; a window of 0 or less never runs out.
    """
    late = F.lit(window > 0) & (F.col("state") == "Changing") & (F.col("window_start") >= 0) & (F.lit(now) - F.col("window_start") > window)
    out = blocks.withColumn("swept", F.coalesce(late, F.lit(False)))
    after = {"state": F.lit("Stable"), "pending_payload": F.lit(None), "window_start": F.lit(-1), "window_weight": F.lit(0.0), "last_update": F.lit(now)}
    return out.select(*[F.when(F.col("swept"), after[c].cast(t)).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c, t in out.dtypes])


def aged(instances: DataFrame, now: int, stationary_after: int, archive_after: int) -> DataFrame:
    """Instances (id, last_seen, since, ...) with their state at a time; both timeouts are met by reaching them.

    What has not been seen for long is archived whatever it was; archived ones stay
    until a later report makes them active again, so an instance is known by its
    last report alone.
    """
    return instances.withColumn("state", signals.instance_state(F.col("last_seen"), F.col("since"), F.lit(now), stationary_after, archive_after))


def promote(instances: DataFrame, next_id: int) -> DataFrame:
    """Stationary instances as new pending blocks: id, box, payload, timestamp, confidence, state, instance.

    Blocks are numbered from next_id in the order of the instances, range by range.
    """
    resting = instances.where(F.col("state") == RESTING)
    box = [c for c in instances.columns if c.startswith(("min_", "max_"))]
    return records.numbered(resting, "id", "_n", next_id - 1).select(F.col("_n").cast("bigint").alias("id"), *box, F.col("label").alias("payload"), F.col("last_seen").alias("timestamp"), "confidence", F.lit("Pending").alias("state"), F.col("id").alias("instance"))


def archived(instances: DataFrame, promoted: DataFrame) -> DataFrame:
    """Instances after promotion: those that became blocks are archived, their tracks stay."""
    gone = promoted.select(F.col("instance").alias("id"), F.lit(True).alias("_gone"))
    return instances.join(gone, "id", "left").withColumn("state", F.when(F.col("_gone"), "Archived").otherwise(F.col("state"))).drop("_gone")


def purge(versions: DataFrame, gone: DataFrame) -> DataFrame:
    """Version chains without those of the given blocks (block_id)."""
    return versions.join(gone.select("block_id"), "block_id", "left_anti")


def seal(versions: DataFrame, ends: DataFrame) -> DataFrame:
    """Ends the open version of blocks at a time: ends (block_id, valid_to); sealed versions stay as they are."""
    closing = ends.groupBy("block_id").agg(F.min("valid_to").alias("_end"))
    return versions.join(closing, "block_id", "left").withColumn("valid_to", F.coalesce("valid_to", "_end")).drop("_end")


def all_versions(versions: DataFrame) -> DataFrame:
    """Every version of every block in order, and of how many blocks the chains are."""
    return versions.withColumn("place", F.row_number().over(W.partitionBy("block_id").orderBy("version")))


def slices(ids: DataFrame, first: int) -> list[Column]:
    """Conditions that cut a column of ids into ranges, ascending: about `first` rows, then GROWTH times as many each time, then all others."""
    name, rows = ids.columns[0], ids.count()
    marks = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64(name), F.lit(max(1, rows // MARKS))) == 0).collect()) if rows > first else []
    cuts, upto = [], first
    while upto < rows and marks:
        cuts.append(marks[min(len(marks) - 1, upto * len(marks) // rows)])
        upto *= GROWTH
    cuts = list(dict.fromkeys(cuts))
    low = [F.lit(True), *[F.col(name) > F.lit(c) for c in cuts]]
    high = [*[F.col(name) <= F.lit(c) for c in cuts], F.lit(True)]
    return [x & y for x, y in zip(low, high, strict=True)]


def associate(seen: DataFrame, instances: DataFrame, window: int, size: float) -> DataFrame:
    """The instance each observation belongs to, or null: same label, overlapping boxes, and seen within a window.

    seen (id, box, label, t), instances (id, box, label, last_seen).  Boxes meet by
    grid cells, labels and stretches of time, so only neighbours are compared; of
    several instances the least id wins.  Instances come in slices of ascending ids,
    and observations that have found one are through: few are left for the large
    slices, and no pairs are moved.  Of instances that are alike the least is met.
    """
    span = 2 * max(window, 0) + 1
    known = instances.where("instance is not null").select(*[F.col(c).alias(f"b_{c}") for c in spatial.BOX], F.col("label").alias("b_label"), F.col("last_seen").alias("b_t"), "instance")
    rest, found = seen.select("id", *spatial.BOX, "label", "t"), []
    near = spatial.intersects(spatial.box_of(seen), spatial.box_of(known, "b_")) & (F.col("label") == F.col("b_label")) & (F.abs(F.col("t") - F.col("b_t")) <= window)
    for key in ("cx", "cy", "cz", "slot"):
        near = near & (F.col(key) == F.col(f"b_{key}"))
    for n, chosen in enumerate(slices(known.select("instance"), SLICE)):
        part = known.where(chosen).groupBy(*[c for c in known.columns if c != "instance"]).agg(F.min("instance").alias("instance"))
        part = part if n else written(part, "slice")
        part = spatial.spread(part.withColumn("slot", F.floor(F.col("b_t") / span)), size, "b_").withColumnsRenamed({c: f"b_{c}" for c in ("cx", "cy", "cz", "slot")})
        left = spatial.spread(rest.withColumn("slot", F.explode(F.sequence(F.floor((F.col("t") - window) / span), F.floor((F.col("t") + window) / span)))), size)
        left, part = (spatial.counted(left, SPREAD), part) if n else (left, spatial.counted(part, SPREAD))
        found.append(written(left.join(part, near).groupBy("id").agg(F.min("instance").alias("instance")), "found"))
        rest = written(rest.join(found[-1], "id", "left_anti"), "rest")
        if rest.isEmpty():
            break
    out = rest.select("id", F.lit(None).cast(known.schema["instance"].dataType).alias("instance")).distinct()
    for part in found:
        out = out.unionByName(part)
    return out


def nearest_in_time(probes: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """For each probe (id, key, t, ...) the row of known (id, key, t, ...) of its key that is nearest in time.

    One union and two running windows, so no key is multiplied: the last row at or
    before the probe and the first after it; of equally near ones the earlier, and of
    one time the least id.  Columns of the found row are named near_*.
    """
    names = [c for c in known.columns if c != key]
    one = known.groupBy(key, "t").agg(F.min(F.struct("id", *[c for c in names if c not in ("id", "t")])).alias("k"))
    held = one.select(key, "t", F.lit(0).alias("side"), F.struct("t", "k.*").alias("k"), F.lit(None).cast(f"struct<{','.join(f'`{n}`:{t}' for n, t in probes.dtypes)}>").alias("p"))
    asked = probes.select(key, "t", F.lit(1).alias("side"), F.lit(None).cast(held.schema["k"].dataType).alias("k"), F.struct(*probes.columns).alias("p"))
    both = held.unionByName(asked)
    past = W.partitionBy(key).orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy("t", "side").rowsBetween(0, W.unboundedFollowing)
    found = both.select("p", F.col("t"), F.last("k", ignorenulls=True).over(past).alias("before"), F.first("k", ignorenulls=True).over(ahead).alias("after")).where("p is not null")
    later = F.col("before").isNull() | (F.col("after").isNotNull() & (F.col("after.t") - F.col("t") < F.col("t") - F.col("before.t")))
    chosen = F.when(later, F.col("after")).otherwise(F.col("before"))
    return found.select("p.*", chosen.alias("n")).where("n is not null").select("*", *[F.col(f"n.{c}").alias(f"near_{c}") for c in ("id", *[c for c in names if c != "id"])]).drop("n")


def impossible(pairs: DataFrame, vmax: float) -> Column:
    """Whether the way between two places (x, y and near_x, near_y) is too long for the time between them."""
    way = F.sqrt((F.col("x") - F.col("near_x")) ** 2 + (F.col("y") - F.col("near_y")) ** 2)
    return way > vmax * F.abs(F.col("t") - F.col("near_t"))
