"""The event log and its folds: projections, time travel, slices, owners, counters and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cells(log: DataFrame) -> DataFrame:
    """The writes of an event log in long form: seq, entity, key, value (double)."""
    writes = F.create_map(F.col("type"), F.col("value"), F.lit("k"), F.col("k").cast("double"))
    return log.select("seq", "entity", F.explode(writes).alias("key", "value"))


def fold(writes: DataFrame, upto: int | None = None) -> DataFrame:
    """Last writer wins per (entity, key), nulls included: value and source_event; `upto` gives the state as of a seq.

    Sums up on the map side first, so a hot entity moves one row per key and task.
    """
    if upto is not None:
        writes = writes.where(F.col("seq") <= upto)
    last = writes.groupBy("entity", "key").agg(F.max_by(F.struct("value"), "seq").alias("cell"), F.max("seq").alias("source_event"))
    return last.select("entity", "key", F.col("cell.value").alias("value"), "source_event")


def watermarks(writes: DataFrame) -> DataFrame:
    """The last event that wrote each entity."""
    return writes.groupBy("entity").agg(F.max("seq").alias("watermark"))


def attributes(folded: DataFrame) -> DataFrame:
    """One row per entity with its attributes as a map."""
    return folded.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("attrs"))


def preview(attrs: Column, candidate: Column) -> Column:
    """Current attributes overlaid with candidate writes."""
    return F.map_concat(F.map_filter(attrs, lambda k, _: ~F.map_contains_key(candidate, k)), candidate)


def inherit(writes: DataFrame, declarations: DataFrame) -> DataFrame:
    """Adds the cells that owners receive from the entities they declare: one hop, not transitive.

    declarations (seq, owner, key, source): an owner's latest declaration holds.
    Direct and inherited writes apply at the event's seq; at a declaration the
    owner receives the source's cell of that moment, applied at the
    declaration's seq.  Returns writes with `applied` for folding.
    """
    last = declarations.groupBy("owner").agg(F.max("seq").alias("declared"))
    held = declarations.join(last, "owner").where("seq = declared").select("owner", F.col("key").alias("dkey"), F.col("source").alias("from"), "declared")
    later = writes.join(held, (F.col("entity") == F.col("from")) & (F.col("key") == F.col("dkey")) & (F.col("seq") > F.col("declared"))).select(F.col("owner").alias("entity"), "key", "value", "seq", F.col("seq").alias("applied"))
    before = writes.join(held, (F.col("entity") == F.col("from")) & (F.col("key") == F.col("dkey")) & (F.col("seq") <= F.col("declared")))
    back = before.groupBy("owner", "key").agg(F.max_by(F.struct("value", "seq"), "seq").alias("c"), F.max("declared").alias("applied")).select(F.col("owner").alias("entity"), "key", F.col("c.value").alias("value"), F.col("c.seq").alias("seq"), "applied")
    return writes.select("entity", "key", "value", "seq", F.col("seq").alias("applied")).unionByName(later).unionByName(back)


def fold_applied(writes: DataFrame) -> DataFrame:
    """Fold by the order of application, keeping the event that the value came from."""
    last = writes.groupBy("entity", "key").agg(F.max_by(F.struct("value", "seq"), F.struct("applied", "seq")).alias("c"))
    return last.select("entity", "key", F.col("c.value").alias("value"), F.col("c.seq").alias("source_event"))


def running_count(log: DataFrame, kind: str, name: str = "count") -> DataFrame:
    """A derived counter per entity: 1, 2, ... over the events of a type."""
    return log.where(F.col("type") == kind).withColumn(name, F.row_number().over(W.partitionBy("entity").orderBy("seq")).cast("bigint"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """A derived ratio, null where the denominator is zero or missing."""
    return F.when(denominator != 0, numerator / denominator)


def anchor_matches(slice_: str, anchor: Column) -> Column:
    """An empty slice matches all; else the anchor starts with it (so the last segment may be a prefix)."""
    return F.lit(True) if slice_ == "" else F.coalesce(anchor.startswith(F.lit(slice_)), F.lit(False))


def in_slice(slice_: str, kind: Column, anchor: Column) -> Column:
    """Only references by anchor can match a slice."""
    return F.lit(True) if slice_ == "" else (kind == "anchor") & anchor_matches(slice_, anchor)


def region(log: DataFrame, slice_: str, first: int = 0, last: int = 0) -> DataFrame:
    """Events of an anchor and what lies under it, between two seqs (0: open)."""
    out = log.where(anchor_matches(slice_, F.col("anchor")))
    out = out.where(F.col("seq") >= first) if first else out
    return out.where(F.col("seq") <= last) if last else out


def anchor_as_of(log: DataFrame, seq: int) -> DataFrame:
    """The events that each exact anchor had gathered at a seq."""
    return log.where(F.col("seq") <= seq).groupBy("anchor").agg(F.sort_array(F.collect_list("seq")).alias("events"))


def trajectory(log: DataFrame) -> DataFrame:
    """(entity, n, seq, anchor): the places of each entity in order."""
    return log.where(F.col("anchor").isNotNull()).select("entity", F.row_number().over(W.partitionBy("entity").orderBy("seq")).alias("n"), "seq", "anchor")


def current_anchor(log: DataFrame) -> DataFrame:
    """The last place of each entity."""
    return log.where(F.col("anchor").isNotNull()).groupBy("entity").agg(F.max_by("anchor", "seq").alias("anchor"), F.max("seq").alias("seq"))


def corrections(log: DataFrame) -> DataFrame:
    """Events with the event they correct: seq, entity, corrected, corrected_entity."""
    target = log.select(F.col("seq").alias("corrected"), F.col("entity").alias("corrected_entity"))
    return log.where(F.col("corrects").isNotNull()).select("seq", "entity", F.col("corrects").alias("corrected")).join(target, "corrected")


def idempotent(log: DataFrame, key: str, rejected: Column) -> DataFrame:
    """The first event of each key that was not rejected; events without a key all stay."""
    settled = log.where(~rejected)
    firsts = settled.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("seq"))
    return settled.join(firsts.select("seq"), "seq", "left_semi").unionByName(settled.where(F.col(key).isNull()))


def consistency(log: DataFrame) -> DataFrame:
    """One row: events, least and greatest seq, repeated seqs and gaps of the log (all but the first two are 0 in a sound log of seqs from 1)."""
    each = log.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("events"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum((F.col("n") > 1).cast("bigint")).alias("repeated"), (F.max("seq") - F.min("seq") + 1 - F.count(F.lit(1))).alias("gaps"))
