"""Signals and tracks: hysteresis edges, velocities, stationary runs, latest points and association."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def edges(samples: DataFrame, on: float, off: float, dwell: int) -> DataFrame:
    """Edges of a signal (id, tick, value) through a hysteresis band and a dwell count, de-duplication off: id, tick, high.

    Samples at or above `on` are high, at or below `off` low, and those between
    keep the last clear one.  The dwell-th sample of a run of equal clear samples
    is an edge if it differs from the edge before it (low at first).
    """
    by = W.partitionBy("id").orderBy("tick")
    clear = samples.where((F.col("value") >= on) | (F.col("value") <= off)).select("id", "tick", (F.col("value") >= on).alias("high"))
    run = F.row_number().over(by) - F.row_number().over(W.partitionBy("id", "high").orderBy("tick"))
    placed = clear.withColumn("run", run).withColumn("n", F.row_number().over(W.partitionBy("id", "high", "run").orderBy("tick")))
    held = placed.where(F.col("n") == dwell)
    before = F.coalesce(F.lag("high").over(by), F.lit(False))
    return held.withColumn("before", before).where(F.col("high") != F.col("before")).select("id", "tick", "high")


def filter_step(state: tuple, tick: int, value: float, on: float, off: float, dwell: int, dedup: int) -> tuple[tuple, bool | None]:
    """One sample of the filter with a de-duplication window: the next state and the edge, if any.

    state is (high, candidate, count, tick of the last edge or None).  A change
    within `dedup` ticks of the last edge is swallowed, but the state flips.
    """
    high, candidate, count, last = state
    clear = True if value >= on else False if value <= off else None
    if clear is None:
        return state, None
    if clear == high:
        return (high, None, 0, last), None
    count = count + 1 if candidate == clear else 1
    if count < dwell:
        return (high, clear, count, last), None
    swallowed = last is not None and tick - last < dedup
    return (clear, None, 0, last if swallowed else tick), None if swallowed else clear


def edges_deduplicated(samples: DataFrame, on: float, off: float, dwell: int, dedup: int) -> DataFrame:
    """Edges with a de-duplication window, which depends on the last edge let through: one ordered fold per signal."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = (False, None, 0, None), []
        for tick, value in frame.sort_values("tick")[["tick", "value"]].itertuples(index=False):
            state, edge = filter_step(state, tick, value, on, off, dwell, dedup)
            if edge is not None:
                out.append((frame["id"].iloc[0], tick, edge))
        return pd.DataFrame(out, columns=["id", "tick", "high"])

    return samples.select("id", "tick", "value").groupBy("id").applyInPandas(run, f"id {samples.schema['id'].dataType.simpleString()}, tick long, high boolean")


def edge_events(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges as events by a mapping (id, on_type, off_type); signals without a mapping make none."""
    return found.join(mapping, "id").select("id", "tick", F.when(F.col("high"), F.col("on_type")).otherwise(F.col("off_type")).alias("type")).where("type is not null")


def velocities(points: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Adds vx, vy per `scale` units of t by finite differences; 0 for the first point or where time does not advance."""
    by = W.partitionBy("id").orderBy("t", "seq")
    dt = (F.col("t") - F.lag("t").over(by)) / scale
    speed = lambda c: F.when(dt > 0, (F.col(c) - F.lag(c).over(by)) / dt).otherwise(0.0)
    return points.withColumns({"vx": speed("x"), "vy": speed("y")})


def newest(points: DataFrame, most: int = 64) -> DataFrame:
    """The newest points of each track."""
    return points.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("t"), F.desc("seq")))).where(F.col("_n") <= most).drop("_n")


def latest(points: DataFrame) -> DataFrame:
    """The last point of each track."""
    others = [c for c in points.columns if c != "id"]
    return points.groupBy("id").agg(F.max_by(F.struct(*others), F.struct("t", "seq")).alias("p")).select("id", "p.*")


def stationary_since(points: DataFrame, still) -> DataFrame:
    """Where the last run of still points of each track began; null if its last point moves."""
    by = W.partitionBy("id").orderBy("t", "seq")
    moved = F.max(F.when(~still, F.struct("t", "seq"))).over(W.partitionBy("id"))
    marked = points.withColumn("_moved", moved).withColumn("_last", F.row_number().over(W.partitionBy("id").orderBy(F.desc("t"), F.desc("seq"))) == 1).withColumn("_still", still)
    after = F.col("_moved").isNull() | (F.struct("t", "seq") > F.col("_moved"))
    return marked.groupBy("id").agg(F.min(F.when(F.col("_still") & after, F.col("t"))).alias("since"))


def instance_state(last_seen, since, now, stationary_after: int, archive_after: int):
    """Active, Stationary (still for at least the first time) or Archived (unseen for at least the second)."""
    return F.when(now - last_seen >= archive_after, "Archived").when(since.isNotNull() & (now - since >= stationary_after), "Stationary").otherwise("Active")


def active_in(points: DataFrame, low: tuple, high: tuple, first: int, last: int) -> DataFrame:
    """Tracks whose last point lies in a box and a closed time range."""
    p = latest(points)
    return p.where(F.col("t").between(first, last) & F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]))


def phase(t, period: int, offset: int, duration: int):
    """Whether a time lies in a phase of a period."""
    return F.pmod(t, F.lit(period)).between(offset, offset + duration - 1)


def clamped_fold(feedback: DataFrame, start: float, reward: float, penalty: float, low: float = 0.05, high: float = 1.0) -> DataFrame:
    """Reliability after ordered feedback (source, seq, good), clamped at every step: one aggregate over the sorted steps of a source."""
    steps = feedback.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("seq", "good"))).alias("s"))
    change = lambda r, x: F.least(F.lit(high), F.greatest(F.lit(low), r + F.when(x["good"], F.lit(reward)).otherwise(F.lit(-penalty))))
    return steps.select("source", F.aggregate("s", F.lit(start), change).alias("reliability"))
