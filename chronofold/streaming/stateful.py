"""Ordered state machines per key, with one step function for batch and stream.

``run_batch`` folds the sorted rows of each key; ``run_stream`` keeps the same
state between micro-batches.  A key's rows are handled in the order of (t, seq)
within a batch, so both give the same results if batches arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronofold.operators.settlement import fold_sorted
from chronofold.operators.signals import filter_step
from chronofold.session import ship

#: step(state or None, row as dict) -> (state, output rows as tuples); states are JSON values.
Step = Callable[[dict | None, dict], tuple[dict, list[tuple]]]


def _fold(step: Step, state, frame: pd.DataFrame, order: list[str]) -> tuple[object, list[tuple]]:
    out = []
    for row in frame.sort_values(order, kind="stable").to_dict("records"):
        state, made = step(state, row)
        out += made
    return state, out


def run_batch(rows: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """All rows of each key in order; tasks read them sorted, in batches, and hold one key's state at a time."""
    return fold_sorted(rows, key, order, lambda: None, step, schema)


def run_stream(rows: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The same over a stream: state is kept per key as JSON text."""
    ship(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(_, frames, group: GroupState):
        frame = pd.concat(list(frames))
        state, out = _fold(step, json.loads(group.get[0]) if group.exists else None, frame, order)
        group.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def edge_step(on: float, off: float, dwell: int, dedup: int) -> Step:
    """Hysteresis, dwell and de-duplication of a signal: emits (id, tick, high)."""

    def step(state, row):
        own = tuple(state["s"]) if state else (False, None, 0, None)
        own, edge = filter_step(own, int(row["tick"]), float(row["value"]), on, off, dwell, dedup)
        return {"s": list(own)}, [] if edge is None else [(row["id"], int(row["tick"]), edge)]

    return step


def arbitration_step(threshold: float, window: int, reliability: dict[int, float], default: float = 0.5, pattern: dict | None = None) -> Step:
    """Classifies observations (id, t, payload, source) of a block and decides on changes by weight.

    A row with `put` places the block, Pending with its payload; an observation of a
    block that is not there is not accepted and changes nothing.  A candidate opens a
    window; it takes effect once the weights of observations for it reach the threshold,
    lapses when the window is over (strictly more than `window` after its start)
    or the old value is seen again.  pattern maps phases of a period to expected
    payloads: {"period": p, "phases": [[offset, duration, payload], ...]}.
    Emits (id, t, kind, accepted, state, payload, version).
    """

    def step(block, row):
        t, seen, weight = int(row["t"]), row["payload"], reliability.get(int(row["source"]), default)
        made = lambda kind, accepted: [(row["id"], t, kind, accepted, block["state"], block["payload"], block["version"])]
        if row.get("put"):
            block = {"payload": seen, "state": "Pending", "version": 1, "weight": 0.0, "candidate": None, "since": -1, "for": 0.0}
            return block, made("Put", True)
        if block is None:
            return None, [(row["id"], t, "Vanishing" if seen == "" else "Emergence", False, None, None, None)]
        block = dict(block)
        if block["candidate"] is not None and t - block["since"] > window:
            block |= {"state": "Stable", "candidate": None, "since": -1, "for": 0.0}
        if pattern:
            at = t % max(1, pattern["period"])
            if any(o <= at < o + d and p == seen for o, d, p in pattern["phases"]):
                block["weight"] += weight
                return block, made("Seasonal", True)
        if block["state"] != "Changing" and seen == block["payload"]:
            block["weight"] += weight
            if block["state"] == "Pending" and block["weight"] >= threshold:
                block["state"] = "Stable"
            return block, made("Transient", True)
        kind = "Vanishing" if seen == "" else "Emergence" if block["payload"] == "" else "Mutation"
        if block["state"] == "Changing":
            if seen == block["payload"]:
                block |= {"state": "Stable", "candidate": None, "since": -1, "for": 0.0}
                return block, made("Transient", True)
            if seen != block["candidate"]:
                return block, made("Conflict", False)
            block["for"] += weight
            kind = kind if block["for"] >= threshold or seen == "" else "Mutation"
        elif block["state"] != "Stable":
            return block, made("Conflict", False)
        else:
            block |= {"state": "Changing", "candidate": seen, "since": t, "for": weight}
        if block["for"] >= threshold:
            block |= {"payload": seen, "state": "Stable", "version": block["version"] + 1, "candidate": None, "since": -1, "for": 0.0}
            return block, made(kind, True)
        return block, made(kind, False)

    return step


ARBITRATED = "id long, t long, kind string, accepted boolean, state string, payload string, version long"


def track_step(stationary_after: int, archive_after: int, still: float = 1e-3) -> Step:
    """Life of a moving instance from its points (id, t, x, y): emits (id, t, state, speed, revived).

    Speed is the finite difference to the point before; a point without later
    time keeps speed 0.  An instance that was unseen for the archive time is
    revived by its next point.
    """

    def step(own, row):
        t, x, y = int(row["t"]), float(row["x"]), float(row["y"])
        if own is None:
            return {"t": t, "x": x, "y": y, "since": t}, [(row["id"], t, "Active", 0.0, False)]
        dt = (t - own["t"]) / 1000
        speed = (((x - own["x"]) ** 2 + (y - own["y"]) ** 2) ** 0.5) / dt if dt > 0 else 0.0
        revived = t - own["t"] >= archive_after
        since = (own["since"] if own["since"] >= 0 and not revived else t) if speed <= still else -1
        state = "Stationary" if since >= 0 and t - since >= stationary_after else "Active"
        return {"t": t, "x": x, "y": y, "since": since}, [(row["id"], t, state, speed, revived)]

    return step


TRACKED = "id long, t long, state string, speed double, revived boolean"


def windowed_fold(stream: DataFrame, time: str, delay: str, size: str) -> DataFrame:
    """Latest value per (entity, key) and event-time window of a stream, late rows dropped by a watermark."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, delay).groupBy(F.window(time, size), "entity", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("source_event"))


def sink_fold(stream: DataFrame, path: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame]):
    """Writes each micro-batch, folded, as Parquet under its batch number, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
