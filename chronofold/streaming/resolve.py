"""Emergence of entities from observations, profile by profile in order, per group of anchors.

Profiles of one group (an anchor, or whatever key the caller blocks by) are
resolved one after the other: each is compared with the entities of its group
and is merged into the best one, becomes a new entity, or is disputed.  Groups
are independent, so they run in parallel and as a stream.
"""

from __future__ import annotations

from math import log1p

from chronofold.streaming.stateful import Step

RESOLVED = "anchor string, bucket long, decision string, entity string, score double"


def resolve_step(weights: dict[str, float], default: float = 1.0, theta: float = 3.0, merge: float = 0.75, split: float = 0.3) -> Step:
    """Steps over profiles (anchor, bucket, entries: [(key, value, source), ...]).

    A profile whose information (weight * ln(1 + sources) summed over keys) is
    under theta stays in the pool.  Scores are weighted agreement mapped to
    [0, 1], 0.5 without a common key, plus 0.05 per new source up to 0.15; ties
    go to the entity that was there first.
    """

    def step(state, row):
        entities = state["entities"] if state else []
        values: dict[str, set] = {}
        sources: dict[str, set] = {}
        for entry in row["entries"]:
            key, value, source = entry["key"], entry["value"], int(entry["source"])
            values.setdefault(key, set()).add(value)
            sources.setdefault(key, set()).add(source)
        info = sum(weights.get(k, default) * log1p(len(s)) for k, s in sources.items())
        made = lambda decision, entity, score: [(row["anchor"], int(row["bucket"]), decision, entity, score)]
        if info < theta:
            return {"entities": entities}, made("pool", None, None)
        own = set().union(*sources.values())
        best, best_score = None, None
        for e in entities:
            common = [k for k in values if k in e["values"]]
            total = sum(weights.get(k, default) for k in common)
            agree = sum(weights.get(k, default) * (1 if values[k] & set(e["values"][k]) else -1) for k in common)
            score = ((agree / total + 1) / 2 if total else 0.5) + min(0.15, 0.05 * len(own - set(e["sources"])))
            score = min(1.0, score)
            if best_score is None or score > best_score:
                best, best_score = e, score
        if best is None or best_score <= split:
            name = f"{row['anchor']}#{len(entities) + 1}"
            fresh = {"name": name, "values": {k: sorted(v) for k, v in values.items()}, "sources": sorted(own)}
            return {"entities": [*entities, fresh]}, made("new", name, best_score)
        if best_score < merge:
            return {"entities": entities}, made("disputed", best["name"], best_score)
        best["sources"] = sorted(own | set(best["sources"]))
        for k, v in values.items():
            best["values"][k] = sorted(v | set(best["values"].get(k, ())))
        return {"entities": entities}, made("merge", best["name"], best_score)

    return step
