"""Ordered settlement: candidates of an entity are judged one after the other against the state the accepted ones made.

Layers 0 to 2 (settle.validate) need no state.  Layer 3 does: a write rule sees
the entity's attributes overlaid with the candidate's writes, and a rejected
candidate changes nothing.  Rows are dealt by entity and sorted within tasks; a
task reads them in batches and keeps one entity's attributes at a time, so no
entity needs to fit into memory, however many candidates it has.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.session import ship


class Reject(Exception):
    """A rule that cannot be evaluated; a filter that raises rejects."""


def _truthy(v) -> bool:
    return v not in (None, False, "") and not (isinstance(v, (int, float)) and v == 0)


def _number(v) -> float:
    if v is None:
        return 0
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise Reject("not a number")
    return v


def _text(v) -> str:
    return "" if v is None else str(v)


def _same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return a == b and (isinstance(a, str) == isinstance(b, str))


def _ordered(a, b) -> None:
    numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))
    if not numbers and not (isinstance(a, str) and isinstance(b, str)):
        raise Reject("not comparable")


def _binary(op: str, a, b):
    if op in ("==", "!="):
        return _same(a, b) == (op == "==")
    if op in ("<", "<=", ">", ">="):
        _ordered(a, b)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if op == "in":
        return any(_same(a, x) for x in b) if isinstance(b, list) else _text(a) in _text(b)
    x, y = _number(a), _number(b)
    if op == "%":  # of whole numbers, the sign that of the first
        x, y = int(x), int(y)
    if y == 0:
        raise Reject("zero")
    return x / y if op == "/" else abs(x) % abs(y) * (1 if x >= 0 else -1)


def evaluate(e, variables: dict, fields: dict):
    """Value of a rule expression over attributes and the candidate's fields; the same language that columns are compiled from."""
    if not isinstance(e, dict):
        return [evaluate(x, variables, fields) for x in e] if isinstance(e, list) else e
    ((op, args),) = e.items()
    args = args if isinstance(args, list) else [args]
    if op == "var":
        return variables.get(args[0], args[1] if len(args) > 1 else None)
    if op in ("cand", "write"):
        return fields.get(args[0])
    if op == "if":
        for condition, value in zip(args[::2], args[1::2], strict=False):
            if _truthy(evaluate(condition, variables, fields)):
                return evaluate(value, variables, fields)
        return evaluate(args[-1], variables, fields)
    if op in ("and", "or"):
        value = None
        for x in args:
            value = evaluate(x, variables, fields)
            if _truthy(value) == (op == "or"):
                return value
        return value
    own = [evaluate(x, variables, fields) for x in args]
    if op == "!":
        return not _truthy(own[0])
    if op in ("pass", "reject"):
        return op == "pass"
    if op == "+" and any(isinstance(x, str) for x in own) or op == "cat":
        return "".join(map(_text, own))
    if op in ("+", "*", "-"):
        total = _number(own[0])
        for x in own[1:]:
            total = total + _number(x) if op == "+" else total * _number(x) if op == "*" else total - _number(x)
        return -total if op == "-" and len(own) == 1 else total
    if op == "count":
        return len(own[0] or [])
    return _binary(op, *own)


def judge(rules: list[dict], state: dict, kind: str, writes: dict) -> list[str]:
    """Ids of the write rules that reject a candidate; keys that no one wrote are null."""
    after, out = state | writes, []
    for rule in rules:
        if rule.get("on_types") and kind not in rule["on_types"]:
            continue
        try:
            passes = _truthy(evaluate(rule["expr"], after, {"type": kind, **writes}))
        except (Reject, TypeError):
            passes = False
        if not passes:
            out.append(rule["id"])
    return out


def fold_sorted(rows: DataFrame, key: str, order: list[str], fresh: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """Folds each key's rows in order: step(state, row) -> (state, results as tuples of `schema`).

    Rows arrive sorted in batches, and one state is held at a time.
    """
    ship(rows.sparkSession)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != own:
                    own, state = row[key], fresh()
                state, made = step(state, row)
                out.extend(made)
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


RECEIPT = "id bigint, entity string, accepted boolean, layer int, reasons array<string>"


def settle(candidates: DataFrame, rules: list[dict], remembered: DataFrame | None = None) -> DataFrame:
    """Receipts of candidates (id, entity, type, writes as JSON text, idempotency_key) in the order of their ids.

    A candidate whose idempotency key an accepted one of the entity has used before
    gets that one's receipt: accepted, and written no second time; keys of rejected
    candidates are not remembered.  remembered (entity, writes as JSON text) is the state before.
    """
    rows = candidates.select("id", "entity", "type", "writes", "idempotency_key")
    if remembered is not None:
        before = remembered.select(F.lit(None).cast("bigint").alias("id"), "entity", F.lit("").alias("type"), "writes", F.lit(None).cast("string").alias("idempotency_key"))
        rows = rows.unionByName(before)

    def step(state, row):
        attributes, used = state
        writes = json.loads(row["writes"] or "{}")
        if row["id"] is None:
            return (attributes | writes, used), []
        if row["idempotency_key"] is not None and row["idempotency_key"] in used:
            return state, [(row["id"], row["entity"], True, None, [])]
        if not writes:
            return state, [(row["id"], row["entity"], False, 1, ["no writes"])]
        reasons = judge(rules, attributes, row["type"], writes)
        if reasons:
            return state, [(row["id"], row["entity"], False, 3, reasons)]
        return (attributes | writes, used | ({row["idempotency_key"]} - {None})), [(row["id"], row["entity"], True, None, [])]

    return fold_sorted(rows, "entity", ["id"], lambda: ({}, frozenset()), step, RECEIPT)


def transitions(rows: DataFrame, key: str, order: str, state: str, allowed: dict[str | None, list[str]]) -> DataFrame:
    """A running state machine: key, order, state, accepted and the state in force after each row.

    allowed: the states that may follow a state, None being that of a key without
    any.  A refused row does not move the state.
    """

    def step(now, row):
        fine = row[state] in allowed.get(now, [])
        now = row[state] if fine else now
        return now, [(row[key], row[order], row[state], fine, now)]

    kinds = dict(rows.dtypes)
    return fold_sorted(rows.select(key, order, state), key, [order], lambda: None, step, f"{key} {kinds[key]}, {order} {kinds[order]}, {state} string, accepted boolean, held string")
