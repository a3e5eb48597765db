"""What can be done from a view: buttons of its rows with options, presets and context, and the view's own actions.

An event type names the keys it writes, what it always writes (presets) and the
write rules that guard it.  A button is enabled if its presets pass the rules or,
where the type has enumerated keys, if each of them has a value that passes: what
can be pressed is what can be settled.  Everything is a column over the view's
rows; the number of expressions follows the definitions, never the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.rules import Value, rejects

SYSTEM = ("id", "type", "actor", "space", "time", "evidence", "corrects", "idempotency_key", "writes")


@dataclass
class EventType:
    """An event type as far as buttons look at it; rules are write-side filters."""

    type: str
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    presets: dict = field(default_factory=dict)
    rules: list[dict] = field(default_factory=list)
    multi_target: bool = False

    @property
    def keys(self) -> list[str]:
        return [*self.required, *self.optional]


def merged_presets(kind: EventType, view_presets: dict[str, dict]) -> dict:
    """What the type always writes, the view's own presets for it coming last."""
    return kind.presets | view_presets.get(kind.type, {})


def _written(value) -> Value:
    kind = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "int" if isinstance(value, int) else "number"
    return Value(F.lit(value), kind)


def _bad(kind: EventType, variables: dict[str, Value], writes: dict) -> list[Column]:
    """One column per rule: whether it rejects the row as it would be after the writes."""
    after = variables | {k: _written(v) for k, v in writes.items()}
    return [rejects(rule, after, {}, "write") for rule in kind.rules]


def legal(kind: EventType, key: str, values: list, variables: dict[str, Value], presets: dict) -> Column:
    """The values of an enumerated key that pass, as text in declared order; a preset of the key is always among them."""
    tried = []
    for value in values:
        bad = reduce(lambda a, b: a | b, _bad(kind, variables, presets | {key: value}), F.lit(False))
        passes = ~bad if presets.get(key) != value else F.lit(True)
        tried.append(F.when(passes, F.lit(str(value))))
    if key in presets and presets[key] not in values:
        tried.insert(0, F.lit(str(presets[key])))
    return F.filter(F.array(*tried), lambda x: x.isNotNull())


def context(kind: EventType, variables: dict[str, Value], presets: dict) -> Column:
    """The type's keys that the row has a value for, less presets and system keys, as a map of text."""
    keys = [k for k in kind.keys if k in variables and k not in presets and k not in SYSTEM]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), variables[k].column.cast("string").alias("value")) for k in keys])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())) if keys else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _text_map(values: dict) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]).cast("array<string>"), F.array(*[F.lit(str(v)) for v in values.values()]).cast("array<string>"))


def button(kind: EventType, variables: dict[str, Value], ranges: dict[str, list], view_presets: dict[str, dict]) -> Column:
    """struct<type, enabled, reasons, presets, options, context> of one event type on a row.

    reasons are the ids of the rules that reject, or the keys without a legal value.
    """
    presets = merged_presets(kind, view_presets)
    chosen = [] if kind.multi_target else [k for k in kind.keys if ranges.get(k)]
    options = {k: legal(kind, k, ranges[k], variables, presets) for k in chosen}
    if options:
        reasons = [F.when(F.size(found) == 0, F.lit(f"no legal value: {k}")) for k, found in options.items()]
    else:
        reasons = [F.when(bad, F.lit(rule["id"])) for rule, bad in zip(kind.rules, _bad(kind, variables, presets), strict=True)]
    given = F.filter(F.array(*reasons).cast("array<string>"), lambda x: x.isNotNull())
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in options]).cast("array<string>"), F.array(*options.values()).cast("array<array<string>>"))
    return F.struct(F.lit(kind.type).alias("type"), (F.size(given) == 0).alias("enabled"), given.alias("reasons"), _text_map(presets).alias("presets"), table.alias("options"), context(kind, variables, presets).alias("context"))


def with_buttons(rows: DataFrame, emits: list[EventType], variables: dict[str, Value], ranges: dict[str, list], view_presets: dict[str, dict] | None = None) -> DataFrame:
    """Adds `buttons`, one per emitted type in the view's order."""
    return rows.withColumn("buttons", F.array(*[button(kind, variables, ranges, view_presets or {}) for kind in emits]))


def actions(spark: SparkSession, emits: list[EventType], ranges: dict[str, list], view_presets: dict[str, dict] | None = None) -> DataFrame:
    """type, presets and options of a view's actions: without a row, an enumerated key has all its declared values."""
    out = spark.range(1).select(F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("place"), F.lit(kind.type).alias("type"), _text_map(merged_presets(kind, view_presets or {})).alias("presets"),
            F.map_from_arrays(F.array(*[F.lit(k) for k in shown]).cast("array<string>"), F.array(*[F.array(*[F.lit(str(v)) for v in ranges[k]]) for k in shown]).cast("array<array<string>>")).alias("options"),
        )
        for n, kind in enumerate(emits)
        for shown in [[] if kind.multi_target else [k for k in kind.keys if ranges.get(k)]]
    ])).alias("a"))
    return out.select("a.*")
