"""View contracts compiled to DataFrames: terminal, flow, intercept and traversal modes, with time travel.

A view names its event types, the attributes it shows, read rules and an
optional observer variant of the columns.  Terminal rows are the entities that
the selected events wrote; their values come from the whole projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators import events, graph
from chronofold.operators.rules import Value, rejects


@dataclass
class View:
    """A view contract."""

    types: list[str]
    selects: list[str]
    rules: list[dict] = field(default_factory=list)
    variants: dict[str, list[str]] = field(default_factory=dict)
    mode: str = "terminal"
    folds_corrections: bool = True


def selected(log: DataFrame, view: View, entity: str | None = None, slice_: str = "", upto: int | None = None) -> DataFrame:
    """The events that a view looks at; flow views without corrections leave correcting events out."""
    out = log.where(F.col("type").isin(view.types)).where(events.anchor_matches(slice_, F.col("anchor")))
    if entity is not None:
        out = out.where(F.col("entity") == entity)
    if upto is not None:
        out = out.where(F.col("seq") <= upto)
    if view.mode == "flow" and not view.folds_corrections:
        out = out.where(F.col("corrects").isNull())
    return out


def terminal(log: DataFrame, view: View, observer: str | None = None, **params) -> DataFrame:
    """entity and one column per selected attribute (missing: null), without the rows that a read rule rejects."""
    shown = view.variants.get(observer, view.selects)
    needed = sorted({*shown, *(d for r in view.rules for d in r.get("deps", []))})
    upto = params.get("upto")
    cells = events.cells(log).where(F.col("key").isin(needed))
    if upto is not None:
        cells = cells.where(F.col("seq") <= upto)
    # one aggregation makes the fold and the columns: the last cell of each key, by entity
    last = lambda k: F.max(F.when(F.col("key") == k, F.struct("seq", "value")))
    wide = cells.groupBy("entity").agg(*[last(k).alias(f"_{i}") for i, k in enumerate(needed)])
    wide = wide.join(selected(log, view, **params).select("entity").distinct(), "entity", "left_semi")
    at = {k: f"_{i}" for i, k in enumerate(needed)}
    variables = {k: Value(F.col(f"{c}.value"), "number") for k, c in at.items()}
    present = {k: F.col(c).isNotNull() for k, c in at.items()}
    hidden = reduce(lambda a, b: a | b, [rejects(r, variables, present, "read") for r in view.rules], F.lit(False))
    return wide.where(~hidden).select("entity", *[F.col(f"{at[k]}.value").alias(k) for k in shown])


def flow(log: DataFrame, view: View, **params) -> DataFrame:
    """The selected events themselves, each once: seq, type, entity, anchor, value."""
    return selected(log, view, **params).select("seq", "type", "entity", "anchor", "value").dropDuplicates(["seq"])


def recent(rejections: DataFrame, limit: int = 50) -> DataFrame:
    """The last rejections, newest first, at most the 256 that are remembered."""
    return rejections.orderBy(F.desc("seq")).limit(min(max(limit, 1), 256))


def intercept(log: DataFrame, view: View, rejections: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """Terminal rows and the 50 latest rejections."""
    return terminal(log, view, **params), recent(rejections)


def traversal(references: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """Nodes within `depth` undirected steps of a root and the edges between them: src, dst, type."""
    nodes = graph.within(references, root, depth)
    left = nodes.select(F.col("node").alias("src"))
    right = nodes.select(F.col("node").alias("dst"))
    return references.select("src", "dst", "type").distinct().join(left, "src", "left_semi").join(right, "dst", "left_semi")


def probe_options(rows: DataFrame, key: str, options: list, rules: list[dict], variables, name: str = "options") -> DataFrame:
    """Adds the values of an enumerated key that the write rules allow on each row, in declared order."""
    allowed = []
    for option in options:
        tried = dict(variables) | {key: Value(F.lit(option), "string" if isinstance(option, str) else "number")}
        bad = reduce(lambda a, b: a | b, [rejects(r, tried, {}, "write") for r in rules], F.lit(False))
        allowed.append(F.when(~bad, F.lit(option)))
    return rows.withColumn(name, F.filter(F.array(*allowed), lambda x: x.isNotNull()))
