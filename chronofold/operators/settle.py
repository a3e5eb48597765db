"""The write path: candidates validated in layers, settled in order, with derivations and bounded trigger cascades.

Candidates come in long form: id, type, trust, entity, key, value (JSON text);
a candidate without writes has one row with a null entity.  Layers 0 to 2 need
no state and are joins with the definition tables, which are small and capped
by the number of registered definitions; layer 3 looks at the projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.sources.scratch import written

#: Rounds of triggers after the first settlement.
CASCADE = 4


def current_definitions(log: DataFrame, key: str = "key") -> DataFrame:
    """The latest version of each definition of a log (key, version, ...), retired ones included."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("d")).select(key, "d.*")


def datatype_matches(value: Column, kind: Column) -> Column:
    """Whether JSON text is of a datatype; null fits all, enum and ref are strings here."""
    text = value.rlike(r'^".*"$')
    number = value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    fits = (
        F.when(kind.isin("string", "enum", "ref"), text)
        .when(kind == "integer", value.rlike("^-?[0-9]+$"))
        .when(kind == "number", number)
        .when(kind == "boolean", value.isin("true", "false"))
        .when(kind == "list", value.startswith("["))
        .when(kind == "object", value.startswith("{"))
        .otherwise(True)
    )
    return value.isNull() | (value == "null") | fits


def validate(candidates: DataFrame, attributes: DataFrame, types: DataFrame) -> DataFrame:
    """(id, layer, reasons): layer is the first of 0, 1, 2 that rejects, or null; reasons are sorted.

    attributes (key, status, writers, range, datatype); types (type, status, min_trust, multi_target, required).
    """
    a = attributes.select(F.col("key"), F.col("status").alias("a_status"), "writers", F.col("range"), "datatype")
    t = types.select(F.col("type"), F.col("status").alias("t_status"), "min_trust", "multi_target", "required")
    rows = candidates.join(a, "key", "left").join(t, "type", "left")
    writes = F.col("entity").isNotNull()
    l0 = F.when(writes & (F.col("a_status").isNull() | (F.col("a_status") != "active")), F.concat(F.lit("unregistered "), "key"))
    no_type = F.col("t_status").isNull() | (F.col("t_status") != "active")
    known = writes & F.col("a_status").isNotNull()
    l2 = [
        F.when(no_type, F.lit("unknown type")),
        F.when(~no_type & (F.col("min_trust") > F.col("trust")), F.lit("trust")),
        F.when(~no_type & known & ~(F.array_contains("writers", "*") | F.array_contains("writers", F.col("type"))), F.concat(F.lit("not authorised "), "key")),
        F.when(~no_type & known & (F.size("range") > 0) & ~F.array_contains("range", F.col("value")), F.concat(F.lit("out of range "), "key")),
        F.when(~no_type & known & ~datatype_matches(F.col("value"), F.col("datatype")), F.concat(F.lit("datatype "), "key")),
    ]
    found = rows.select("id", "type", "entity", "key", l0.alias("l0"), F.filter(F.array(*l2), lambda x: x.isNotNull()).alias("l2"), "multi_target", "required", (~no_type).alias("typed"))
    # required keys of each target, and the number of targets, by candidate
    targets = found.where("entity is not null").groupBy("id", "entity").agg(F.collect_set("key").alias("keys"), F.first("required").alias("required"), F.first("multi_target").alias("multi"), F.first("typed").alias("typed"))
    missing = F.transform(F.array_except("required", "keys"), lambda k: F.concat(F.lit("missing "), k))
    shape = targets.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("typed"), missing)))).alias("missing"), (F.first("typed") & ~F.first("multi") & (F.count(F.lit(1)) > 1)).alias("many"))
    each = found.groupBy("id").agg(F.collect_set("l0").alias("r0"), F.count("entity").alias("n"), F.array_distinct(F.flatten(F.collect_list("l2"))).alias("r2"))
    empty = F.array().cast("array<string>")
    joined = each.join(shape, "id", "left")
    r2 = F.concat("r2", F.coalesce("missing", empty), F.when(F.col("many"), F.array(F.lit("many targets"))).otherwise(empty))
    layer = F.when(F.size("r0") > 0, 0).when(F.col("n") == 0, 1).when(F.size(r2) > 0, 2)
    reasons = F.when(F.size("r0") > 0, F.col("r0")).when(F.col("n") == 0, F.array(F.lit("no writes"))).otherwise(r2)
    return joined.select("id", layer.alias("layer"), F.sort_array(reasons).alias("reasons"))


def first_settled(candidates: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """The accepted candidates, each idempotency key once (rejected ones are not remembered)."""
    fine = candidates.join(receipts.where("layer is null").select("id"), "id", "left_semi")
    first = fine.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id")).select("id")
    return fine.where(F.col(key).isNotNull()).join(first, "id", "left_semi").unionByName(fine.where(F.col(key).isNull()))


def cascade(events: DataFrame, triggers: list, depth: int = CASCADE) -> DataFrame:
    """Events with those that triggers emit, round by round: adds `round`.

    A trigger is a function DataFrame -> DataFrame of emitted events with the
    same columns; a round without events ends the cascade.  Each round is written,
    so triggers and the result read it and never the rounds before it.
    """
    out = current = events.withColumn("round", F.lit(0))
    for number in range(1, depth + 1):
        emitted = written(reduce(DataFrame.unionByName, [t(current.drop("round")) for t in triggers]).withColumn("round", F.lit(number)), "cascade")
        if emitted.isEmpty():
            break
        out, current = out.unionByName(emitted), emitted
    return out
