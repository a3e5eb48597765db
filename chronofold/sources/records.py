"""Record tables: scans with conjunctive conditions, order and limit; upserts, appends, patches and deletes.

Writes are expressed as new tables derived from old ones; nothing is changed in place.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType()}


class Condition(NamedTuple):
    """field, one of eq ne le ge prefix is_null not_null, and a value."""

    field: str
    op: str
    value: object = None


def schema(fields: dict[str, str]) -> T.StructType:
    """A table schema of int, real and text fields."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields.items()])


def predicate(c: Condition) -> Column:
    """Equality matches null with null; the other comparisons never match a null row; prefixes are case sensitive."""
    field = F.col(c.field)
    if c.op == "eq":
        return field.eqNullSafe(F.lit(c.value))
    if c.op == "ne":
        return field.isNotNull() & (field != F.lit(c.value))
    if c.op == "le":
        return field <= F.lit(c.value)
    if c.op == "ge":
        return field >= F.lit(c.value)
    if c.op == "prefix":
        return field.startswith(F.lit(c.value))
    if c.op == "is_null":
        return field.isNull()
    if c.op == "not_null":
        return field.isNotNull()
    raise ValueError(f"unknown operator {c.op}")


def query(df: DataFrame, conditions=(), order=(), limit: int = 0) -> DataFrame:
    """Rows that meet all conditions; order is (field, descending) pairs, nulls lowest; limit 0 is none."""
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, map(predicate, conditions)))
    if order:
        df = df.orderBy(*[F.col(f).desc_nulls_last() if down else F.col(f).asc_nulls_first() for f, down in order])
    return df.limit(limit) if limit > 0 else df


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a primary key, or none."""
    return query(df, [Condition(key, "eq", value)])


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the greatest `by`; null keys are keys."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def upsert(df: DataFrame, changes: DataFrame, key: str, by: str) -> DataFrame:
    """Rows of df replaced and extended by the last change (by `by`) of each key."""
    last = latest(changes, [key], by).select(df.columns)
    return df.join(last.select(F.col(key).alias("_k")), df[key].eqNullSafe(F.col("_k")), "left_anti").unionByName(last)


def append(df: DataFrame, rows: DataFrame, order: str, seq: str = "seq") -> DataFrame:
    """Appends rows with the next sequence numbers in the given order.

    Numbers come from counts per range partition, so no task sees all rows.
    """
    top = df.agg(F.coalesce(F.max(seq), F.lit(0)).alias("m")).first()["m"]
    return df.unionByName(numbered(rows, order, seq, top).select(df.columns))


def numbered(rows: DataFrame, order: str, name: str = "seq", after: int = 0) -> DataFrame:
    """Adds after + 1, after + 2, ... in the order of a column, gapless.

    Rows are cut into ranges of the column; each range is numbered on its own
    and shifted by the rows of the ranges before it.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.select(F.percentile_approx(order, F.lit([i / parts for i in range(1, parts)]), 1000).alias("e")).first()["e"] or [] if parts > 1 else []
    edges = sorted(set(edges))
    part = reduce(lambda a, e: a + F.when(F.col(order) > F.lit(e), 1).otherwise(0), edges, F.lit(0))
    rows = rows.withColumn("_part", part)
    counts = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}  # one number per range
    before, total = [], after
    for p in range(len(edges) + 1):
        before.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in before]), F.col("_part") + 1)
    return rows.withColumn(name, start + F.row_number().over(W.partitionBy("_part").orderBy(order))).drop("_part")


def remove(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df without the rows of the given keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def update_where(df: DataFrame, conditions, patch: dict) -> DataFrame:
    """Sets fields where all conditions hold."""
    hit = reduce(lambda a, b: a & b, map(predicate, conditions), F.lit(True))
    return df.withColumns({f: F.when(hit, F.lit(v)).otherwise(F.col(f)) for f, v in patch.items()})


def valid(rows: DataFrame, key: str, existing: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Adds `reject`: null, duplicate, or the first reference field that points nowhere."""
    known = existing.select(F.col(key).alias("_known")).distinct()
    out = rows.join(known, F.col(key) == F.col("_known"), "left")
    reason = F.when(F.col("_known").isNotNull(), F.lit("duplicate"))
    drop = ["_known"]
    for n, (field, (table, column)) in enumerate(references.items()):
        mark = f"_ref{n}"
        out = out.join(table.select(F.col(column).alias(mark)).distinct(), F.col(field) == F.col(mark), "left")
        reason = reason.when(F.col(field).isNotNull() & F.col(mark).isNull(), F.lit(field))
        drop.append(mark)
    return out.withColumn("reject", reason).drop(*drop)


def tagged(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows as JSON text of type-tagged values: {"f": {"t": "int", "v": "1"}}."""
    return df.select(F.to_json(F.struct(*[F.struct(F.when(F.col(f).isNull(), "null").otherwise(F.lit(k)).alias("t"), F.col(f).cast("string").alias("v")).alias(f) for f, k in fields.items()])).alias("record"))


def untagged(df: DataFrame, fields: dict[str, str], column: str = "record") -> DataFrame:
    """The inverse of tagged()."""
    kind = T.StructType([T.StructField(f, T.StructType([T.StructField("t", T.StringType()), T.StructField("v", T.StringType())])) for f in fields])
    return df.select(F.from_json(column, kind).alias("r")).select(*[F.when(F.col(f"r.{f}.t") != "null", F.col(f"r.{f}.v").cast(TYPES[k])).alias(f) for f, k in fields.items()])


def replay_log(spark: SparkSession, path: str, fields: dict[str, str], key: str) -> DataFrame:
    """A table from a JSON-lines log of {"seq", "op": put|remove, "row": {...}}: the last operation of a key wins; bad lines are dropped."""
    kind = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("row", schema(fields))])
    log = spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path).select("seq", "op", F.col(f"row.{key}").alias("_key"), "row")
    return latest(log.where(F.col("_key").isNotNull()), ["_key"], "seq").where("op = 'put'").select("row.*")


def jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a database by JDBC; filters and columns are pushed down by Spark."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
