"""The engine's tables as derived from the driver tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY0 = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an event log: seq, ts, type, entity, user_id, value, k, anchor, corrects.

    An error corrects the last purchase of the same user before it.
    """
    earlier = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        "ts",
        F.col("event_type").alias("type"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"),
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("plant/line"), (F.col("user_id") % 4).cast("string"), F.lit("/st"), (F.col("event_id") % 7).cast("string")).alias("anchor"),
        F.when(F.col("event_type") == "error", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id") + 1)).over(earlier)).alias("corrects"),
    )


def plain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_log without corrects, which needs no shuffle."""
    return event_log(spark, sf_dir).drop("corrects")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as memory blocks: id, box, t, payload, state, confidence."""
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_custkey") % 100).cast("double").alias("x"),
            (F.col("o_orderkey") % 100).cast("double").alias("y"),
            F.lit(0.0).alias("z"),
            (1 + F.col("o_orderkey") % 3).cast("double").alias("half"),
            F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit(DAY0))).cast("bigint").alias("t"),
            F.col("o_orderpriority").alias("payload"),
            F.when(F.col("o_orderstatus") == "F", "Stable").when(F.col("o_orderstatus") == "O", "Pending").otherwise("Changing").alias("state"),
            (0.5 + (F.col("o_orderkey") % 50) / 100).alias("confidence"),
        )
        .select("id", *[(F.col(a) - F.col("half")).alias(f"min_{a}") for a in "xyz"], *[(F.col(a) + F.col("half")).alias(f"max_{a}") for a in "xyz"], "t", "payload", "state", "confidence")
    )


def version_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of a block per customer: block_id, t, payload, ord (breaks ties)."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block_id"), F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit(DAY0))).cast("bigint").alias("t"), F.col("o_orderpriority").alias("payload"), F.col("o_orderkey").alias("ord"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as observations: anchor (supplier), bucket, key, value, source, confidence, ts (days)."""
    base = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("anchor"),
        F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.lit(DAY0))).cast("bigint").alias("ts"),
        (F.col("l_partkey") % 5).alias("source"),
        (F.lit(0.5) + F.col("l_discount")).alias("confidence"),
        F.explode(F.create_map(F.lit("returnflag"), "l_returnflag", F.lit("linestatus"), "l_linestatus")).alias("key", "value"),
    )
    return base.withColumn("bucket", F.expr("ts div 30"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as track points: id (user), seq, t (ms), x (value), y (k)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("event_id") + 1).alias("seq"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))").alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


def is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and supplier -> nation -> region as IS_A edges (child, parent)."""
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    return (
        table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
        .union(table(spark, sf_dir, "supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey")))
        .union(table(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    )


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges customer -> supplier by lineitems ordered: src, dst, type, weight."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("CO_OCCURS").alias("type"), F.col("n").cast("double").alias("weight"))
