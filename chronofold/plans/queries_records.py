"""Queries over record tables: scans, predicates, order, writes as derived tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.plans.book import Book
from chronofold.sources import records as r
from chronofold.sources.bindings import table

BOOK = Book()
q = BOOK.query
C = r.Condition


@q("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 400000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 50")
def scan_conditions_order_limit(spark, d):
    rows = r.query(table(spark, d, "orders"), [C("o_orderstatus", "eq", "F"), C("o_totalprice", "ge", 400000.0)], [("o_totalprice", True), ("o_orderkey", False)], 50)
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@q("SELECT * FROM customer WHERE c_custkey = 42")
def scan_point_lookup(spark, d):
    return r.get(table(spark, d, "customer"), "c_custkey", 42)


@q("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def filter_not_equal(spark, d):
    return r.query(table(spark, d, "customer"), [C("c_mktsegment", "ne", "MACHINERY")]).select("c_custkey", "c_mktsegment")


@q("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 1000 AND c_acctbal >= 0")
def filter_range(spark, d):
    return r.query(table(spark, d, "customer"), [C("c_acctbal", "le", 1000.0), C("c_acctbal", "ge", 0.0)]).select("c_custkey", "c_acctbal")


@q("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def filter_prefix(spark, d):
    return r.query(table(spark, d, "part"), [C("p_name", "prefix", "red")]).select("p_partkey", "p_name")


_NULLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS note FROM orders)"


def _nulled(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("note"))


@q(f"SELECT o_orderkey FROM {_NULLED} WHERE note IS NULL")
def filter_is_null(spark, d):
    return r.query(_nulled(spark, d), [C("note", "is_null")]).select("o_orderkey")


@q(f"SELECT o_orderkey, note FROM {_NULLED} WHERE note IS NOT NULL AND note <> '5-LOW'")
def filter_not_null_ne(spark, d):
    return r.query(_nulled(spark, d), [C("note", "not_null"), C("note", "ne", "5-LOW")])


@q(f"SELECT o_orderkey FROM {_NULLED} WHERE note IS NOT DISTINCT FROM NULL")
def filter_eq_null(spark, d):
    return r.query(_nulled(spark, d), [C("note", "eq", None)]).select("o_orderkey")


@q(f"SELECT o_orderkey, note FROM {_NULLED} ORDER BY note ASC NULLS FIRST, o_orderkey DESC LIMIT 700")
def sort_nulls_lowest(spark, d):
    return r.query(_nulled(spark, d), [], [("note", False), ("o_orderkey", True)], 700)


@q("""WITH ch AS (SELECT event_id AS op, user_id AS c_custkey, value AS c_acctbal FROM events),
    last AS (SELECT c_custkey, arg_max(c_acctbal, op) AS c_acctbal FROM ch GROUP BY 1)
    SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM last) UNION ALL SELECT * FROM last""")
def write_upsert(spark, d):
    changes = table(spark, d, "events").select(F.col("event_id").alias("op"), F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"))
    return r.upsert(table(spark, d, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey", "op")


@q("""SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) + 1000 AS seq FROM events WHERE event_type = 'click'""")
def write_append_seq(spark, d):
    rows = table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id")
    return r.numbered(rows, "event_id", "seq", 1000)


@q("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT user_id * 2 FROM events)")
def write_delete(spark, d):
    keys = table(spark, d, "events").select((F.col("user_id") * 2).alias("s_suppkey"))
    return r.remove(table(spark, d, "supplier").select("s_suppkey", "s_name"), keys, "s_suppkey")


@q("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal <= 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal <= 0 THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def write_conditional_patch(spark, d):
    return r.update_where(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), [C("c_mktsegment", "eq", "MACHINERY"), C("c_acctbal", "le", 0.0)], {"c_acctbal": 0.0, "c_mktsegment": "CLOSED"})


@q("""SELECT event_id, user_id, CASE WHEN event_id IN (SELECT o_orderkey * 2 FROM orders) THEN 'duplicate' WHEN user_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'user_id' END AS reject FROM events""")
def write_validated_append(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id")
    existing = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("event_id"))
    return r.valid(rows, "event_id", existing, {"user_id": (table(spark, d, "supplier"), "s_suppkey")})


@q("SELECT DISTINCT l_suppkey AS owner, 'returnflag' AS key, l_returnflag AS value FROM lineitem")
def write_inverted_index(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.lit("returnflag").alias("key"), F.col("l_returnflag").alias("value")).distinct()


@q("SELECT c_custkey, c_name, c_acctbal FROM customer")
def codec_round_trip(spark, d):
    fields = {"c_custkey": "int", "c_name": "text", "c_acctbal": "real"}
    return r.untagged(r.tagged(table(spark, d, "customer"), fields), fields)


@q("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey").intersect(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@q("SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def set_union_distinct(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id")).union(table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


@q("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_except(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@q("SELECT conv_id, turn, role, length(text)::INTEGER AS chars FROM conversations WHERE role = 'user' AND turn >= 2")
def children_in_order(spark, d):
    return r.query(table(spark, d, "conversations"), [C("role", "eq", "user"), C("turn", "ge", 2)]).select("conv_id", "turn", "role", F.length("text").alias("chars"))


@q("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS stable, count(*) FILTER (o_orderstatus = 'O') AS pending, round(avg(o_totalprice), 4) AS mean FROM orders")
def statistics(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("stable"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@q("""WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1)
    SELECT event_type, round(list_avg(v), 6) AS avg, v[1 + floor((len(v) - 1) * 0.5)::BIGINT] AS p50, v[1 + floor((len(v) - 1) * 0.95)::BIGINT] AS p95, v[1 + floor((len(v) - 1) * 0.99)::BIGINT] AS p99, v[len(v)] AS max, v[1] AS min FROM s""")
def latency_statistics(spark, d):
    w = W.partitionBy("event_type")
    placed = table(spark, d, "events").select("event_type", "value", F.row_number().over(w.orderBy("value")).alias("n"), F.count(F.lit(1)).over(w).alias("size"))
    pick = lambda p: F.max(F.when(F.col("n") == 1 + F.floor((F.col("size") - 1) * p), F.col("value")))
    return placed.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), F.max("value").alias("max"), F.min("value").alias("min"))
