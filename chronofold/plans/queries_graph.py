"""Queries of entity resolution and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import entity, graph
from chronofold.plans import views
from chronofold.plans.book import CS, ISA, OB, Book
from chronofold.sources.bindings import is_a, observations, supplier_edges, table

BOOK = Book()
q = BOOK.query


@q(OB + "SELECT anchor, bucket, count(*) AS entries, max(ts) AS last FROM ob GROUP BY 1, 2")
def entity_profiles(spark, d):
    return entity.profiles(observations(spark, d)).select("anchor", "bucket", F.size("entries").cast("bigint").alias("entries"), F.element_at("entries", -1)["ts"].alias("last"))


@q(OB + """, k AS (SELECT anchor, bucket, key, count(DISTINCT source) AS n FROM ob GROUP BY 1, 2, 3), i AS (SELECT anchor, bucket, round(sum(CASE key WHEN 'returnflag' THEN 3 ELSE 1 END * ln(1 + n)), 8) AS info FROM k GROUP BY 1, 2)
    SELECT *, CASE WHEN info >= 3 THEN 'emerged' ELSE 'pool' END AS status FROM i""")
def entity_information(spark, d):
    made = entity.information(observations(spark, d), {"returnflag": 3.0}).withColumn("info", F.round("info", 8))
    return made.withColumn("status", entity.status(F.col("info")))


_BIND = "SELECT event_id AS seq, user_id AS profile, event_id % 3 AS slot, 'e' || (event_id % 40) AS entity, value / 200 AS confidence, event_id % 7 AS source, event_id AS ts FROM events"


def _bindings(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("profile"), (F.col("event_id") % 3).alias("slot"), F.concat(F.lit("e"), (F.col("event_id") % 40).cast("string")).alias("entity"), (F.col("value") / 200).alias("confidence"), (F.col("event_id") % 7).alias("source"), F.col("event_id").alias("ts"))


@q(f"WITH b AS ({_BIND}) SELECT profile, slot, arg_max(entity, seq) AS entity, max(seq) AS seq FROM b GROUP BY 1, 2")
def entity_effective_binding(spark, d):
    return entity.effective_bindings(_bindings(spark, d), ["profile", "slot"]).select("profile", "slot", "entity", "seq")


@q(f"WITH b AS ({_BIND}), e AS (SELECT profile, arg_max(entity, seq) AS entity FROM b GROUP BY 1) SELECT entity, list(profile ORDER BY profile) AS profiles FROM e GROUP BY 1")
def entity_profiles_of(spark, d):
    return entity.effective_bindings(_bindings(spark, d), ["profile"]).groupBy("entity").agg(F.sort_array(F.collect_list("profile")).alias("profiles"))


@q(f"WITH b AS ({_BIND}) SELECT entity, round(avg(confidence) * count(DISTINCT source) / (1 + count(DISTINCT source)), 6) AS credibility, max(ts) AS updated_at FROM b GROUP BY 1")
def entity_credibility(spark, d):
    b = _bindings(spark, d)
    return entity.credibility(b, b).withColumn("credibility", F.round("credibility", 6))


@q(OB + "SELECT anchor AS entity, key, value, round(sum(confidence * CASE WHEN source < 3 THEN 0.8::DOUBLE ELSE 1 END), 5) AS weight FROM ob GROUP BY 1, 2, 3")
def entity_merged_view(spark, d):
    known = spark.range(3).select(F.col("id").alias("source"), F.lit(0.8).alias("reliability"))
    rows = entity.reliability(F.col("source"), F.broadcast(known), observations(spark, d).withColumnRenamed("anchor", "entity").withColumnRenamed("source", "src").withColumn("source", F.col("src")))
    return entity.merged(rows).withColumn("weight", F.round("weight", 5))


@q(OB + "SELECT anchor AS entity, floor(bucket::DOUBLE / 4)::BIGINT AS coarse, count(*) AS entries, min(bucket) AS first_bucket FROM ob GROUP BY 1, 2")
def entity_rollup(spark, d):
    return entity.rollup(observations(spark, d).withColumn("entity", F.col("anchor")), 4).select("entity", "coarse", "entries", "first_bucket")


@q(f"""WITH b AS ({_BIND}), m AS (SELECT DISTINCT profile, 'area' || profile % 5 || '/st' || profile % 11 AS anchor, profile % 60 AS bucket, profile % 2 AS level FROM b),
    c AS (SELECT a.profile, o.profile AS candidate, o.level, min(o.level) OVER (PARTITION BY a.profile) AS f FROM m a JOIN m o ON o.bucket BETWEEN a.bucket - 1 AND a.bucket + 1 AND a.profile <> o.profile AND split_part(a.anchor, '/', 1) = split_part(o.anchor, '/', 1))
    SELECT profile, candidate, level FROM c WHERE level = f""")
def entity_blocking(spark, d):
    p = F.col("profile")
    rows = _bindings(spark, d).select("profile").distinct().select("profile", F.concat(F.lit("area"), (p % 5).cast("string"), F.lit("/st"), (p % 11).cast("string")).alias("anchor"), (p % 60).alias("bucket"), (p % 2).alias("level"))
    return entity.candidates(rows.drop("level"), rows)


@q("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'new' WHEN value / 200 <= 0.3 THEN 'new' WHEN value / 200 >= 0.75 THEN 'merge' ELSE 'disputed' END AS decision FROM events")
def entity_decision(spark, d):
    best = F.when(F.col("event_id") % 11 != 0, F.col("value") / 200)
    return table(spark, d, "events").select("event_id", entity.decision(best).alias("decision"))


@q(OB + """, v AS (SELECT DISTINCT anchor AS entity, key, value FROM ob), h AS (SELECT entity, count(DISTINCT key) / 2.0::DOUBLE AS m FROM v WHERE (key = 'returnflag' AND value = 'R') OR (key = 'linestatus' AND value = 'O') GROUP BY 1),
    c AS (SELECT 's' || s_suppkey AS entity, (s_suppkey % 100)::DOUBLE / 100 AS credibility FROM supplier) SELECT entity, round(0.7 * m + 0.3 * credibility, 8) AS score FROM h JOIN c USING (entity) WHERE credibility >= 0.1 ORDER BY score DESC, entity LIMIT 15""")
def entity_search(spark, d):
    held = observations(spark, d).select(F.col("anchor").alias("entity"), "key", "value")
    credible = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"), ((F.col("s_suppkey") % 100) / 100).alias("credibility"))
    return entity.search(held, {"returnflag": "R", "linestatus": "O"}, credible, 15, least=0.1).withColumn("score", F.round("score", 8))


@q("WITH " + ISA + ", up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM isa UNION ALL SELECT a.child, b.parent, 2 FROM isa a JOIN isa b ON a.parent = b.child) SELECT node, ancestor, min(depth)::INTEGER AS depth FROM up GROUP BY 1, 2")
def graph_ancestors(spark, d):
    return graph.ancestors(is_a(spark, d))


@q("WITH " + ISA + ", up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM isa UNION ALL SELECT a.child, b.parent, 2 FROM isa a JOIN isa b ON a.parent = b.child) SELECT node, ancestor, min(depth)::INTEGER AS depth FROM up GROUP BY 1, 2")
def graph_ancestors_recursive_sql(spark, d):
    return graph.ancestors_sql(spark, is_a(spark, d))


@q("WITH " + ISA + "SELECT child AS node, 1 AS depth FROM isa WHERE parent = 'r1' UNION SELECT b.child, 2 FROM isa a JOIN isa b ON b.parent = a.child WHERE a.parent = 'r1'")
def graph_descendants(spark, d):
    return graph.descendants(is_a(spark, d), "r1")


@q("WITH " + ISA + "SELECT child AS node, parent AS ancestor, [child, parent] AS path FROM isa UNION ALL SELECT a.child, b.parent, [a.child, a.parent, b.parent] FROM isa a JOIN isa b ON b.child = a.parent")
def graph_is_a_path(spark, d):
    return graph.paths(is_a(spark, d))


@q(CS + "SELECT src AS node, dst AS neighbour, type, weight FROM cs UNION SELECT dst, src, type, weight FROM cs")
def graph_neighbours(spark, d):
    return graph.neighbours(supplier_edges(spark, d))


@q(CS + """, big AS (SELECT * FROM cs), l AS (SELECT src, dst FROM big UNION SELECT dst, src FROM big), r0 AS (SELECT 's1' AS node, 0 AS depth), r1 AS (SELECT DISTINCT l.dst AS node FROM l JOIN r0 ON l.src = r0.node WHERE l.dst <> 's1'),
    r2 AS (SELECT DISTINCT l.dst AS node FROM l JOIN r1 ON l.src = r1.node WHERE l.dst <> 's1' AND l.dst NOT IN (SELECT node FROM r1)),
    al AS (SELECT node FROM r0 UNION SELECT node FROM r1 UNION SELECT node FROM r2) SELECT DISTINCT src, dst, type FROM big WHERE src IN (SELECT node FROM al) AND dst IN (SELECT node FROM al)""")
def graph_traversal(spark, d):
    return views.traversal(supplier_edges(spark, d), "s1", 2)


@q()
def graph_traversal_view(spark, d):
    """The reference's traversal view: three steps, which it fixes."""
    return views.traversal(supplier_edges(spark, d), "s1")


@q(CS + ", e AS (SELECT src, dst, type, weight FROM cs UNION ALL SELECT src, dst, type, weight * 2 FROM cs WHERE weight > 1) SELECT src, dst, type, max(weight) AS weight FROM e GROUP BY 1, 2, 3")
def graph_merge_edges(spark, d):
    e = supplier_edges(spark, d)
    return graph.merge_edges(e.unionByName(e.where("weight > 1").withColumn("weight", F.col("weight") * 2)))


@q(CS + ", e AS (SELECT src, dst, type, weight FROM cs UNION ALL SELECT src, dst, type, weight * 2 FROM cs WHERE weight > 1) SELECT src, dst, type, sum(weight) AS weight FROM e GROUP BY 1, 2, 3")
def graph_accumulate_edges(spark, d):
    e = supplier_edges(spark, d)
    return graph.accumulate_edges(e.unionByName(e.where("weight > 1").withColumn("weight", F.col("weight") * 2)))


@q("WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS weight, count(*) >= 3 AS settled FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2")
def graph_co_occurrence(spark, d):
    return graph.co_occurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@q(CS + """, l0 AS (SELECT src, dst, weight FROM cs UNION ALL SELECT dst, src, weight FROM cs), dg AS (SELECT src, count(*) AS n FROM l0 GROUP BY 1), l AS (SELECT l0.src, l0.dst, 0.9::DOUBLE * weight / (1 + weight) / n AS s FROM l0 JOIN dg USING (src)),
    h1 AS (SELECT dst AS node, sum(s * 0.5::DOUBLE) AS e FROM l WHERE src = 's1' AND s * 0.5::DOUBLE >= 0.0001 GROUP BY 1),
    h2 AS (SELECT dst AS node, sum(h1.e * s * 2 / 3) AS e FROM l JOIN h1 ON l.src = h1.node WHERE h1.node <> 's1' AND h1.e * s * 2 / 3 >= 0.0001 GROUP BY 1),
    al AS (SELECT 's1' AS node, 1::DOUBLE AS e UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) SELECT node, round(sum(e), 7) AS energy FROM al GROUP BY 1""")
def graph_diffusion(spark, d):
    seeds = spark.range(1).select(F.lit("s1").alias("node"), F.lit(1.0).alias("energy"))
    return graph.diffuse(supplier_edges(spark, d), seeds, {"CO_OCCURS": 0.9}, 2, 0.0001).withColumn("energy", F.round("energy", 7))


_RULES = "(VALUES ('r0', 'TRIGGERS', 'audit', 0.8::DOUBLE), ('r1', 'CAUSES', 'delay', 0.7), ('audit', 'REQUIRES', 'report', 0.5), ('delay', 'PREVENTS', 'report', 0.9), ('report', 'TRIGGERS', 'archive', 0.4)) r(antecedent, relation, consequent, strength)"


@q("WITH " + ISA + f""", top AS (SELECT a.child AS node, b.parent AS ancestor FROM isa a JOIN isa b ON a.parent = b.child WHERE a.child LIKE 'c%'), ru AS (SELECT * FROM {_RULES}),
    s1 AS (SELECT node AS subject, consequent AS concept, relation, strength AS confidence FROM top JOIN ru ON antecedent = ancestor),
    s2 AS (SELECT subject, consequent AS concept, ru.relation, confidence * strength AS confidence FROM s1 JOIN ru ON antecedent = concept),
    s3 AS (SELECT subject, consequent AS concept, ru.relation, confidence * strength AS confidence FROM s2 JOIN ru ON antecedent = concept)
    SELECT subject, concept, relation, round(confidence, 8) AS confidence, 1 AS depth FROM s1 UNION ALL SELECT subject, concept, relation, round(confidence, 8), 2 FROM s2 UNION ALL SELECT subject, concept, relation, round(confidence, 8), 3 FROM s3""")
def graph_inference(spark, d):
    rules = spark.sql("SELECT * FROM VALUES ('r0', 'TRIGGERS', 'audit', 0.8D), ('r1', 'CAUSES', 'delay', 0.7D), ('audit', 'REQUIRES', 'report', 0.5D), ('delay', 'PREVENTS', 'report', 0.9D), ('report', 'TRIGGERS', 'archive', 0.4D) AS r(antecedent, relation, consequent, confidence)")
    edges = is_a(spark, d)
    facts = edges.where("child like 'c%'").select(F.col("child").alias("subject"), F.col("child").alias("concept"), F.lit(1.0).alias("confidence"))
    made = graph.infer(facts, graph.ancestors(edges), F.broadcast(rules))
    return made.select("subject", "concept", "relation", F.round("confidence", 8).alias("confidence"), "depth")
