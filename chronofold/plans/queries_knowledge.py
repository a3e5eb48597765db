"""Queries of concepts, ingestion, sources, keywords and remaining lookups and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import scalars
from chronofold.operators import entity, events, graph, knowledge, lexicon, scenes, signals
from chronofold.plans.book import CS, EV, ISA, OB, Book
from chronofold.sources import records
from chronofold.sources.bindings import is_a, observations, plain_log, points, supplier_edges, table

BOOK = Book()
q = BOOK.query


def _text(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@q("""SELECT p_partkey AS slot, CASE WHEN split_part(p_name, ' ', 2) IN ('widget', 'ring') THEN 'c:' || split_part(p_name, ' ', 2) WHEN p_type IN ('ECONOMY', 'PROMO') THEN 't:' || p_type END AS concept FROM part""")
def concept_fallback(spark, d):
    slots = table(spark, d, "part").select(F.col("p_partkey").alias("slot"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"), F.col("p_type").alias("entity_type"))
    concepts = spark.sql("SELECT * FROM VALUES ('c:widget', 'widget'), ('c:ring', 'ring') AS c(id, name)")
    by_type = spark.sql("SELECT * FROM VALUES ('ECONOMY', 't:ECONOMY'), ('PROMO', 't:PROMO') AS t(entity_type, concept)")
    return knowledge.typed_slots(slots, concepts, by_type).select("slot", "concept")


@q("""WITH m AS (SELECT 1 AS round, p_partkey AS seq, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'e' || p_partkey ELSE '' END AS ref FROM part UNION ALL SELECT 0, 0, 'red ring', ''),
    f AS (SELECT name, arg_min(ref, round * 1000000000 + seq) FILTER (ref <> '') AS ref FROM m GROUP BY 1) SELECT 'i:' || name AS id, name, coalesce(ref, '') AS entity_ref FROM f""")
def instances_named(spark, d):
    made = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, _text("e", "p_partkey")).otherwise("").alias("entity_ref"))
    known = spark.range(1).select(F.lit(0).cast("bigint").alias("seq"), F.lit("red ring").alias("name"), F.lit("").alias("entity_ref"))
    return knowledge.add_named(known, made, "i")


@q("""WITH r AS (SELECT s_suppkey AS source, (s_suppkey % 10)::DOUBLE / 10 AS stored FROM supplier WHERE s_suppkey % 3 > 0), k AS (SELECT n_nationkey::BIGINT AS source, 0.5::DOUBLE AS known FROM nation)
    SELECT source, coalesce(stored, known) AS reliability FROM r FULL JOIN k USING (source)""")
def source_synchronised(spark, d):
    stored = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, _text("cam", "s_suppkey")).otherwise(F.col("s_suppkey").cast("string")).alias("source_id"), (F.col("s_suppkey") % 10 / 10).alias("reliability"))
    registered = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("source"), F.lit(0.5).alias("reliability"))
    return knowledge.synchronised_sources(stored, registered)


@q("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS trust FROM customer")
def trust_of_token(spark, d):
    tokens = spark.sql("SELECT * FROM VALUES ('BUILDING', 2), ('MACHINERY', 1), ('NONE', 9) AS t(token, level)")
    return knowledge.trust(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("token")), tokens).select("c_custkey", "trust")


def _nodes(spark, d):
    return table(spark, d, "part").select(_text("k", "p_partkey").alias("uid"), F.when(F.col("p_partkey") % 4 == 0, "Event").otherwise("Keyword").alias("kind"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), (F.col("p_size") % 2).alias("status"))


@q("SELECT 'k' || p_partkey AS uid FROM part WHERE p_partkey % 4 = 0 AND p_name IN (SELECT p_name FROM part WHERE p_partkey < 20)")
def nodes_named(spark, d):
    names = table(spark, d, "part").where("p_partkey < 20").select(F.col("p_name").alias("name"))
    return knowledge.nodes_named(_nodes(spark, d), "Event", names).select("uid")


@q("SELECT 'k' || p_partkey AS uid FROM part WHERE p_partkey % 4 <> 0 AND p_type = 'ECONOMY' AND p_size % 2 = 0")
def keywords_listed(spark, d):
    return knowledge.keywords(_nodes(spark, d), "ECONOMY", 0).select("uid")


@q("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'Event' ELSE 'Keyword' END AS kind, count(*) AS n FROM part GROUP BY 1")
def nodes_counted(spark, d):
    return _nodes(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT event_id, ['的', '失眠', '天', '了', 'x'][(event_id % 5 + 1)::INTEGER] AS word FROM events WHERE event_id % 5 NOT IN (0, 3)")
def words_informative(spark, d):
    word = F.get(F.array(*[F.lit(x) for x in ("的", "失眠", "天", "了", "x")]), (F.col("event_id") % 5).cast("int"))
    return knowledge.informative(table(spark, d, "events").select("event_id", word.alias("word")))


def _profiles(spark, d):
    o = table(spark, d, "orders")
    modifier = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("object").alias("target"), F.lit("manner").alias("kind"), F.lit("soon").alias("text")))).otherwise(F.array().cast("array<struct<target:string,kind:string,text:string>>"))
    return o.select(
        _text("p", "o_orderkey").alias("profile_id"), F.col("o_orderkey").alias("seq"), _text("v", "o_orderkey").alias("event_id"), _text("c", "o_custkey").alias("subject"), F.lit("buys").alias("verb"), F.col("o_orderpriority").alias("object"), F.col("o_orderstatus").alias("place"), F.lit("t").alias("time"), modifier.alias("modifiers"),
        _text("e", "o_custkey").alias("subject_entity"), F.lit("Customer").alias("subject_type"), F.when(F.col("o_orderkey") % 3 == 0, 0.5).alias("subject_confidence"),
        F.lit("").alias("object_entity"), F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("double").alias("object_confidence"), F.lit("").alias("place_entity"), F.lit(None).cast("string").alias("place_type"), F.lit(None).cast("double").alias("place_confidence"),
    )


@q("""SELECT 'p' || o_orderkey AS profile_id, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 4 END AS nodes, CASE WHEN o_orderkey % 2 = 0 THEN ['object', 'place', 'time', 'mod0'] ELSE ['object', 'place', 'time'] END AS "to", ['buys', o_orderstatus, 't'] AS labels FROM orders""")
def profile_graph(spark, d):
    g = knowledge.profile_graph(_profiles(spark, d))
    return g.select("profile_id", F.size("nodes").alias("nodes"), F.transform("edges", lambda e: e["to"]).alias("to"), F.slice(F.transform("edges", lambda e: e["label"]), 1, 3).alias("labels"))


def _ingested(spark, d):
    p = _profiles(spark, d)
    concepts = spark.sql("SELECT * FROM VALUES ('k:urgent', '1-URGENT'), ('k:open', 'O') AS c(id, name)")
    by_type = spark.sql("SELECT 'Customer' AS entity_type, 'k:customer' AS concept")
    return knowledge.ingest(p.unionByName(p.where("seq % 5 = 0")), concepts, by_type, p.where("seq % 10 = 1"))


_ING = """WITH p AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 1), e AS (SELECT 'i:c' || o_custkey AS src, 'k:customer' AS dst, 'INSTANCE_OF' AS type, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS weight FROM p
    UNION ALL SELECT 'i:1-URGENT', 'k:urgent', 'INSTANCE_OF', 1 FROM p WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'i:O', 'k:open', 'INSTANCE_OF', 1 FROM p WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'i:' || x.name, 'i:c' || o_custkey || 'buys' || o_orderpriority, x.rel, 1 FROM p, LATERAL (SELECT unnest(['c' || o_custkey, o_orderpriority, o_orderstatus]) AS name, unnest(['SUBJECT_OF', 'OBJECT_OF', 'LOCATED_IN']) AS rel) x)
"""


@q(_ING + "SELECT src, dst, type, max(weight) AS weight FROM e GROUP BY 1, 2, 3")
def ingest_edges(spark, d):
    return _ingested(spark, d)["edges"]


@q("""WITH p AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 1), n AS (SELECT 'c' || o_custkey || 'buys' || o_orderpriority AS name, 'v' || o_orderkey AS ref, o_orderkey AS seq FROM p UNION ALL SELECT 'c' || o_custkey, 'e' || o_custkey, o_orderkey FROM p UNION ALL SELECT o_orderpriority, '', o_orderkey FROM p UNION ALL SELECT o_orderstatus, '', o_orderkey FROM p)
    SELECT 'i:' || name AS id, name, coalesce(arg_min(ref, seq) FILTER (ref <> ''), '') AS entity_ref FROM n GROUP BY 2""")
def ingest_instances(spark, d):
    return _ingested(spark, d)["instances"]


@q("""WITH i AS (SELECT 'c' || c_custkey AS subject, 'g' || c_nationkey % 7 AS concept, CASE WHEN c_nationkey % 3 = 0 THEN 'TRIGGERS' WHEN c_nationkey % 3 = 1 THEN 'PREVENTS' ELSE 'CAUSES' END AS relation, 1 + c_nationkey % 2 AS depth, 0.5::DOUBLE AS confidence FROM customer)
    SELECT subject, concept, 1 AS place FROM i WHERE relation <> 'PREVENTS' AND concept IN ('g0', 'g2', 'g3', 'g5')""")
def followups(spark, d):
    n = F.col("c_nationkey")
    made = table(spark, d, "customer").select(_text("c", "c_custkey").alias("subject"), F.concat(F.lit("g"), (n % 7).cast("string")).alias("concept"), F.when(n % 3 == 0, "TRIGGERS").when(n % 3 == 1, "PREVENTS").otherwise("CAUSES").alias("relation"), (1 + n % 2).alias("depth"), F.lit(0.5).alias("confidence"))
    return knowledge.followups(made, spark.sql("SELECT * FROM VALUES ('g0'), ('g2'), ('g3'), ('g5') AS t(concept)"))


@q("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT w.id AS node, v.id, round(list_cosine_similarity(w.v, v.v), 9) AS score FROM v w JOIN v ON w.id < 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, id)::INTEGER AS rank FROM s WHERE score > 0) SELECT node, id, round(score, 6) AS score, rank FROM r WHERE rank <= 4""")
def vector_components(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return knowledge.decompose(v, v.where("id < 5"), 3).withColumn("score", F.round("score", 6)).select("node", "id", "score", "rank")


@q(CS + "SELECT dst AS node, src AS path, weight AS energy, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src)::INTEGER AS rank FROM cs QUALIFY rank <= 3")
def graph_top_paths(spark, d):
    return scenes.ranked_paths(supplier_edges(spark, d).select(F.col("dst").alias("node"), F.col("src").alias("path"), F.col("weight").alias("energy")))


@q(CS + """, b AS (SELECT src, dst, weight FROM cs UNION ALL SELECT dst, src, weight FROM cs), deg AS (SELECT src, count(*) AS n FROM b GROUP BY 1), l AS (SELECT b.src, b.dst, 0.8::DOUBLE * weight / (1 + weight) / n AS share FROM b JOIN deg USING (src) WHERE b.dst NOT IN ('s1', 's2')),
    l1 AS (SELECT dst AS node, sum(100 * share / 2) AS e FROM l WHERE src = 'c1' AND 100 * share / 2 >= 0.01 GROUP BY 1),
    l2 AS (SELECT dst AS node, sum(e * share * 2 / 3) AS e FROM l1 JOIN l ON l.src = l1.node WHERE e * share * 2 / 3 >= 0.01 GROUP BY 1)
    SELECT node, round(sum(e), 8) AS energy FROM (SELECT 'c1' AS node, 100::DOUBLE AS e UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1""")
def graph_diffusion_blocked(spark, d):
    seeds = spark.sql("SELECT 'c1' AS node, 100.0D AS energy")
    blocked = spark.sql("SELECT * FROM VALUES ('s1'), ('s2') AS b(node)")
    return graph.diffuse(supplier_edges(spark, d), seeds, {"CO_OCCURS": 0.8}, 2, blocked=blocked).select("node", F.round("energy", 8).alias("energy"))


@q("WITH " + ISA + "SELECT child AS node, parent AS ancestor FROM isa UNION SELECT a.child, b.parent FROM isa a JOIN isa b ON a.parent = b.child UNION SELECT a.child, c.parent FROM isa a JOIN isa b ON a.parent = b.child JOIN isa c ON b.parent = c.child")
def graph_closure_whole(spark, d):
    return graph.ancestors(is_a(spark, d)).select("node", "ancestor")


@q("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1000000 - 86400 WHEN 1 THEN 1000000 - 7 * 86400 WHEN 2 THEN 0 WHEN 3 THEN 1000000 - 90 * 86400 WHEN 4 THEN 1000000 - 2 * 86400 ELSE 1000000 - 30 * 86400 END::BIGINT AS t FROM events""")
def fn_relative_phrases(spark, d):
    said = F.get(F.array(*[F.lit(x) for x in ("what of YESTERDAY?", "上周 and today", "never", "a few months ago", "前天和昨天", "Last Month")]), (F.col("event_id") % 6).cast("int"))
    # of "上周 and today" the phrase that comes first in the list is "today"
    words = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 6 == 1, "上周").otherwise(said).alias("said"))
    return words.select("event_id", scalars.relative_time(F.col("said"), F.lit(1_000_000)).cast("bigint").alias("t"))


@q("SELECT event_id, 'u' || user_id AS entity, 'x y' AS t, '' AS flag FROM events")
def fn_url_parameters(spark, d):
    query = F.concat(F.lit("entity=old&t=x%20y&&flag&entity=u"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", scalars.url_parameters(query).alias("m")).select("event_id", F.col("m")["entity"].alias("entity"), F.col("m")["t"].alias("t"), F.col("m")["flag"].alias("flag"))


@q("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE [(event_id % 100)::BIGINT, user_id] END AS codes FROM events")
def fn_parse_path(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "1//x").otherwise(F.concat((F.col("event_id") % 100).cast("string"), F.lit("/"), F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", F.transform(scalars.parse_path(text), lambda c: c.cast("bigint")).alias("codes"))


@q("SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END || ' ' || p_type AS text FROM part")
def fn_node_text(spark, d):
    return table(spark, d, "part").select("p_partkey", lexicon.node_text(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_type")).alias("text"))


@q("SELECT event_id FROM events WHERE event_id = -5")
def scan_out_of_range(spark, d):
    return records.get(table(spark, d, "events"), "event_id", -5).select("event_id")


@q(OB + "SELECT anchor, ts, value FROM ob WHERE key = 'returnflag' AND source = 2 AND anchor = 's1'")
def filter_observations(spark, d):
    asked = [records.Condition("key", "eq", "returnflag"), records.Condition("source", "eq", 2), records.Condition("anchor", "eq", "s1")]
    return records.query(observations(spark, d), asked).select("anchor", "ts", "value")


@q(OB + "SELECT DISTINCT anchor, bucket FROM ob WHERE bucket BETWEEN 20 AND 22 AND anchor = 's3'")
def filter_profiles(spark, d):
    asked = [records.Condition("bucket", "ge", 20), records.Condition("bucket", "le", 22), records.Condition("anchor", "eq", "s3")]
    return records.query(entity.profiles(observations(spark, d)), asked).select("anchor", "bucket").distinct()


@q(EV + "SELECT seq FROM ev WHERE seq % 3 = 0 AND starts_with(anchor, 'plant/line1')")
def slice_space(spark, d):
    log = plain_log(spark, d).withColumn("kind", F.when(F.col("seq") % 3 == 0, "anchor").otherwise("raw_text"))
    return log.where(events.in_slice("plant/line1", F.col("kind"), F.col("anchor"))).select("seq")


@q("""WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT a AS src, 'OPPOSITE' AS type, b AS dst, 1::DOUBLE AS weight FROM w WHERE a IN ('red', 'small', 'cold') AND b IN ('ring', 'widget')""")
def lexicon_opposites(spark, d):
    pairs = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("other")).distinct()
    concept = spark.sql("SELECT * FROM VALUES ('red'), ('small'), ('cold'), ('ring'), ('widget') AS c(name)")
    none = spark.createDataFrame([], "word string, other string, score double")
    return lexicon.lexicon_edges(none, pairs, concept).select("src", "type", "dst", "weight")


@q("SELECT event_id % 4 AS id, event_id AS tick, CASE WHEN event_id % 4 = 0 THEN CASE WHEN value > 50 THEN 'high' ELSE 'low' END ELSE CASE WHEN value > 50 THEN 'up' END END AS type FROM events WHERE event_id % 4 < 2 AND (event_id % 4 = 0 OR value > 50)")
def signal_events(spark, d):
    found = table(spark, d, "events").select((F.col("event_id") % 4).alias("id"), F.col("event_id").alias("tick"), (F.col("value") > 50).alias("high"))
    mapping = spark.sql("SELECT * FROM VALUES (0L, 'high', 'low'), (1L, 'up', null) AS m(id, on_type, off_type)")
    return signals.edge_events(found, mapping)


@q("WITH p AS (SELECT user_id AS id, max(event_id) AS m FROM events GROUP BY 1) SELECT user_id AS id, event_id + 1 AS seq, event_id = m AS last FROM events JOIN p ON user_id = id")
def track_whole(spark, d):
    p = points(spark, d)
    last = signals.latest(p).select("id", F.col("seq").alias("_last"))
    return p.join(last, "id").select("id", "seq", (F.col("seq") == F.col("_last")).alias("last"))
