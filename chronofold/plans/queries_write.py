"""Queries of the write path, stateful operators, lexicon, frames and embeddings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import embedding, frames
from chronofold.operators import lexicon, settle
from chronofold.plans.book import EV, Book
from chronofold.sources.bindings import plain_log, table
from chronofold.streaming import stateful

BOOK = Book()
q = BOOK.query

ATTRIBUTES = """SELECT * FROM VALUES
    ('click', 'active', array('click'), array(), 'number'), ('purchase', 'active', array('purchase'), array(), 'number'), ('view', 'active', array('view'), array(), 'number'),
    ('signup', 'active', array('*'), array(), 'number'), ('error', 'deprecated', array('*'), array(), 'number'),
    ('k', 'active', array('*'), array('0..79'), 'integer') AS a(key, status, writers, range, datatype)"""
TYPES = """SELECT * FROM VALUES ('click', 'active', 0, false, array()), ('purchase', 'active', 1, false, array()), ('view', 'active', 0, false, array('zone')),
    ('error', 'active', 0, false, array()), ('signup', 'retired', 0, false, array()) AS t(type, status, min_trust, multi_target, required)"""


def _definitions(spark):
    text = lambda c: F.col(c).cast("array<string>").alias(c)
    a = spark.sql(ATTRIBUTES).select("key", "status", "writers", text("range"), "datatype")
    # the range of k is 0 to 79
    whole = F.transform(F.sequence(F.lit(0), F.lit(79)), lambda x: x.cast("string"))
    a = a.withColumn("range", F.when(F.col("key") == "k", whole).otherwise(F.col("range")))
    return a, spark.sql(TYPES).select("type", "status", "min_trust", "multi_target", text("required"))


@q(EV + """, r AS (SELECT seq AS id, type, CASE WHEN type = 'error' THEN ['unregistered error'] ELSE list_sort(list_filter([
        CASE WHEN type = 'signup' THEN 'unknown type' END, CASE WHEN type = 'purchase' AND user_id % 3 < 1 THEN 'trust' END,
        CASE WHEN type <> 'signup' AND k >= 80 THEN 'out of range k' END, CASE WHEN type = 'view' THEN 'missing zone' END], lambda x: x IS NOT NULL)) END AS reasons FROM ev)
    SELECT id, CASE WHEN type = 'error' THEN 0 WHEN len(reasons) > 0 THEN 2 END AS layer, reasons FROM r""")
def settle_layers(spark, d):
    log = plain_log(spark, d)
    writes = F.explode(F.create_map(F.col("type"), F.col("value").cast("string"), F.lit("k"), F.col("k").cast("string"))).alias("key", "value")
    candidates = log.select(F.col("seq").alias("id"), "type", (F.col("user_id") % 3).alias("trust"), "entity", writes)
    return settle.validate(candidates, *_definitions(spark))


@q(EV + "SELECT seq, round(value / pow(2::DOUBLE, r), 8) AS value, r::INTEGER AS round FROM ev, range(0, 5) t(r) WHERE type = 'error' AND (r = 0 OR value / pow(2::DOUBLE, r - 1) > 50)")
def settle_trigger_cascade(spark, d):
    halve = lambda df: df.where("value > 50").withColumn("value", F.col("value") / 2)
    made = settle.cascade(plain_log(spark, d).where("type = 'error'").select("seq", "value"), [halve])
    return made.select("seq", F.round("value", 8).alias("value"), "round")


@q("WITH v AS (SELECT event_type AS key, event_id AS version, value AS body FROM events) SELECT key, arg_max(body, version) AS body, max(version) AS version FROM v GROUP BY 1")
def definitions_current(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("version"), F.col("value").alias("body"))
    return settle.current_definitions(log).select("key", "body", "version")


@q()
def stateful_arbitration(spark, d):
    # the third event of a user places the block, so the first two find none
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) == 3
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("t"), F.col("event_id").alias("seq"), F.when(F.col("value") < 30, "").when(F.col("value") < 60, "empty").otherwise("full").alias("payload"), (F.col("event_id") % 4).alias("source"), place.alias("put"))
    return stateful.run_batch(rows, "id", ["t", "seq"], stateful.arbitration_step(2.0, 500, {0: 1.0, 1: 0.8, 2: 0.4}), stateful.ARBITRATED)


@q()
def stateful_tracks(spark, d):
    from chronofold.sources.bindings import points

    rows = points(spark, d)
    return stateful.run_batch(rows, "id", ["t", "seq"], stateful.track_step(3_600_000, 40_000_000, 0.001), stateful.TRACKED).withColumn("speed", F.round("speed", 9))


@q("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'household' THEN 'home' WHEN 'machinery' THEN 'machine' ELSE lower(c_mktsegment) END AS standard FROM customer")
def lexicon_normalise(spark, d):
    alias = spark.sql("SELECT * FROM VALUES ('household', 'home'), ('machinery', 'machine') AS a(alias, word)")
    return lexicon.normalise(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", alias).select("c_custkey", "standard")


@q("""WITH m AS (SELECT 'u' || user_id AS word, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), l AS (SELECT DISTINCT 'u' || user_id AS word FROM events WHERE event_type = 'error' AND value > 50)
    SELECT m.word, n, n >= 3 AND l.word IS NOT NULL AS awake FROM m LEFT JOIN l ON m.word = l.word""")
def lexicon_awake(spark, d):
    ev = table(spark, d, "events")
    word = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    mentions = ev.where("event_type = 'click'").select(word.alias("word"))
    edges = ev.where("event_type = 'error' and value > 50").select(word.alias("src"), word.alias("dst"))
    return lexicon.awake(mentions, edges)


@q("WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', 2) AS other FROM part) SELECT word AS src, 'SIMILAR' AS type, other AS dst, 0.5::DOUBLE AS weight FROM w WHERE word IN ('red', 'small') AND other IN ('ring', 'widget')")
def lexicon_edges(spark, d):
    words = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("other")).distinct()
    concept = spark.sql("SELECT * FROM VALUES ('red'), ('small'), ('ring'), ('widget') AS c(name)")
    return lexicon.lexicon_edges(words.withColumn("score", F.lit(0.5)), words.limit(0), concept).select("src", "type", "dst", "weight")


@q("SELECT 'u' || user_id AS entity, min(event_id) AS seq FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def entity_new(spark, d):
    seen = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), F.col("event_id").alias("seq"))
    known = table(spark, d, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("entity"))
    return lexicon.new_entities(seen, known)


@q("""WITH p AS (SELECT event_id AS id, value AS x, (props->>'k')::DOUBLE AS y FROM events), c AS (SELECT n_nationkey::BIGINT AS id, n_nationkey * 5::DOUBLE AS x, n_regionkey * 20::DOUBLE AS y FROM nation)
    SELECT c.id AS centre, p.id, round(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), 7) AS distance FROM c JOIN p ON (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 64""")
def frames_radius_search(spark, d):
    p = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.lit(0.0).alias("z"))
    c = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_nationkey") * 5.0).alias("x"), (F.col("n_regionkey") * 20.0).alias("y"), F.lit(0.0).alias("z"), F.lit(8.0).alias("radius"))
    return frames.within(p, c, "radius", 8.0).withColumn("distance", F.round("distance", 7))


@q("""WITH g AS (SELECT event_id, floor((value % 100 + 100) / 200 * 16)::BIGINT AS x, floor(((props->>'k')::DOUBLE + 100) / 200 * 16)::BIGINT AS y FROM events)
    SELECT event_id, list_transform(range(0, 4), lambda i: (((x >> (3 - i)) & 1) + ((y >> (3 - i)) & 1) * 2)::INTEGER) AS path FROM g""")
def frames_anchor_path(spark, d):
    point = F.array(F.col("value") % 100, F.get_json_object("props", "$.k").cast("double"))
    return table(spark, d, "events").select("event_id", frames.anchor_path(point, 100.0, 100.0 / 16, 2).alias("path"))


@q("WITH p AS (SELECT event_id, value AS x, (props->>'k')::DOUBLE AS y FROM events) SELECT event_id, round(10 - y, 6) + 0.0 AS x, round(5 + x, 6) + 0.0 AS y FROM p")
def frames_to_root(spark, d):
    p = table(spark, d, "events").select("event_id", F.lit("cell").alias("frame"), F.array(F.col("value"), F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)).alias("point"))
    half = 0.5**0.5
    known = spark.range(1).select(F.lit("cell").alias("frame"), F.lit("plant").alias("parent"), F.array(F.lit(10.0), F.lit(5.0), F.lit(0.0)).alias("origin"), F.array(F.lit(half), F.lit(0.0), F.lit(0.0), F.lit(half)).alias("turn"))
    moved = frames.to_root(p, F.broadcast(known), 2)
    return moved.select("event_id", *[(F.round(F.get("point", F.lit(i)), 6) + 0.0).alias(n) for i, n in enumerate("xy")])


@q()
def embedding_hash(spark, d):
    rows = embedding.embed(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_name"))
    return rows.select("p_partkey", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))
