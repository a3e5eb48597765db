"""Queries of lookups, timelines, payloads and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import events as ev
from chronofold.operators import graph, joins
from chronofold.plans.book import EV, ISA, Book
from chronofold.sources import snapshots
from chronofold.sources.bindings import is_a, plain_log, table

BOOK = Book()
q = BOOK.query


@q("""WITH p AS (SELECT 'e' || g AS entity, 'p' || (g % 3) || '-' || h AS phase, CASE WHEN h = 1 THEN g * 100 END AS es, CASE WHEN h = 1 THEN g * 100 + 3000 END AS ee, 2000 * h AS s, CASE WHEN h = 0 THEN NULL ELSE 2000 * h + 2500 END AS e FROM range(0, 20) a(g), range(0, 3) b(h))
    SELECT event_id AS id, 'e' || (user_id % 25) AS entity, event_id AS ts, (SELECT min(phase) FROM p WHERE p.entity = 'e' || (user_id % 25) AND event_id BETWEEN coalesce(es, s, 0) AND coalesce(ee, e, 4611686018427387904)) AS phase FROM events""")
def lookup_phase(spark, d):
    g = spark.range(20).select(F.col("id").alias("g")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(2))))
    text = lambda c: F.col(c).cast("string")
    phases = g.select(F.concat(F.lit("e"), text("g")).alias("entity"), F.concat(F.lit("p"), (F.col("g") % 3).cast("string"), F.lit("-"), text("h")).alias("phase"), F.when(F.col("h") == 1, F.col("g") * 100).alias("edge_start"), F.when(F.col("h") == 1, F.col("g") * 100 + 3000).alias("edge_end"), (F.col("h") * 2000).cast("bigint").alias("start"), F.when(F.col("h") != 0, F.col("h") * 2000 + 2500).cast("bigint").alias("end"))
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("e"), (F.col("user_id") % 25).cast("string")).alias("entity"), F.col("event_id").alias("ts"))
    return joins.match_phase(events, F.broadcast(phases)).select("id", "entity", "ts", "phase")


@q(EV + ", r(root, owner) AS (VALUES ('plant', 'site'), ('plant/line1', 'one'), ('plant/line1/st3', 'cell'), ('plant/line2', 'two'), ('pla', 'no')) SELECT seq AS id, anchor AS path, (SELECT arg_max(owner, length(root)) FROM r WHERE anchor = root OR starts_with(anchor, root || '/')) AS owner FROM ev")
def lookup_longest_prefix(spark, d):
    roots = spark.sql("SELECT * FROM VALUES ('plant', 'site'), ('plant/line1', 'one'), ('plant/line1/st3', 'cell'), ('plant/line2', 'two'), ('pla', 'no') AS r(root, owner)")
    return joins.longest_prefix(plain_log(spark, d).select(F.col("seq").alias("id"), F.col("anchor").alias("path")), roots)


@q("WITH s AS (SELECT DISTINCT o_custkey * 7 + 5 AS seq FROM orders) SELECT event_id AS id, event_id AS seq, (SELECT max(s.seq) FROM s WHERE s.seq <= event_id) AS snapshot FROM events")
def lookup_floor(spark, d):
    e = table(spark, d, "events")
    return joins.floor_lookup(e.select(F.col("event_id").alias("id"), F.col("event_id").alias("seq")), table(spark, d, "orders").select((F.col("o_custkey") * 7 + 5).alias("seq")).distinct())


@q("""WITH l AS (SELECT user_id AS src, event_id % 150 AS dst, CASE event_type WHEN 'click' THEN 'causes' WHEN 'view' THEN 'before' ELSE 'other' END AS type, value FROM events), k AS (SELECT s_suppkey AS node FROM supplier)
    SELECT src, dst, type, round(sum(value), 4) AS weight FROM l WHERE type IN ('causes', 'before') AND src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) GROUP BY 1, 2, 3""")
def lookup_synchronised_links(spark, d):
    e = table(spark, d, "events")
    links = e.select(F.col("user_id").alias("src"), (F.col("event_id") % 150).alias("dst"), F.when(F.col("event_type") == "click", "causes").when(F.col("event_type") == "view", "before").otherwise("other").alias("type"), F.col("value").alias("weight"))
    return joins.synchronised_links(links, table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))).withColumn("weight", F.round("weight", 4))


@q("WITH " + ISA + "SELECT a.child AS node, a.parent AS class FROM isa a JOIN isa b ON b.child = a.parent UNION ALL SELECT child, child FROM isa WHERE parent LIKE 'r%'")
def graph_top_class(spark, d):
    return joins.top_class(graph.ancestors(is_a(spark, d)))


@q("SELECT user_id AS narrative, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events")
def narrative_timeline(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("narrative"), F.col("event_id").alias("id"), (-F.col("event_id")).alias("seq"))
    from pyspark.sql import Window as W

    # stored in reverse; links put the story in order
    links = e.withColumn("dst", F.lead("id").over(W.partitionBy("narrative").orderBy("id"))).where("dst is not null").select("narrative", F.col("id").alias("src"), "dst")
    return joins.timeline(e, links)


@q("""SELECT event_id, event_type AS type, CASE WHEN event_id % 3 = 0 THEN ['u' || user_id, 'x'] ELSE ['u' || user_id] END AS targets, (props->>'k') AS k, CASE WHEN event_id % 2 = 0 THEN 'raw_text' ELSE 'anchor' END AS space_kind FROM events""")
def payload_normalise(spark, d):
    e = table(spark, d, "events")
    user = F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"'))
    ids = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), user, F.lit(',"x"]'))).otherwise(user)
    space = F.when(F.col("event_id") % 2 == 0, "near the gate").otherwise("plant/line1")
    payload = F.concat(F.lit('{"type":"'), "event_type", F.lit('","id":'), ids, F.lit(',"space":"'), space, F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    made = snapshots.normalise_payload(e.select("event_id", payload.alias("payload")))
    return made.select("event_id", "type", "targets", F.col("attributes")["k"].alias("k"), "space_kind")


@q("""WITH i AS (SELECT user_id AS subject, event_id % 20 AS concept, CASE WHEN event_type = 'error' THEN 'PREVENTS' ELSE 'CAUSES' END AS relation, event_id FROM events),
    c AS (SELECT subject, concept, bool_or(relation = 'PREVENTS') AND bool_or(relation <> 'PREVENTS') AS conflict FROM i GROUP BY 1, 2) SELECT event_id, conflict FROM i JOIN c USING (subject, concept)""")
def graph_conflicts(spark, d):
    i = table(spark, d, "events").select(F.col("user_id").alias("subject"), (F.col("event_id") % 20).alias("concept"), F.when(F.col("event_type") == "error", "PREVENTS").otherwise("CAUSES").alias("relation"), "event_id")
    return graph.conflicts(i).select("event_id", "conflict")


@q("SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def conversation_fold(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role"), F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))


@q(EV + "SELECT seq, anchor, CASE WHEN anchor LIKE 'plant/line1/%' THEN 1.0::DOUBLE ELSE 0 END AS min_x, CASE WHEN anchor LIKE 'plant/line1/%' THEN 4.0::DOUBLE ELSE 0 END AS max_x FROM ev")
def lookup_anchor_region(spark, d):
    log = plain_log(spark, d)
    anchors = log.where("anchor like 'plant/line1/%'").select("anchor").distinct().withColumn("region", F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4, 5, 6)]))
    return joins.anchor_regions(log.select("seq", "anchor"), anchors).select("seq", "anchor", "min_x", "max_x")


@q(EV + ", f AS (SELECT entity, key, arg_max_null(value, seq) AS value FROM cells GROUP BY 1, 2) SELECT count(*) AS cells, true AS stable FROM f")
def fold_replay_digest(spark, d):
    cells = ev.cells(plain_log(spark, d))
    one = snapshots.digest(ev.fold(cells), F.col("value"))
    two = snapshots.digest(ev.fold(cells.repartition(7)), F.col("value")).select(F.col("cells").alias("c2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return one.join(F.broadcast(two), F.col("cells") == F.col("c2"), "left").select("cells", F.coalesce((F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), F.lit(False)).alias("stable"))


@q("""WITH p AS (SELECT event_id AS id, value AS x, (props->>'k')::DOUBLE AS y, event_id AS t FROM events), w AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance, a.t - b.t AS dt FROM p a JOIN p b ON b.id = a.id - 3) SELECT id FROM w WHERE distance <= 20 * abs(dt)""")
def entity_speed_veto(spark, d):
    from chronofold.operators import entity

    p = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_id").alias("t"))
    b = p.select((F.col("id") + 3).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("t").alias("bt"))
    pairs = p.join(b, "id").select("id", F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2).alias("distance"), (F.col("t") - F.col("bt")).alias("dt"))
    return entity.veto(pairs, 20.0).select("id")


@q("SELECT event_id, round(least(1.0, CASE WHEN user_id % 4 > 0 THEN ((event_id % 7 - 3)::DOUBLE / 3 * least(user_id % 4, 1) + 1) / 2 ELSE 0.5 END + least(0.15, 0.05 * (event_id % 5))), 8) AS score FROM events")
def entity_match_score(spark, d):
    from chronofold.operators import entity

    weight = (F.col("user_id") % 4).cast("double")
    agree = (F.col("event_id") % 7 - 3) / 3 * F.least(weight, F.lit(1.0)) * weight
    return table(spark, d, "events").select("event_id", F.round(entity.match_score(agree, weight, F.col("event_id") % 5), 8).alias("score"))


@q("""WITH a AS (SELECT user_id AS id, max(event_id) AS seen FROM events GROUP BY 1), r AS (SELECT id, row_number() OVER (ORDER BY seen DESC, id DESC) AS n FROM a WHERE id IN (SELECT o_orderkey FROM orders)) SELECT id FROM r WHERE n <= 30""")
def block_lru_evict(spark, d):
    from chronofold.operators import spatial
    from chronofold.sources.bindings import blocks

    at = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"))
    return spatial.evict(blocks(spark, d), at, 30).select("id")


@q("""WITH b AS (SELECT o_orderkey AS id, (o_custkey % 40)::DOUBLE * 2 AS x, (o_orderkey % 40)::DOUBLE * 2 AS y, (o_orderkey % 4)::DOUBLE AS z, CASE WHEN o_orderkey % 4 = 0 THEN 'ground' WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS payload FROM orders),
    x AS (SELECT id, x AS min_x, x + 1 AS max_x, y AS min_y, y + 1 AS max_y, z AS min_z, z + 0.5 AS max_z, payload FROM b)
    SELECT a.id, CASE WHEN payload = 'ground' THEN EXISTS (SELECT 1 FROM x u WHERE u.id <> a.id AND u.payload = '' AND u.min_x <= a.max_x AND a.min_x <= u.max_x AND u.min_y <= a.max_y AND a.min_y <= u.max_y AND u.min_z <= a.max_z + 0.5 AND a.max_z <= u.max_z)
      ELSE NOT EXISTS (SELECT 1 FROM x u WHERE u.id <> a.id AND u.min_x <= a.max_x AND a.min_x <= u.max_x AND u.min_y <= a.max_y AND a.min_y <= u.max_y AND u.min_z <= a.min_z AND a.min_z - 0.5 <= u.max_z) END AS suspect FROM x a""")
def block_suspects(spark, d):
    from chronofold.operators import spatial

    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    x, y, z = (F.col("o_custkey") % 40).cast("double") * 2, (key % 40).cast("double") * 2, (key % 4).cast("double")
    payload = F.when(key % 4 == 0, "ground").when(key % 5 == 0, "").otherwise(F.col("o_orderpriority"))
    rows = o.select(key.alias("id"), x.alias("min_x"), (x + 1).alias("max_x"), y.alias("min_y"), (y + 1).alias("max_y"), z.alias("min_z"), (z + 0.5).alias("max_z"), payload.alias("payload"))
    return spatial.suspects(rows, ["ground"], [""], 4.0)


@q()
def stateful_resolution(spark, d):
    from chronofold.operators import entity
    from chronofold.sources.bindings import observations
    from chronofold.streaming import resolve, stateful

    made = entity.profiles(observations(spark, d))
    return stateful.run_batch(made, "anchor", ["bucket"], resolve.resolve_step({"returnflag": 3.0}), resolve.RESOLVED)
