"""Queries of block and instance upkeep, association, scenes, motion and path numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import scenes, spatial, upkeep
from chronofold.plans.book import BL, VE, Book
from chronofold.sources.bindings import blocks, table, version_events

BOOK = Book()
q = BOOK.query


@q(BL + """, w AS (SELECT id, CASE WHEN state = 'Changing' OR id % 5 = 0 THEN 'Changing' ELSE state END AS state, CASE WHEN id % 3 = 0 THEN 'next' END AS pending_payload, CASE WHEN id % 4 = 0 THEN -1 ELSE t END AS window_start, 1.5::DOUBLE AS window_weight, t AS last_update FROM bl),
    s AS (SELECT *, state = 'Changing' AND window_start >= 0 AND 1500 - window_start > 700 AS swept FROM w)
    SELECT id, CASE WHEN swept THEN 'Stable' ELSE state END AS state, CASE WHEN swept THEN NULL ELSE pending_payload END AS pending_payload, CASE WHEN swept THEN -1 ELSE window_start END AS window_start,
        CASE WHEN swept THEN 0 ELSE window_weight END AS window_weight, CASE WHEN swept THEN 1500 ELSE last_update END AS last_update, swept FROM s""")
def block_window_sweep(spark, d):
    b = blocks(spark, d).select("id", F.when((F.col("state") == "Changing") | (F.col("id") % 5 == 0), "Changing").otherwise(F.col("state")).alias("state"), F.when(F.col("id") % 3 == 0, "next").alias("pending_payload"), F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("t")).cast("bigint").alias("window_start"), F.lit(1.5).alias("window_weight"), F.col("t").alias("last_update"))
    return upkeep.sweep(b, 1500, 700)


def _instances(spark, d):
    b = blocks(spark, d)
    box = [c for c in b.columns if c.startswith(("min_", "max_"))]
    return b.select("id", *box, F.col("payload").alias("label"), F.col("t").alias("last_seen"), F.when(F.col("id") % 3 > 0, F.col("t") - F.col("id") % 400).alias("since"), "confidence")


_INST = BL + """, i0 AS (SELECT id, min_x, max_x, payload AS label, t AS last_seen, CASE WHEN id % 3 > 0 THEN t - id % 400 END AS since, confidence FROM bl),
    inst AS (SELECT *, CASE WHEN 2000 - last_seen >= 900 THEN 'Archived' WHEN since IS NOT NULL AND 2000 - since >= 600 THEN 'Stationary' ELSE 'Active' END AS state FROM i0)
"""


@q(_INST + "SELECT 1000000 + row_number() OVER (ORDER BY id) - 1 AS id, min_x, max_x, label AS payload, last_seen AS timestamp, confidence, 'Pending' AS state, id AS instance FROM inst WHERE state = 'Stationary'")
def instance_promotion(spark, d):
    made = upkeep.promote(upkeep.aged(_instances(spark, d), 2000, 600, 900), 1_000_000)
    return made.select("id", "min_x", "max_x", "payload", "timestamp", "confidence", "state", "instance")


@q(_INST + "SELECT id, CASE WHEN state = 'Stationary' THEN 'Archived' ELSE state END AS state FROM inst")
def instance_archive(spark, d):
    aged = upkeep.aged(_instances(spark, d), 2000, 600, 900)
    return upkeep.archived(aged, upkeep.promote(aged, 1)).select("id", "state")


@q(VE + "SELECT block_id, version, payload FROM ver WHERE block_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def version_purge(spark, d):
    gone = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("block_id"))
    return upkeep.purge(spatial.versions(version_events(spark, d)), gone).select("block_id", "version", "payload")


@q(VE + "SELECT block_id, version, coalesce(valid_to, CASE WHEN block_id % 2 = 0 THEN 9000 END) AS valid_to FROM ver")
def version_seal(spark, d):
    ends = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("block_id"), F.lit(9000).cast("bigint").alias("valid_to"))
    return upkeep.seal(spatial.versions(version_events(spark, d)), ends).select("block_id", "version", "valid_to")


@q(VE + "SELECT count(*) AS versions, count(DISTINCT block_id) AS blocks, max(version)::INTEGER AS longest FROM ver")
def version_all(spark, d):
    return upkeep.all_versions(spatial.versions(version_events(spark, d))).agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("block_id").alias("blocks"), F.max("place").alias("longest"))


@q(BL + """, s AS (SELECT * FROM bl WHERE id % 7 = 0), i AS (SELECT * FROM bl WHERE id % 7 <> 0)
    SELECT s.id, min(i.id) AS instance FROM s LEFT JOIN i ON s.payload = i.payload AND abs(s.t - i.t) <= 30 AND s.min_x <= i.max_x AND i.min_x <= s.max_x AND s.min_y <= i.max_y AND i.min_y <= s.max_y AND s.min_z <= i.max_z AND i.min_z <= s.max_z GROUP BY 1""")
def track_association(spark, d):
    b = blocks(spark, d)
    seen = b.where("id % 7 = 0").withColumnRenamed("payload", "label")
    known = b.where("id % 7 <> 0").withColumnRenamed("payload", "label").withColumnRenamed("id", "instance").withColumnRenamed("t", "last_seen")
    return upkeep.associate(seen, known, 30, 8.0)


@q("""WITH p AS (SELECT event_id AS id, user_id AS u, event_id AS t, value AS x, (props->>'k')::DOUBLE AS y, event_type AS type FROM events), e AS (SELECT * FROM p WHERE type = 'error'), b AS (SELECT * FROM p WHERE type = 'purchase'),
    n AS (SELECT e.id, b.id AS near_id, sqrt((e.x - b.x) ** 2 + (e.y - b.y) ** 2) > 0.2::DOUBLE * abs(e.t - b.t) AS veto, row_number() OVER (PARTITION BY e.id ORDER BY abs(e.t - b.t), b.t, b.id) AS r FROM e JOIN b USING (u))
    SELECT id, near_id, veto FROM n WHERE r = 1""")
def entity_nearest_veto(spark, d):
    p = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), F.col("event_id").alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("type"))
    pairs = upkeep.nearest_in_time(p.where("type = 'error'").drop("type"), p.where("type = 'purchase'").drop("type"), "u")
    return pairs.select("id", "near_id", upkeep.impossible(pairs, 0.2).alias("veto"))


# scenes: regions and nations as roots, suppliers as objects below them


def _scenes(spark, d):
    n = table(spark, d, "nation")
    root = F.array(F.col("n_regionkey"), F.col("n_nationkey"))
    place = F.array(F.col("n_nationkey") * 4.0, F.col("n_regionkey") * 10.0, F.lit(0.0))
    return n.select(F.col("n_nationkey").cast("bigint").alias("scene"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 3).cast("bigint").alias("tags"), root.alias("root"), F.when(F.col("n_nationkey") % 4 == 0, scenes.DORMANT).otherwise(scenes.ACTIVE).alias("state"), place.alias("centre"), scenes.nominal_radius(F.when(F.col("n_nationkey") % 2 == 0, "euclid").otherwise("sphere"), F.lit(2.0)).alias("radius"))


def _objects(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    point = F.array(F.col("s_suppkey") % 100 * 1.0, F.floor(F.col("s_suppkey") / 100) % 50 * 1.0, F.lit(0.0))
    return s.select(F.col("s_suppkey").alias("object"), F.array(F.col("n_regionkey"), F.col("n_nationkey"), (F.col("s_suppkey") % 8).cast("int")).alias("path"), point.alias("point"))


@q("SELECT s_suppkey AS object, s_nationkey::BIGINT AS scene FROM supplier")
def scene_owners(spark, d):
    return scenes.owners(_objects(spark, d), _scenes(spark, d)).select("object", "scene")


@q("SELECT n_nationkey::BIGINT AS scene, n_regionkey = 2 OR n_nationkey < 20 AS accepted FROM nation WHERE n_nationkey % 2 = 1")
def scene_register(spark, d):
    known = _scenes(spark, d).where("scene % 2 = 0")
    regions = table(spark, d, "region").where("r_regionkey <> 2").select((F.col("r_regionkey") + 100).cast("bigint").alias("scene"), F.array("r_regionkey").alias("root"))
    asked = _scenes(spark, d).where("scene % 2 = 1")
    # scenes from 20 on come after those of whole regions, which cover them
    numbered = asked.withColumn("scene", F.when(F.col("scene") >= 20, F.col("scene") + 200).otherwise(F.col("scene")))
    made = scenes.register(known.select("scene", "root"), numbered.select("scene", "root").unionByName(regions))
    return made.where("scene < 100 or scene >= 200").select((F.col("scene") % 200).alias("scene"), "accepted")


@q("SELECT n_nationkey::BIGINT AS scene, n_name AS name FROM nation WHERE (n_nationkey * 3) >> 2 & 1 = 1")
def scene_tagged(spark, d):
    return scenes.tagged(_scenes(spark, d), 2).select("scene", "name")


@q("SELECT s_suppkey AS object FROM supplier WHERE s_nationkey <> 7")
def scene_dormancy(spark, d):
    return scenes.set_state(_scenes(spark, d), _objects(spark, d), 7, scenes.DORMANT)[1].select("object")


@q("""WITH o AS (SELECT s_suppkey AS object, s_nationkey::BIGINT AS scene, (s_suppkey % 100)::DOUBLE AS x, (s_suppkey // 100 % 50)::DOUBLE AS y FROM supplier)
    SELECT object, scene, round(sqrt((x - 30) ** 2 + (y - 2) ** 2), 7) AS distance FROM o WHERE scene % 4 <> 0 AND (x - 30) ** 2 + (y - 2) ** 2 <= 400 ORDER BY distance, object LIMIT 7""")
def scene_search(spark, d):
    all_scenes = _scenes(spark, d)
    found = scenes.search(scenes.owners(_objects(spark, d), all_scenes), all_scenes, [30.0, 2.0, 0.0], 20.0, 7)
    return found.withColumn("distance", F.round("distance", 7))


_SC = "sc AS (SELECT n_nationkey::BIGINT AS scene, n_nationkey * 4::DOUBLE AS x, n_regionkey * 10::DOUBLE AS y, CASE WHEN n_nationkey % 2 = 0 THEN 2 * sqrt(3) / 2 ELSE 4 END::DOUBLE AS radius, CASE WHEN n_nationkey % 4 = 0 THEN 'Dormant' ELSE 'Active' END AS state FROM nation)"


@q(f"WITH {_SC} SELECT scene, state FROM sc WHERE state <> 'Active' AND sqrt((x - 30) ** 2 + (y - 2) ** 2) <= radius + 45")
def scene_unloaded(spark, d):
    return scenes.unloaded(_scenes(spark, d), [30.0, 2.0, 0.0], 45.0)


@q(f"WITH {_SC} SELECT c_custkey AS probe, scene FROM customer JOIN sc ON (c_custkey % 100 - x) ** 2 + (c_nationkey - y) ** 2 <= (3 + radius) ** 2")
def scene_spheres(spark, d):
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("probe"), F.array(F.col("c_custkey") % 100 * 1.0, F.col("c_nationkey") * 1.0, F.lit(0.0)).alias("at"), F.lit(3.0).alias("reach"))
    return scenes.near_scenes(_scenes(spark, d), probes)


@q("""SELECT s_suppkey AS object, CASE WHEN s_suppkey % 3 = 0 THEN [9] ELSE [n_regionkey, n_nationkey, (s_suppkey % 8)::INTEGER] END AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0
    UNION ALL SELECT s_suppkey, [1, 1] FROM supplier WHERE s_suppkey % 10 = 0""")
def scene_object_lifecycle(spark, d):
    objects = _objects(spark, d)
    moved = scenes.transfer(objects, objects.where("object % 3 = 0").select("object", F.array(F.lit(9)).alias("root"), "point"))
    left = scenes.remove_objects(moved, objects.where("object % 5 = 0"))
    return scenes.save_object(left, objects.where("object % 10 = 0").withColumn("path", F.array(F.lit(1), F.lit(1)))).select("object", "path")


@q("""WITH t AS (SELECT event_id, event_id::DOUBLE / 10 AS t, event_id % 3 > 0 AS moving FROM events), a AS (SELECT *, 2 * pi() * ((0.25::DOUBLE + t / 40) - floor(0.25::DOUBLE + t / 40)) AS a, pi() * (t / 16 - floor(t / 16)) AS h FROM t)
    SELECT event_id, CASE WHEN moving THEN round(5 * cos(a), 6) ELSE 0 END + 0.0::DOUBLE AS x, CASE WHEN moving THEN round(5 * sin(a), 6) ELSE 0 END + 0.0::DOUBLE AS y, CASE WHEN moving THEN round(-5 * 2 * pi() / 40 * sin(a), 6) ELSE 0 END + 0.0::DOUBLE AS vx,
        round(cos(h), 6) + 0.0::DOUBLE AS w, round(sin(h), 6) + 0.0::DOUBLE AS z, round(2 * pi() / 16, 6) AS turning FROM a""")
def fn_motion(spark, d):
    made = scenes.motion(F.when(F.col("event_id") % 3 > 0, "orbit").otherwise("static"), F.col("event_id") / 10, F.lit(5.0), F.lit(40.0), F.lit(0.25), F.lit(16.0))
    part = lambda name, i: F.round(F.get(made[name], F.lit(i)), 6) + 0.0
    return table(spark, d, "events").select("event_id", part("origin", 0).alias("x"), part("origin", 1).alias("y"), part("velocity", 0).alias("vx"), part("turn", 0).alias("w"), part("turn", 3).alias("z"), F.round(F.get(made["turning"], F.lit(2)), 6).alias("turning"))


@q("SELECT event_id, CASE WHEN s < 3 THEN s WHEN s < 7 THEN 3 ELSE 3 END::DOUBLE AS x, CASE WHEN s < 3 THEN 0 WHEN s < 7 THEN s - 3 ELSE 4 END::DOUBLE AS y FROM (SELECT event_id, (event_id % 10)::DOUBLE AS s FROM events)")
def fn_along_path(spark, d):
    point = scenes.along([[0, 0], [3, 0], [3, 4]], (F.col("event_id") % 10).cast("double"))
    return table(spark, d, "events").select("event_id", F.get(point, F.lit(0)).alias("x"), F.get(point, F.lit(1)).alias("y"))


@q("""WITH p AS (SELECT event_id, [(event_id % 8)::INTEGER, (event_id // 8 % 10)::INTEGER, (event_id // 80 % 8)::INTEGER] AS path FROM events),
    b AS (SELECT event_id, path, list_concat([3::UBIGINT], list_transform(path, lambda c: c::UBIGINT)) AS n FROM p)
    SELECT event_id, CASE WHEN list_max(path) < 8 THEN ((3::UBIGINT << 56) + path[1]::UBIGINT + (path[2]::UBIGINT << 3) + (path[3]::UBIGINT << 6))::VARCHAR
        ELSE (list_reduce(flatten(list_transform(n, lambda x: list_transform(range(8), lambda i: ((x >> (8 * i)::UBIGINT) & 255::UBIGINT)::UHUGEINT))), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)::UBIGINT | 9223372036854775808::UBIGINT)::VARCHAR END AS key FROM b""")
def fn_path_key(spark, d):
    e = F.col("event_id")
    path = F.array(*[x.cast("int") for x in (e % 8, F.floor(e / 8) % 10, F.floor(e / 80) % 8)])
    return table(spark, d, "events").select("event_id", scenes.path_key(path).alias("key"))
