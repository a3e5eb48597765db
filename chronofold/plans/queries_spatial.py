"""Queries over memory blocks, versions, tracks and signals, and the block query language."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import signals, spatial
from chronofold.plans import vql
from chronofold.plans.book import BL, PT, VE, Book
from chronofold.sources.bindings import blocks, points, table, version_events

BOOK = Book()
q = BOOK.query
SIZES = [6.0, 4.0, 2.0]
_LEVEL = "CASE WHEN max_x - min_x = 6 THEN 0 WHEN max_x - min_x = 4 THEN 1 ELSE 2 END"
_BLV = BL.rstrip() + f", blv AS (SELECT *, {_LEVEL} AS level FROM bl)\n"
_MEET = "{a}.min_x <= {b}.max_x AND {b}.min_x <= {a}.max_x AND {a}.min_y <= {b}.max_y AND {b}.min_y <= {a}.max_y AND {a}.min_z <= {b}.max_z AND {b}.min_z <= {a}.max_z"


def _levelled(spark, d):
    rows = blocks(spark, d)
    return rows.withColumn("level", spatial.detect_level(spatial.box_of(rows), SIZES))


@q(BL + "SELECT id, payload, t FROM bl WHERE min_x <= 40 AND max_x >= 10 AND min_y <= 60 AND max_y >= 20 AND min_z <= 1 AND max_z >= 0 AND t BETWEEN 300 AND 900")
def block_region_time(spark, d):
    return spatial.query(blocks(spark, d), (10, 20, 0, 40, 60, 1), 300, 900).select("id", "payload", "t")


@q(BL + "SELECT id FROM bl WHERE 15.5 BETWEEN min_x AND max_x AND 21 BETWEEN min_y AND max_y AND 0 BETWEEN min_z AND max_z")
def block_contains_point(spark, d):
    rows = blocks(spark, d)
    return rows.where(spatial.contains_point(spatial.box_of(rows), F.lit(15.5), F.lit(21.0), F.lit(0.0))).select("id")


@q(_BLV + "SELECT id, level FROM blv")
def block_levels(spark, d):
    return _levelled(spark, d).select("id", F.col("level").cast("int").alias("level"))


@q(BL + "SELECT id, floor((min_x + max_x) / 2 / 10)::BIGINT AS cell_x, floor((min_y + max_y) / 2 / 10)::BIGINT AS cell_y, floor((min_z + max_z) / 2 / 10)::BIGINT AS cell_z, floor(t::DOUBLE / 30)::BIGINT AS time_slot FROM bl")
def block_keys(spark, d):
    return spatial.block_key(blocks(spark, d), 10.0, 30).select("id", "cell_x", "cell_y", "cell_z", "time_slot")


@q(BL + f"SELECT lo.id AS left_id, hi.id AS right_id FROM bl lo JOIN bl hi ON {_MEET.format(a='lo', b='hi')} AND lo.t = hi.t")
def block_grid_join_same_day(spark, d):
    # all blocks lie at z = 0, so the day takes the place of z and becomes a part of the cell
    lo = hi = blocks(spark, d)
    day = 1000.0
    shift = lambda df: df.withColumns({"min_z": F.col("t") * day, "max_z": F.col("t") * day + 1})
    return spatial.grid_join(shift(lo), shift(hi), "id", "id", 8.0)


@q(BL + ", " + PT[5:] + """, lp AS (SELECT id, arg_max(x, (t, seq)) AS x, arg_max(y, (t, seq)) AS y FROM pt GROUP BY 1)
    SELECT bl.id, list(DISTINCT lp.id ORDER BY lp.id) AS instances FROM bl JOIN lp ON lp.x - 1 <= max_x AND min_x <= lp.x + 1 AND lp.y - 1 <= max_y AND min_y <= lp.y + 1 AND -1 <= max_z AND min_z <= 1 GROUP BY 1""")
def block_occupants(spark, d):
    last = signals.latest(points(spark, d)).select("id", (F.col("x") - 1).alias("min_x"), (F.col("x") + 1).alias("max_x"), (F.col("y") - 1).alias("min_y"), (F.col("y") + 1).alias("max_y"), F.lit(-1.0).alias("min_z"), F.lit(1.0).alias("max_z"))
    return spatial.occupants(blocks(spark, d), last, 8.0)


@q(BL + """, c AS (SELECT floor((min_x + max_x) / 2 / 20)::BIGINT AS cell_x, floor((min_y + max_y) / 2 / 20)::BIGINT AS cell_y, floor((min_z + max_z) / 2 / 20)::BIGINT AS cell_z, *, CASE state WHEN 'Pending' THEN 0 WHEN 'Stable' THEN 1 ELSE 2 END AS so FROM bl),
    p AS (SELECT cell_x, cell_y, cell_z, payload, row_number() OVER (PARTITION BY cell_x, cell_y, cell_z ORDER BY count(*) DESC, payload) AS n FROM c GROUP BY 1, 2, 3, 4),
    s AS (SELECT cell_x, cell_y, cell_z, state, row_number() OVER (PARTITION BY cell_x, cell_y, cell_z ORDER BY count(*) DESC, so) AS n FROM c GROUP BY 1, 2, 3, 4, so),
    b AS (SELECT cell_x, cell_y, cell_z, count(*) AS n, round(avg(confidence), 8) AS confidence, max(t) AS t FROM c GROUP BY 1, 2, 3)
    SELECT b.*, p.payload, s.state FROM b JOIN p USING (cell_x, cell_y, cell_z) JOIN s USING (cell_x, cell_y, cell_z) WHERE p.n = 1 AND s.n = 1""")
def block_summaries(spark, d):
    return spatial.summaries(blocks(spark, d), 20.0).withColumn("confidence", F.round("confidence", 8))


@q(_BLV + f""", co AS (SELECT id, greatest(min_x, 10) AS min_x, greatest(min_y, 10) AS min_y, greatest(min_z, 0) AS min_z, least(max_x, 30) AS max_x, least(max_y, 30) AS max_y, least(max_z, 1) AS max_z FROM blv WHERE level = 0 AND min_x <= 30 AND max_x >= 10 AND min_y <= 30 AND max_y >= 10 AND min_z <= 1 AND max_z >= 0)
    SELECT id, level FROM blv WHERE level = 0 AND id IN (SELECT id FROM co) UNION ALL SELECT DISTINCT blv.id, blv.level FROM blv JOIN co ON {_MEET.format(a='blv', b='co')} WHERE blv.level >= 1 AND blv.min_x <= 30 AND blv.max_x >= 10 AND blv.min_y <= 30 AND blv.max_y >= 10""")
def block_coarse_to_fine(spark, d):
    return spatial.coarse_to_fine(_levelled(spark, d), (10, 10, 0, 30, 30, 1), 8.0).select("id", F.col("level").cast("int").alias("level"))


@q(_BLV + f"SELECT a.id, EXISTS (SELECT 1 FROM blv b WHERE b.level >= 1 AND {_MEET.format(a='a', b='b')}) AS refined FROM blv a WHERE level = 0")
def block_refined(spark, d):
    return spatial.refined(_levelled(spark, d), 8.0)


@q(BL + "SELECT id, t FROM bl WHERE t >= 1500")
def block_expire(spark, d):
    return spatial.expired(blocks(spark, d), 1500).select("id", "t")


@q(BL + "SELECT id, round(CASE WHEN 2500 - t > 0 THEN confidence * pow(0.5::DOUBLE, (2500 - t)::DOUBLE / 365) ELSE confidence END, 8) AS confidence FROM bl")
def block_decayed_confidence(spark, d):
    from chronofold.functions.scalars import decayed

    return blocks(spark, d).select("id", F.round(decayed(F.col("confidence"), 2500 - F.col("t"), 365.0), 8).alias("confidence"))


@q(BL + "SELECT max(greatest(max_x - min_x, max_y - min_y, max_z - min_z) / 2) AS radius FROM bl")
def block_largest_radius(spark, d):
    return blocks(spark, d).agg(F.max(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.col("max_z") - F.col("min_z")) / 2).alias("radius"))


@q(VE + "SELECT * FROM ver")
def version_chain(spark, d):
    return spatial.versions(version_events(spark, d))


@q(VE + "SELECT block_id, version, payload FROM ver WHERE valid_from <= 1200 AND (valid_to IS NULL OR valid_to > 1200)")
def version_in_force(spark, d):
    return spatial.version_at(spatial.versions(version_events(spark, d)), 1200).select("block_id", "version", "payload")


@q(VE + "SELECT user_id AS block_id, event_id AS probe_id, (event_id % 2500)::BIGINT AS t, v.payload FROM events LEFT JOIN ver v ON v.block_id = user_id AND v.valid_from <= event_id % 2500 AND (v.valid_to IS NULL OR v.valid_to > event_id % 2500)")
def version_as_of_join(spark, d):
    probes = table(spark, d, "events").select(F.col("user_id").alias("block_id"), F.col("event_id").alias("probe_id"), (F.col("event_id") % 2500).alias("t"))
    return spatial.versions_at(version_events(spark, d), probes)


@q(_BLV + "SELECT id, payload, level FROM blv WHERE min_x <= 100 AND max_x >= 0 AND min_y <= 50 AND max_y >= 0 AND min_z <= 10 AND max_z >= 0 AND t BETWEEN 0 AND 2000 AND level = 1 AND state = 'Stable' AND contains(payload, 'LOW') ORDER BY id LIMIT 100")
def vql_blocks(spark, d):
    text = "FIND BLOCKS IN REGION(0,0,0,100,50,10) DURING(0,2000) LEVEL 1 STATE Stable PAYLOAD ~ 'LOW' LIMIT 100"
    return vql.execute(text, _levelled(spark, d), levels=3).select("id", "payload", F.col("level").cast("int").alias("level"))


@q(_BLV + ", " + VE[5:] + "SELECT blv.id, v.payload, v.version FROM blv JOIN ver v ON v.block_id = blv.id AND v.valid_from <= 900 AND (v.valid_to IS NULL OR v.valid_to > 900) WHERE min_x <= 100 AND max_x >= 0 AND min_y <= 100 AND max_y >= 0 AND min_z <= 10 AND max_z >= 0 AND blv.t BETWEEN 0 AND 5000")
def vql_blocks_at(spark, d):
    text = "FIND BLOCKS IN REGION(0,0,0,100,100,10) DURING(0,5000) AT 900 SUMMARY"
    return vql.execute(text, _levelled(spark, d), spatial.versions(version_events(spark, d)), levels=3).select("id", "payload", "version")


@q(VE + "SELECT * FROM ver WHERE block_id = 12")
def vql_history(spark, d):
    return vql.execute("FIND HISTORY OF 12", blocks(spark, d), spatial.versions(version_events(spark, d)))


@q(BL + "SELECT count(*) AS blocks, count(*) FILTER (state = 'Pending') AS pending, count(*) FILTER (state = 'Stable') AS stable, count(*) FILTER (state = 'Changing') AS changing FROM bl")
def vql_stats(spark, d):
    return vql.execute("STATS", blocks(spark, d))


def _boxes(spark, d):
    return points(spark, d).select("id", "t", "seq", *[(F.col(a) - 1).alias(f"min_{a}") for a in "xy"], F.lit(-1.0).alias("min_z"), *[(F.col(a) + 1).alias(f"max_{a}") for a in "xy"], F.lit(1.0).alias("max_z"))


@q(PT + ", l AS (SELECT id, max(t) AS t, arg_max(x, t) AS x, arg_max(y, t) AS y FROM pt GROUP BY 1) SELECT id, t FROM l WHERE x - 1 <= 50 AND x + 1 >= 0 AND y - 1 <= 60 AND y + 1 >= 0")
def vql_dynamic(spark, d):
    return vql.execute("FIND DYNAMIC IN REGION(0,0,0,50,60,5) DURING(0,9000000000000)", None, None, _boxes(spark, d)).select("id", "t")


@q(PT + ", n AS (SELECT *, row_number() OVER (ORDER BY t DESC) AS n FROM pt WHERE id = 5) SELECT t, seq FROM n WHERE n <= 64")
def vql_trajectory(spark, d):
    return vql.execute("FIND TRAJECTORY OF 5", None, None, _boxes(spark, d)).select("t", "seq")


@q(PT + """, m AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt FROM pt WINDOW w AS (PARTITION BY id ORDER BY t, seq))
    SELECT id, seq, round(CASE WHEN t - pt > 0 THEN (x - px) / ((t - pt) / 1000.0) ELSE 0 END, 6) AS vx, round(CASE WHEN t - pt > 0 THEN (y - py) / ((t - pt) / 1000.0) ELSE 0 END, 6) AS vy FROM m""")
def track_velocity(spark, d):
    return signals.velocities(points(spark, d)).select("id", "seq", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@q(PT + ", n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, seq DESC) AS n FROM pt) SELECT id, seq, t, x, y FROM n WHERE n <= 20")
def track_newest_points(spark, d):
    return signals.newest(points(spark, d), 20)


@q(PT + ", m AS (SELECT id, max(seq) FILTER (x >= 90) AS moved FROM pt GROUP BY 1) SELECT pt.id, min(t) FILTER (x < 90 AND (moved IS NULL OR seq > moved)) AS since FROM pt JOIN m USING (id) GROUP BY 1")
def track_stationary_since(spark, d):
    return signals.stationary_since(points(spark, d), F.col("x") < 90)


@q(PT + ", l AS (SELECT id, arg_max(x, (t, seq)) AS x, arg_max(y, (t, seq)) AS y, max(t) AS t FROM pt GROUP BY 1) SELECT id, x, y, t FROM l WHERE x BETWEEN 10 AND 80 AND y BETWEEN 10 AND 90")
def track_active_in_region(spark, d):
    return signals.active_in(points(spark, d), (10, 10), (80, 90), 0, 1 << 50).select("id", "x", "y", "t")


@q(PT + """, l AS (SELECT id, max(t) AS last FROM pt GROUP BY 1), z AS (SELECT max(t) AS now FROM pt) SELECT id, CASE WHEN now - last >= 20000000 THEN 'Archived' ELSE 'Active' END AS state FROM l, z""")
def track_states(spark, d):
    rows = points(spark, d)
    now = rows.agg(F.max("t")).first()[0]
    last = rows.groupBy("id").agg(F.max("t").alias("last"))
    return last.select("id", signals.instance_state(F.col("last"), F.lit(None).cast("bigint"), F.lit(now), 1000, 20000000).alias("state"))


@q("""WITH c AS (SELECT user_id AS id, event_id AS tick, value >= 100 AS high FROM events WHERE value >= 100 OR value <= 50),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tick) - row_number() OVER (PARTITION BY id, high ORDER BY tick) AS run FROM c),
    h AS (SELECT *, row_number() OVER (PARTITION BY id, high, run ORDER BY tick) AS n FROM r),
    e AS (SELECT id, tick, high, coalesce(lag(high) OVER (PARTITION BY id ORDER BY tick), false) AS before FROM h WHERE n = 2)
    SELECT id, tick, high FROM e WHERE high <> before""")
def signal_edges(spark, d):
    samples = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("tick"), "value")
    return signals.edges(samples, 100.0, 50.0, 2)


@q()
def signal_edges_deduplicated(spark, d):
    from chronofold.session import ship

    ship(spark)
    samples = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("tick"), "value")
    return signals.edges_deduplicated(samples, 100.0, 50.0, 2, 500)


@q("SELECT event_id, (event_id % 100) BETWEEN 20 AND 49 AS inside FROM events")
def signal_phase(spark, d):
    return table(spark, d, "events").select("event_id", signals.phase(F.col("event_id"), 100, 20, 30).alias("inside"))


@q("""SELECT user_id % 10 AS source, round(list_reduce(list_prepend(0.5::DOUBLE, list(CASE WHEN event_type <> 'error' THEN 0.02::DOUBLE ELSE -0.05::DOUBLE END ORDER BY event_id)), lambda r, x: least(1::DOUBLE, greatest(0.05::DOUBLE, r + x))), 9) AS reliability FROM events GROUP BY 1""")
def source_reliability_feedback(spark, d):
    feedback = table(spark, d, "events").select((F.col("user_id") % 10).alias("source"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("good"))
    return signals.clamped_fold(feedback, 0.5, 0.02, 0.05).withColumn("reliability", F.round("reliability", 9))
