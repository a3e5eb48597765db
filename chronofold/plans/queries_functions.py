"""Queries of scalar functions: time, geometry, text, hashes, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import coordinates
from chronofold.functions import scalars as s
from chronofold.operators import entity
from chronofold.plans.book import Book
from chronofold.sources.bindings import table

BOOK = Book()
q = BOOK.query


@q("SELECT event_id, round(CASE WHEN event_id % 500 > 0 THEN value * pow(0.5::DOUBLE, (event_id % 500)::DOUBLE / 100) ELSE value END, 8) AS decayed FROM events")
def fn_half_life(spark, d):
    return table(spark, d, "events").select("event_id", F.round(s.decayed(F.col("value"), F.col("event_id") % 500, 100.0), 8).alias("decayed"))


@q("SELECT event_id, floor((event_id - 5000)::DOUBLE / 300)::BIGINT AS slot, (trunc((event_id - 5000)::DOUBLE / 300))::BIGINT AS bucket FROM events")
def fn_slots(spark, d):
    t = F.col("event_id") - 5000
    return table(spark, d, "events").select("event_id", s.slot(t, 300).alias("slot"), s.bucket(t, 300).cast("bigint").alias("bucket"))


@q("""WITH h AS (SELECT event_id, ((event_id * 977 + 8 * 3600) // 3600 % 24)::INTEGER AS hour FROM events) SELECT event_id, hour, CASE WHEN hour BETWEEN 5 AND 8 THEN 'dawn' WHEN hour BETWEEN 9 AND 10 THEN 'morning' WHEN hour BETWEEN 11 AND 13 THEN 'noon' WHEN hour BETWEEN 14 AND 16 THEN 'afternoon' WHEN hour BETWEEN 17 AND 19 THEN 'evening' WHEN hour BETWEEN 20 AND 22 THEN 'night' ELSE 'late' END AS period FROM h""")
def fn_local_period(spark, d):
    hour = s.local_hour(F.col("event_id") * 977)
    return table(spark, d, "events").select("event_id", hour.alias("hour"), s.day_period(hour).alias("period"))


@q("SELECT event_id, NOT ((event_id % 1440) >= 1320 OR (event_id % 1440) < 360) AS outside FROM events")
def fn_outside_hours(spark, d):
    return table(spark, d, "events").select("event_id", s.outside_hours(F.col("event_id") % 1440, 1320, 360).alias("outside"))


@q("SELECT event_id, (event_id * 300000 > 0 AND event_id * 300000 < 1700000000 + 10 * 365 * 86400) AS valid FROM events")
def fn_valid_utc(spark, d):
    return table(spark, d, "events").select("event_id", s.valid_utc(F.col("event_id") * 300000, 1700000000).alias("valid"))


_LL = "SELECT o_orderkey, (o_orderkey % 170 - 85)::DOUBLE AS lat, (o_custkey % 350 - 175)::DOUBLE AS lng FROM orders"


def _places(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 170 - 85).cast("double").alias("lat"), (F.col("o_custkey") % 350 - 175).cast("double").alias("lng"))


@q(f"SELECT o_orderkey, round(2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(31.23 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31.23)) * pow(sin(radians(121.47 - lng) / 2), 2)))), 2) AS metres FROM ({_LL})")
def fn_haversine(spark, d):
    return _places(spark, d).select("o_orderkey", F.round(s.haversine(F.col("lat"), F.col("lng"), F.lit(31.23), F.lit(121.47)), 2).alias("metres"))


@q(f"""WITH p AS ({_LL}), c AS (SELECT o_orderkey, floor((lng + 180) / 360 * 32768)::BIGINT AS x, floor((lat + 90) / 180 * 32768)::BIGINT AS y FROM p),
    b AS (SELECT o_orderkey, list_transform(range(0, 30), lambda i: CASE WHEN i % 2 = 0 THEN (x >> (14 - i // 2)) & 1 ELSE (y >> (14 - i // 2)) & 1 END) AS v FROM c)
    SELECT o_orderkey, array_to_string(list_transform(range(0, 6), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + v[5*c+1] * 16 + v[5*c+2] * 8 + v[5*c+3] * 4 + v[5*c+4] * 2 + v[5*c+5])::BIGINT, 1)), '') AS hash FROM b""")
def fn_geohash(spark, d):
    return _places(spark, d).select("o_orderkey", s.geohash(F.col("lat"), F.col("lng")).alias("hash"))


@q(f"SELECT o_orderkey, lat, lng FROM ({_LL}) WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lng) / 2), 2)))) <= 1500000")
def fn_places_within(spark, d):
    return _places(spark, d).where(s.haversine(F.col("lat"), F.col("lng"), F.lit(10.0), F.lit(20.0)) <= 1500000)


@q("WITH p AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, p WHERE list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) > 0 ORDER BY score DESC, vec_id LIMIT 20")
def vector_top_k_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    probe = rows.where("vec_id = 3").select(F.col("embedding").alias("e")).first()["e"]
    score = F.round(s.cosine(F.col("embedding"), F.lit(probe)), 6)
    return rows.select("vec_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "vec_id").limit(20)


@q("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def vector_normalize(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(s.norm(e), 6).alias("norm"), F.round(F.get(s.normalized(e), F.lit(0)), 6).alias("first"))


@q("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE + x[2]::DOUBLE))), 5) AS plus, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE))), 5) AS minus FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_compose(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda t, x: t + x), 5)
    return a.join(b, "vec_id").select("vec_id", total(s.plus(F.col("a"), F.col("b"))).alias("plus"), total(s.minus(F.col("a"), F.col("b"))).alias("minus"))


@q("SELECT event_id, round(10 * cos(2 * pi() * ((0.25 + event_id::DOUBLE / 365) - floor(0.25 + event_id::DOUBLE / 365))), 6) + 0.0 AS x, round(10 * sin(2 * pi() * ((0.25 + event_id::DOUBLE / 365) - floor(0.25 + event_id::DOUBLE / 365))), 6) + 0.0 AS y FROM events")
def fn_orbit(spark, d):
    at = s.orbit(F.col("event_id"), 10.0, 365.0, 0.25)
    return table(spark, d, "events").select("event_id", *[(F.round(F.get(at, F.lit(i)), 6) + 0.0).alias(n) for i, n in enumerate("xy")])


@q("SELECT event_id, round(0.0 - value, 6) + 0.0 AS x, round((props->>'k')::DOUBLE, 6) + 0.0 AS z FROM events")
def fn_quaternion_rotate(spark, d):
    # half a turn about z
    v = F.array(F.col("value"), F.lit(0.0), F.get_json_object("props", "$.k").cast("double"))
    turned = s.rotate(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]), v)
    return table(spark, d, "events").select("event_id", *[(F.round(F.get(turned, F.lit(i)), 6) + 0.0).alias(n) for i, n in ((0, "x"), (2, "z"))])


_PATHS = "SELECT l_orderkey, l_linenumber, l_partkey, [l_suppkey % 3, l_partkey % 4, l_linenumber % 2] AS a, [l_suppkey % 3, l_partkey % 2, l_linenumber % 2] AS b FROM lineitem"


@q(f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 ELSE 3 END AS depth, a[1:2] AS parent, a[1:2] = b[1:2] AS nested FROM ({_PATHS})")
def fn_path_codes(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.col("l_suppkey") % 3, F.col("l_partkey") % 4, (F.col("l_linenumber") % 2).cast("bigint")).alias("a"), F.array(F.col("l_suppkey") % 3, F.col("l_partkey") % 2, (F.col("l_linenumber") % 2).cast("bigint")).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", entity.lca_depth(F.col("a"), F.col("b")).alias("depth"), s.path_parent(F.col("a")).alias("parent"), s.is_prefix(F.slice("b", 1, 2), F.col("a")).alias("nested"))


@q("SELECT page_id, CASE WHEN contains(url, ' ') OR strlen(url) > 32 THEN 'raw_text' ELSE 'anchor' END AS kind, len(string_split(url, '/'))::INTEGER AS segments FROM pages")
def fn_space_kind(spark, d):
    return table(spark, d, "pages").select("page_id", s.space_kind(F.col("url")).alias("kind"), F.size(F.split("url", "/")).alias("segments"))


@q("SELECT c_custkey, lower(c_mktsegment) AS lower, to_base64(encode(c_name)) AS b64 FROM customer")
def fn_text_codec(spark, d):
    return table(spark, d, "customer").select("c_custkey", s.ascii_lower(F.col("c_mktsegment")).alias("lower"), F.base64(F.encode("c_name", "UTF-8")).alias("b64"))


@q("""SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS hash FROM part""")
def fn_fnv1a64(spark, d):
    return table(spark, d, "part").select("p_partkey", s.fnv1a64_hex(F.col("p_name")).alias("hash"))


@q("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 1000 - 86400 WHEN contains(p_name, 'ring') THEN 1000 - 3600 ELSE 0 END AS t FROM part")
def fn_relative_time(spark, d):
    return table(spark, d, "part").select("p_partkey", s.first_phrase(F.col("p_name"), [("red", -86400), ("ring", -3600)], F.lit(1000)).alias("t"))


@q("SELECT p_partkey, list_sort(list_distinct(list_filter([p_name, p_brand, p_type, p_brand], lambda x: x IS NOT NULL AND x <> ''))) AS forms FROM part")
def fn_surface_forms(spark, d):
    return table(spark, d, "part").select("p_partkey", s.surface_forms(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_brand")).alias("forms"))


@q("""WITH w AS (SELECT p_partkey, p_name, i, n, substr(p_name, i, n) AS piece FROM part, range(1, 33) a(i), range(2, 9) b(n) WHERE i + n - 1 <= length(p_name)),
    hits AS (SELECT p_partkey, piece, row_number() OVER (PARTITION BY p_partkey ORDER BY length(piece) DESC, piece) AS r FROM w WHERE piece IN ('red', 'ring', 'widget', 'small', 'blue', 'in'))
    SELECT p_partkey, piece AS word FROM hits WHERE r = 1""")
def fn_longest_dictionary_hit(spark, d):
    words = ["red", "ring", "widget", "small", "blue", "in"]
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(s.substrings(F.col("p_name")))).alias("piece")).where(F.col("piece").isin(words))
    return rows.groupBy("p_partkey").agg(F.min_by("piece", F.struct(-F.length("piece"), F.col("piece"))).alias("word"))


@q(f"SELECT o_orderkey, round(6371000 * cos(radians(lat)) * cos(radians(lng)), 1) + 0.0 AS x, round(6371000 * cos(radians(lat)) * sin(radians(lng)), 1) + 0.0 AS y, round(6371000 * sin(radians(lat)), 1) + 0.0 AS z FROM ({_LL})")
def coordinates_sphere_chart(spark, d):
    at = coordinates.sphere_chart(F.col("lat"), F.col("lng"), F.lit(0.0), 6371000.0)
    return _places(spark, d).select("o_orderkey", *[(F.round(F.get(at, F.lit(i)), 1) + 0.0).alias(n) for i, n in enumerate("xyz")])


@q(f"SELECT o_orderkey, lat, lng, 0.0::DOUBLE AS height FROM ({_LL})")
def coordinates_sphere_round_trip(spark, d):
    back = coordinates.sphere_from_chart(coordinates.sphere_chart(F.col("lat"), F.col("lng"), F.lit(0.0), 1000.0), 1000.0)
    return _places(spark, d).select("o_orderkey", *[(F.round(F.get(back, F.lit(i)), 6) + 0.0).alias(n) for i, n in enumerate(("lat", "lng", "height"))])


@q("SELECT event_id, least((value * 3 - 40) - floor((value * 3 - 40) / 360) * 360, 360 - ((value * 3 - 40) - floor((value * 3 - 40) / 360) * 360)) IS NOT NULL AS placed, round(least(abs(value - 40) - floor(abs(value - 40) / 100) * 100, 100 - (abs(value - 40) - floor(abs(value - 40) / 100) * 100)), 6) AS distance FROM events")
def coordinates_closed_track(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", v.isNotNull().alias("placed"), F.round(coordinates.track_distance(v, F.lit(40.0), 100.0), 6).alias("distance"))
