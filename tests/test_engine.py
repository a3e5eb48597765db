"""Exact-number scenarios, step functions against streams, and brute-force comparisons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronofold.functions import embedding, frames, scalars
from chronofold.operators import entity, events, graph, rules, signals, spatial
from chronofold.plans import vql
from chronofold.sources import records
from chronofold.streaming import stateful


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_record_predicates(spark):
    rows = [("st-001", "hall/line/1", 10, "day"), ("st-002", "hall/line/2", 20, None), ("st-003", "hall/paint/1", 30, "night"), ("st-004", "press/line/1", 40, "day")]
    df = frame(spark, rows, "id string, path string, load long, note string")
    ids = lambda *c: [r.id for r in records.query(df, [records.Condition(*x) for x in c], [("id", False)]).collect()]
    assert ids(("path", "prefix", "hall/line")) == ["st-001", "st-002"]
    assert ids(("path", "prefix", "hall/line3")) == []
    assert ids(("note", "ne", "day")) == ["st-003"]
    assert ids(("note", "is_null")) == ["st-002"]
    assert ids(("note", "eq", None)) == ["st-002"]
    assert ids(("load", "ne", 20)) == ["st-001", "st-003", "st-004"]
    assert [r.id for r in records.query(df, [], [("note", False), ("id", False)], 2).collect()] == ["st-002", "st-001"]
    with pytest.raises(ValueError):
        records.predicate(records.Condition("id", "like", "x"))


def test_numbering_is_gapless(spark):
    rows = [(random.Random(i).random(), i) for i in range(500)]
    out = records.numbered(frame(spark, rows, "at double, i int"), "at", "seq", 10).collect()
    assert [r.seq for r in sorted(out, key=lambda r: r["at"])] == list(range(11, 511))


def test_replay_log(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"seq":1,"op":"put","row":{"id":1,"v":"a"}}\n{"seq":2,"op":"put","row":{"id":2,"v":"b"}}\nbroken\n{"seq":3,"op":"remove","row":{"id":1}}\n{"seq":4,"op":"put","row":{"id":2,"v":"c"}}\n')
    got = records.replay_log(spark, str(tmp_path / "log.json"), {"id": "int", "v": "text"}, "id").collect()
    assert [(r.id, r.v) for r in got] == [(2, "c")]


def test_fold_keeps_written_nulls(spark):
    writes = frame(spark, [(1, "e", "k", 5.0), (2, "e", "k", None), (1, "f", "k", 1.0)], "seq long, entity string, key string, value double")
    got = {r.entity: (r.value, r.source_event) for r in events.fold(writes).collect()}
    assert got == {"e": (None, 2), "f": (1.0, 1)}
    assert {r.entity: r.value for r in events.fold(writes, 1).collect()} == {"e": 5.0, "f": 1.0}


CASES = [
    ({"+": [1, 2, 3]}, 6), ({"+": [None, 2]}, 2), ({"+": ["a", 1]}, "a1"), ({"-": [4]}, -4), ({"*": [2, 2.5]}, 5.0), ({"/": [1, 4]}, 0.25), ({"%": [-7, 3]}, -1),
    ({"==": [1, 1.0]}, True), ({"==": [None, None]}, True), ({"!=": ["a", "b"]}, True), ({"and": [1, 0]}, 0), ({"or": [0, 3]}, 3), ({"!": [""]}, True),
    ({"in": [2, [1, 2]]}, True), ({"cat": ["a", 1, None]}, "a1"), ({"count": [[1, 2, 3]]}, 3), ({"if": [False, "x", True, "y", "z"]}, "y"),
]


@pytest.mark.parametrize("expr,expected", CASES)
def test_rule_operators(spark, expr, expected):
    made = rules.Compiler({}).compile(expr)
    assert spark.range(1).select(made.column.alias("v")).first()["v"] == expected


def test_rule_errors_reject(spark):
    rule = {"effect": "filter", "deps": ["x"], "expr": {">": [{"/": [1, {"var": "x"}]}, 0]}}
    x = {"x": rules.Value(F.col("x"), "int")}
    df = frame(spark, [(0,), (1,), (None,)], "x long")
    write = rules.rejects(rule, x, {}, "write")
    read = rules.rejects(rule, x, {"x": F.col("x").isNotNull()}, "read")
    assert [(r.w, r.r) for r in df.select(write.alias("w"), read.alias("r")).collect()] == [(True, True), (False, False), (True, False)]


def test_rule_checks():
    rule = {"effect": "filter", "deps": ["a", "gone"], "expr": {"if": [{"==": [{"var": "b"}, 1]}, {"return": [1]}]}}
    faults = rules.check(rule, {"a", "b"})
    assert "unregistered dependency gone" in faults and "undeclared variable b" in faults and "terminal return in a filter rule" in faults and "arity of if" in faults


def test_vql_errors_and_defaults():
    s = vql.parse("FIND BLOCKS IN REGION(0,0,0,1,1,1) DURING(0,10) STATE stable LIMIT 3")
    assert (s.state, s.limit, s.level) == ("Stable", 3, None)
    with pytest.raises(vql.VqlError):
        vql.parse("FIND BLOCKS IN REGION(0,0,0) DURING(0,10)")
    with pytest.raises(vql.VqlError, match="at 5"):
        vql.parse("FIND NOTHING")


def test_grid_join_is_brute_force(spark):
    rng = random.Random(3)

    def box():
        low = [rng.uniform(-30, 30) for _ in range(3)]
        return [c for x in low for c in (x, x + rng.uniform(0, 9))]

    cols = "id long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"
    a, b = [(i, *box()) for i in range(80)], [(i, *box()) for i in range(80)]
    meet = lambda p, q: all(p[k] <= q[k + 1] and q[k] <= p[k + 1] for k in (1, 3, 5))
    got = sorted(map(tuple, spatial.grid_join(frame(spark, a, cols), frame(spark, b, cols), "id", "id", 4.0).collect()))
    assert got == sorted((p[0], q[0]) for p in a for q in b if meet(p, q))


def test_radius_search_is_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, *(rng.uniform(-100, 100) for _ in range(3))) for i in range(300)]
    centres = [(*p, 40.0) for p in pts[:12]]
    got = {(r.centre, r.id) for r in frames.within(frame(spark, pts, "id long, x double, y double, z double"), frame(spark, centres, "id long, x double, y double, z double, radius double"), "radius", 25.0).collect()}
    assert got == {(c[0], p[0]) for c in centres for p in pts if math.dist(c[1:4], p[1:]) <= 40}


def test_signal_scenarios(spark):
    samples = list(enumerate([1.2, 1.1, -0.2, 1.2, 1.2, 1.2, -0.1, -0.1, -0.1]))
    df = frame(spark, [(1, t, v) for t, v in samples], "id long, tick long, value double")
    want = [(5, True), (8, False)]
    assert sorted((r.tick, r.high) for r in signals.edges(df, 1, 0, 3).collect()) == want
    assert sorted((r.tick, r.high) for r in signals.edges_deduplicated(df, 1, 0, 3, 0).collect()) == want
    state, out = (False, None, 0, None), []
    for t, v in ((0, 1.2), (2, -0.1), (15, 1.2)):
        state, edge = signals.filter_step(state, t, v, 1, 0, 1, 10)
        out.append(edge)
    assert out == [True, None, True]


def test_noise_gives_two_edges():
    rng, state, edges = random.Random(20260907), (False, None, 0, None), 0
    for t in range(100_000):
        level = 1.5 if 30_000 <= t < 60_000 else -0.5
        state, edge = signals.filter_step(state, t, level + rng.uniform(-0.4, 0.4), 1, 0, 5, 0)
        edges += edge is not None
    assert edges == 2


def test_arbitration():
    step, block, kinds = stateful.arbitration_step(2.0, 5000, {1: 1.0, 9: 2.5}), None, []
    # what is observed before the block is placed changes nothing
    for t, payload, kind in ((-3, "a", "Emergence"), (-2, "", "Vanishing")):
        block, out = step(block, {"id": 1, "t": t, "payload": payload, "source": 9})
        assert block is None and out[0][2:4] == (kind, False)
    block, out = step(block, {"id": 1, "t": -1, "payload": "a", "source": 9, "put": True})
    assert out[0][2:] == ("Put", True, "Pending", "a", 1)
    for t, payload, source in ((0, "a", 9), (10, "b", 1), (20, "a", 1), (30, "b", 1), (40, "c", 1), (50, "b", 1), (60, "", 9), (70, "x", 1), (9000, "x", 1)):
        block, out = step(block, {"id": 1, "t": t, "payload": payload, "source": source})
        kinds.append(out[0][2:4])
    assert kinds == [("Transient", True), ("Mutation", False), ("Transient", True), ("Mutation", False), ("Conflict", False), ("Mutation", True), ("Vanishing", True), ("Emergence", False), ("Emergence", False)]
    assert (block["payload"], block["state"], block["version"]) == ("", "Changing", 3)
    # a candidate that is not there yet is a mutation of an empty block as well
    low = stateful.arbitration_step(9.0, 5000, {1: 1.0})
    assert low(block, {"id": 1, "t": 9100, "payload": "x", "source": 1})[1][0][2:4] == ("Mutation", False)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i % 7, i, rng.choice([-1.0, 0.5, 2.0])) for i in range(700)]
    schema = "id long, tick long, value double"
    step, out = stateful.edge_step(1, 0, 2, 5), "id long, tick long, high boolean"
    batch = stateful.run_batch(frame(spark, rows, schema), "id", ["tick"], step, out)
    source = tmp_path / "in"
    for part in range(3):
        frame(spark, rows[part * 250 : (part + 1) * 250], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stateful.run_stream(stream, "id", ["tick"], step, out).writeStream.format("memory").queryName("edges").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        assert query.awaitTermination(150)
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("edges").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_fold_sink(spark, tmp_path):
    rows = [(i, f"e{i % 3}", "k", float(i)) for i in range(30)]
    frame(spark, rows, "seq long, entity string, key string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, entity string, key string, value double").parquet(str(tmp_path / "in"))
    query = stateful.sink_fold(stream, str(tmp_path / "out"), str(tmp_path / "ck"), events.fold)
    assert query.awaitTermination(120)
    assert {r.entity: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"e0": 27.0, "e1": 28.0, "e2": 29.0}


def test_information_scores(spark):
    obs = [("a", 1, "plate", 1), ("a", 1, "colour", 1), ("a", 1, "brand", 1)]
    score = lambda n: entity.information(frame(spark, obs[:n], "anchor string, bucket long, key string, source int"), {"plate": 3.0}).first()["info"]
    assert [round(score(n), 2) for n in (1, 2, 3)] == [2.08, 2.77, 3.47]


def test_decay_and_clamp(spark):
    got = spark.range(1).select(scalars.decayed(F.lit(1.0), F.lit(100), 100).alias("a"), scalars.decayed(F.lit(1.0), F.lit(600), 100).alias("b"), scalars.decayed(F.lit(1.0), F.lit(-5), 100).alias("c")).first()
    assert tuple(got) == (0.5, 0.015625, 1.0)
    feedback = frame(spark, [("s", 1, True), ("s", 2, False)], "source string, seq long, good boolean")
    assert round(signals.clamped_fold(feedback, 0.5, 0.02, 0.05).first()["reliability"], 9) == 0.47
    assert signals.clamped_fold(feedback.where("not good"), 0.06, 0.02, 0.05).first()["reliability"] == 0.05


def test_diffusion_numbers(spark):
    edges = frame(spark, [("ka", "kb", "CAUSE", 1.0), ("ev", "kb", "CONTAINS", 1.0)], "src string, dst string, type string, weight double")
    seeds = frame(spark, [("ka", 1.0)], "node string, energy double")
    run = lambda **k: {r.node: round(r.energy, 6) for r in graph.diffuse(edges, seeds, {"CAUSE": 0.9, "CONTAINS": 0.8}, 2, **k).collect()}
    got = run()
    assert got["kb"] == pytest.approx(0.9 * 0.5 * 0.5) and "ev" in got
    assert "ev" not in run(blocked=frame(spark, [("kb",)], "node string"))


def test_paths_and_hashes(spark):
    row = spark.range(1).select(scalars.parse_path(F.lit("1/2/3")).alias("ok"), scalars.parse_path(F.lit("1//3")).alias("bad"), scalars.fnv1a64_hex(F.lit("hello")).alias("h"), frames.longitude(F.lit(181.0)).alias("lng"), scalars.geohash(F.lit(57.64911), F.lit(10.40744)).alias("g")).first()
    assert (row.ok, row.bad, row.h, row.lng, row.g) == ([1, 2, 3], None, "a430d84680aabd0b", -179.0, "u4pruy")


def test_hash_embedding_is_unit_length():
    v = embedding.hash_embedding("状态 ok")
    assert abs(float((v**2).sum()) - 1) < 1e-5
    assert not embedding.hash_embedding("").any()


def test_resolution_decides():
    from chronofold.streaming.resolve import resolve_step

    step, state, out = resolve_step({"plate": 3.0}), None, []
    entry = lambda k, v, s: {"key": k, "value": v, "source": s}
    for bucket, entries in enumerate((
        [entry("plate", "A", 1)],
        [entry("plate", "A", 1), entry("colour", "red", 1), entry("brand", "x", 1)],
        [entry("plate", "A", 2), entry("colour", "red", 2), entry("brand", "x", 2)],
        [entry("plate", "B", 1), entry("colour", "blue", 1), entry("brand", "y", 1)],
        [entry("wheels", "4", 1), entry("doors", "5", 1), entry("size", "L", 1), entry("roof", "y", 1), entry("seats", "2", 1)],
    )):
        state, made = step(state, {"anchor": "gate", "bucket": bucket, "entries": entries})
        out.append(made[0][2:4])
    assert out == [("pool", None), ("new", "gate#1"), ("merge", "gate#1"), ("new", "gate#2"), ("disputed", "gate#1")]


def test_snapshots_and_tools(spark, tmp_path):
    import json

    from chronofold.plans.registry import Registry, commands
    from chronofold.sources import snapshots

    writes = frame(spark, [(n, f"e{n % 2}", "k", float(n)) for n in range(1, 9)], "seq long, entity string, key string, value double")
    for seq in (4, 8):
        snapshots.save_snapshot(events.fold(writes, seq), str(tmp_path / "snap"), seq)
    at = lambda upto: {r.entity: r.value for r in snapshots.latest_snapshot(spark, str(tmp_path / "snap"), upto).collect()}
    assert at(7) == {"e0": 4.0, "e1": 3.0} and at(None) == {"e0": 8.0, "e1": 7.0} and at(3) == {}
    blocks = frame(spark, [(1, 0.0, 2.0, 0.0, 2.0, 0.0, 2.0, 5, "oak", "Stable", 0.9, 0), (2, 50.0, 52.0, 0.0, 2.0, 0.0, 2.0, 95, "elm", "Pending", 0.5, 0)], "id long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double, t long, payload string, state string, confidence double, level int")
    snapshots.save_shards(blocks, str(tmp_path / "blocks"), 10.0, 30)
    assert [r.id for r in snapshots.read_shards(spark, str(tmp_path / "blocks"), 90, 99, 30).collect()] == [2]
    tools = snapshots.tools(blocks, None, None)
    asked = ['{"cmd":"schemas"}', '{"cmd":"call","name":"query","args":{"region":[0,0,0,9,9,9],"first":0,"last":99}}', '{"cmd":"vql","text":"FIND"}']
    got = [json.loads(x) for x in commands(asked, tools, lambda t: vql.execute(t, blocks))]
    assert got[0]["ok"] and [r["id"] for r in got[1]["result"]] == [1] and not got[2]["ok"]
    registry = Registry()
    pinned = registry.register("double", lambda x: x * 2, ["t"])
    assert [r.o for r in registry.apply(blocks, "double", "o").orderBy("id").collect()] == [10, 190] and len(pinned) == 64
    with pytest.raises(ValueError):
        registry.register("double", lambda x: x * 3, ["t"], pinned)


def test_sphere_cells_miss_nothing(spark):
    from chronofold.functions import coordinates

    rng = random.Random(8)
    places = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(300)]
    df = frame(spark, places, "id int, lat double, lng double")
    cell = F.struct(F.floor(F.col("lat") / 10).alias("i"), F.pmod(F.floor((F.col("lng") + 180) / 10), F.lit(36)).alias("j"))
    near = coordinates.sphere_cells(F.col("lat"), F.col("lng"), F.lit(1200.0), 6371.0, 10.0)
    b = df.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), cell.alias("cell"))
    pairs = df.withColumn("cell", F.explode(near)).join(b, "cell").where(coordinates.sphere_distance(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"), 6371.0) <= 1200)
    got = sorted((r.id, r.b) for r in pairs.collect())

    def away(p, q):
        v = [(math.cos(math.radians(a)) * math.cos(math.radians(g)), math.cos(math.radians(a)) * math.sin(math.radians(g)), math.sin(math.radians(a))) for _, a, g in (p, q)]
        return 2 * 6371 * math.asin(min(1, math.dist(*v) / 2))

    assert got == sorted((p[0], q[0]) for p in places for q in places if away(p, q) <= 1200)
    moving = spark.range(1).select(coordinates.chart_velocity(lambda s: F.array(F.cos(s), F.sin(s)), [F.lit(0.0)], [F.lit(2.0)]).alias("v")).first()["v"]
    assert moving == pytest.approx([0.0, 2.0], abs=1e-4)


def test_traversal_view_takes_three_steps(spark):
    from chronofold.plans import catalog
    from chronofold.sources.bindings import supplier_edges

    data = "/root/testdata/sf0.001"
    edges = {(r.src, r.dst, r.type) for r in supplier_edges(spark, data).collect()}
    near = {"s1"}
    for _ in range(3):
        near |= {b for x, y, _ in edges for a, b in ((x, y), (y, x)) if a in near}
    got = [tuple(r) for r in catalog.QUERIES["graph_traversal_view"](spark, data).select("src", "dst", "type").collect()]
    assert len(got) == len(set(got)) and set(got) == {e for e in edges if e[0] in near and e[1] in near}
    assert set(got) > {tuple(r) for r in catalog.QUERIES["graph_traversal"](spark, data).select("src", "dst", "type").collect()}
