"""Settlement, buttons, journals, scenes, knowledge and upkeep in small exact cases."""

import json
import random

from pyspark.sql import functions as F

from chronofold.operators import entity, graph, knowledge, rules, scenes, settle, settlement, spatial, upkeep
from chronofold.operators.rules import Value
from chronofold.plans import buttons, registry
from chronofold.sources import journal


def test_settlement_keeps_state_between_candidates(spark):
    grow = {"id": "R", "effect": "filter", "on_types": ["set"], "deps": ["n", "top"], "expr": {"<=": [{"var": "n"}, {"+": [{"var": "top"}, 1]}]}}
    rows = [
        (1, "a", "set", {"n": 1}, "k1"), (2, "a", "set", {"n": 5}, "k2"), (3, "a", "raise", {"top": 4}, None), (4, "a", "set", {"n": 5}, "k2"), (5, "a", "set", {"n": 9}, "k2"),
        (6, "b", "set", {"n": 2}, None), (7, "b", "set", {}, None), (8, "a", "set", {"n": "x"}, None), (9, "c", "set", {"n": 8}, None),
    ]
    table = spark.createDataFrame([(i, e, t, json.dumps(w), k) for i, e, t, w, k in rows], "id long, entity string, type string, writes string, idempotency_key string")
    before = spark.createDataFrame([("c", '{"top": 7}')], "entity string, writes string")
    got = {r.id: (r.accepted, r.layer, list(r.reasons)) for r in settlement.settle(table, [grow], before).collect()}
    fine = (True, None, [])
    # 2 is refused and its key free again; 5 repeats the key of 4; text is no number, so the rule rejects
    assert got == {1: fine, 2: (False, 3, ["R"]), 3: fine, 4: fine, 5: fine, 6: (False, 3, ["R"]), 7: (False, 1, ["no writes"]), 8: (False, 3, ["R"]), 9: fine}


def test_rules_mean_the_same_compiled_and_evaluated(spark):
    rng = random.Random(2)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([{"var": "a"}, {"var": "b"}, rng.randint(-3, 3), 0.5])
        op = rng.choice(["+", "-", "*", "/", "%"])
        return {op: [made(depth - 1), made(depth - 1)]}

    exprs = [{rng.choice(["<", "<=", ">", "=="]): [made(2), made(2)]} for _ in range(30)]
    rows = [(i, rng.randint(-3, 3), rng.choice([None, 0, 2, -1])) for i in range(40)]
    df = spark.createDataFrame([(i, float(a), None if b is None else float(b)) for i, a, b in rows], "id int, a double, b double")
    variables = {"a": Value(F.col("a"), "number"), "b": Value(F.col("b"), "number")}
    columns = [rules.rejects({"expr": e, "deps": ["a", "b"]}, variables, {}, "write").alias(f"r{n}") for n, e in enumerate(exprs)]
    for row in df.select("id", *columns).collect():
        _, a, b = rows[row.id]
        for n, e in enumerate(exprs):
            own = bool(settlement.judge([{"id": "R", "expr": e}], {}, "t", {"a": float(a), "b": None if b is None else float(b)}))
            assert own == row[f"r{n}"], (e, a, b)


def test_transitions_and_long_keys(spark):
    rows = [(1, n, s) for n, s in enumerate(["open", "shut", "shut", "open", "locked"])] + [(2, n, "open") for n in range(5000)]
    got = settlement.transitions(spark.createDataFrame(rows, "id long, n long, state string"), "id", "n", "state", {None: ["open"], "open": ["shut"], "shut": ["open", "locked"]}).collect()
    assert [(r.accepted, r.held) for r in sorted(got, key=lambda r: (r.id, r.n)) if r.id == 1] == [(True, "open"), (True, "shut"), (False, "shut"), (True, "open"), (False, "open")]
    assert sum(r.accepted for r in got if r.id == 2) == 1


def test_buttons(spark):
    small = {"id": "R", "effect": "filter", "deps": ["load", "mode"], "expr": {"or": [{"<": [{"var": "load"}, 5]}, {"==": [{"var": "mode"}, "slow"]}]}}
    run = buttons.EventType("run", ["mode"], ["load", "note"], {"note": "n"}, [small])
    many = buttons.EventType("many", ["mode"], [], {}, [small], multi_target=True)
    fixed = buttons.EventType("fixed", ["mode"], [], {"mode": "fast"}, [small])
    df = spark.createDataFrame([(1, 3.0, "fast", "x"), (2, 9.0, None, None)], "id int, load double, mode string, note string")
    variables = {"load": Value(F.col("load"), "number"), "mode": Value(F.col("mode"), "string"), "note": Value(F.col("note"), "string")}
    got = {r.id: {b.type: b for b in r.buttons} for r in buttons.with_buttons(df, [run, many, fixed], variables, {"mode": ["fast", "slow"]}, {"run": {"note": "own"}}).collect()}
    assert got[1]["run"].options == {"mode": ["fast", "slow"]} and got[2]["run"].options == {"mode": ["slow"]}
    assert got[1]["run"].presets == {"note": "own"} and got[1]["run"].context == {"mode": "fast", "load": "3.0"} and got[2]["run"].context == {"load": "9.0"}
    # a type of many targets has no options, so its presets are judged; a preset value is always an option
    assert (got[1]["many"].enabled, got[2]["many"].enabled, list(got[2]["many"].reasons), got[2]["many"].options) == (True, False, ["R"], {})
    assert got[2]["fixed"].options == {"mode": ["fast", "slow"]} and got[2]["fixed"].enabled
    shown = buttons.actions(spark, [run, many], {"mode": ["fast", "slow"]}).orderBy("place").collect()
    assert [(r.type, r.options) for r in shown] == [("run", {"mode": ["fast", "slow"]}), ("many", {})]


def test_journal_survives_what_is_cut_off(spark, tmp_path):
    schema = "key string, seq long, gone boolean, value long"
    own = journal.Journal(spark, f"file://{tmp_path}/j", schema)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    now = lambda j: {r.key: r.value for r in j.read().collect()}
    assert now(own) == {}
    own.append(rows(("a", 1, False, 1), ("b", 2, False, 2)))
    own.append(rows(("a", 3, False, 5), ("b", 4, True, None)))
    assert now(own) == {"a": 5}
    own.checkpoint()
    own.append(rows(("c", 5, None, 7)))
    (tmp_path / "j" / "batch" / "9").mkdir()  # a batch without its marker
    again = journal.Journal(spark, f"file://{tmp_path}/j", schema)
    assert now(again) == {"a": 5, "c": 7}
    assert again.checkpoint() == 3 and again.checkpoint() == 3 and now(again) == {"a": 5, "c": 7}


def test_snapshot_of_tables(spark, tmp_path):
    tables = {"concept": spark.sql("SELECT 'k' AS id"), "edge": spark.sql("SELECT 'a' AS src, 'b' AS dst")}
    knowledge.dump(tables, f"file://{tmp_path}/o")
    knowledge.dump(tables, f"file://{tmp_path}/o")
    back = knowledge.restore(spark, ["concept", "edge"], f"file://{tmp_path}/o")
    assert {n: [tuple(r) for r in df.collect()] for n, df in back.items()} == {"concept": [("k",)], "edge": [("a", "b")]}


def test_constants():
    assert len(knowledge.STOP_WORDS) == 20 and len(knowledge.ROOT_TOPICS) == 30 and knowledge.ALIASES["车子"] == "车"


def test_sweep_is_strict(spark):
    rows = [(1, "Changing", "x", 0, 1.0, 0), (2, "Changing", "x", 1, 1.0, 0), (3, "Stable", "x", 0, 1.0, 0), (4, "Changing", "x", -1, 1.0, 0)]
    df = spark.createDataFrame(rows, "id int, state string, pending_payload string, window_start int, window_weight double, last_update int")
    assert [r.id for r in upkeep.sweep(df, 11, 10).where("swept").collect()] == [1]
    assert upkeep.sweep(df, 11, 0).where("swept").isEmpty()


def test_nearest_in_time_ties(spark):
    known = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (0, "a", 20), (3, "a", 31), (9, "b", 5)], "id int, u string, t int")
    probes = spark.createDataFrame([(100, "a", 15), (101, "a", 26), (102, "a", 0), (103, "a", 20), (104, "c", 5)], "id int, u string, t int")
    got = {r.id: r.near_id for r in upkeep.nearest_in_time(probes, known, "u").collect()}
    assert got == {100: 1, 101: 3, 102: 1, 103: 0}


def test_closures_have_no_depth_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(22)] + [("n22", "n0")], "child string, parent string")
    closure = graph.ancestors(edges)
    assert closure.where("node = 'n0'").count() == 22 and closure.agg(F.max("depth")).first()[0] == 22
    assert graph.descendants(edges, "n5").count() == 23
    assert graph.ancestors(edges, 3).agg(F.max("depth")).first()[0] == 3
    chain = {r.ancestor: r.path for r in graph.paths(edges.where("child <> 'n22'")).where("node = 'n0'").collect()}
    assert chain["n22"] == [f"n{i}" for i in range(23)]


def test_beam_keeps_the_strongest(spark):
    edges = spark.createDataFrame([("a", "b", "R", 3.0), ("a", "c", "R", 1.0), ("b", "d", "R", 1.0), ("c", "e", "R", 1.0)], "src string, dst string, type string, weight double")
    seeds = spark.createDataFrame([("a", 10.0)], "node string, energy double")
    all_nodes = {r.node for r in graph.diffuse(edges, seeds, {"R": 1.0}).collect()}
    beamed = {r.node for r in graph.diffuse(edges, seeds, {"R": 1.0}, beam=1).collect()}
    assert all_nodes == {"a", "b", "c", "d", "e"} and beamed == {"a", "b", "c", "d"}


def test_pairs_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIR_MEMBERS", 7)
    rows = [("g", f"m{i}") for i in range(40)] + [("h", "m1"), ("h", "m2"), ("h", "m2")]
    got = {(r.a, r.b): r.weight for r in graph.co_occurrence(spark.createDataFrame(rows, "g string, m string"), "g", "m").collect()}
    assert len(got) == 780 and got[("m1", "m2")] == 2 and sum(got.values()) == 781


def test_eviction_counts_to_its_cut(spark, monkeypatch):
    monkeypatch.setattr(spatial, "RANGES", 5)
    monkeypatch.setattr(spatial, "LAST_RANGE", 3)
    rng = random.Random(4)
    at = {i: rng.randint(0, 60) for i in range(300)}
    blocks = spark.createDataFrame([(i,) for i in at], "id long")
    accesses = spark.createDataFrame([(i, t) for i, t in at.items()] + [(i, t - 1) for i, t in at.items()], "id long, at long")
    for capacity in (0, 1, 57, 299, 300, 900):
        want = sorted(at, key=lambda i: (-at[i], -i))[:capacity]
        assert sorted(r.id for r in spatial.evict(blocks, accesses, capacity).collect()) == sorted(want), capacity
    assert spatial.evict(blocks, accesses.limit(0), 5).collect() == []


def test_blocking_keys_lose_no_candidate(spark):
    rng = random.Random(9)
    names = ["x", "y", "x/1", "x/1/a", "x/2", "y/1", "y/1/b", "z/1"]
    rows = [(i, rng.choice(names), rng.randint(0, 3)) for i in range(60)]
    probes = spark.createDataFrame(rows, "profile long, anchor string, bucket long")
    got = {(r.profile, r.candidate) for r in entity.candidates(probes, probes.withColumn("level", F.lit(0)), 1).collect()}

    def near(a, b):
        if a == b:
            return True
        p, s = a.split("/"), b.split("/")
        return "/" in a and "/" in b and p[0] == s[0]

    assert got == {(i, j) for i, a, s in rows for j, b, t in rows if i != j and abs(s - t) <= 1 and near(a, b)}


def test_cascade_is_bounded(spark):
    events = spark.createDataFrame([(1, 1.0)], "seq long, value double")
    again = lambda df: df.withColumn("value", F.col("value") + 1)
    assert sorted(r["round"] for r in settle.cascade(events, [again]).collect()) == [0, 1, 2, 3, 4]


def test_reader_says_that_there_is_more(spark):
    tools = {"all": lambda: spark.range(5)}
    asked = ['{"cmd": "call", "name": "all"}']
    cut, = (json.loads(x) for x in registry.commands(asked, tools, lambda text: spark.range(0), 3))
    whole, = (json.loads(x) for x in registry.commands(asked, tools, lambda text: spark.range(0), 5))
    assert cut["more"] and len(cut["result"]) == 3 and "more" not in whole


def test_scene_states(spark):
    table = spark.createDataFrame([(1, "a", [1], "Active"), (2, "b", [2, 3], "Active")], "scene long, name string, root array<int>, state string")
    objects = spark.createDataFrame([(10, [1, 5]), (11, [1]), (12, [2, 3, 4]), (13, [12, 3])], "object long, path array<int>")
    changed, left = scenes.set_state(table, objects, 1, scenes.UNLOADED)
    # what lies at the root itself stays, and 12 does not lie under 1
    assert {r.object for r in left.collect()} == {11, 12, 13}
    assert {r.scene: r.state for r in changed.collect()} == {1: "Unloaded", 2: "Active"}
    assert {r.object: r.scene for r in scenes.owners(objects, table).collect()} == {10: 1, 11: 1, 12: 2, 13: None}


def test_ingest_is_idempotent(spark):
    fields = "profile_id string, seq long, event_id string, subject string, verb string, object string, place string, subject_entity string, subject_type string, subject_confidence double, object_entity string, object_type string, object_confidence double, place_entity string, place_type string, place_confidence double"
    p = spark.createDataFrame([("p1", 1, "e1", "Ann", "eats", "pie", "", "x1", "Person", 0.5, "", None, None, "", None, None)] * 2, fields)
    concepts = spark.createDataFrame([("k:pie", "pie")], "id string, name string")
    types = spark.createDataFrame([("Person", "k:person")], "entity_type string, concept string")
    made = knowledge.ingest(p, concepts, types)
    assert {tuple(r) for r in made["instances"].collect()} == {("i:Anneatspie", "Anneatspie", "e1"), ("i:Ann", "Ann", "x1"), ("i:pie", "pie", "")}
    assert {tuple(r) for r in made["edges"].collect()} == {("i:Ann", "k:person", "INSTANCE_OF", 0.5), ("i:pie", "k:pie", "INSTANCE_OF", 1.0), ("i:Ann", "i:Anneatspie", "SUBJECT_OF", 1.0), ("i:pie", "i:Anneatspie", "OBJECT_OF", 1.0)}
    none = knowledge.ingest(p, concepts, types, p.select("profile_id"))
    assert none["instances"].isEmpty() and none["edges"].isEmpty()
