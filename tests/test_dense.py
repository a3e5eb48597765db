"""Joins over many copies in one place: right results, and no more rows between than the job needs."""

import random

from pyspark.sql import functions as F

from chronofold.operators import graph, spatial, upkeep

COLS = "id long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"
#: Copies of one box; their pairs are a million.
COPIES = 1_000


def boxes(spark, rows, more=""):
    return spark.createDataFrame(rows, COLS + more).repartition(2)


def meet(p, q):
    return None not in p[1:] + q[1:] and all(p[k] <= q[k + 1] and q[k] <= p[k + 1] for k in (1, 3, 5))


def joined(spark, run):
    """The result of run(), and the most rows that a join made in it."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, most = store.executionsCount(), 0
    out = run().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(before, 1_000).iterator()
    while ran.hasNext():
        k = ran.next().executionId()
        counts, nodes = store.executionMetrics(k), store.planGraph(k).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while "Join" in node.name() and metrics.hasNext():
                m = metrics.next()
                if m.name() == "number of output rows" and counts.contains(m.accumulatorId()):
                    most = max(most, int(counts.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def some(rng, ids, step=1):
    """Boxes on a coarse raster, so that many are equal and many touch, and a few without a side."""

    def box():
        low = [rng.randrange(0, 24, step) for _ in range(3)]
        return [float(c) for x in low for c in (x, x + rng.choice([1, 2, 5]))]

    return [(i, *(None if rng.random() < 0.01 else c for c in box())) for i in ids]


def test_occupants_of_copies(spark):
    place = (0.0, 1.0, 0.0, 1.0, 0.0, 1.0)
    blocks, instances = boxes(spark, [(i, *place) for i in range(COPIES)]), boxes(spark, [(i, *place) for i in range(COPIES)])
    got, most = joined(spark, lambda: spatial.occupants(blocks, instances, 8.0).select("id", F.size("instances").alias("n")))
    assert sorted(map(tuple, got)) == [(i, COPIES) for i in range(COPIES)] and most <= 5 * COPIES


def test_occupants_is_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    a, b = some(rng, [*range(300), *range(40), None, None], 3), some(rng, range(80), 3)
    for most in (spatial.BROADCAST, 10):
        monkeypatch.setattr(spatial, "BROADCAST", most)
        got = {r.id: r.instances for r in spatial.occupants(boxes(spark, a + a[:20]), boxes(spark, b), 4.0).collect()}
        # ids that come twice have the instances of all their boxes
        want = {i: sorted({q[0] for p in a if p[0] == i for q in b if meet(p, q)}) for i in {p[0] for p in a}}
        assert got == {i: x for i, x in want.items() if x}


def test_association_of_copies(spark):
    place = (0.0, 1.0, 0.0, 1.0, 0.0, 1.0)
    seen = boxes(spark, [(i, *place, "a", 0) for i in range(COPIES)], ", label string, t long")
    known = boxes(spark, [(i, *place, "a", 3) for i in range(COPIES)], ", label string, last_seen long").withColumnRenamed("id", "instance")
    got, most = joined(spark, lambda: upkeep.associate(seen, known, 3, 8.0))
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(COPIES)] and most <= 10 * COPIES


def test_association_is_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    with_label = lambda rows: [(*r, rng.choice(["a", "b", None]), rng.randrange(-20, 20)) for r in rows]
    a, b = with_label(some(rng, [*range(150), *range(20)], 3)), with_label(some(rng, [*range(400), None], 3))
    seen, known = boxes(spark, a, ", label string, t long"), boxes(spark, b, ", label string, last_seen long").withColumnRenamed("id", "instance")
    fits = lambda p, q: q[0] is not None and meet(p[:7], q[:7]) and p[7] is not None and p[7] == q[7] and abs(p[8] - q[8]) <= 4
    want = {i: min((q[0] for p in a if p[0] == i for q in b if fits(p, q)), default=None) for i in range(150)}
    assert None in want.values() and max(x for x in want.values() if x is not None) > 100
    for first, most in ((upkeep.SLICE, upkeep.SPREAD), (5, 0), (40, upkeep.SPREAD)):
        monkeypatch.setattr(upkeep, "SLICE", first)
        monkeypatch.setattr(upkeep, "SPREAD", most)
        got = sorted(map(tuple, upkeep.associate(seen, known, 4, 8.0).collect()))
        assert got == sorted(want.items())


def test_slices_hold_every_id_once(spark):
    ids = spark.range(1_000).select(F.col("id") * 7 % 1_000)
    cuts = upkeep.slices(ids.toDF("n"), 20)
    assert len(cuts) == 3
    assert sorted(r.n for x in cuts for r in ids.toDF("n").where(x).collect()) == list(range(1_000))
    assert len(upkeep.slices(ids.toDF("n"), 1_000)) == 1


def test_refined_of_copies(spark):
    place = (0.0, 1.0, 0.0, 1.0, 0.0, 1.0)
    blocks = boxes(spark, [(i, *place, i % 2) for i in range(2 * COPIES)], ", level int")
    got, most = joined(spark, lambda: spatial.refined(blocks, 8.0))
    assert sorted(map(tuple, got)) == [(2 * i, True) for i in range(COPIES)] and most <= 5 * COPIES


def test_refined_is_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(*r, rng.choice([0, 0, 1, 2, None])) for r in some(rng, range(200), 2)]
    want = [(p[0], any(q[7] and meet(p[:7], q[:7]) for q in rows)) for p in rows if p[7] == 0]
    assert 10 < sum(x for _, x in want) < len(want) - 10
    for most in (spatial.BROADCAST, 0):
        monkeypatch.setattr(spatial, "BROADCAST", most)
        assert sorted(map(tuple, spatial.refined(boxes(spark, rows, ", level int"), 4.0).collect())) == want


def test_suspects_of_copies(spark):
    low = [(i, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, "stone") for i in range(COPIES)]
    high = [(COPIES + i, 0.0, 1.0, 0.0, 1.0, 1.0, 2.0, "") for i in range(COPIES)]
    ground = [(2 * COPIES + i, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, "ground") for i in range(COPIES)]
    blocks = boxes(spark, low + high + ground, ", payload string")
    got, most = joined(spark, lambda: spatial.suspects(blocks, ["ground"], [""], 4.0))
    # ground under emptiness; all others rest on one another
    assert sorted(map(tuple, got)) == [(i, i >= 2 * COPIES) for i in range(3 * COPIES)] and most <= 5 * COPIES


def test_suspects_is_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(*r, rng.choice(["ground", "ground", "", "stone", None])) for r in some(rng, [*range(150), None, None], 4)]
    want = []
    for p in rows:
        low, top = p[5:7] if None not in p[5:7] else (float("nan"),) * 2  # meets nothing
        up, down = (*p[:5], top, 2 * top - low), (*p[:5], 2 * low - top, low)
        other = [q for q in rows if None not in (p[0], q[0]) and q[0] != p[0]]
        want.append((p[0], any(q[7] == "" and meet(up, q[:7]) for q in other) if p[7] == "ground" else not any(meet(down, q[:7]) for q in other)))
    assert 10 < sum(x for _, x in want) < len(want) - 10
    for most in (spatial.BROADCAST, 0):
        monkeypatch.setattr(spatial, "BROADCAST", most)
        got = spatial.suspects(boxes(spark, rows, ", payload string"), ["ground"], [""], 4.0).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def limited(spark, key, most, run):
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        return sorted(map(tuple, run().collect()))
    finally:
        spark.conf.set(key, before)


def test_recursive_ancestors_have_no_row_limit(spark):
    # 200 leaves under two ways up, of which one is a cycle, and a repeated edge
    rows = [(f"c{i}", f"n{i % 2}") for i in range(200)] + [("n0", "r"), ("n1", "r"), ("n1", "r"), ("r", "s"), ("s", "r"), ("n0", "n1")]
    edges = spark.createDataFrame(rows, "child string, parent string")
    got = limited(spark, "spark.sql.cteRecursionRowLimit", "100", lambda: graph.ancestors_sql(spark, edges, most=8))
    assert got == sorted(map(tuple, graph.ancestors(edges).collect())) and len(got) > 600


def test_recursive_ancestors_as_deep_as_asked(spark):
    edges = spark.createDataFrame([("x", "a"), ("a", "b"), ("b", "a")], "child string, parent string")
    # the way from x never ends, so the query goes as deep as it may
    got = limited(spark, "spark.sql.cteRecursionLevelLimit", "5", lambda: graph.ancestors_sql(spark, edges, most=8))
    assert got == [("a", "b", 1), ("b", "a", 1), ("x", "a", 1), ("x", "b", 2)]
