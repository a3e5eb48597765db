"""Graph operators as bounded sequences of joins: closures, neighbourhoods, diffusion and rule chaining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.sources.scratch import written

#: Relation types that are read in both directions.
UNDIRECTED = ("SIMILAR", "OPPOSITE", "CO_OCCURS", "RELATED")


def ancestors(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, ancestor, depth) for all nodes of child -> parent edges, with the least depth.

    Each round joins the frontier with the edges and drops what is known, so
    cycles end; rounds stop when nothing new is found, or at `most` steps if asked.
    Every round is written, so plans stay as short as one round.
    """
    step = written(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "edges")
    known = step.withColumn("depth", F.lit(1))
    frontier, up, depth = known, step.select(F.col("node").alias("via"), F.col("ancestor").alias("next")), 1
    while most is None or depth < most:
        depth += 1
        found = frontier.join(up, F.col("ancestor") == F.col("via")).where("node <> next").select("node", F.col("next").alias("ancestor")).distinct()
        frontier = written(found.join(known, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def ancestors_sql(spark, edges: DataFrame, name: str = "edges_", most: int = 100) -> DataFrame:
    """The same as one recursive query, which needs a limit of its own.

    LIMIT ALL lifts Spark's limit of a million rows (spark.sql.cteRecursionRowLimit).
    Each step drops repeated rows, so it holds a pair once however many ways lead up.
    """
    edges.createOrReplaceTempView(name)
    return spark.sql(f"""
        WITH RECURSIVE up(node, ancestor, depth) MAX RECURSION LEVEL {most + 1} AS (
            SELECT DISTINCT child, parent, 1 FROM {name}
            UNION ALL SELECT DISTINCT u.node, e.parent, u.depth + 1 FROM up u JOIN {name} e ON u.ancestor = e.child WHERE u.depth < {most} AND e.parent <> u.node)
        SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY node, ancestor LIMIT ALL""")


def descendants(edges: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """(node, depth) below a root, as deep as it goes or to `most` steps."""
    frontier = known = edges.where(F.col("parent") == root).select(F.col("child").alias("node")).distinct().withColumn("depth", F.lit(1))
    depth = 1
    while most is None or depth < most:
        depth += 1
        below = edges.join(frontier.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        frontier = written(below.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)), "descent")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def paths(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, ancestor, path): the shortest chain of edges upward, ties by the least path.

    A round keeps the least chain to each ancestor that no shorter one reached.
    """
    rows = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.array("child", "parent").alias("path")).distinct()
    out, length = rows, 1
    while most is None or length < most:
        length += 1
        longer = rows.join(edges, F.col("ancestor") == F.col("child")).where(~F.array_contains("path", F.col("parent"))).select("node", F.col("parent").alias("ancestor"), F.concat("path", F.array("parent")).alias("path"))
        best = longer.groupBy("node", "ancestor").agg(F.min("path").alias("path"))
        rows = written(best.join(out.select("node", "ancestor").distinct(), ["node", "ancestor"], "left_anti"), "paths")
        if rows.isEmpty():
            break
        out = out.unionByName(rows)
    return out.groupBy("node", "ancestor").agg(F.min_by("path", F.struct(F.size("path"), F.col("path"))).alias("path"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def neighbours(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(node, neighbour, type, weight): out-edges and reversed in-edges."""
    chosen = edges if types is None else edges.where(F.col("type").isin(types))
    return both_ways(chosen).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "type", "weight").distinct()


def within(edges: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """(node, depth) of the nodes within a number of undirected steps; the root is always among them."""
    spark = edges.sparkSession
    links = both_ways(edges.select("src", "dst")).distinct()
    known = frontier = spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"))
    for step in range(1, depth + 1):
        fresh = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti").withColumn("depth", F.lit(step))
        known, frontier = known.unionByName(fresh), fresh
    return known


def merge_edges(edges: DataFrame) -> DataFrame:
    """Repeated edges become one of the greatest weight."""
    return edges.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))


def accumulate_edges(edges: DataFrame) -> DataFrame:
    """Repeated edges become one of the summed weight."""
    return edges.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"))


#: Members of a group that one task compares with all others of it.
PAIR_MEMBERS = 2_000


def co_occurrence(members: DataFrame, group: str, item: str, least: int = 3) -> DataFrame:
    """Unordered pairs of items within a group: a, b, weight and whether the weight is settled (>= least).

    A group of many members is cut: each part of it meets a copy of the whole, so
    its pairs are made by as many tasks as it has parts.
    """
    each = members.select(group, F.col(item).alias("a")).distinct()
    parts = each.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / PAIR_MEMBERS).cast("int").alias("_parts"))
    sized = each.join(parts, group)
    left = sized.select(group, "a", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int").alias("_part"))
    right = sized.select(group, F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    counted = left.join(right, [group, "_part"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return counted.withColumn("settled", F.col("weight") >= least)


def diffuse(edges: DataFrame, seeds: DataFrame, coefficients: dict[str, float], depth: int = 2, prune: float = 0.01, blocked: DataFrame | None = None, beam: int | None = None) -> DataFrame:
    """Spreading activation: (node, energy).

    A node passes on energy * coefficient * w/(1+w) * (h+1)/(h+2) / degree to
    each neighbour, h being the layer (0 for seeds) and degree the number of its
    neighbours; amounts under `prune` and blocked nodes receive nothing.  Each
    node passes on once, in the layer it is reached first, with the energy it
    has gathered in that layer; what comes later only adds up.  depth is held
    to 2..3.  beam keeps the strongest nodes of a layer (ties: least name).
    """
    coefficient = F.coalesce(*[F.when(F.col("type") == t, F.lit(float(c))) for t, c in coefficients.items()], F.lit(0.0))
    links = both_ways(edges.select("src", "dst", "type", "weight")).withColumn("share", coefficient * F.col("weight") / (1 + F.col("weight")))
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = links.join(degree, "src").select(F.col("src").alias("node"), "dst", (F.col("share") / F.col("degree")).alias("share"))
    if blocked is not None:
        links = links.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")
    total = frontier = seeds.select("node", F.col("energy").cast("double").alias("energy"))
    done = seeds.select("node")
    for h in range(min(3, max(2, depth))):
        if beam is not None:
            frontier = frontier.orderBy(F.desc("energy"), "node").limit(beam)
        passed = frontier.join(links, "node").select(F.col("dst").alias("node"), (F.col("energy") * F.col("share") * (h + 1) / (h + 2)).alias("energy")).where(F.col("energy") >= prune)
        gathered = passed.groupBy("node").agg(F.sum("energy").alias("energy"))
        total = total.unionByName(gathered)
        frontier = gathered.join(done, "node", "left_anti")
        done = done.unionByName(frontier.select("node"))
    return total.groupBy("node").agg(F.sum("energy").alias("energy"))


def infer(facts: DataFrame, closure: DataFrame, rules: DataFrame, depth: int = 3) -> DataFrame:
    """Forward chaining: (subject, concept, relation, confidence, depth, path).

    facts (subject, concept, confidence); closure (node, ancestor) lets rules of
    ancestors fire too; rules (antecedent, relation, consequent, confidence).
    Confidence multiplies along a chain; a concept fires once per subject, by
    its most confident chain (ties: least path).
    """
    up = closure.select(F.col("node").alias("concept"), F.col("ancestor").alias("antecedent")).unionByName(rules.select(F.col("antecedent").alias("concept"), "antecedent").distinct())
    applicable = up.join(rules.withColumnRenamed("confidence", "strength"), "antecedent").select("concept", "relation", "consequent", "strength").distinct()
    applicable = written(applicable, "rules")
    frontier = facts.select("subject", "concept", "confidence", F.array("concept").alias("path"))
    fired, out = frontier.select("subject", "concept"), None
    for step in range(1, depth + 1):
        made = frontier.join(applicable, "concept").select("subject", F.col("consequent").alias("concept"), "relation", (F.col("confidence") * F.col("strength")).alias("confidence"), F.concat("path", F.array("consequent")).alias("path"))
        best = made.groupBy("subject", "concept").agg(F.max_by(F.struct("relation", "confidence", "path"), F.struct(F.col("confidence"), -F.size("path"))).alias("b"))
        fresh = written(best.join(fired, ["subject", "concept"], "left_anti").select("subject", "concept", "b.*").withColumn("depth", F.lit(step)), "inferred")
        out = fresh if out is None else out.unionByName(fresh)
        frontier = fresh.select("subject", "concept", "confidence", "path")
        fired = fired.unionByName(fresh.select("subject", "concept"))
    return out


def conflicts(inferences: DataFrame) -> DataFrame:
    """Adds conflict: the same subject and concept is both promoted and prevented."""
    w = W.partitionBy("subject", "concept")
    prevents = (F.col("relation") == "PREVENTS").cast("int")
    return inferences.withColumn("conflict", (F.max(prevents).over(w) == 1) & (F.min(prevents).over(w) == 0))
