"""Entity resolution by sets: profiles, information scores, bindings, merged views, credibility, blocking and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def profiles(observations: DataFrame) -> DataFrame:
    """Observations gathered per (anchor, bucket): entries (key, value, source, confidence, ts), sorted."""
    entry = F.struct("ts", "key", "value", "source", "confidence")
    return observations.groupBy("anchor", "bucket").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def information(observations: DataFrame, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """Score per profile: sum over keys of weight * ln(1 + distinct sources)."""
    weight = F.coalesce(*[F.when(F.col("key") == k, F.lit(float(w))) for k, w in weights.items()], F.lit(default))
    per_key = observations.groupBy("anchor", "bucket", "key").agg(F.countDistinct("source").alias("sources"))
    return per_key.groupBy("anchor", "bucket").agg(F.sum(weight * F.log1p("sources")).alias("info"))


def status(info: Column, threshold: float = 3.0) -> Column:
    return F.when(info >= threshold, "emerged").otherwise("pool")


def effective_bindings(bindings: DataFrame, keys: list[str]) -> DataFrame:
    """The last binding (by seq) of each profile, or profile and slot."""
    others = [c for c in bindings.columns if c not in keys]
    return bindings.groupBy(*keys).agg(F.max_by(F.struct(*others), "seq").alias("b")).select(*keys, "b.*")


def reliability(source: Column, table: DataFrame, rows: DataFrame, default: float = 1.0) -> DataFrame:
    """rows with the reliability of their source, or the default."""
    return rows.join(table.select(F.col("source").alias("_s"), "reliability"), source == F.col("_s"), "left").drop("_s").withColumn("reliability", F.coalesce("reliability", F.lit(default)))


def merged(observations: DataFrame, owner: str = "entity") -> DataFrame:
    """Weight of each value per (entity, key): the sum of confidence * reliability."""
    return observations.groupBy(owner, "key", "value").agg(F.sum(F.col("confidence") * F.col("reliability")).alias("weight"))


def credibility(bindings: DataFrame, observations: DataFrame) -> DataFrame:
    """mean(binding confidence) * n / (1 + n) with n distinct sources, and the last time seen."""
    mean = bindings.groupBy("entity").agg(F.avg("confidence").alias("mean"))
    seen = observations.groupBy("entity").agg(F.countDistinct("source").alias("n"), F.max("ts").alias("updated_at"))
    return mean.join(seen, "entity").select("entity", (F.col("mean") * F.col("n") / (1 + F.col("n"))).alias("credibility"), "updated_at")


def rollup(observations: DataFrame, factor: int) -> DataFrame:
    """Fine buckets as coarse ones: entries, the anchor of the newest member and the first bucket."""
    coarse = F.floor(F.col("bucket") / factor)
    return observations.withColumn("coarse", coarse).groupBy("entity", "coarse").agg(F.count(F.lit(1)).alias("entries"), F.max_by("anchor", F.struct("ts", "anchor")).alias("anchor"), F.min("bucket").alias("first_bucket"))


def lca_depth(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    both = F.slice(F.zip_with(a, b, lambda x, y: x == y), 1, F.least(F.size(a), F.size(b)))
    stop = F.array_position(both, False)
    return F.when(stop == 0, F.size(both)).otherwise(stop - 1).cast("int")


def anchors_near(a: Column, b: Column, k: int = 1) -> Column:
    """Equal paths, one under the other, or with at least k common segments; names without a slash only if equal."""
    path = a.contains("/") & b.contains("/")
    depth = lca_depth(F.split(a, "/"), F.split(b, "/"))
    nested = depth >= F.least(F.size(F.split(a, "/")), F.size(F.split(b, "/")))
    return (a == b) | (path & (nested | (depth >= k)))


def candidates(probes: DataFrame, known: DataFrame, k: int = 1, span: int = 1) -> DataFrame:
    """Blocking: known profiles of a level within `span` buckets and near anchors, of the first level that has any.

    The bucket range becomes 2 * span + 1 equal keys, and near anchors (k is 1 at
    least) have their first segment in common, so the join has both as keys.
    """
    top = lambda anchor: F.split(anchor, "/", 2)[0]
    spread = probes.withColumn("bucket_key", F.explode(F.sequence(F.col("bucket") - span, F.col("bucket") + span))).withColumn("top_key", top(F.col("anchor")))
    other = known.select(F.col("profile").alias("candidate"), F.col("anchor").alias("other_anchor"), F.col("bucket").alias("bucket_key"), top(F.col("anchor")).alias("top_key"), "level")
    near = spread.join(other, ["bucket_key", "top_key"]).where((F.col("profile") != F.col("candidate")) & anchors_near(F.col("anchor"), F.col("other_anchor"), k))
    first = F.min("level").over(W.partitionBy("profile"))
    return near.withColumn("_first", first).where("level = _first").select("profile", "candidate", "level")


def veto(pairs: DataFrame, vmax: float) -> DataFrame:
    """Pairs (distance, dt) that could have been travelled at no more than vmax; at equal times only the same place."""
    return pairs.where(F.col("distance") <= vmax * F.abs("dt"))


def match_score(agree: Column, weight_all: Column, new_sources: Column) -> Column:
    """Weighted agreement in [-1, 1] mapped to [0, 1] (no common key: 0.5), plus 0.05 per new source up to 0.15, at most 1."""
    base = F.when(weight_all > 0, (agree / weight_all + 1) / 2).otherwise(0.5)
    return F.least(F.lit(1.0), base + F.least(F.lit(0.15), 0.05 * new_sources))


def decision(best: Column, merge: float = 0.75, split: float = 0.3) -> Column:
    return F.when(best.isNull() | (best <= split), "new").when(best >= merge, "merge").otherwise("disputed")


def search(views: DataFrame, wanted: dict[str, str], credible: DataFrame, top: int, alpha: float = 0.7, beta: float = 0.3, least: float = 0.0) -> DataFrame:
    """The best entities by alpha * (share of wanted values held) + beta * credibility; ties by entity."""
    hit = views.where(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in wanted.items()]).cast("array<struct<k:string,v:string>>").isNotNull() & F.struct(F.col("key").alias("k"), F.col("value").alias("v")).isin([F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in wanted.items()]))
    matched = hit.groupBy("entity").agg((F.countDistinct("key") / len(wanted)).alias("match"))
    scored = matched.join(credible.where(F.col("credibility") >= least), "entity")
    return scored.select("entity", (alpha * F.col("match") + beta * F.col("credibility")).alias("score")).orderBy(F.desc("score"), "entity").limit(top)
