"""Concepts, instances and keywords: creation, lookups, profile graphs, ingestion, follow-ups, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import scalars

# Words without information, everyday forms and their standard word, and root topics.
STOP_WORDS = ["的", "了", "在", "我", "我们", "你", "他", "她", "和", "就", "都", "而", "及", "与", "着", "或", "一个", "没有", "是", "很"]
ALIASES = {"睡不着": "失眠", "失眠症": "失眠", "睡不好": "失眠", "压力大": "压力", "压力过大": "压力", "心烦": "焦虑", "感冒了": "感冒", "车子": "车", "单车": "自行车"}
ROOT_TOPICS = [
    "工作", "健康", "理财", "家庭", "学习", "出行", "饮食", "运动", "社交", "娱乐", "居住", "车辆", "数码", "旅行", "情感",
    "睡眠", "医疗", "教育", "购物", "宠物", "法律", "装修", "育儿", "养老", "保险", "投资", "餐饮", "穿搭", "游戏", "音乐",
]
#: Nodes that one call takes apart.
WANTED = 10_000
#: Relations that suggest what comes next.
FOLLOWING = ("TRIGGERS", "CAUSES", "REQUIRES")


def informative(words: DataFrame, column: str = "word", stop: list[str] | None = None) -> DataFrame:
    """Rows whose word is none of the stop words (a fixed short list)."""
    return words.where(~F.col(column).isin(STOP_WORDS if stop is None else stop))


def keywords(nodes: DataFrame, category: str | None = None, status: int | None = None) -> DataFrame:
    """Keyword nodes of a category and a status, either left open."""
    out = nodes.where("kind = 'Keyword'")
    out = out if category is None else out.where(F.col("category") == category)
    return out if status is None else out.where(F.col("status") == status)


def make_id(prefix: str, name: Column) -> Column:
    """The id of a named concept or instance: the same name always gives the same."""
    return F.concat(F.lit(prefix + ":"), name)


def add_named(known: DataFrame, made: DataFrame, prefix: str) -> DataFrame:
    """Creates concepts or instances by name, each once: id, name, entity_ref.

    The first of a name stays (known before made, then the least seq); an empty
    entity_ref is filled from the first that has one.
    """
    rows = known.select(F.lit(0).alias("round"), "seq", "name", "entity_ref").unionByName(made.select(F.lit(1).alias("round"), "seq", "name", "entity_ref"))
    first = F.min(F.when(F.col("entity_ref") != "", F.struct("round", "seq", "entity_ref")))["entity_ref"]
    return rows.groupBy("name").agg(F.coalesce(first, F.lit("")).alias("entity_ref")).select(make_id(prefix, F.col("name")).alias("id"), "name", "entity_ref")


def nodes_named(nodes: DataFrame, kind: str, names: DataFrame) -> DataFrame:
    """Nodes of a kind whose names are asked for (name), each node once."""
    return nodes.where(F.col("kind") == kind).join(names.select("name").distinct(), "name", "left_semi")


def typed_slots(slots: DataFrame, concepts: DataFrame, by_type: DataFrame) -> DataFrame:
    """The concept of each slot: that of its name, else the one its entity's type stands for.

    slots (slot, name, entity_type); concepts (id, name); by_type (entity_type, concept).
    """
    named = concepts.select(F.col("id").alias("named"), "name")
    fallback = by_type.select("entity_type", F.col("concept").alias("typed"))
    return slots.join(named, "name", "left").join(fallback, "entity_type", "left").withColumn("concept", F.coalesce("named", "typed")).drop("named", "typed")


def profile_graph(profiles: DataFrame) -> DataFrame:
    """profile_id, nodes and edges of a profile's five elements and its modifiers (array<struct<target,kind,text>>).

    Modifier nodes are numbered in their order and hang on what they modify.
    """
    node = lambda name, label: F.struct(F.lit(name).alias("id"), F.lit(name).alias("role"), F.lit(None).cast("string").alias("kind"), F.col(label).alias("label"))
    edge = lambda to, relation, label: F.struct(F.lit("subject").alias("from"), F.lit(to).alias("to"), F.lit(relation).alias("relation"), F.col(label).alias("label"))
    name = lambda i: F.concat(F.lit("mod"), i.cast("string"))
    nodes = F.concat(
        F.array(node("subject", "subject"), node("object", "object"), node("place", "place"), node("time", "time")),
        F.transform("modifiers", lambda m, i: F.struct(name(i).alias("id"), F.lit("modifier").alias("role"), m["kind"].alias("kind"), m["text"].alias("label"))),
    )
    edges = F.concat(
        F.array(edge("object", "action", "verb"), edge("place", "located_at", "place"), edge("time", "occurs_at", "time")),
        F.transform("modifiers", lambda m, i: F.struct(m["target"].alias("from"), name(i).alias("to"), m["kind"].alias("relation"), m["text"].alias("label"))),
    )
    return profiles.select("profile_id", nodes.alias("nodes"), edges.alias("edges"))


def ingest(profiles: DataFrame, concepts: DataFrame, by_type: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Takes profiles up into the ontology: instances, edges and participants, each profile once.

    profiles (profile_id, seq, event_id, subject, verb, object, place, and per slot
    <slot>_entity, <slot>_type, <slot>_confidence).  An event instance is named by
    subject, verb and object; subject, object and place become instances linked to
    the event and, by the confidence of their binding, to their concept.  known
    (profile_id) are those taken up before.
    """
    fresh = profiles if known is None else profiles.join(known.select("profile_id"), "profile_id", "left_anti")
    first = fresh.groupBy("profile_id").agg(F.min_by(F.struct(*[F.col(c) for c in fresh.columns if c != "profile_id"]), "seq").alias("p")).select("profile_id", "p.*")
    event = F.concat_ws("", "subject", "verb", "object")
    slots = [("subject", "SUBJECT_OF"), ("object", "OBJECT_OF"), ("place", "LOCATED_IN")]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(r).alias("relation"), F.col(s).alias("name"), F.col(f"{s}_entity").alias("entity_ref"), F.col(f"{s}_type").alias("entity_type"), F.coalesce(F.col(f"{s}_confidence"), F.lit(1.0)).alias("confidence")) for s, r in slots])).alias("s")
    parts = first.select("profile_id", "seq", make_id("i", event).alias("event"), each).select("profile_id", "seq", "event", "s.*").where(F.col("name") != "")
    typed = typed_slots(parts, concepts, by_type)
    instances = add_named(first.select("seq", event.alias("name"), F.col("event_id").alias("entity_ref")).limit(0), first.select("seq", event.alias("name"), F.col("event_id").alias("entity_ref")).unionByName(parts.select("seq", "name", F.coalesce("entity_ref", F.lit("")).alias("entity_ref"))), "i")
    to_concept = typed.where("concept is not null").select(make_id("i", F.col("name")).alias("src"), F.col("concept").alias("dst"), F.lit("INSTANCE_OF").alias("type"), F.col("confidence").alias("weight"))
    to_event = typed.select(make_id("i", F.col("name")).alias("src"), F.col("event").alias("dst"), F.col("relation").alias("type"), F.lit(1.0).alias("weight"))
    edges = to_concept.unionByName(to_event).groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))
    return {"instances": instances, "edges": edges, "participants": typed.select("profile_id", "slot", make_id("i", F.col("name")).alias("instance"), "confidence")}


def followups(inferences: DataFrame, offered: DataFrame) -> DataFrame:
    """What may come next: offered concepts that a subject's inferences trigger, cause or require.

    Each once per subject, with its place in the order of depth, confidence and name.
    """
    likely = inferences.where(F.col("relation").isin(*FOLLOWING)).join(offered.select("concept").distinct(), "concept", "left_semi")
    once = likely.groupBy("subject", "concept").agg(F.min(F.struct("depth", (-F.col("confidence")).alias("less"))).alias("o"))
    place = F.row_number().over(W.partitionBy("subject").orderBy("o.depth", "o.less", "concept"))
    return once.select("subject", "concept", place.alias("place"))


def decompose(vectors: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Component directions of each wanted node: its k + 1 nearest by positive cosine, itself among them.

    vectors and wanted (id, v).  wanted is what a user asks for, WANTED nodes at
    most, so it is broadcast and the vectors stay where they are; ranks are cut to
    the best in each task before rows are shuffled.
    """
    if wanted.limit(WANTED + 1).count() > WANTED:
        raise ValueError(f"at most {WANTED} nodes are taken apart at once")
    asked = F.broadcast(wanted.select(F.col("id").alias("node"), F.col("v").alias("w")))
    scored = vectors.join(asked, F.size("v") == F.size("w"))
    score = scalars.cosine(F.col("v"), F.col("w"))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "id"))
    return scored.select("node", "id", score.alias("score")).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k + 1)


def synchronised_sources(stored: DataFrame, registered: DataFrame) -> DataFrame:
    """Reliability by numeric source id: the stored table wins, ids that are no number are passed over.

    stored (source_id text, reliability); registered (source bigint, reliability).
    """
    number = F.try_to_number("source_id", F.lit("999999999999999999")).cast("bigint")
    kept = stored.where(F.col("source_id").rlike("^[0-9]{1,18}$")).select(number.alias("source"), F.col("reliability").alias("stored"))
    return registered.select("source", F.col("reliability").alias("known")).join(kept, "source", "full_outer").select("source", F.coalesce("stored", "known").alias("reliability"))


def trust(rows: DataFrame, tokens: DataFrame, column: str = "token") -> DataFrame:
    """Adds the trust level of a credential, 0 where it is unknown or missing."""
    return rows.join(tokens.select(F.col("token").alias(column), F.col("level").alias("_level")), column, "left").withColumn("trust", F.coalesce("_level", F.lit(0))).drop("_level")


def dump(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes a snapshot of named tables (an ontology's or a graph's), each replaced as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def restore(spark: SparkSession, names: list[str], folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
