"""Ontology and lexicon tables: loaders, alias normalisation, synonym and antonym edges, keyword dormancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions.scalars import ascii_lower

LEXICON = "word string, syn_strong array<string>, syn_near array<struct<word:string,score:double>>, antonyms array<string>"
ONTOLOGY = "concepts array<struct<name:string,parent:string>>, relations array<struct<src:string,type:string,dst:string,weight:double>>, rules array<struct<id:string,antecedent:string,relation:string,consequent:string,confidence:double>>"
NEAR = 8


def load_ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables concept, is_a, edge and rule of a JSON asset; a parent that is no concept is an error."""
    asset = spark.read.schema(ONTOLOGY).json(path, multiLine=True)
    concept = asset.select(F.explode("concepts").alias("c")).select("c.*").dropDuplicates(["name"])
    is_a = concept.where("parent is not null and parent <> ''").select(F.col("name").alias("child"), "parent")
    lost = is_a.join(concept.select(F.col("name").alias("parent")), "parent", "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"unknown parents, such as {lost.first()['parent']}")
    return {"concept": concept, "is_a": is_a, "edge": asset.select(F.explode("relations").alias("r")).select("r.*"), "rule": asset.select(F.explode("rules").alias("r")).select("r.*").dropDuplicates(["id"])}


def split_lexicon(entries: DataFrame, most: int = NEAR) -> dict[str, DataFrame]:
    """Tables alias (alias, word), near (word, other, score; the first `most` as listed) and antonym (word, other).

    A strong synonym that names the word as its own strong synonym goes to the lesser of the two only.
    """
    alias = entries.select("word", F.explode("syn_strong").alias("alias")).where("alias <> word")
    mutual = alias.select(F.col("alias").alias("word"), F.col("word").alias("alias"))
    both = alias.intersect(mutual.select("word", "alias"))
    alias = alias.join(both.where("word > alias"), ["word", "alias"], "left_anti")
    near = entries.select("word", F.posexplode("syn_near").alias("n", "s")).where(F.col("n") < most).select("word", F.col("s.word").alias("other"), F.col("s.score").alias("score"))
    return {"alias": alias.select("alias", "word"), "near": near, "antonym": entries.select("word", F.explode("antonyms").alias("other"))}


def normalise(rows: DataFrame, column: str, alias: DataFrame, name: str = "standard") -> DataFrame:
    """Adds the standard form of a word: lower-case ASCII, then its alias, if any (ties: the least)."""
    one = alias.groupBy(F.col("alias").alias("_alias")).agg(F.min("word").alias("_word"))
    return rows.join(one, ascii_lower(F.col(column)) == F.col("_alias"), "left").withColumn(name, F.coalesce("_word", ascii_lower(F.col(column)))).drop("_alias", "_word")


def lexicon_edges(near: DataFrame, antonym: DataFrame, concept: DataFrame) -> DataFrame:
    """SIMILAR (score) and OPPOSITE (1.0) edges between words that are concepts."""
    both = near.select(F.col("word").alias("src"), F.lit("SIMILAR").alias("type"), F.col("other").alias("dst"), F.col("score").alias("weight")).unionByName(antonym.select(F.col("word").alias("src"), F.lit("OPPOSITE").alias("type"), F.col("other").alias("dst"), F.lit(1.0).alias("weight")))
    known = concept.select("name").distinct()
    return both.join(known.select(F.col("name").alias("src")), "src", "left_semi").join(known.select(F.col("name").alias("dst")), "dst", "left_semi")


def variants(alias: DataFrame, most: int) -> DataFrame:
    """Aliases by standard word, at most so many, in order."""
    return alias.withColumn("_n", F.row_number().over(W.partitionBy("word").orderBy("alias"))).where(F.col("_n") <= most).drop("_n")


def awake(mentions: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Keywords (word, n, awake): awake with enough mentions and at least one edge."""
    linked = edges.select(F.col("src").alias("word")).union(edges.select("dst")).distinct().withColumn("_linked", F.lit(True))
    return mentions.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(linked, "word", "left").select("word", "n", ((F.col("n") >= least) & F.coalesce("_linked", F.lit(False))).alias("awake"))


def new_entities(seen: DataFrame, known: DataFrame, key: str = "entity") -> DataFrame:
    """Entities seen for the first time: each once, with its first seq."""
    return seen.join(known.select(key), key, "left_anti").groupBy(key).agg(F.min("seq").alias("seq"))


def node_text(name: Column, text: Column, kind: Column) -> Column:
    """What a node is embedded by."""
    return F.concat_ws(" ", name, F.nullif(text, F.lit("")), F.nullif(kind, F.lit("")))
