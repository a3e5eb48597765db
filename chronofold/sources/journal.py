"""A journal of writes beside a checkpoint, and definitions in five sets.

Writes are appended in numbered batches; a checkpoint folds all of them into one
table and then forgets them.  Reading takes the checkpoint and the batches after
it.  A batch is complete when its marker is written, so one that was cut off is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETS = ("attribute", "type", "rule", "view", "anchor")


class Journal:
    """Rows (key, seq, gone, ...) under a folder: key's last seq holds, gone rows are removed."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete batches or checkpoints."""
        root = self._path(f"{self.folder}/{kind}")
        if not self._files.exists(root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(root)]
        return sorted(int(n) for n in names if n.isdigit() and self._files.exists(self._path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def append(self, rows: DataFrame) -> int:
        """Adds a batch; its number."""
        number = max([0, *self._numbers("batch"), *self._numbers("checkpoint")]) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch/{number}")
        return number

    def read(self) -> DataFrame:
        """The rows as they are now: one per key, without those that are gone."""
        kept = self._numbers("checkpoint")[-1:]
        paths = [f"{self.folder}/checkpoint/{n}" for n in kept] + [f"{self.folder}/batch/{n}" for n in self._numbers("batch") if n > (kept or [0])[0]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        last = rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
        return last.where(~F.coalesce("gone", F.lit(False)))

    def checkpoint(self) -> int:
        """Folds everything into a new checkpoint and then drops what it covers; a cut-off one leaves all as it was."""
        number = max([0, *self._numbers("batch"), *self._numbers("checkpoint")])
        old, batches = self._numbers("checkpoint"), self._numbers("batch")
        if number in old:
            return number
        self.read().write.mode("overwrite").parquet(f"{self.folder}/checkpoint/{number}")
        for kind, numbers in (("checkpoint", old), ("batch", batches)):
            for n in numbers:
                self._files.delete(self._path(f"{self.folder}/{kind}/{n}"), True)
        return number


def settle_definitions(log: DataFrame) -> DataFrame:
    """Definitions of five sets judged in order: set, key, version, body, accepted, reason.

    log (seq, set, key, body, refs array<string>).  A definition needs a known set and a
    key; types and rules refer to attributes, views to types, and what they refer
    to must have been accepted before.  Attributes and anchors refer to nothing, so
    three passes, each a join with the first acceptance of a key, settle all.
    version counts the accepted definitions of a key.
    """
    shaped = log.withColumn("reason", F.when(~F.col("set").isin(*SETS), "unknown set").when(F.coalesce("key", F.lit("")) == "", "no key"))
    plain = shaped.where(F.col("reason").isNotNull() | F.col("set").isin("attribute", "anchor"))
    attributes = plain.where("reason is null and set = 'attribute'").groupBy("key").agg(F.min("seq").alias("since"))

    def referring(rows: DataFrame, first: DataFrame) -> DataFrame:
        each = rows.select("seq", F.explode_outer("refs").alias("ref"))
        known = each.join(first.select(F.col("key").alias("ref"), "since"), "ref", "left")
        bad = known.where(F.col("ref").isNotNull() & (F.col("since").isNull() | (F.col("since") >= F.col("seq")))).groupBy("seq").agg(F.min("ref").alias("_ref"))
        return rows.join(bad, "seq", "left").withColumn("reason", F.when(F.col("_ref").isNotNull(), F.concat(F.lit("unknown "), "_ref"))).drop("_ref")

    middle = referring(shaped.where("reason is null and set in ('type', 'rule')"), attributes)
    types = middle.where("reason is null and set = 'type'").groupBy("key").agg(F.min("seq").alias("since"))
    views = referring(shaped.where("reason is null and set = 'view'"), types)
    return plain.unionByName(middle).unionByName(views).withColumn("accepted", F.col("reason").isNull()).drop("refs")


def current_sets(settled: DataFrame) -> DataFrame:
    """The definition in force of each key of each set: set, key, body, version (accepted ones so far), seq."""
    fine = settled.where("accepted")
    return fine.groupBy("set", "key").agg(F.max_by("body", "seq").alias("body"), F.count(F.lit(1)).alias("version"), F.max("seq").alias("seq"))
