"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.session import ship

#: Most rows a Python worker gets at once; texts may be long, so batches stay small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Readies a session for Python workers: they import this package and get small Arrow batches."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster
    that is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="chronofold-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Tables that save() wrote and nothing has removed yet, in the order of writing.
_SAVED: list[str] = []


#: Rows of a file where a table's size is known to be small for its number of tasks.
FILE_ROWS = 1_000_000


def save(df: DataFrame, tag: str, rows: int | None = None, dealt: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors cost no recomputation.

    rows: a bound on its rows, where rows are narrow and cheap; there are then no
    more files than FILE_ROWS asks for.  dealt: making them is not cheap, so all
    tasks do that and the rows are dealt to those that write.
    """
    spark = df.sparkSession
    if rows is not None:
        files = max(1, -(-rows // FILE_ROWS))
        df = df.repartition(files) if dealt else df.coalesce(files)
    path = f"{scratch(spark)}/chronofold/{tag}-{uuid.uuid4().hex}"
    _SAVED.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    if path in _SAVED:
        _SAVED.remove(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables, as save() returned them, that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.saved_at)


def saved() -> list[str]:
    """Paths of the tables that save() wrote and that are still there."""
    return list(_SAVED)


def sweep(spark: SparkSession, before: list[str], *kept: DataFrame) -> None:
    """Removes the tables written since saved() gave `before`, but those kept; results that read them must be saved."""
    stay = {*before, *(df.saved_at for df in kept)}
    for path in [p for p in _SAVED if p not in stay]:
        _remove(spark, path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_of(df: DataFrame, column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(df[column], F.lit(""))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number >= 0 a row.

    A condition that names it is evaluated on the columns above as they were
    computed; without it the optimizer would copy their long expressions into
    filters further down.
    """
    return df.withColumn(name, F.monotonically_increasing_id())
