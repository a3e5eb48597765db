"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package.

    Where it is installed or sent with --py-files nothing changes; a session
    that runs from a checkout passes its folder on to the workers.
    """
    sc = spark.sparkContext
    own = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in own and ROOT not in sc.environment.get("PYTHONPATH", ""):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, sc.environment.get("PYTHONPATH", "")) if x)


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that results do not depend on but time does."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronofold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
