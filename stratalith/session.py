"""Sessions: the settings that plans here assume, and the package for the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # tables that cut lineage go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in one process, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application; a worker's own copy, if it has one, comes first or is the same."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="package-")
        atexit.register(shutil.rmtree, folder, True)
        made = shutil.make_archive(f"{folder}/{here.name}", "zip", here.parent, here.name)
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)
    return spark
