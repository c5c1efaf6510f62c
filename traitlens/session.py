"""Session settings that the operators expect."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that hold on a laptop and on a cluster alike; sizes of shuffles and
# executors stay with the cluster's own configuration.
PORTABLE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def let_workers_import(spark: SparkSession) -> None:
    """Put this checkout on the import path of Python workers.

    Enough where executors see the same folders; elsewhere the package travels with ``--py-files``.
    """
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def local_session(cpus: int | None = None, app: str = "traitlens") -> SparkSession:
    """A local session for tests and the bench."""
    cpus = cpus or min(8, os.cpu_count() or 2)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in PORTABLE_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("TRAITLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
