"""Let Python workers import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path. On a cluster whose nodes don't share that folder, submit the package
    with --py-files; then this changes nothing."""
    env = spark.sparkContext.environment
    if ROOT not in (there := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, there)])
