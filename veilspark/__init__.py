"""veilspark: privacy analytics over text and JSON tables, planned by Spark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Lets Python workers find this package where it is not installed but lies on the driver's path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
