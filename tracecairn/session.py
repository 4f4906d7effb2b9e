"""Session settings that suit this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Generated methods beyond this size stay uncompiled in the JVM; past it Spark splits
# the work into smaller ones. The row functions here come close to it.
TUNED = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; partition counts and memory stay the cluster's choice."""
    for name, value in TUNED.items():
        spark.conf.set(name, value)
    return spark
