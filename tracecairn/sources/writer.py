"""Writing traces and outcomes in the bucketed layout."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecairn.operators.storage import remove
from tracecairn.options import DEFAULT_BUCKET_WIDTH
from tracecairn.sources.normalize import bucket_of
from tracecairn.sources.reader import dataset_dir


def bucket_name(width: int = DEFAULT_BUCKET_WIDTH):
    number = bucket_of(F.coalesce(F.col("machine_ts"), F.lit(0.0)))
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def write_trace(
    df: DataFrame, root: str, bucket_width: int = DEFAULT_BUCKET_WIDTH, mode: str = "errorifexists"
) -> None:
    """Store raw trace rows as ``bucket=NNNNNN`` directories, sorted inside.

    Ranges are cut on the full sort key, so a bucket that holds much of the trace
    is split over several tasks and its files still do not overlap in time.
    """
    key = ["bucket", "machine_ts", "log_offset"]
    (
        df.withColumn("bucket", bucket_name(bucket_width))
        .repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .write.mode(mode).partitionBy("bucket").parquet(dataset_dir(root))
    )


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store outcome rows by bucket, in time order inside each file."""
    key = ["bucket", "machine_ts", "log_offset"]
    (
        outcomes.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .write.mode(mode).partitionBy("bucket").parquet(path)
    )


def commit_outcomes(outcomes: DataFrame, root: str, run: int) -> None:
    """Add a run's outcomes to a sink, once, however often it is tried.

    The rows go to a folder of this attempt; a one-row manifest of the run, written last, names it.
    Before that nothing of the attempt is seen, and a repeated run replaces what it had committed.
    Folders that no manifest names any more are removed.
    """
    spark = outcomes.sparkSession
    had = _manifest(spark, root).where(F.col("run") == run).first() if _exists(spark, root) else None
    folder = f"run={run}-{uuid.uuid4().hex}"
    write_outcomes(outcomes, f"{root.rstrip('/')}/data/{folder}")
    named = spark.createDataFrame([(folder,)], "folder string").coalesce(1)
    named.write.mode("overwrite").parquet(f"{root.rstrip('/')}/manifest/run={run}")
    if had is not None:
        remove(spark, f"{root.rstrip('/')}/data/{had['folder']}")


def committed_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """The outcomes of all committed runs, with their run."""
    runs = _manifest(spark, root).orderBy("run").collect()   # one row a run
    parts = [spark.read.parquet(f"{root.rstrip('/')}/data/{r['folder']}").withColumn(
        "run", F.lit(r["run"])) for r in runs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("folder string, run int").parquet(f"{root.rstrip('/')}/manifest")


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifest")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
