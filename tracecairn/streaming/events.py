"""Traces as streams of arriving bucket files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tracecairn.functions.numbers import moved_bytes
from tracecairn.operators.storage import remove, scratch_path
from tracecairn.options import BUCKET_SECONDS, TraceOptions
from tracecairn.schema import stored_schema
from tracecairn.sources.normalize import normalize, row_filter
from tracecairn.sources.reader import (
    BUCKET_DIRS,
    PART_FILES,
    dataset_dir,
    in_bucket_range,
    is_flat,
)


def stream_events(
    spark: SparkSession, opts: TraceOptions, stored: T.StructType | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Typed events of bucket files as they appear, filters pushed into the scan.

    ``stored`` replaces the usual file schema, for instance where ``mapped`` is boolean.
    """
    root = opts.require_source()
    reader = spark.readStream.option("ignoreCorruptFiles", opts.ignore_corrupt_files)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if is_flat(root):
        df = reader.schema(stored or stored_schema(with_bucket=False)).parquet(root)
    else:
        base = dataset_dir(root)
        df = (
            reader.schema(stored or stored_schema())
            .option("basePath", base).option("pathGlobFilter", PART_FILES)
            .parquet(f"{base}/{BUCKET_DIRS}").where(in_bucket_range(opts))
        )
    keep = row_filter(opts)
    return normalize(df if keep is None else df.where(keep), opts.signed_numbers)


def with_event_time(events: DataFrame) -> DataFrame:
    """``event_time``: the trace clock as a timestamp, for watermarks.

    Cut to microseconds, not rounded, so that windows begin where batch buckets do.
    """
    return events.withColumn("event_time", F.timestamp_micros(
        F.floor(F.col("machine_ts") * 1e6).cast("bigint")))


def bucket_stats_stream(
    events: DataFrame, delay: str = "10 minutes"
) -> DataFrame:
    """Operations and IO bytes per tumbling bucket; rows later than ``delay`` are dropped.

    ``BucketStream`` keeps a record of them.
    """
    is_io = F.col("op_class") == "io"
    length = moved_bytes(F.col("ret"))
    timed = with_event_time(events).withWatermark("event_time", delay)
    return (
        timed.groupBy(F.window("event_time", f"{BUCKET_SECONDS} seconds"))
        .agg(
            F.count(F.lit(1)).alias("ops"),
            F.count_if(is_io).alias("io_ops"),
            F.coalesce(F.sum(F.when(is_io, length)), F.lit(0)).alias("io_bytes"),
            F.min("machine_ts").alias("first_ts"),
            F.max("machine_ts").alias("last_ts"),
        )
        .select(
            (F.unix_micros("window.start") / F.lit(BUCKET_SECONDS * 1_000_000))
            .cast("bigint").alias("bucket"),
            "ops", "io_ops", "io_bytes", "first_ts", "last_ts",
        )
    )


@dataclass(frozen=True)
class BucketStream:
    """Tumbling statistics that keep their late rows.

    A row is late where its bucket had ended ``delay_seconds`` before the latest row of the
    batches before. Each batch writes partial counts of the rows in time to ``partials``, the late
    rows to ``late`` and the clock it reached to ``marks``, each under its batch id, below
    ``root``; ``totals`` adds the partials up. A repeated batch reads the same marks and
    overwrites its own output.
    """

    root: str
    delay_seconds: float = BUCKET_SECONDS

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def writer(self, events: DataFrame) -> DataStreamWriter:
        return events.writeStream.foreachBatch(self.process)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Read the micro-batch once, into a table that goes when the batch is done."""
        spark = batch.sparkSession
        path = scratch_path(spark, "micro-batch")
        batch.write.parquet(path)
        self._process(spark.read.schema(batch.schema).parquet(path), batch_id)
        remove(spark, path)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        before = self._reached(batch.sparkSession, batch_id)
        ended = (F.floor(F.col("machine_ts") / BUCKET_SECONDS) + 1) * BUCKET_SECONDS
        late = F.lit(False) if before is None else F.coalesce(
            ended <= before - self.delay_seconds, F.lit(False))
        is_io = F.col("op_class") == "io"
        self._write(batch.where(late), "late", batch_id)
        self._write(
            batch.where(~late).groupBy(
                F.floor(F.col("machine_ts") / BUCKET_SECONDS).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("ops"), F.count_if(is_io).alias("io_ops"),
                 F.coalesce(F.sum(F.when(is_io, moved_bytes(F.col("ret")))), F.lit(0))
                 .alias("io_bytes")),
            "partials", batch_id)
        high = F.max("machine_ts")
        if before is not None:   # the clock never goes back, so older marks are not asked for
            high = F.greatest(high, F.lit(before))
        self._write(batch.agg(high.alias("high")), "marks", batch_id)
        if batch_id > 1:
            remove(batch.sparkSession, f"{self.table('marks')}/batch={batch_id - 2}")

    def totals(self, spark: SparkSession) -> DataFrame:
        parts = spark.read.parquet(self.table("partials"))
        return parts.groupBy("bucket").agg(
            *(F.sum(c).alias(c) for c in ("ops", "io_ops", "io_bytes")))

    def _reached(self, spark: SparkSession, batch_id: int) -> float | None:
        if batch_id == 0:
            return None
        marks = spark.read.schema("high double, batch bigint").parquet(self.table("marks"))
        return marks.where(F.col("batch") < batch_id).agg(F.max("high")).first()[0]

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.table(name)}/batch={batch_id}")
