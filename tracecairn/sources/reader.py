"""Reading trace datasets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracecairn.options import TraceOptions
from tracecairn.schema import PARTITION_FIELD, STORED_FIELDS, stored_schema
from tracecairn.sources.normalize import is_usable, normalize, row_filter

# The layout of a bucketed dataset.
SORTED_DIR = "events_tsorted"
BUCKET_DIRS = "bucket=[0-9]*"
PART_FILES = "*.parquet"


def is_flat(root: str) -> bool:
    return root.endswith(".parquet")


def dataset_dir(root: str) -> str:
    return f"{root.rstrip('/')}/{SORTED_DIR}"


def in_bucket_range(opts: TraceOptions) -> Column:
    number = F.col(PARTITION_FIELD).try_cast("bigint")
    keep = number >= opts.bucket_min
    return keep & (number <= opts.bucket_max) if opts.bucket_max >= 0 else keep


def scan_schema(stored: T.StructType) -> T.StructType:
    """The read schema for a dataset, from the schema of one of its files.

    Columns are bound by name to the trace types, so parts with narrower numbers
    widen on read. A column whose stored type cannot serve is left out and gets
    its default later; a boolean ``mapped`` keeps its type.
    """
    out = T.StructType()
    for name, wanted in STORED_FIELDS.items():
        if name not in stored.fieldNames():
            out.add(name, wanted)
            continue
        found = stored[name].dataType
        if not is_usable(found.simpleString(), wanted.simpleString()):
            continue
        out.add(name, found if isinstance(found, T.BooleanType) else wanted)
    return out


def read_trace(
    spark: SparkSession, opts: TraceOptions, stored: T.StructType | None = None
) -> DataFrame:
    """The stored rows of a bucketed dataset or a flat file, bucket range applied.

    The range becomes a partition filter. Directories without a numeric bucket are
    never listed. ``stored`` skips reading a file footer for the schema.
    """
    root = opts.require_source()
    reader = spark.read.option("ignoreCorruptFiles", opts.ignore_corrupt_files)
    if is_flat(root):
        stored = stored or _stored(reader, root, opts)
        return reader.schema(scan_schema(stored)).parquet(root)
    base = dataset_dir(root)
    parts = f"{base}/{BUCKET_DIRS}"
    reader = reader.option("basePath", base).option("pathGlobFilter", PART_FILES)
    schema = scan_schema(stored or _stored(reader, parts, opts)).add(PARTITION_FIELD, T.StringType())
    return reader.schema(schema).parquet(parts).where(in_bucket_range(opts))


def _stored(reader: DataFrameReader, path: str, opts: TraceOptions) -> T.StructType:
    try:
        return reader.parquet(path).schema
    except AnalysisException:
        # The file looked at may be one to skip.
        if not opts.ignore_corrupt_files:
            raise
        return stored_schema(with_bucket=False)


def read_events(
    spark: SparkSession, opts: TraceOptions, stored: T.StructType | None = None
) -> DataFrame:
    """Typed events with the pid and side filters pushed into the scan."""
    df = read_trace(spark, opts, stored)
    keep = row_filter(opts)
    return normalize(df if keep is None else df.where(keep), opts.signed_numbers)


def read_quarantine(spark: SparkSession, opts: TraceOptions) -> DataFrame:
    """Rows of the special buckets (no numeric name), which no run ever reads."""
    base = dataset_dir(opts.require_source())
    return (
        spark.read.schema(stored_schema(with_bucket=False))
        .option("ignoreCorruptFiles", opts.ignore_corrupt_files)
        .option("pathGlobFilter", PART_FILES)
        .option("recursiveFileLookup", True)
        .parquet(base)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("folder", F.regexp_extract("file", ".*/([^/]+)/[^/]+$", 1))
        .where(~F.col("folder").rlike("^bucket=[0-9]+$"))
        .drop("file")
    )


def buckets_opened(events: DataFrame) -> DataFrame:
    """Number of non-empty buckets."""
    return events.agg(F.count_distinct("bucket").alias("buckets"))
