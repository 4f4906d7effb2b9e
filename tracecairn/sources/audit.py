"""What a dataset holds before it is read: file by file, and whether its order can be trusted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracecairn.options import TraceOptions
from tracecairn.schema import STORED_FIELDS
from tracecairn.sources.normalize import is_usable
from tracecairn.sources.reader import PART_FILES, dataset_dir, is_flat

_REPORT = "file string, folder string, bytes long, rows long, status string, why string, defaulted array<string>"
#: Rows of a file whose order is checked in one window.
ROWS_PER_BLOCK = 1_000_000


def read_report(spark: SparkSession, opts: TraceOptions) -> DataFrame:
    """One row per file below the dataset, or for the flat file.

    ``status`` is ``read``, ``special`` (a folder without a numeric bucket), ``out of range``,
    or ``unreadable`` (``why`` says what failed). ``rows`` comes from the footer, null where there is
    none to read; ``defaulted`` names the trace columns a file lacks or stores in an unusable type.
    Files are listed by Spark and their footers read in tasks; no data page is read. Files without a
    byte are not listed, as no scan opens them.
    """
    root = opts.require_source()
    reader = spark.read.format("binaryFile")
    if is_flat(root):
        listed = reader.load(root)
    else:
        listed = reader.option("pathGlobFilter", PART_FILES).option(
            "recursiveFileLookup", True).load(dataset_dir(root))
    files = listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probed = files.repartition(n).mapInArrow(
        _probe, "file string, bytes long, rows long, why string, stored map<string,string>")
    folder = F.regexp_extract("file", ".*/([^/]+)/[^/]+$", 1)
    bucket = F.regexp_extract(folder, "^bucket=([0-9]+)$", 1).try_cast("bigint")
    outside = bucket < opts.bucket_min
    if opts.bucket_max >= 0:
        outside |= bucket > opts.bucket_max
    if is_flat(root):
        bucket, outside = F.lit(0), F.lit(False)
    status = (
        F.when(F.col("why").isNotNull(), "unreadable").when(bucket.isNull(), "special")
        .when(outside, "out of range").otherwise("read")
    )
    defaulted = F.filter(F.array(*map(F.lit, STORED_FIELDS)), lambda x: ~F.coalesce(
        F.element_at("stored", x) == "usable", F.lit(False)))
    return probed.select(
        "file", folder.alias("folder"), "bytes", "rows", status.alias("status"), "why",
        F.when(F.col("why").isNull(), defaulted).alias("defaulted"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    def uri(path: str) -> str:   # Spark writes file:/x
        return path if "://" in path or ":/" not in path else path.replace(":/", ":///", 1)

    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()),
                        ("why", pa.string()), ("stored", pa.map_(pa.string(), pa.string()))])
    for batch in batches:
        out = []
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, why, stored = None, None, []
            try:
                store, at = fs.FileSystem.from_uri(uri(path))
                with store.open_input_file(at) as file:
                    footer = pq.ParquetFile(file)
                    rows = footer.metadata.num_rows
                    stored = [(f.name, _use(f)) for f in footer.schema_arrow if f.name in STORED_FIELDS]
            except (OSError, pa.ArrowInvalid) as error:
                why = str(error).split("\n")[0]
            out.append((path, size, rows, why, stored))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), f.type) for x, f in zip(columns, schema)], schema=schema)


def _use(field: pa.Field) -> str:
    kinds = {"string": "string", "large_string": "string", "binary": "binary", "double": "double",
             "float": "float", "int64": "bigint", "int32": "int", "int16": "smallint",
             "int8": "tinyint", "bool": "boolean"}
    wanted = STORED_FIELDS[field.name].simpleString()
    return "usable" if is_usable(kinds.get(str(field.type), ""), wanted) else "other"


def order_certificate(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file of a dataset: is it sorted inside, and does it begin behind all before it?

    ``first_key`` and ``last_key`` are (machine_ts, log_offset). Inside a file, blocks of rows are
    checked apart and their edges against each other, so a large file is not one task. ``overlaps``
    says that some file that begins earlier ends behind this one's beginning.
    """
    c = F.col
    key = F.struct("machine_ts", "log_offset")
    rows = spark.read.parquet(folder).select(
        "machine_ts", "log_offset", c("_metadata.file_path").alias("file"),
        c("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_block", F.floor(c("_row") / ROWS_PER_BLOCK))
    inside = Window.partitionBy("file", "_block").orderBy("_row")
    blocks = rows.withColumn("_back", F.coalesce(F.lag(key).over(inside) > key, F.lit(False))).groupBy(
        "file", "_block").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_back").alias("_backs"),
        F.min_by(key, "_row").alias("_first"), F.max_by(key, "_row").alias("_last"),
        F.min(key).alias("_low"), F.max(key).alias("_high"))
    # One row per block, then one row per file, goes through these windows.
    across = Window.partitionBy("file").orderBy("_block")
    blocks = blocks.withColumn("_step", F.coalesce(F.lag("_last").over(across) > c("_first"), F.lit(False)))
    files = blocks.groupBy("file").agg(
        F.sum("rows").alias("rows"), (F.sum("_backs") + F.count_if("_step")).alias("_wrong"),
        F.min("_low").alias("first_key"), F.max("_high").alias("last_key"))
    before = Window.orderBy("first_key", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        "file", "rows", "first_key", "last_key", (c("_wrong") == 0).alias("sorted"),
        F.coalesce(F.max("last_key").over(before) > c("first_key"), F.lit(False)).alias("overlaps"))
