"""From stored columns to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecairn.functions.numbers import parse_num
from tracecairn.functions.syscalls import classify_op, parse_side
from tracecairn.options import BUCKET_SECONDS, FILTERABLE_SIDES, TraceOptions
from tracecairn.schema import NUMBER_TEXT, PARTITION_FIELD, STORED_FIELDS


def bucket_of(machine_ts: Column) -> Column:
    return F.floor(machine_ts / BUCKET_SECONDS).cast("bigint")


def row_filter(opts: TraceOptions) -> Column | None:
    """The pid and side filters as a predicate the Parquet scan can take over.

    It holds on stored and on normalised columns alike; a missing pid counts as 0.
    """
    parts = []
    if opts.pid_filter:
        keep = F.col("pid").isin(*opts.pid_filter)
        parts.append(keep | F.col("pid").isNull() if 0 in opts.pid_filter else keep)
    if opts.side_filter in FILTERABLE_SIDES:
        parts.append(F.col("side") == opts.side_filter)
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def normalize(df: DataFrame, signed_numbers: bool = False) -> DataFrame:
    """Bind the trace columns by name, fill defaults and parse the number columns.

    Any DataFrame with (some of) the stored columns is accepted. A column that is
    missing, null or of an unusable type becomes 0, "" or false; other columns are
    dropped. ``bucket`` comes from the partition column where there is one, else
    from the timestamp.
    """
    types = dict(df.dtypes)

    def bound(name: str) -> Column:
        wanted = STORED_FIELDS[name].simpleString()
        found = types.get(name)
        empty = F.lit("" if wanted == "string" else 0).cast(wanted)
        if found is None or not is_usable(found, wanted):
            return empty
        return F.coalesce(F.col(name).cast(wanted), empty)

    columns = []
    for name in STORED_FIELDS:
        value = bound(name)
        if name in NUMBER_TEXT:
            value = parse_num(value, signed_numbers)
        elif name == "mapped":
            value = value != 0
        elif name == "side":
            value = parse_side(value)
        columns.append(value.alias(name))
    bucket = bucket_of(bound("machine_ts"))
    if PARTITION_FIELD in types:
        bucket = F.coalesce(F.col(PARTITION_FIELD).try_cast("bigint"), bucket)
    return df.select(
        *columns,
        classify_op(bound("sc")).alias("op_class"),
        bucket.alias("bucket"),
    )


def is_usable(found: str, wanted: str) -> bool:
    """Whether a stored type can serve a trace column."""
    if wanted == "string":
        return found in ("string", "binary")
    if wanted == "double":
        return found in ("double", "float")
    return found in ("bigint", "int", "smallint", "tinyint", "boolean")
