"""The trace schema: what is stored, and what the operators work on."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and stored types of a trace file.
STORED_FIELDS = {
    "machine_ts": T.DoubleType(),
    "log_offset": T.LongType(),
    "pid": T.LongType(),
    "comm": T.StringType(),
    "sc": T.StringType(),
    "ret": T.StringType(),
    "err": T.StringType(),
    "arg1": T.StringType(),
    "arg2": T.StringType(),
    "path": T.StringType(),
    "rename_src": T.StringType(),
    "rename_dst": T.StringType(),
    "canonical_path": T.StringType(),
    "mapped": T.LongType(),
    "side": T.StringType(),
}
NUMBER_TEXT = ("ret", "err", "arg1", "arg2")
PARTITION_FIELD = "bucket"

# The total order of a trace. (machine_ts, log_offset) is the recorded key; the
# last two columns only settle rows that share it.
ORDER = ("machine_ts", "log_offset", "pid", "sc")


def stored_schema(with_bucket: bool = True) -> T.StructType:
    out = [T.StructField(name, dtype) for name, dtype in STORED_FIELDS.items()]
    if with_bucket:
        out.append(T.StructField(PARTITION_FIELD, T.StringType()))
    return T.StructType(out)
