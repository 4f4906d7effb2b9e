"""The replay plan: what an executor would issue for each event, as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracecairn.functions.numbers import (
    AT_FDCWD,
    decode_open_flags,
    effective_length,
    open_mode,
    wrap_int32,
)
from tracecairn.functions.paths import (
    absolute_target,
    inside_root,
    is_relative,
    normalize_path,
    under_root,
)
from tracecairn.functions.syscalls import io_direction, io_offset, is_vectored, real_action
from tracecairn.operators.slices import TimeSlices
from tracecairn.operators.timing import add_schedule, micros
from tracecairn.options import TraceOptions
from tracecairn.schema import ORDER

# Fixed value: the mode of directories an executor makes.
MKDIR_MODE = 0o755

_PATH_ACTIONS = ("open", "stat", "mkdir", "unlink", "rename")


def replay_plan(outcome_rows: DataFrame, opts: TraceOptions, slices: TimeSlices) -> DataFrame:
    """One row per selected event: operation, arguments and time of issue.

    ``status`` is ``issue``, ``skip`` (nothing to do, or no open descriptor) or
    ``reject`` (path missing or outside the root, see ``reason``).
    """
    c = F.col
    rows = add_schedule(outcome_rows, opts, slices)
    rows = rows.withColumn("real_action", real_action(c("sc"), c("rename_dst")))
    rows = _with_rename_source(rows, opts.sandbox_root)
    on_path = c("real_action").isin(*_PATH_ACTIONS)
    on_fd = c("real_action").isin("io", "close")
    is_io, is_open = c("real_action") == "io", c("real_action") == "open"
    flags = decode_open_flags(c("arg1"))
    reason = (
        F.when(c("real_action") == "rename", F.coalesce("source_reason", "path_reason"))
        .when(on_path, c("path_reason"))
        .when(on_fd & c("session_at").isNull(), "fd_not_mapped")
        .when(c("real_action") == "skip", "not_supported")
    )
    status = (
        F.when(c("_why").isin("fd_not_mapped", "not_supported"), "skip")
        .when(c("_why").isNotNull(), "reject").otherwise("issue")
    )
    return rows.withColumn("_why", reason).select(
        "machine_ts", "log_offset", "pid", "sc", "bucket",
        c("real_action").alias("action"), status.alias("status"), c("_why").alias("reason"),
        F.when(on_path, c("resolved")).alias("target"),
        F.when(c("real_action") == "rename", c("source_resolved")).alias("source"),
        F.when(is_open, flags).alias("flags"),
        F.when(is_open, open_mode(c("arg1"))).when(c("real_action") == "mkdir", MKDIR_MODE)
        .alias("mode"),
        F.when(is_io, io_direction(c("sc"))).alias("direction"),
        F.when(is_io, effective_length(c("ret"), opts.max_io_bytes)).alias("length"),
        F.when(is_io, io_offset(c("sc"), c("arg2"))).alias("file_offset"),
        F.when(is_io, is_vectored(c("sc"))).alias("vectored"),
        F.when(on_fd | is_open, c("session_at")).alias("session"),
        F.when(on_fd | is_open, c("our_fd")).alias("our_fd"),
        micros(c("wait_s")).alias("wait_us"), "replay_offset_us",
    )


def _with_rename_source(rows: DataFrame, root: str) -> DataFrame:
    """Resolve the source of renames like their destination, against the same directory."""
    c = F.col
    source = c("rename_src")
    base = F.when(wrap_int32(c("arg1")) == AT_FDCWD, F.lit(root)).otherwise(c("session_path"))
    relative = F.when(c("session_path") == "", source).otherwise(
        F.concat(base, F.lit("/"), source))
    target = F.when(source.startswith("/"), absolute_target(source, root)).when(
        is_relative(source), F.when(wrap_int32(c("arg1")) == AT_FDCWD, under_root(source, root))
        .otherwise(relative))
    return rows.withColumn("source_resolved", normalize_path(target)).withColumn(
        "source_reason", source_reason(source, c("source_resolved"), root))


def source_reason(source: Column, resolved: Column, root: str) -> Column:
    return (
        F.when(source == "", "no_path")
        .when(resolved.isNull(), "dirfd_unregistered")
        .when(resolved.startswith("/") & ~inside_root(resolved, root), "traversal")
    )


def execute_plan(
    plan: DataFrame,
    execute: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """Run a user function over the plan in time order, as Arrow batches.

    Each task gets one stretch of the time axis, so that no process or file, however
    busy, ends up in a single task.
    """
    return (
        plan.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(execute, schema)
    )
