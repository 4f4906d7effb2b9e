"""What happens to each event of a simulated run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecairn.functions.syscalls import is_open_op
from tracecairn.functions.text import outcome_note
from tracecairn.operators.descriptors import Descriptors, attach_sessions, with_base
from tracecairn.operators.slices import PART

def outcomes(state: Descriptors, notes: bool = False) -> DataFrame:
    """One row per selected event: ``action, status, reason`` and the session it used.

    Opens come from the tracked control rows. Everything else passes one as-of lookup;
    rows without a key take part only to save a second scan.
    """
    c = F.col
    root = state.opts.sandbox_root
    rest = attach_sessions(
        state.rows.where(~is_open_op(c("sc"))), state.sessions, state.slices)
    rest = with_base(rest, root)
    opens = state.opens.withColumn("session_at", F.when(
        c("reason").isNull(), F.struct("machine_ts", "log_offset", "sc")))
    out = rest.unionByName(opens, allowMissingColumns=True)
    unmapped = c("action").isin("io", "close") & c("session_at").isNull()
    out = out.withColumnRenamed("reason", "path_reason")
    out = out.withColumn("reason", F.when(c("action") == "other", "other_syscall")
                         .when(unmapped, "fd_not_mapped").otherwise(c("path_reason")))
    out = out.withColumn("status", F.when(c("reason").isin("other_syscall", "fd_not_mapped"),
                                          "skipped")
                         .when(c("reason").isNotNull(), "failed").otherwise("ok"))
    if notes:
        out = out.withColumn("note", outcome_note())
    return out.drop("owner", "key", "exit_at", PART)


def first_failure(events: DataFrame) -> DataFrame:
    """The earliest failed event; no row if none failed."""
    c = F.col
    row = F.struct("machine_ts", "log_offset", "pid", "sc", "action", "reason")
    return (
        events.where(c("status") == "failed").agg(F.min(row).alias("_row"))
        .where(c("_row").isNotNull()).select("_row.*")
    )


def check_failures(events: DataFrame, continue_on_error: bool) -> DataFrame:
    """Raise at the first failure unless told to go on."""
    if not continue_on_error:
        row = first_failure(events).first()
        if row is not None:
            raise RuntimeError(
                f"event failed at ts={row['machine_ts']:.6f} pid={row['pid']} {row['sc']}: "
                f"{row['reason']}")
    return events


def traversal_report(events: DataFrame) -> DataFrame:
    """Events rejected because their path leaves the root."""
    return events.where(F.col("reason") == "traversal").select(
        "machine_ts", "log_offset", "pid", "sc", "path", "target", "resolved")
