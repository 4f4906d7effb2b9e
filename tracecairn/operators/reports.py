"""Aggregates over events, outcomes and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.functions.numbers import moved_bytes
from tracecairn.operators.descriptors import Descriptors, residual
from tracecairn.operators.select import passes
from tracecairn.operators.slices import SLICE, TimeSlices, add_ordinal
from tracecairn.options import TraceOptions
from tracecairn.schema import ORDER


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def syscall_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("sc").agg(F.count(F.lit(1)).alias("events"))


def run_stats(
    events: DataFrame, outcome_rows: DataFrame, state: Descriptors
) -> DataFrame:
    """Counters of a run as one row.

    ``events`` are all events read, filtered ones included, and with a cap also the event that ran
    into it; the time range covers the same rows.
    """
    opts = state.opts
    read = events.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(~passes(opts)).alias("filtered"),
        F.min("machine_ts").alias("first_ts"),
        F.max("machine_ts").alias("last_ts"),
    )
    done = outcome_rows.agg(
        count_if(F.col("status") != "failed").alias("processed"),
        count_if(F.col("status") == "skipped").alias("skipped"),
        count_if(F.col("status") == "failed").alias("failed"),
    )
    left = residual(state.sessions)
    rows = read.unionByName(done, allowMissingColumns=True).unionByName(
        left, allowMissingColumns=True)
    counters = ("total", "processed", "skipped", "failed", "filtered", "residual")
    return rows.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counters],
        F.coalesce(F.min("first_ts"), F.lit(0.0)).alias("first_ts"),
        F.coalesce(F.max("last_ts"), F.lit(0.0)).alias("last_ts"),
    )


def outcome_counts(outcome_rows: DataFrame) -> DataFrame:
    return outcome_rows.groupBy("action", "status", "reason").agg(
        F.count(F.lit(1)).alias("events"))


def skip_rate_by_window(
    outcome_rows: DataFrame, windows: Sequence[int], slices: TimeSlices
) -> DataFrame:
    """Skipped share of the first n events, for each n of ``windows``, in basis points."""
    windows = sorted(set(windows))
    numbered = add_ordinal(
        outcome_rows.select(SLICE, *ORDER, "status"), "position", slices, start=1)
    bound = F.lit(None).cast("bigint")
    for n in reversed(windows):
        bound = F.when(F.col("position") <= n, F.lit(n).cast("bigint")).otherwise(bound)
    steps = numbered.withColumn("window_events", bound).where(F.col("window_events").isNotNull())
    # One row per window length goes into this window.
    so_far = Window.orderBy("window_events").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    counted = steps.groupBy("window_events").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("status") == "skipped").alias("s"))
    return counted.select(
        "window_events",
        F.sum("n").over(so_far).alias("events"),
        F.sum("s").over(so_far).alias("skipped"),
    ).withColumn("skip_bp", F.floor(F.col("skipped") * 10_000 / F.col("events")).cast("bigint"))


def io_volume(outcome_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Operations and bytes of attributed IO per group."""
    done = outcome_rows.where((F.col("action") == "io") & (F.col("status") == "ok"))
    return done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("ops"),
        F.sum(moved_bytes(F.col("ret"))).alias("bytes"),
    )


def io_rollup(outcome_rows: DataFrame) -> DataFrame:
    """Attributed IO by side and syscall with subtotals."""
    done = outcome_rows.where((F.col("action") == "io") & (F.col("status") == "ok"))
    return done.rollup("side", "sc").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("ops"),
        F.sum(moved_bytes(F.col("ret"))).alias("bytes"),
    )


def bucket_profile(events: DataFrame) -> DataFrame:
    """Operations and IO bytes per 600 s bucket."""
    is_io = F.col("op_class") == "io"
    length = moved_bytes(F.col("ret"))
    return events.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("ops"),
        count_if(is_io).alias("io_ops"),
        F.coalesce(F.sum(F.when(is_io, length)), F.lit(0)).alias("io_bytes"),
    )


def side_consistency(outcome_rows: DataFrame) -> DataFrame:
    """Opens, closes and IO per path on the source and the target side, and whether they agree.

    IO and closes count for the path of the session they belong to, where there is one.
    """
    on_session = F.when(F.col("action").isin("io", "close"), F.col("session_path"))
    ok = F.col("status") == "ok"
    measures = ("opens", "closes", "io_ops", "io_bytes")
    sides = ("source", "target")
    table = outcome_rows.where(F.col("action").isin("open", "close", "io")).groupBy(
        F.coalesce(on_session, "lookup_path").alias("path")
    ).pivot("side", list(sides)).agg(
        count_if(ok & (F.col("action") == "open")).alias("opens"),
        count_if(ok & (F.col("action") == "close")).alias("closes"),
        count_if(ok & (F.col("action") == "io")).alias("io_ops"),
        F.sum(F.when(ok & (F.col("action") == "io"),
                     moved_bytes(F.col("ret")))).alias("io_bytes"),
    )
    table = table.select("path", *[
        F.coalesce(f"{s}_{m}", F.lit(0)).alias(f"{s}_{m}") for s in sides for m in measures])
    same = F.lit(True)
    for m in measures:
        same = same & (F.col(f"source_{m}") == F.col(f"target_{m}"))
    return table.withColumn("consistent", same)
