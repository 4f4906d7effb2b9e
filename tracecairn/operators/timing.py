"""Gaps between events and the pacing schedule derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.operators.slices import (
    SLICE,
    TimeSlices,
    add_previous_ts,
    along,
    nearest,
    with_slice_facts,
)
from tracecairn.operators.storage import materialize
from tracecairn.options import MAX_WAIT_SECONDS, TraceOptions
from tracecairn.schema import ORDER


def micros(seconds: Column) -> Column:
    return F.round(seconds * 1e6).cast("bigint")


def add_gap(df: DataFrame, slices: TimeSlices) -> DataFrame:
    """``gap_s``: seconds since the preceding event of the trace, 0 for the first."""
    rows = add_previous_ts(df, "_previous", slices)
    return rows.withColumn("gap_s", _gap(F.col("_previous"))).drop("_previous")


def wait_seconds(gap: Column, opts: TraceOptions) -> Column:
    if opts.pace_mode == "fast":
        return F.lit(0.0)
    scaled = gap / F.lit(float(opts.speed)) if opts.pace_mode == "scaled" else gap
    return F.least(scaled, F.lit(MAX_WAIT_SECONDS))


def slice_totals(df: DataFrame, opts: TraceOptions, slices: TimeSlices) -> DataFrame:
    """What a schedule carries into each slice: the last timestamp before it, and the waits so far.

    One row per slice, from the keys alone, written once.
    """
    local = Window.partitionBy(SLICE).orderBy(*ORDER)
    inside = F.col("machine_ts") - F.lag("machine_ts").over(local)
    waits = df.select(SLICE, *ORDER).withColumn("_wait", _wait_us(inside, opts))
    sums = waits.groupBy(SLICE).agg(
        F.sum("_wait").alias("_inside"), F.min("machine_ts").alias("_first"),
        F.max("machine_ts").alias("_last"))
    # One row per slice goes through these windows.
    across = Window.orderBy(SLICE)
    edges = sums.withColumn("_edge", F.lag("_last").over(across))
    step = F.col("_inside") + _wait_us(F.col("_first") - F.col("_edge"), opts)
    so_far = F.sum(step).over(across.rowsBetween(Window.unboundedPreceding, -1))
    return materialize(
        edges.select(SLICE, "_edge", F.coalesce(so_far, F.lit(0)).alias("_before")), "slice-totals")


def _gap(previous: Column) -> Column:
    return F.greatest(F.col("machine_ts") - F.coalesce(previous, "machine_ts"), F.lit(0.0))


def _wait_us(difference: Column, opts: TraceOptions) -> Column:
    gap = F.greatest(F.coalesce(difference, F.lit(0.0)), F.lit(0.0))
    return micros(wait_seconds(gap, opts))


def add_schedule(df: DataFrame, opts: TraceOptions, slices: TimeSlices) -> DataFrame:
    """``gap_s``, ``wait_s`` and ``replay_offset_us``: when each event would be issued.

    The offset sums whole microseconds, so it does not depend on how rows are grouped. With several
    slices the input is read twice: for its keys alone, to carry totals from slice to slice, and for
    the rows, which pass one window. Fast mode waits for nothing and needs no totals.
    """
    if opts.pace_mode == "fast":
        out = add_gap(df, slices)
        return (
            out.withColumn("wait_s", wait_seconds(F.col("gap_s"), opts))
            .withColumn("replay_offset_us", F.lit(0).cast("bigint"))
        )
    local = Window.partitionBy(SLICE).orderBy(*ORDER)
    previous, before = F.lag("machine_ts").over(local), F.lit(0).cast("bigint")
    if slices.several:
        df = with_slice_facts(df, slice_totals(df, opts, slices))
        previous, before = F.coalesce(previous, "_edge"), F.col("_before")
    out = df.withColumn("gap_s", _gap(previous))
    out = out.withColumn("wait_s", wait_seconds(F.col("gap_s"), opts))
    up_to_here = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    waited = F.sum(micros(F.col("wait_s"))).over(up_to_here)
    return out.withColumn("replay_offset_us", before + waited).drop("_edge", "_before")


def pid_gaps(df: DataFrame, slices: TimeSlices, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Idle time per process (or other key): events, and total and longest gap."""
    order = [c for c in ORDER if c not in by]
    slices = along(slices, by)
    ranked = nearest(slices.assign_parts(df), by, order, F.col("machine_ts"), "_previous", slices)
    gap = micros(F.col("machine_ts") - F.col("_previous"))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("idle_us"),
        F.coalesce(F.max(gap), F.lit(0)).alias("longest_gap_us"),
    )
