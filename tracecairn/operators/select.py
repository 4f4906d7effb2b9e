"""Choosing and ordering events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecairn.operators.slices import TimeSlices, at_or_before, nth_keys
from tracecairn.options import TraceOptions
from tracecairn.schema import ORDER
from tracecairn.sources.normalize import row_filter


def passes(opts: TraceOptions) -> Column:
    """Whether a row passes the pid and side filters, never null."""
    keep = row_filter(opts)
    return F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))


def keep_pids(events: DataFrame, pids: DataFrame, copies: int = 16) -> DataFrame:
    """The pid filter for lists too long for a predicate: a table with a ``pid`` column.

    The list is there ``copies`` times, so that a process's rows go to as many tasks.
    """
    listed = pids.select("pid").distinct().withColumn("_copy", F.explode(
        F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = events.withColumn("_copy", F.pmod(F.xxhash64("machine_ts", "log_offset"), F.lit(copies)
                                              ).cast("int"))
    return dealt.join(listed, ["pid", "_copy"], "left_semi").select(events.columns)


def select_events(events: DataFrame, opts: TraceOptions, slices: TimeSlices) -> DataFrame:
    """Events that pass the filters, up to the cap. Adds the slice column.

    With a cap this looks up the key of its last event, a constant from then on.
    """
    kept = slices.assign(events)
    if row_filter(opts) is not None:
        kept = kept.where(row_filter(opts))
    if opts.max_events > 0:
        last = nth_keys(kept, [opts.max_events], slices).get(opts.max_events)
        if last is not None:
            kept = kept.where(at_or_before(last))
    return kept


def time_order(df: DataFrame) -> DataFrame:
    """All rows in trace order (a range shuffle)."""
    return df.orderBy(*ORDER)


def first_events(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in trace order, for an ``n`` that a report would show."""
    return df.orderBy(*ORDER).limit(n)


def bucket_order(df: DataFrame) -> DataFrame:
    """Rows sorted inside each partition by bucket and key; no shuffle."""
    return df.sortWithinPartitions("bucket", *ORDER)
