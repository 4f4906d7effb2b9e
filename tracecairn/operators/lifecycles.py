"""Descriptor lifecycles on the source and the target side.

A lifecycle is the sequence of calls that a session saw, its open and close included. Two sides replay
the same work if the k-th session of a path on one side has the calls of the k-th session on the
other. Sequences are compared by a digest that no single task has to read in order: every call is
hashed with its place in the session, and the hashes are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.operators.slices import PART, SLICE, WHOLE, TimeSlices, along

SIDES = ("source", "target")
#: Hexadecimal digits of a call's hash; their sum fits a decimal for any number of calls.
DIGITS = 15


def add_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, slices: TimeSlices
) -> DataFrame:
    """Number the rows of each key in order, from 1. A window holds a key's rows of one slice, or all of
    them where its process is no larger than a slice; one row per (key, slice) carries the counts on."""
    slices = along(slices, keys)
    df = slices.assign_parts(df)
    local = Window.partitionBy(*keys, PART).orderBy(*order)
    df = df.withColumn(out, F.row_number().over(local).cast("bigint"))
    if not slices.parted:
        return df.drop(PART)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = df.where(F.col(PART) != WHOLE).groupBy(*keys, PART).agg(
        F.count(F.lit(1)).alias("_n")).select(
        *keys, PART, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, PART)]
    condition = same[0]
    for x in same[1:]:
        condition &= x
    joined = df.alias("a").join(before.alias("b"), condition, "left")
    return joined.select(
        *[F.col(f"a.{n}") for n in df.columns if n not in (out, PART)],
        (F.col(out) + F.coalesce("_before", F.lit(0))).alias(out))


def call_hash(*parts: Column) -> Column:
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("decimal(20,0)")


def lifecycles(outcome_rows: DataFrame, slices: TimeSlices) -> DataFrame:
    """One row per session whose open was seen: ``pid, session_at, side, path, calls, digest``."""
    c = F.col
    calls = outcome_rows.where(
        (c("status") == "ok") & c("action").isin("open", "io", "close") & c("session_at").isNotNull()
    ).select("pid", "session_at", SLICE, "machine_ts", "log_offset", "sc", "action", "side",
             "lookup_path")
    ranked = add_rank(calls, ["pid", "session_at"], ["machine_ts", "log_offset", "sc"], "_place", slices)
    opened = c("action") == "open"
    return (
        ranked.groupBy("pid", "session_at").agg(
            F.max(F.when(opened, F.struct("side", c("lookup_path").alias("path"), SLICE)))
            .alias("_open"),
            F.count(F.lit(1)).alias("calls"), F.sum(call_hash(c("_place"), c("sc"))).alias("digest"))
        .where(c("_open").isNotNull()).select("pid", "session_at", "_open.*", "calls", "digest")
    )


def side_lifecycles(outcome_rows: DataFrame, slices: TimeSlices) -> DataFrame:
    """How the sessions of each path compare between the sides.

    ``matched``: same place, same calls. ``reordered``: the other side has a session with these
    calls, at another place. ``missing_in_target`` and ``missing_in_source``: it has none left.
    """
    c = F.col
    sessions = lifecycles(outcome_rows, slices).where(c("side").isin(*SIDES))
    placed = add_rank(sessions, ["path", "side"], ["session_at", "pid"], "_place", slices)
    lined_up = placed.groupBy("path", "_place").agg(*[
        F.max(F.when(c("side") == s, c("digest"))).alias(s) for s in SIDES])
    same = c("source").eqNullSafe(c("target"))
    # One row a digest of a path: how many sessions of each side have it, and how many at one place.
    each = lined_up.select("path", F.explode(F.array(
        F.struct(c("source").alias("digest"), F.lit(1).alias("s"), F.lit(0).alias("t"),
                 same.cast("int").alias("both")),
        F.struct(c("target").alias("digest"), F.lit(0).alias("s"), F.lit(1).alias("t"),
                 F.lit(0).alias("both")),
    )).alias("x")).select("path", "x.*").where(c("digest").isNotNull())
    counts = each.groupBy("path", "digest").agg(
        F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("both").alias("both"))
    shared = F.least("s", "t")
    return counts.groupBy("path").agg(
        F.sum("s").alias("source_sessions"), F.sum("t").alias("target_sessions"),
        F.sum("both").alias("matched"), F.sum(shared - c("both")).alias("reordered"),
        F.sum(c("s") - shared).alias("missing_in_target"),
        F.sum(c("t") - shared).alias("missing_in_source"))
