"""Time slices and the ordered operators built on them.

A trace is one long ordered sequence, and one process or file may own a large part
of it. Windows over a process, a file or the whole trace would then put that part
into one task. So the time axis is cut into slices of about equal row count; a
window runs per (key, slice), and a summary with one row per (key, slice) carries
values across slice borders. Slices are plain functions of a row's own columns, so
every branch of a plan, and every retry, assigns them alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracecairn.schema import ORDER

SLICE = "slice"
#: A row's slice where its process is cut into slices; ``WHOLE`` where it is not.
PART = "part"
WHOLE = -1
SAMPLED_ROWS_PER_SLICE = 100
MIN_SAMPLE = 1_000_000
#: So many slices keep a cluster's tasks busy; a trace gets more only where they would be larger than
#: ``FULL_SLICE``, as every further cut adds a summary row for each key that it divides.
ENOUGH_SLICES = 1_000
FULL_SLICE = 1_000_000
_KEY = "_slice_key"
_BELOW_ONE = 1.0 - 2.0**-30
_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def _bucket(df: DataFrame, cuts: Sequence[float], column: str, out: str) -> DataFrame:
    """Number of cuts at or below ``column``, one more for NaN."""
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=column, outputCol=out,
                      handleInvalid="keep").transform(df)


@dataclass(frozen=True)
class TimeSlices:
    """Cut points on ``machine_ts``.

    Where single timestamps have more rows than a slice should have, ``fine`` cuts once more: on
    the number of a row's slice plus the place of its ``log_offset`` between ``low`` and ``high``, and
    of its ``pid`` between ``low_pid`` and ``high_pid`` among rows that share the offset too.

    ``large`` are the processes with more rows than a slice, at most as many as there are slices; None
    counts all as large. Windows within a process need slices for these alone.
    """

    cuts: tuple[float, ...] = ()
    fine: tuple[float, ...] = ()
    low: int = 0
    high: int = 0
    low_pid: int = 0
    high_pid: int = 0
    large: tuple[int, ...] | None = None

    @property
    def several(self) -> bool:
        return bool(self.cuts)

    @property
    def parted(self) -> bool:
        """Whether some process is cut."""
        return self.several and self.large != ()

    def assign_parts(self, df: DataFrame) -> DataFrame:
        """Add the part of a process a row is in, from its ``pid`` and slice."""
        if not self.parted:
            return df.withColumn(PART, F.lit(WHOLE).cast("bigint"))
        if self.large is None:
            return df.withColumn(PART, F.col(SLICE))
        return df.withColumn(PART, F.when(F.col("pid").isin(*self.large), F.col(SLICE)).otherwise(
            F.lit(WHOLE).cast("bigint")))

    def assign(self, df: DataFrame) -> DataFrame:
        if not self.cuts:
            return df.withColumn(SLICE, F.lit(0).cast("bigint"))
        out = _bucket(df.drop(SLICE), self.cuts, "machine_ts", SLICE)
        if self.fine:
            out = self._keyed(out)
            out = _bucket(out.drop(SLICE), self.fine, _KEY, SLICE).drop(_KEY)
        return out.withColumn(SLICE, F.col(SLICE).cast("bigint"))

    def span(self, first: int, last: int) -> tuple[float, float]:
        """Timestamps of these slices: from, and below. NaN is in the last slice."""
        if self.fine:   # back to slices by time
            first = math.floor(self.fine[first - 1]) if first > 0 else 0
            last = math.floor(self.fine[last]) if last < len(self.fine) else len(self.cuts)
        low = self.cuts[min(first, len(self.cuts)) - 1] if first > 0 else -math.inf
        return low, self.cuts[last] if last < len(self.cuts) else math.inf

    def until(self, timestamp: float) -> TimeSlices:
        """The slices of rows up to a timestamp."""
        cuts = tuple(x for x in self.cuts if x <= timestamp)
        fine = tuple(x for x in self.fine if x <= len(cuts) + 1) if cuts else ()
        return replace(self, cuts=cuts, fine=fine)

    def _keyed(self, df: DataFrame) -> DataFrame:
        """Doubles round in order, so equal or close offsets at worst share a slice."""
        def between(name: str, low: int, high: int) -> Column:
            steps = F.col(name) - F.lit(float(low))
            return F.least(F.greatest(steps, F.lit(0.0)), F.lit(float(high - low)))

        process = between("pid", self.low_pid, self.high_pid) / F.lit(
            float(self.high_pid - self.low_pid) + 1.0)
        place = (between("log_offset", self.low, self.high) + process) / F.lit(
            float(self.high - self.low) + 1.0)
        return df.withColumn(_KEY, F.col(SLICE) + place * F.lit(_BELOW_ONE))


def plan_slices(events: DataFrame, rows_per_slice: int) -> TimeSlices:
    """Choose slices of about ``rows_per_slice`` rows, larger ones where there would be too many.

    Counts the rows and, if there is more than one slice, reads timestamps of a sample,
    as a range partitioner does. The sample only places the cuts; they are constants
    from then on and results do not depend on them. Only the cuts reach the driver.
    """
    rows = events.count()
    wanted = slices_wanted(rows, rows_per_slice)
    if wanted <= 1:
        return TimeSlices()
    share = min(1.0, max(wanted * SAMPLED_ROWS_PER_SLICE, MIN_SAMPLE) / rows)
    keys = events.select("machine_ts", "log_offset", "pid")
    keys = keys if share == 1.0 else keys.sample(share, seed=1)

    def quantiles(column: str) -> Column:
        return F.percentile_approx(
            column, [i / wanted for i in range(1, wanted)], max(10_000, 10 * wanted))

    row = keys.agg(
        quantiles("machine_ts").alias("cuts"), F.min("log_offset").alias("low"),
        F.max("log_offset").alias("high"), F.min("pid").alias("low_pid"),
        F.max("pid").alias("high_pid")).first()
    found, heavy = slices_from_quantiles(row["cuts"] or (), row["low"] or 0, row["high"] or 0)
    # No more processes than slices can be larger than a slice is on the average.
    large = events.groupBy("pid").count().where(F.col("count") > rows / wanted).collect()
    found = replace(found, large=tuple(sorted(r["pid"] for r in large)))
    if not heavy:
        return found
    found = replace(found, low_pid=row["low_pid"] or 0, high_pid=row["high_pid"] or 0)
    keyed = found._keyed(_bucket(keys, found.cuts, "machine_ts", SLICE))
    fine = keyed.agg(quantiles(_KEY).alias("fine")).first()["fine"] or ()
    # Whole numbers keep the cuts by time, so that no slice joins parts of two.
    whole = map(float, range(1, len(found.cuts) + 2))
    return replace(found, fine=tuple(sorted({*fine, *whole})))


def slices_wanted(rows: int, rows_per_slice: int) -> int:
    """How many slices ``rows`` get. Summaries per (key, slice) must not grow into as many rows as the
    trace has, so beyond ``ENOUGH_SLICES`` the slices grow, up to ``FULL_SLICE`` rows each."""
    return min(-(-rows // rows_per_slice), max(ENOUGH_SLICES, -(-rows // FULL_SLICE)))


def slices_from_quantiles(
    quantiles: Sequence[float], low: int, high: int
) -> tuple[TimeSlices, bool]:
    """Slices by time, and whether one of them has a timestamp of more rows than wanted."""
    finite = [q for q in quantiles if math.isfinite(q)]
    repeated = {a for a, b in zip(finite, finite[1:]) if a == b}
    cuts = sorted(set(finite) | {math.nextafter(q, math.inf) for q in repeated})
    return TimeSlices(tuple(cuts), (), low, high), bool(repeated)


def order_key(columns: Sequence[str] = ORDER) -> Column:
    return F.struct(*columns)


def along(slices: TimeSlices, keys: Sequence[str]) -> TimeSlices:
    """Slices for windows over these keys: without the process among them, no key is known to be small."""
    return slices if "pid" in keys else replace(slices, large=None)


def nearest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
    slices: TimeSlices, following: bool = False,
) -> DataFrame:
    """Add the last non-null ``value`` strictly before each row of the same key, which lies within a
    process.

    With ``following`` the first one strictly after it. ``df`` needs a part column.
    """
    def directed(name: str) -> Column:
        return F.col(name).desc() if following else F.col(name).asc()

    df = df.withColumn("_value", value)
    local = Window.partitionBy(*keys, PART).orderBy(*map(directed, order)).rowsBetween(*_BEFORE)
    df = df.withColumn(out, F.last("_value", ignorenulls=True).over(local))
    if not slices.parted:
        return df.drop("_value")
    position = F.when(F.col("_value").isNotNull(), F.struct(*order))
    pick = F.min_by if following else F.max_by
    across = Window.partitionBy(*keys).orderBy(directed(PART)).rowsBetween(*_BEFORE)
    carried = (
        df.where(F.col(PART) != WHOLE).groupBy(*keys, PART).agg(pick("_value", position).alias("_edge"))
        .withColumn("_carry", F.last("_edge", ignorenulls=True).over(across))
        .where(F.col("_carry").isNotNull()).drop("_edge")
    )
    return (
        df.join(carried, [*keys, PART], "left")
        .withColumn(out, F.coalesce(out, "_carry"))
        .drop("_value", "_carry")
    )


def per_slice(df: DataFrame, total: Column, out: str) -> DataFrame:
    """Sum of ``total`` over all earlier slices, one row per slice.

    The window has no partition key, but only one row per slice goes in.
    """
    earlier = Window.orderBy(SLICE).rowsBetween(*_BEFORE)
    return (
        df.groupBy(SLICE).agg(total.alias("_total"))
        .select(SLICE, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias(out), "_total")
    )


def add_ordinal(
    df: DataFrame, out: str, slices: TimeSlices, start: int = 0, order: Sequence[str] = ORDER
) -> DataFrame:
    """Number all rows in trace order, from ``start``."""
    local = Window.partitionBy(SLICE).orderBy(*order)
    df = df.withColumn(out, F.row_number().over(local).cast("bigint") + F.lit(start - 1))
    if not slices.several:
        return df
    before = per_slice(df, F.count(F.lit(1)), "_before").drop("_total")
    return (
        df.join(before, SLICE)   # one row per slice
        .withColumn(out, F.col(out) + F.col("_before")).drop("_before")
    )


def add_running_sum(
    df: DataFrame, value: str, out: str, slices: TimeSlices, order: Sequence[str] = ORDER
) -> DataFrame:
    """Running sum of ``value`` in trace order, the row itself included."""
    local = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(*_UP_TO)
    df = df.withColumn(out, F.sum(value).over(local))
    if not slices.several:
        return df
    before = per_slice(df, F.sum(value), "_before").drop("_total")
    return (
        df.join(before, SLICE)   # one row per slice
        .withColumn(out, F.col(out) + F.col("_before")).drop("_before")
    )


def previous_edges(df: DataFrame) -> DataFrame:
    """(slice, edge): the last timestamp before each slice; one row per slice."""
    return (
        df.groupBy(SLICE).agg(F.max("machine_ts").alias("_last"))
        .select(SLICE, F.lag("_last").over(Window.orderBy(SLICE)).alias("_edge"))
    )


def with_slice_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Add facts of a row's slice. There is one row per slice, and the plan holds a cut for each
    slice already, so the broadcast is no larger than the plan's own constants."""
    return df.join(F.broadcast(facts), SLICE)


def add_previous_ts(
    df: DataFrame, out: str, slices: TimeSlices, order: Sequence[str] = ORDER
) -> DataFrame:
    """Timestamp of the preceding row of the trace, null for the first."""
    local = Window.partitionBy(SLICE).orderBy(*order)
    previous = F.lag("machine_ts").over(local)
    if not slices.several:
        return df.withColumn(out, previous)
    df = with_slice_facts(df, previous_edges(df))
    return df.withColumn(out, F.coalesce(previous, "_edge")).drop("_edge")


def nth_keys(
    df: DataFrame, positions: Sequence[int], slices: TimeSlices, order: Sequence[str] = ORDER
) -> dict[int, Row]:
    """Keys of the rows at these positions (from 1) in trace order; none past the end.

    An order statistic: one job counts rows per slice, a second one sorts the keys of the slices
    that hold a position, asking for their span of time. Only the keys found reach the driver.
    """
    keys = df.select(SLICE, *order)
    before = F.lit(0)
    if slices.several:
        counts = per_slice(keys, F.count(F.lit(1)), "_before")
        holds = F.lit(False)
        for n in positions:
            holds |= (F.col("_before") < n) & (F.col("_before") + F.col("_total") >= n)
        holders = counts.where(holds).collect()   # at most one row a position
        if not holders:
            return {}
        found = [r[SLICE] for r in holders]
        low, high = slices.span(min(found), max(found))
        keys = keys.where(F.col("machine_ts") >= low) if math.isfinite(low) else keys
        keys = keys.where(F.col("machine_ts") < high) if math.isfinite(high) else keys
        keys = keys.where(F.col(SLICE).isin(found))
        before = F.lit(None)
        for r in holders:
            before = F.when(F.col(SLICE) == r[SLICE], F.lit(r["_before"])).otherwise(before)
    local = Window.partitionBy(SLICE).orderBy(*order)
    ranked = keys.withColumn("_position", F.row_number().over(local) + before)
    return {r["_position"]: r for r in ranked.where(F.col("_position").isin(*positions)).collect()}


def at_or_before(key: Row, order: Sequence[str] = ORDER) -> Column:
    """Rows up to a key. The first column is compared on its own too, for the scan."""
    first, *others = order
    tied = order_key(others) <= F.struct(*[F.lit(key[n]).alias(n) for n in others])
    return (F.col(first) <= key[first]) & ((F.col(first) < key[first]) | tied)
