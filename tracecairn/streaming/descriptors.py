"""Descriptor tracking over micro-batches.

A micro-batch is read once, into a table of the shared folder that goes when the batch is done. The
sessions that earlier batches left open are kept as a log: ``changes`` holds what each batch opened,
closed or made unreachable, and every ``compact_every`` batches ``open_sessions`` gets the state in
full. A batch takes up only the sessions it can touch: those whose number or path it names, and those
that share a path with one of them. So what a batch writes follows the batch, not what is open.

Every table is written under the batch's id, and a mark, the last to be written, names the snapshot it
stands on. A repeated batch reads the same mark and overwrites its own output, so replays after a
failure change nothing. What no mark stands on any more is deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracecairn.functions.numbers import as_fd
from tracecairn.operators.descriptors import (
    FIRST_VIRTUAL_FD,
    carry_over,
    prepare,
    track_descriptors,
)
from tracecairn.operators.outcomes import check_failures, outcomes
from tracecairn.operators.select import select_events
from tracecairn.operators.slices import SLICE, TimeSlices, order_key, plan_slices
from tracecairn.operators.storage import materialize, remove, scratch_path
from tracecairn.options import TraceOptions

_KEY_TYPE = "struct<machine_ts:double,log_offset:bigint,pid:bigint,sc:string>"
_MARK_SCHEMA = (f"high {_KEY_TYPE}, next_fd bigint, taken bigint, snapshot bigint, previous bigint, "
                "batch bigint")


def _carried_schema(owner: str) -> str:
    return (f"owner {owner}, machine_ts double, log_offset bigint, sc string, fd int, "
            "our_fd bigint, path string, reachable boolean")


def _literal_key(key: Row) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in key.asDict().items()])


_SESSION = ("owner", "machine_ts", "log_offset", "sc")


@dataclass(frozen=True)
class DescriptorStream:
    """``root``: folder for the tables ``outcomes``, ``late``, ``open_sessions``, ``changes`` and
    ``marks``.

    Filters, the cap and stopping at a failure hold over the whole stream as they do in a batch: the
    cap counts what earlier batches took, and a failed event ends the query before its batch
    is marked as done.
    """

    root: str
    opts: TraceOptions = TraceOptions()
    compact_every: int = 16

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def writer(self, events: DataFrame) -> DataStreamWriter:
        return events.writeStream.foreachBatch(self.process)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = scratch_path(spark, "micro-batch")
        batch.write.parquet(path)
        self._process(spark, spark.read.schema(batch.schema).parquet(path), batch_id)
        remove(spark, path)

    def _process(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        c = F.col
        before = self.last_mark(spark, batch_id)
        fresh, carried, next_fd, taken = batch, None, FIRST_VIRTUAL_FD, 0
        if before is not None:
            carried = self._sessions(spark, before)
            next_fd, taken = before["next_fd"], before["taken"]
            if before["high"] is not None:
                seen = order_key() <= _literal_key(before["high"])
                self._write(batch.where(seen), "late", batch_id)
                fresh = batch.where(~seen)
        slices = plan_slices(fresh, self.opts.rows_per_slice)
        chosen = self._selected(fresh, taken, slices)
        touched = None
        if carried is not None:
            touched = materialize(self._touched(carried, chosen, slices), "touched")
        state = track_descriptors(chosen, self.opts, slices, touched, next_fd)
        found = check_failures(outcomes(state, notes=True), self.opts.continue_on_error)
        self._write(found.drop(SLICE), "outcomes", batch_id)
        now = materialize(carry_over(state.sessions).withColumn(
            "owner", c("owner").cast(self._owner_type)), "still-open")
        self._write(_changes(touched, now), "changes", batch_id)
        snapshot, previous = (0, 0) if before is None else (before["snapshot"], before["previous"])
        if before is None or batch_id - snapshot >= self.compact_every:
            whole = now if carried is None else carried.join(
                touched, list(_SESSION), "left_anti").unionByName(now)
            self._write(whole, "open_sessions", batch_id)
            previous, snapshot = snapshot, batch_id
        # The mark comes last: a batch without one counts as not done.
        made = state.opens.agg(F.count("our_fd").alias("made"))
        reached = fresh.agg(F.max(order_key()).alias("high"))
        counted = chosen.agg(F.count(F.lit(1)).alias("taken"))
        high = c("high")
        if before is not None and before["high"] is not None:
            high = F.coalesce(high, _literal_key(before["high"]))
        # Three tables of one row each.
        total = made.crossJoin(reached).crossJoin(counted)
        self._write(
            total.select(high.alias("high"), (c("made") + next_fd).alias("next_fd"),
                         (c("taken") + taken).alias("taken"),
                         F.lit(snapshot).cast("bigint").alias("snapshot"),
                         F.lit(previous).cast("bigint").alias("previous")),
            "marks", batch_id)
        if before is not None:
            self._forget(spark, before)

    @property
    def _owner_type(self) -> str:
        return "string" if self.opts.exit_closes else "bigint"

    def open_sessions(self, spark: SparkSession) -> DataFrame:
        """The sessions that the finished batches have left open."""
        mark = self.last_mark(spark, None)
        if mark is None:
            return spark.createDataFrame([], _carried_schema(self._owner_type))
        return self._sessions(spark, mark)

    def _sessions(self, spark: SparkSession, mark: Row) -> DataFrame:
        """The snapshot a mark stands on, with the changes up to the mark."""
        schema = _carried_schema(self._owner_type)
        whole = spark.read.schema(schema).parquet(
            f"{self.table('open_sessions')}/batch={mark['snapshot']}")
        if mark["batch"] == mark["snapshot"]:
            return whole
        changed = spark.read.schema(f"{schema}, alive boolean, batch bigint").parquet(
            self.table("changes")).where(
            (F.col("batch") > mark["snapshot"]) & (F.col("batch") <= mark["batch"]))
        facts = ("alive", "fd", "our_fd", "path", "reachable")
        rows = whole.withColumn("alive", F.lit(True)).withColumn(
            "batch", F.lit(mark["snapshot"]).cast("bigint")).unionByName(changed)
        latest = rows.groupBy(*_SESSION).agg(F.max_by(F.struct(*facts), "batch").alias("x"))
        return latest.where("x.alive").select(*_SESSION, *[f"x.{n}" for n in facts[1:]])

    def _touched(self, carried: DataFrame, chosen: DataFrame, slices: TimeSlices) -> DataFrame:
        """The carried sessions whose state the batch may change or that its rows may find."""
        c = F.col
        if self.opts.exit_closes:   # an exit ends all sessions of its process
            pid = F.substring_index("owner", "@", 1).cast("bigint")
            return carried.join(chosen.select("pid").distinct(), pid == c("pid"), "left_semi")
        rows = prepare(chosen, self.opts, slices)
        opened = rows.where(c("action") == "open")
        fd = as_fd(c("ret"))
        keys = materialize(
            rows.where(c("key").isNotNull()).select("owner", "key").unionByName(
                opened.where(fd.isNotNull()).select("owner", F.concat(F.lit("fd:"), fd).alias("key"))
            ).unionByName(opened.select("owner", F.concat(F.lit("p:"), "lookup_path").alias("key")))
            .distinct(), "touched-keys")
        by_fd = carried.withColumn("key", F.concat(F.lit("fd:"), "fd")).join(
            keys, ["owner", "key"], "left_semi")
        # A session that loses its number takes its path from all others.
        paths = keys.unionByName(by_fd.select("owner", F.concat(F.lit("p:"), "path").alias("key")))
        by_path = carried.withColumn("key", F.concat(F.lit("p:"), "path")).join(
            paths.distinct(), ["owner", "key"], "left_semi")
        return by_path.drop("key")

    def _forget(self, spark: SparkSession, before: Row) -> None:
        """Delete what the batch before needs no more, should this one be repeated."""
        remove(spark, f"{self.table('marks')}/batch={before['batch'] - 1}")
        if before["batch"] == before["snapshot"] and before["snapshot"] > before["previous"]:
            remove(spark, f"{self.table('open_sessions')}/batch={before['previous']}")
            for old in range(before["previous"], before["snapshot"] + 1):
                remove(spark, f"{self.table('changes')}/batch={old}")

    def _selected(self, fresh: DataFrame, taken: int, slices: TimeSlices) -> DataFrame:
        if not self.opts.max_events:
            return select_events(fresh, self.opts, slices)
        left = self.opts.max_events - taken
        if left <= 0:
            return slices.assign(fresh.where(F.lit(False)))
        return select_events(fresh, self.opts.with_(max_events=left), slices)

    def last_mark(self, spark: SparkSession, batch_id: int | None) -> Row | None:
        """Where the latest finished batch (before this one) ended."""
        if batch_id == 0:
            return None
        marks = spark.read.schema(_MARK_SCHEMA).parquet(self.table("marks"))
        if batch_id is not None:
            marks = marks.where(F.col("batch") < batch_id)
        return marks.orderBy(F.desc("batch")).first()

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.table(name)}/batch={batch_id}")


def _changes(touched: DataFrame | None, now: DataFrame) -> DataFrame:
    """Sessions opened, closed or made unreachable since ``touched``."""
    if touched is None:
        return now.withColumn("alive", F.lit(True))
    was = touched.select(*_SESSION, F.col("reachable").alias("_was"))
    fresh = now.join(was, list(_SESSION), "left").where(
        F.col("_was").isNull() | (F.col("_was") != F.col("reachable"))).drop("_was")
    gone = touched.join(now, list(_SESSION), "left_anti")
    return fresh.withColumn("alive", F.lit(True)).unionByName(
        gone.withColumn("alive", F.lit(False)))
