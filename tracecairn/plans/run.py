"""A simulated run over a trace, each result a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracecairn.functions.text import outcome_note
from tracecairn.operators import reports
from tracecairn.operators.descriptors import FIRST_VIRTUAL_FD, Descriptors, track_descriptors
from tracecairn.operators.outcomes import check_failures, outcomes
from tracecairn.operators.slices import TimeSlices, at_or_before, nth_keys, plan_slices
from tracecairn.operators.storage import materialize
from tracecairn.options import TraceOptions
from tracecairn.plans.schedule import replay_plan
from tracecairn.sources.normalize import normalize, row_filter
from tracecairn.sources.reader import read_trace


@dataclass(frozen=True)
class TraceRun:
    """``events`` are typed events, before any filter; ``opts`` says what to select.

    ``carried`` starts the run with descriptors that were open before the first event, and
    ``first_virtual_fd`` continues the numbers of an earlier run. ``stored`` are the rows as they are
    stored, where the scan can use the filters and the end of a capped run.
    """

    events: DataFrame
    opts: TraceOptions = TraceOptions()
    carried: DataFrame | None = None
    first_virtual_fd: int = FIRST_VIRTUAL_FD
    stored: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, opts: TraceOptions) -> TraceRun:
        return cls.over(read_trace(spark, opts), opts)

    @classmethod
    def over(cls, stored: DataFrame, opts: TraceOptions) -> TraceRun:
        """A run over rows as they are stored."""
        return cls(normalize(stored, opts.signed_numbers), opts, stored=stored)

    def _read(self, filtered: bool, last: Row | None = None) -> DataFrame:
        """Events, with or without the filters, up to a key."""
        keep = row_filter(self.opts) if filtered else None
        rows = self.events
        if self.stored is not None:
            rows = self.stored if keep is None else self.stored.where(keep)
            if last is not None and dict(rows.dtypes).get("machine_ts") == "double":
                rows = rows.where(F.col("machine_ts").isNull()
                                  | (F.col("machine_ts") <= last["machine_ts"]))
            rows = normalize(rows, self.opts.signed_numbers)
        elif keep is not None:
            rows = rows.where(keep)
        return rows if last is None else rows.where(at_or_before(last))

    @cached_property
    def _planned(self) -> TimeSlices:
        """Slices of all events that pass the filters."""
        return plan_slices(self._read(filtered=True), self.opts.rows_per_slice)

    @cached_property
    def _ends(self) -> dict[int, Row]:
        """Keys of the last event that a capped run takes, and of the one that runs into the cap."""
        n = self.opts.max_events
        if n <= 0:
            return {}
        return nth_keys(self._planned.assign(self._read(filtered=True)), [n, n + 1], self._planned)

    @cached_property
    def slices(self) -> TimeSlices:
        last = self._ends.get(self.opts.max_events)
        return self._planned if last is None else self._planned.until(last["machine_ts"])

    @cached_property
    def selected(self) -> DataFrame:
        last = self._ends.get(self.opts.max_events)
        return self.slices.assign(self._read(filtered=True, last=last))

    @cached_property
    def state(self) -> Descriptors:
        return track_descriptors(
            self.selected, self.opts, self.slices, self.carried, self.first_virtual_fd)

    @cached_property
    def sessions(self) -> DataFrame:
        return self.state.sessions

    @cached_property
    def outcomes(self) -> DataFrame:
        """Written once: statistics, plan and reports all read it."""
        return materialize(
            check_failures(outcomes(self.state), self.opts.continue_on_error), "outcomes")

    @property
    def explained_outcomes(self) -> DataFrame:
        """The outcomes with a note each, from the stored rows."""
        return self.outcomes.withColumn("note", outcome_note())

    def stats(self) -> DataFrame:
        read = self._read(filtered=False, last=self._ends.get(self.opts.max_events + 1))
        return reports.run_stats(read, self.outcomes, self.state)

    def plan(self) -> DataFrame:
        return replay_plan(self.outcomes, self.opts, self.slices)
