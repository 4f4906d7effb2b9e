"""Only processes larger than a slice are cut, and slices stay few."""

from __future__ import annotations

from dataclasses import replace

from tests.model import simulate
from tests.test_descriptors import random_rows, run_rows
from tracecairn.operators.lifecycles import add_rank
from tracecairn.operators.slices import TimeSlices, plan_slices, slices_wanted
from tracecairn.operators.timing import pid_gaps
from tracecairn.sources import normalize


def test_slices_grow_before_they_are_many():
    assert slices_wanted(100_000, 2_000) == 50
    assert slices_wanted(36_000_000, 2_000) == 1_000
    assert slices_wanted(5_000_000_000, 2_000) == 5_000
    assert slices_wanted(3_000_000, 1_000_000) == 3


def _rows():
    """One process with most rows, others with a few each."""
    rows = random_rows(23, 400, [1], ["/p", "/q", "/r"], [3, 4, 5], 0.0)
    for i, r in enumerate(rows):
        if i % 4 == 0:
            r["pid"] = 2 + i % 9
    return rows


def test_small_processes_are_not_cut(trace):
    rows = _rows()
    planned = plan_slices(normalize(trace(rows)), 80)
    assert planned.several and planned.large == (1,)
    want, left = simulate(rows)
    for slices in (planned, replace(planned, large=()), replace(planned, large=None), TimeSlices()):
        got, open_at_end, _ = run_rows(trace, rows, slices)
        assert got == want and open_at_end == left
    assert planned.parted and not replace(planned, large=()).parted


def test_ranks_and_gaps_within_processes(trace):
    events = normalize(trace(_rows()))
    planned = plan_slices(events, 80)
    want_gaps = sorted(map(tuple, pid_gaps(TimeSlices().assign(events), TimeSlices()).collect()))
    order = ["machine_ts", "log_offset", "sc"]
    ranks = {}
    for slices in (TimeSlices(), planned, replace(planned, large=()), replace(planned, large=None)):
        rows = slices.assign(events)
        assert sorted(map(tuple, pid_gaps(rows, slices).collect())) == want_gaps
        ranked = add_rank(rows.select("pid", "slice", *order), ["pid"], order, "n", slices)
        ranks[slices] = sorted((r["pid"], r["log_offset"], r["n"]) for r in ranked.collect())
    assert len({tuple(x) for x in ranks.values()}) == 1
