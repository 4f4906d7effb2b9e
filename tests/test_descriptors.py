"""Descriptor tracking against the sequential model, for several slicings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.model import simulate
from tracecairn import TraceOptions
from tracecairn.operators import descriptors
from tracecairn.operators.descriptors import (
    build_sessions,
    carry_over,
    residual,
    spread_failures,
    track_descriptors,
)
from tracecairn.operators.outcomes import outcomes
from tracecairn.operators.slices import TimeSlices
from tracecairn.plans import TraceRun
from tracecairn.sources import normalize


def event(i, sc, path="", ret="0", pid=1, **more):
    return {"machine_ts": i / 10, "log_offset": i, "pid": pid, "sc": sc, "path": path,
            "ret": ret, "arg1": "0", "arg2": "0", "side": "source", **more}


def story(*steps):
    return [event(i, *s[:-1], **s[-1]) if isinstance(s[-1], dict) else event(i, *s)
            for i, s in enumerate(steps)]


def observed(run_outcomes):
    rows = run_outcomes.select("log_offset", "action", "status", "reason",
                               F.col("session_at.log_offset").alias("s"), "our_fd").collect()
    return {r["log_offset"]: (
        r["status"], r["reason"],
        (r["s"], r["our_fd"]) if r["s"] is not None and r["action"] != "meta" else None)
        for r in rows}


def run_rows(trace, rows, slices, **options):
    opts = TraceOptions(**options)
    events = normalize(trace(rows), opts.signed_numbers)
    state = track_descriptors(events, opts, slices)
    return observed(outcomes(state)), residual(state.sessions).first()["residual"], state


CASES = {
    "plain": story(("open", "/p", "3"), ("read", "/p"), ("close", "/p"), ("read", "/p")),
    "reuse without close": story(
        ("open", "/p", "3"), ("open", "/q", "3"), ("read", "/p"), ("read", "/q")),
    "reuse after close": story(("open", "/p", "3"), ("close", "/p"), ("open", "/p", "4"),
                               ("open", "/q", "3"), ("read", "/p")),
    "double open": story(("open", "/p", "3"), ("open", "/p", "4"), ("read", "/p"),
                         ("close", "/p"), ("read", "/p")),
    "close by number": story(("open", "/p", "3"), ("open", "/p", "4"),
                             ("close", "/[unknown, fd=3]"), ("read", "/p")),
    "unknown number": story(("open", "/p", "3"), ("read", "/[unknown, fd=3]")),
    "process isolation": story(("open", "/p", "3", 1), ("read", "/p", "0", 2)),
    "chain of foreign losses": story(
        ("open", "/p", "3"), ("close", "/p"), ("open", "/p", "4"), ("open", "/q", "3"),
        ("close", "/p"), ("open", "/p", "5"), ("open", "/q", "4"), ("close", "/p"),
        ("open", "/p", "6"), ("open", "/q", "5"), ("read", "/p"), ("close", "/p"), ("read", "/p")),
    "failed open counts as 0": story(("open", "/p", "-2"), ("read", "/[unknown, fd=0]")),
    "huge numbers": story(("open", "/p", "4294967299"), ("read", "/p"),
                          ("read", "/[unknown, fd=99999999999]")),
    "pathless open": story(("open", "", "3", 1, {"rename_dst": "/x"}), ("read", ""),
                           ("read", "/[unknown, fd=3]"), ("close", "/[unknown, fd=3]")),
    "relative": story(("open", "/tmp/sandbox/d", "577"),
                      ("openat", "f", "5", 1, {"arg1": "577"}), ("read", "f"),
                      ("openat", "f", "6", 1, {"arg1": "4294967196"}),
                      ("openat", "../../../x", "7", 1, {"arg1": "577"}),
                      ("openat", "g", "8", 1, {"arg1": "9"})),
}


@pytest.mark.parametrize("slices", [TimeSlices(), TimeSlices((0.15, 0.35, 0.75))],
                         ids=["one slice", "four slices"])
def test_hand_written_cases(trace, slices):
    """Every case is one process, so that one run covers them all."""
    rows = []
    for n, (name, steps) in enumerate(CASES.items()):
        rows += [{**r, "pid": 1000 * n + r["pid"], "machine_ts": r["machine_ts"] + n * 1e-4,
                  "log_offset": 100 * n + r["log_offset"]} for r in steps]
    got, left, _ = run_rows(trace, rows, slices)
    want, open_at_end = simulate(rows)
    assert got == want
    assert left == open_at_end


def test_expected_outcomes_by_hand(trace):
    """A few results stated outright, so that model and operator cannot share a mistake."""
    got, left, _ = run_rows(trace, CASES["double open"], TimeSlices())
    assert [got[i][0] for i in range(5)] == ["ok", "ok", "ok", "ok", "skipped"]
    assert got[2][2] == (1, 4)
    assert left == 1
    got, _, _ = run_rows(trace, CASES["close by number"], TimeSlices())
    assert got[3][0] == "skipped"


def random_rows(seed, n, pids, paths, fds, relative):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 0.01, 0.5])
        kind = rng.choices(["open", "close", "read", "stat", "exit_group"], [8, 6, 8, 1, 0.3])[0]
        path = rng.choice(paths)
        if kind in ("close", "read") and rng.random() < 0.35:
            path = f"/[unknown, fd={rng.choice(fds)}]"
        if kind in ("open", "stat") and rng.random() < relative:
            path = rng.choice(["f", "g/../h", "../../../up", "../etc"])
        row = event(i, kind, path, str(rng.choice(fds)), rng.choice(pids),
                    arg1=str(rng.choice([*fds, 577])))
        if kind == "open" and rng.random() < 0.1:
            row["ret"] = "-2"
        if kind == "open" and rng.random() < 0.03:
            row.update(rename_dst="/named")
        row["machine_ts"] = t
        rows.append(row)
    return rows


RANDOM = [
    # (seed, options, share of relative paths, rows per slice)
    (1, {}, 0.0, 10_000),
    (2, {"sandbox_root": "/"}, 0.5, 150),
    (3, {"signed_numbers": True}, 0.1, 150),
    (4, {"exit_closes": True}, 0.1, 150),
]


@pytest.mark.parametrize("seed,options,relative,rows_per_slice", RANDOM)
def test_random_traces(trace, seed, options, relative, rows_per_slice):
    """Few paths and numbers over many rows: reuse, double opens and long chains."""
    paths = ["/p", "/q", "/r", "", "/tmp/sandbox/d", "/../x"]
    rows = random_rows(seed, 1500, [1, 2, 3, 3, 3, 3], paths, [3, 4, 5, 6, 0], relative)
    opts = TraceOptions(rows_per_slice=rows_per_slice, **options)
    run = TraceRun(normalize(trace(rows), opts.signed_numbers), opts)
    want, open_at_end = simulate(
        rows, opts.sandbox_root, opts.signed_numbers, opts.exit_closes)
    assert run.slices.several == (rows_per_slice == 150)
    got = observed(run.outcomes)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert residual(run.sessions).first()["residual"] == open_at_end


@pytest.mark.parametrize("partitions", [1, 7])
def test_partition_independence(spark, trace, partitions):
    rows = random_rows(7, 600, [1, 2], ["/p", "/q", "/r"], [3, 4, 5], 0.1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got, _, _ = run_rows(trace, rows, TimeSlices((3.0, 40.0, 90.0)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == simulate(rows)[0]


def test_seeded_run_equals_whole_run(trace):
    """Cut a trace anywhere: the second part, given the open sessions, continues exactly."""
    rows = random_rows(11, 900, [1, 2], ["/p", "/q", "/r"], [3, 4, 5], 0.0)
    want, open_at_end = simulate(rows)
    events = normalize(trace(rows))
    opts, one = TraceOptions(), TimeSlices()
    cut = F.col("log_offset") < 450
    first = track_descriptors(events.where(cut), opts, one)
    made = first.opens.agg(F.count("our_fd")).first()[0]
    second = track_descriptors(
        events.where(~cut), opts, one, carry_over(first.sessions), 3 + made)
    got = observed(outcomes(first)) | observed(outcomes(second))
    assert got == want
    assert residual(second.sessions).first()["residual"] == open_at_end


def test_hot_key_is_spread_over_slices(trace):
    """One process and path own all rows; no window group may hold them all."""
    rows = []
    for i in range(2000):
        sc = ["open", "read", "read", "close"][i % 4]
        rows.append(event(i, sc, "/hot", "3"))
    opts = TraceOptions(rows_per_slice=100)
    run = TraceRun(normalize(trace(rows)), opts)
    sizes = run.selected.groupBy("pid", "path", "slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 200
    assert observed(run.outcomes) == simulate(rows)[0]


def test_failures_spread_over_long_chains(spark):
    """A chain of 300 links with one failed node: exactly the nodes above it fail."""
    rows = [(1, i, i == 100, i + 1 if i < 299 else None) for i in range(300)]
    nodes = spark.createDataFrame(rows, "k int, node int, failed boolean, above int")
    done = spread_failures(nodes, ["k"], "node", "above")
    assert {r["node"] for r in done.where("failed").collect()} == set(range(100, 300))


@pytest.mark.parametrize("broken", [None, 0, 30])
@pytest.mark.parametrize("slices", [TimeSlices(), TimeSlices((1.0, 2.5, 4.0))])
def test_chain_of_relative_opens_settles_in_few_rounds(trace, monkeypatch, broken, slices):
    """Each open's directory is the one before it; where one fails, all behind it fail."""
    rows = [event(0, "open", "/tmp/sandbox/d", "100")]
    for i in range(1, 65):
        rows.append(event(i, "openat", "x" if i != broken else "../../../../y", str(100 + i),
                          arg1=str(99 + i)))
    if broken == 0:
        rows[0]["path"] = "/../d"
    if broken == 30:   # leaves the root: its directory is absolute
        rows[29].update(path="/tmp/sandbox/e", arg1="0")
    rounds = []
    monkeypatch.setattr(descriptors, "build_sessions", lambda *a: rounds.append(1) or build(*a))
    build = build_sessions
    got, left, state = run_rows(trace, rows, slices)
    want, want_left = simulate(rows)
    assert got == want and left == want_left
    failed = sum(v[0] == "failed" for v in got.values())
    assert failed == {None: 0, 0: 65, 30: 35}[broken]
    assert len(rounds) <= 4   # the last one builds the run's own sessions


@pytest.mark.parametrize("seed", range(4))
def test_random_relative_opens(trace, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        sc = rng.choice(["openat", "openat", "openat", "close", "read"])
        path = rng.choice(["/tmp/sandbox/a", "r", "s/t", "../../../../z", "/[unknown, fd=4]"])
        if sc == "openat" and path.startswith("/["):
            path = "r"
        rows.append(event(i, sc, path, str(rng.randint(3, 7)), rng.randint(1, 2),
                          arg1=str(rng.randint(3, 7))))
    got, left, _ = run_rows(trace, rows, TimeSlices((4.0, 9.0)))
    want, want_left = simulate(rows)
    assert got == want and left == want_left


def test_exits_do_not_order_the_trace(trace):
    rows = []
    for i in range(120):
        sc = ["open", "read", "exit_group", "close", "read"][i * 7 % 5 if i % 4 else 0]
        rows.append(event(i, sc, "/p", "3", i % 3))
    opts = TraceOptions(exit_closes=True)
    for slices in (TimeSlices(), TimeSlices((2.0, 2.5, 8.0))):
        prepared = descriptors.prepare(normalize(trace(rows)), opts, slices)
        assert "Window" not in prepared._jdf.queryExecution().executedPlan().toString()
        state = track_descriptors(normalize(trace(rows)), opts, slices)
        want, left = simulate(rows, exits=True)
        assert observed(outcomes(state)) == want
        assert residual(state.sessions).first()["residual"] == left
