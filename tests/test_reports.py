from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.model import simulate
from tests.test_descriptors import event, random_rows
from tracecairn import TraceOptions
from tracecairn.operators.outcomes import check_failures
from tracecairn.operators.reports import skip_rate_by_window
from tracecairn.operators.slices import (
    TimeSlices,
    at_or_before,
    nth_keys,
    plan_slices,
    slices_from_quantiles,
)
from tracecairn.operators.storage import materialize
from tracecairn.operators.timing import add_schedule, pid_gaps
from tracecairn.plans import TraceRun, execute_plan
from tracecairn.sources import normalize, write_trace


@pytest.mark.parametrize("cap,side,rows_per_slice", [(0, "all", 10_000), (120, "source", 60)])
def test_run_statistics(trace, cap, side, rows_per_slice):
    rows = random_rows(5, 400, [1, 2], ["/p", "/q", "/../x"], [3, 4], 0.0)
    for i, r in enumerate(rows):
        r["side"] = ["source", "target", "other"][i % 3]
    opts = TraceOptions(max_events=cap, side_filter=side, rows_per_slice=rows_per_slice)
    run = TraceRun(normalize(trace(rows)), opts)
    s = run.stats().first()

    kept = [r for r in rows if side == "all" or r["side"] == side]
    seen = rows
    if cap and len(kept) > cap:
        seen = rows[: rows.index(kept[cap]) + 1]
        kept = kept[:cap]
    results, left = simulate(kept)
    failed = sum(v[0] == "failed" for v in results.values())
    assert s["total"] == len(seen)
    assert s["processed"] == len(kept) - failed
    assert s["failed"] == failed
    assert s["skipped"] == sum(v[0] == "skipped" for v in results.values())
    assert s["filtered"] == sum(side != "all" and r["side"] != side for r in seen)
    assert s["residual"] == left
    assert (s["first_ts"], s["last_ts"]) == (rows[0]["machine_ts"], seen[-1]["machine_ts"])
    hit = len(seen) < len(rows)
    assert s["total"] == s["processed"] + s["failed"] + s["filtered"] + hit

    windows = [10, 50, 10_000]
    got = {r["window_events"]: (r["events"], r["skipped"])
           for r in skip_rate_by_window(run.outcomes, windows, run.slices).collect()}
    order = [results[r["log_offset"]][0] for r in kept]
    for n in windows:
        assert got[n] == (len(order[:n]), order[:n].count("skipped"))

    if failed:
        with pytest.raises(RuntimeError):
            check_failures(run.outcomes, continue_on_error=False)


@pytest.mark.parametrize("slices", [TimeSlices(), TimeSlices((1.0, 2.0, 5000.0))])
def test_schedule(trace, slices):
    times = [0.0, 0.5, 0.5, 2.5, 9000.0, 9000.25]
    rows = [{**event(i, "read", "/p", pid=i % 2), "machine_ts": t} for i, t in enumerate(times)]
    events = slices.assign(normalize(trace(rows)))

    def schedule(**options):
        out = add_schedule(events, TraceOptions(**options), slices).orderBy("log_offset")
        return [(r["gap_s"], r["wait_s"], r["replay_offset_us"]) for r in out.collect()]

    gaps = [0.0, 0.5, 0.0, 2.0, 8997.5, 0.25]
    assert [s[0] for s in schedule()] == gaps
    assert all(s[1:] == (0.0, 0) for s in schedule())
    real = schedule(pace_mode="real")
    assert [s[1] for s in real] == [min(g, 3600.0) for g in gaps]
    assert real[-1][2] == 3_602_750_000
    assert [s[1] for s in schedule(pace_mode="scaled", speed=2.0)] == [
        min(g / 2, 3600.0) for g in gaps]
    idle = {r["pid"]: (r["events"], r["idle_us"], r["longest_gap_us"])
            for r in pid_gaps(events, slices).collect()}
    assert idle == {0: (3, 9_000_000_000, 8_999_500_000), 
                    1: (3, 8_999_750_000, 8_997_750_000)}


def test_slices_cut_a_single_hot_timestamp(trace):
    """A third of all rows share one timestamp: it is cut by offset, order kept."""
    rows = [{**event(i, "read", "/p"), "machine_ts": 5.0 if 300 <= i < 600 else i / 100}
            for i in range(900)]
    for r in rows[600:]:
        r["machine_ts"] += 10
    events = normalize(trace(rows))
    slices = plan_slices(events, 50)
    assert slices.fine
    sized = slices.assign(events).groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("log_offset").alias("lo"),
        F.max("log_offset").alias("hi")).orderBy("slice").collect()
    assert max(r["n"] for r in sized) <= 110
    by_offset = [r for r in sized if 300 <= r["lo"] < 600]
    assert all(a["hi"] < b["lo"] for a, b in zip(by_offset, by_offset[1:]))


def test_slices_cut_a_log_without_offsets_at_processes(trace):
    """Nothing but the process tells the rows of a timestamp apart."""
    rows = [{**event(0, "read", "/p", pid=i % 500), "machine_ts": float(i // 4000)}
            for i in range(8000)]
    events = normalize(trace(rows))
    slices = plan_slices(events, 100)
    sized = slices.assign(events).groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("machine_ts", "pid")).alias("lo"),
        F.max(F.struct("machine_ts", "pid")).alias("hi")).orderBy("slice").collect()
    assert len(sized) >= 60 and max(r["n"] for r in sized) <= 200
    assert all(a["hi"] < b["lo"] for a, b in zip(sized, sized[1:]))


def test_slices_of_overfull_timestamps_hold_for_any_offsets(spark):
    """Offsets that do not follow time, or one far out, make neither many nor large slices."""
    mixed = spark.range(20_000).selectExpr(
        "double(id % 20) machine_ts", "(id * 7919) % 20000 log_offset", "id % 5 pid")
    far = spark.range(20_000).selectExpr(
        "5.0D machine_ts", "if(id = 7, 1000000000000, id) log_offset", "id % 5 pid")
    for events in (mixed, far):
        slices = plan_slices(events, 100)
        sized = slices.assign(events).groupBy("slice").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("machine_ts", "log_offset")).alias("lo"),
            F.max(F.struct("machine_ts", "log_offset")).alias("hi")).orderBy("slice").collect()
        assert len(sized) <= 400 and max(r["n"] for r in sized) <= 200
        assert all(a["hi"] < b["lo"] for a, b in zip(sized, sized[1:]))


@pytest.mark.parametrize("hot", [False, True])
def test_order_statistics(trace, hot):
    """Keys at positions in any slice, among hot timestamps and past the end."""
    rng = random.Random(hot)
    rows = [{**event(i, "read", "/p", pid=rng.randrange(3)),
             "machine_ts": 4.0 if hot and i % 2 else rng.choice((rng.random() * 9, float("nan")))
             if i % 9 == 0 else rng.random() * 9} for i in range(600)]
    rng.shuffle(rows)
    events = normalize(trace(rows))
    order = sorted(rows, key=lambda r: (
        math.inf if math.isnan(r["machine_ts"]) else r["machine_ts"], r["log_offset"]))
    for slices in (plan_slices(events, 40), TimeSlices()):
        sliced = slices.assign(events)
        for places in ([1], [300, 301], [599, 600], [600, 601], [900], [17, 450]):
            found = nth_keys(sliced, places, slices)
            want = {n: order[n - 1]["log_offset"] for n in places if n <= 600}
            assert {n: r["log_offset"] for n, r in found.items()} == want
            for n, key in found.items():
                kept = sliced.where(at_or_before(key)).select("log_offset").collect()
                assert {r[0] for r in kept} == {r["log_offset"] for r in order[:n]}


def plan_text(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_cap_reaches_the_scan(spark, trace, tmp_path):
    rows = [event(i, "read", "/p", pid=i % 3) for i in range(5000)]
    write_trace(trace(rows), str(tmp_path / "t"))
    opts = TraceOptions(events_root=str(tmp_path / "t"), max_events=1234, pid_filter=(1, 2),
                        rows_per_slice=200)
    run = TraceRun.open(spark, opts)
    text = plan_text(run.selected)
    pushed = [x for x in text.splitlines() if "PushedFilters" in x]
    assert len(pushed) == 1 and "LessThanOrEqual(machine_ts" in pushed[0] and "In(pid" in pushed[0]
    assert "Exchange" not in text and "Window" not in text
    got = [r[0] for r in run.selected.select("log_offset").collect()]
    assert sorted(got) == [i for i in range(5000) if i % 3][:1234]
    s = run.stats().first()
    assert (s["total"], s["processed"] + s["failed"]) == (1853, 1234)


def test_schedule_reads_its_input_twice_and_sorts_once(trace):
    rows = [event(i * 3 % 1000, "read", "/p") for i in range(1000)]
    events = materialize(normalize(trace(rows)), "events")
    slices = plan_slices(events, 50)
    out = add_schedule(slices.assign(events), TraceOptions(pace_mode="real"), slices)
    text = plan_text(out)
    tree = text.split("\n\n\n")[0]
    assert tree.count("Sort (") == 1 and len(re.findall(r"Exchange \(", tree)) <= 3
    assert len(re.findall(r"Scan parquet ", tree)) == 2   # the rows, and one row per slice
    got = {r["log_offset"]: r["replay_offset_us"] for r in out.collect()}
    assert got == {i: i * 100_000 for i in range(1000)}


def test_slice_boundaries_from_quantiles():
    s, heavy = slices_from_quantiles([1.0, 2.0, 2.0, 3.0, math.nan], 0, 100)
    assert s.cuts == (1.0, 2.0, math.nextafter(2.0, math.inf), 3.0)
    assert heavy and (s.low, s.high) == (0, 100)
    assert not slices_from_quantiles([1.0, 2.0], 0, 100)[1]


def test_user_function_over_the_plan(trace):
    rows = [event(0, "open", "/p", "3"), event(1, "write", "/p", "10"), event(2, "close", "/p"),
            event(3, "rename", "/a", rename_src="/a", rename_dst="/../b"),
            event(4, "mkdir", "/d"), event(5, "fsync", "/p")]
    plan = TraceRun(normalize(trace(rows))).plan()
    got = {r["log_offset"]: (r["action"], r["status"], r["reason"]) for r in plan.collect()}
    assert got == {
        0: ("open", "issue", None), 1: ("io", "issue", None), 2: ("close", "issue", None),
        3: ("rename", "reject", "traversal"), 4: ("mkdir", "issue", None),
        5: ("skip", "skip", "not_supported")}

    def execute(batches):
        for b in batches:
            yield b.select(["log_offset", "action"])

    done = execute_plan(plan.where("status = 'issue'"), execute, "log_offset bigint, action string")
    assert {r["log_offset"] for r in done.collect()} == {0, 1, 2, 4}
