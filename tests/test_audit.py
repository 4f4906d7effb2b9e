"""Read report, order certificate, sink commits and lifecycles, by hand and against plain Python."""

from __future__ import annotations

import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.model import simulate
from tests.test_descriptors import event, random_rows
from tracecairn import TraceOptions
from tracecairn.operators import lifecycles
from tracecairn.operators.slices import TimeSlices
from tracecairn.plans import TraceRun
from tracecairn.sources import (
    audit,
    commit_outcomes,
    committed_outcomes,
    normalize,
    order_certificate,
    read_report,
    write_outcomes,
    write_trace,
)


def test_report_names_every_file(spark, trace, tmp_path):
    rows = [{**event(i, "read", "/p"), "machine_ts": 300.0 * i} for i in range(20)]
    root = tmp_path / "t"
    write_trace(trace(rows), str(root))
    base = root / "events_tsorted"
    trace(rows[:3]).drop("side").withColumn("pid", F.col("pid").cast("string")).write.parquet(
        str(base / "bucket=_bad"))
    (base / "bucket=000002" / "x.parquet").write_bytes(b"PAR1")
    (base / "bucket=000002" / "y.parquet").write_bytes(b"")
    (base / "bucket=000002" / "notes.txt").write_text("not listed")
    opts = TraceOptions(events_root=str(root), bucket_min=1, bucket_max=5)
    found = read_report(spark, opts).collect()
    by_status = Counter()
    for r in found:
        by_status[r["status"]] += r["rows"] or 0
        assert (r["why"] is None) == (r["status"] != "unreadable")
        if r["status"] == "special":
            assert r["defaulted"] == ["pid", "side"]
        elif r["status"] != "unreadable":
            assert r["defaulted"] == []
    assert by_status == {"read": 10, "out of range": 10, "special": 3, "unreadable": 0}
    assert sum(r["status"] == "unreadable" for r in found) == 1   # y is empty, no scan opens it
    flat = str(tmp_path / "one.parquet")
    trace(rows[:4]).coalesce(1).write.parquet(flat)
    assert [(r["status"], r["rows"]) for r in read_report(
        spark, TraceOptions(events_root=flat)).collect()] == [("read", 4)]


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_certificate_finds_disorder_and_overlap(spark, trace, tmp_path, monkeypatch, block):
    monkeypatch.setattr(audit, "ROWS_PER_BLOCK", block)
    rows = [event(i, "read", "/p") for i in range(100)]

    def certificate(*parts):
        path = str(tmp_path / f"d{random.random()}")
        for part in parts:
            trace(part).coalesce(1).write.mode("append").parquet(path)
        return sorted((r["rows"], r["sorted"], r["overlaps"])
                      for r in order_certificate(spark, path).collect())

    assert certificate(rows[:40], rows[40:]) == [(40, True, False), (60, True, False)]
    assert certificate(rows[:40], rows[30:]) == [(40, True, False), (70, True, True)]
    swapped = rows[:13] + [rows[14], rows[13]] + rows[15:30]
    assert certificate(swapped, rows[30:]) == [(30, False, False), (70, True, False)]
    assert certificate(rows[:50], rows[10:20], rows[50:]) == [
        (10, True, True), (50, True, False), (50, True, False)]


def test_sink_holds_each_run_once(spark, trace, tmp_path):
    out = TraceRun(normalize(trace([event(i, "read", "/p") for i in range(9)]))).outcomes
    root = str(tmp_path / "sink")
    commit_outcomes(out.where("log_offset < 5"), root, 1)
    write_outcomes(out, f"{root}/data/run=2-crashed")   # before its manifest
    commit_outcomes(out.where("log_offset >= 5"), root, 2)
    commit_outcomes(out.where("log_offset >= 6"), root, 2)   # replaces the whole run
    got = sorted((r["run"], r["log_offset"]) for r in committed_outcomes(spark, root).collect())
    assert got == [(1, i) for i in range(5)] + [(2, i) for i in range(6, 9)]
    shutil.rmtree(tmp_path / "sink" / "manifest" / "run=2")   # a crash while its manifest is replaced
    assert committed_outcomes(spark, root).count() == 5
    commit_outcomes(out.where("log_offset >= 5"), root, 2)
    assert committed_outcomes(spark, root).count() == 9


@pytest.mark.parametrize("slices", [TimeSlices(), TimeSlices((4.0, 11.0, 19.0))])
def test_lifecycles_compare_in_order(trace, slices):
    rows = random_rows(17, 240, [1, 2, 3], ["/p", "/q", "/r"], [3, 4, 5], 0.0)
    for r in rows:
        r["side"] = ["source", "target", "other"][r["pid"] % 3]
    run = TraceRun(slices.assign(normalize(trace(rows))), TraceOptions(rows_per_slice=60))
    got = {r["path"]: tuple(r)[1:] for r in lifecycles.side_lifecycles(
        run.outcomes, run.slices).collect()}
    results, _ = simulate(rows)
    calls, opened = {}, {}
    for r in rows:
        status, _, session = results[r["log_offset"]]
        if status == "ok" and session and r["sc"] not in ("stat", "newfstatat", "unlink", "mkdir", "renameat"):
            calls.setdefault(session[0], []).append(r["sc"])
            if session[0] == r["log_offset"]:
                opened[session[0]] = r
    lists = {}
    for at in sorted(opened):
        best = opened[at]["path"]
        side = opened[at]["side"]
        if side != "other":
            lists.setdefault(best, {"source": [], "target": []})[side].append(",".join(calls[at]))
    want = {}
    for path, sides in lists.items():
        s, t = sides["source"], sides["target"]
        matched = sum(a == b for a, b in zip(s, t))
        shared = sum((Counter(s) & Counter(t)).values())
        want[path] = (len(s), len(t), matched, shared - matched, len(s) - shared, len(t) - shared)
    assert got == want and any(x[3] for x in want.values())
