from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_descriptors import event
from tracecairn import TraceOptions
from tracecairn.operators.select import bucket_order, select_events, time_order
from tracecairn.operators.slices import TimeSlices
from tracecairn.plans import TraceRun
from tracecairn.sources import (
    buckets_opened,
    normalize,
    read_events,
    read_quarantine,
    read_trace,
    write_outcomes,
    write_trace,
)


@pytest.fixture(scope="module")
def dataset(spark, trace, tmp_path_factory):
    """Three numeric buckets, the special ones and a stray text file."""
    root = str(tmp_path_factory.mktemp("dataset"))
    rows = [{**event(i, "read", f"/f{i}", pid=i % 3, side=["source", "target"][i % 2]),
             "machine_ts": 600.0 * (8466 + i % 3) + i} for i in range(30)]
    write_trace(trace(rows), root)
    base = Path(root) / "events_tsorted"
    for special in ("bucket=_unparsed", "null_ts"):
        trace([event(99, "read", "/odd")]).write.parquet(str(base / special))
    (base / "bucket=008467" / "notes.txt").write_text("not a table")
    return root


def test_layout_and_scan(spark, dataset):
    names = sorted(p.name for p in (Path(dataset) / "events_tsorted").iterdir()
                   if p.name.startswith("bucket="))
    assert names == ["bucket=008466", "bucket=008467", "bucket=008468", "bucket=_unparsed"]
    events = read_events(spark, TraceOptions(events_root=dataset))
    assert events.count() == 30
    assert buckets_opened(events).first()["buckets"] == 3
    assert {r["bucket"] for r in events.select("bucket").distinct().collect()} == {8466, 8467, 8468}


def test_bucket_range_and_filters_reach_the_scan(spark, dataset):
    opts = TraceOptions(events_root=dataset, bucket_min=8467, bucket_max=8467, pid_filter=(1,),
                        side_filter="target")
    events = read_events(spark, opts).select("machine_ts", "pid")
    assert {r["pid"] for r in events.collect()} == {1}
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "8467" in plan.split("PartitionFilters")[1].split("]")[0]
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "EqualTo(side,target)" in pushed and "pid" in pushed
    assert plan.split("ReadSchema")[1].count(":") <= 5


def test_flat_file_and_missing_columns(spark, tmp_path):
    table = str(tmp_path / "flat.parquet")
    spark.sql("""SELECT cast(1300.5 AS float) AS machine_ts, cast(7 AS int) AS log_offset,
        cast(NULL AS int) AS pid, 'read' AS sc, '0x10' AS ret, 5 AS path, true AS mapped,
        '/c' AS canonical_path, 'junk' AS side, 'meta' AS op_class""").coalesce(1).write.parquet(
        table)
    row = read_events(spark, TraceOptions(events_root=table)).first()
    assert (row["machine_ts"], row["log_offset"], row["pid"], row["bucket"]) == (1300.5, 7, 0, 2)
    assert (row["ret"], row["err"], row["path"], row["mapped"]) == (16, 0, "", True)
    assert (row["side"], row["op_class"], row["comm"]) == ("other", "io", "")


def test_quarantine(spark, dataset):
    rows = read_quarantine(spark, TraceOptions(events_root=dataset))
    got = {r["folder"]: r["count"] for r in rows.groupBy("folder").count().collect()}
    assert got == {"bucket=_unparsed": 1, "null_ts": 1}


def test_corrupt_files_fail_unless_told_otherwise(spark, trace, tmp_path):
    root = str(tmp_path)
    write_trace(trace([event(1, "read", "/p")]), root)
    folder = next((tmp_path / "events_tsorted").glob("bucket=*"))
    (folder / "broken.parquet").write_bytes(b"not parquet at all")
    opts = TraceOptions(events_root=root)
    with pytest.raises(Exception):
        read_trace(spark, opts).select("sc").collect()
    assert read_trace(spark, opts.with_(ignore_corrupt_files=True)).select("sc").collect()


def test_written_buckets_are_sorted_and_do_not_overlap(spark, trace, tmp_path):
    rows = [event((i * 37) % 500, "read", "/p") for i in range(500)]
    write_trace(trace(rows).repartition(5), str(tmp_path))
    folder = tmp_path / "events_tsorted" / "bucket=000000"
    spans = []
    for file in folder.glob("*.parquet"):
        offsets = [r[0] for r in spark.read.parquet(str(file)).select("log_offset").collect()]
        assert offsets == sorted(offsets)
        spans.append((offsets[0], offsets[-1]))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_order_and_outcome_sink(spark, trace, tmp_path):
    rows = [event((i * 7) % 20, "read", "/p") for i in range(20)]
    events = normalize(trace(rows))
    assert [r["log_offset"] for r in time_order(events).collect()] == list(range(20))
    local = bucket_order(events.coalesce(1))
    assert [r["log_offset"] for r in local.collect()] == list(range(20))
    run = TraceRun(events)
    write_outcomes(run.outcomes, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'skipped'").count() == 20


@pytest.mark.parametrize("slices", [TimeSlices(), TimeSlices((0.45, 1.0, 2.5))])
def test_cap_keeps_the_first_events(trace, slices):
    rows = [event(i, "read", "/p", pid=i % 3, side=["source", "target"][i % 2]) for i in range(40)]
    events = normalize(trace(rows))
    for cap, pids, side in ((7, (), "all"), (5, (1,), "source"), (100, (), "target")):
        opts = TraceOptions(max_events=cap, pid_filter=pids, side_filter=side)
        want = [r["log_offset"] for r in rows if (not pids or r["pid"] in pids)
                and (side == "all" or r["side"] == side)][:cap]
        got = select_events(events, opts, slices).select("log_offset").collect()
        assert sorted(r[0] for r in got) == want
    assert select_events(events, TraceOptions(pid_filter=(0,)), slices).where(
        F.col("pid") != 0).isEmpty()
