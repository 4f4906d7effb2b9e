from __future__ import annotations

import random
import shutil

from pyspark.sql import functions as F

from tests.model import simulate
from tests.test_descriptors import event, random_rows
from tracecairn import TraceOptions
from tracecairn.sources import normalize, write_trace
from tracecairn.streaming import BucketStream, DescriptorStream, bucket_stats_stream, stream_events


def deliver(spark, trace, tracked, root, state, rows):
    write_trace(trace(rows), root, mode="append")
    events = stream_events(spark, TraceOptions(events_root=root))
    tracked.writer(events).option("checkpointLocation", state).trigger(
        availableNow=True).start().awaitTermination()


def test_descriptors_are_carried_between_batches(spark, trace, tmp_path):
    rows = random_rows(21, 300, [1, 2], ["/p", "/q"], [3, 4, 5], 0.0)
    late = {**event(9999, "read", "/p"), "machine_ts": rows[10]["machine_ts"] - 1e-6}
    tracked = DescriptorStream(str(tmp_path / "out"))
    root, state = str(tmp_path / "in"), str(tmp_path / "state")
    deliver(spark, trace, tracked, root, state, rows[:150])
    deliver(spark, trace, tracked, root, state, [late, *rows[150:]])

    out = spark.read.parquet(tracked.table("outcomes")).select(
        "log_offset", "action", "status", "reason", F.col("session_at.log_offset").alias("s"),
        "our_fd").collect()
    got = {r["log_offset"]: (
        r["status"], r["reason"],
        (r["s"], r["our_fd"]) if r["s"] is not None and r["action"] != "meta" else None)
        for r in out}
    want, left = simulate(rows)
    assert got == want
    assert tracked.open_sessions(spark).count() == left
    assert [r["log_offset"] for r in spark.read.parquet(tracked.table("late")).collect()] == [9999]

    # A repeated batch leaves everything as it was.
    again = spark.read.parquet(tracked.table("outcomes")).where("batch = 1").count()
    tracked.process(normalize(trace([late, *rows[150:]])), 1)
    assert spark.read.parquet(tracked.table("outcomes")).where("batch = 1").count() == again
    assert tracked.open_sessions(spark).count() == left


def test_tumbling_statistics(spark, trace, tmp_path):
    rows = [{**event(i, "read", "/p", "10"), "machine_ts": 400.0 * i} for i in range(12)]
    root = str(tmp_path / "in")
    write_trace(trace(rows), root)
    opts = TraceOptions(events_root=root)
    job = (
        bucket_stats_stream(stream_events(spark, opts)).writeStream.outputMode("complete")
        .format("memory").queryName("tumbling").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    got = {r["bucket"]: (r["ops"], r["io_bytes"]) for r in spark.table("tumbling").collect()}
    want = {}
    for r in rows:
        n, b = want.get(int(r["machine_ts"] // 600), (0, 0))
        want[int(r["machine_ts"] // 600)] = (n + 1, b + 10)
    assert got == want


def test_statistics_keep_late_rows(spark, trace, tmp_path):
    def read(i, ts):
        return {**event(i, "read", "/p", "10"), "machine_ts": ts}

    counted = BucketStream(str(tmp_path / "out"))
    root, state = str(tmp_path / "in"), str(tmp_path / "state")
    # The clock reaches 2500: with 600 seconds' delay buckets 0 to 2 are closed, 3 is not.
    second = [read(3, 1799.0), read(4, 1801.0), read(5, 2600.0)]
    deliver(spark, trace, counted, root, state, [read(1, 100.0), read(2, 2500.0)])
    deliver(spark, trace, counted, root, state, second)
    want = {0: (1, 10), 3: (1, 10), 4: (2, 20)}

    def totals():
        return {r["bucket"]: (r["ops"], r["io_bytes"]) for r in counted.totals(spark).collect()}

    def late():
        return [r["log_offset"] for r in spark.read.parquet(counted.table("late")).collect()]

    assert (totals(), late()) == (want, [3])
    counted.process(normalize(trace(second)), 1)
    assert (totals(), late()) == (want, [3])


def test_state_is_a_log_of_changes(spark, trace, tmp_path):
    """Batches write what they change; a lost batch is repeated; old files go after a compaction."""
    rng = random.Random(4)
    tracked = DescriptorStream(str(tmp_path / "out"), compact_every=3)
    opens = [event(i, "open", f"/many/{i}", str(1000 + i), pid=i % 7) for i in range(400)]
    batches = [opens]
    for b in range(1, 9):
        batch = []
        for j in range(12):
            i = 400 + 12 * (b - 1) + j
            sc = rng.choice(["open", "close", "read", "close"])
            path = rng.choice([f"/many/{rng.randrange(400)}", "/p", f"/[unknown, fd={1000 + rng.randrange(400)}]"])
            if sc == "open" and path.startswith("/["):
                path = "/p"
            batch.append(event(i, sc, path, str(rng.choice([3, 4, 1000 + rng.randrange(400)])),
                               pid=rng.randrange(7)))
        batches.append(batch)
    for b, batch in enumerate(batches):
        tracked.process(normalize(trace(batch)), b)
        if b == 5:   # lost before its mark: everything but the mark is there already
            state = sorted(map(tuple, tracked.open_sessions(spark).collect()))
            shutil.rmtree(tmp_path / "out" / "marks" / "batch=5")
            tracked.process(normalize(trace(batch)), b)
            assert sorted(map(tuple, tracked.open_sessions(spark).collect())) == state
    rows = [r for batch in batches for r in batch]
    got = {r["log_offset"]: (r["status"], r["reason"]) for r in spark.read.parquet(
        tracked.table("outcomes")).collect()}
    want, left = simulate(rows)
    assert got == {i: v[:2] for i, v in want.items()}
    assert tracked.open_sessions(spark).count() == left
    changes = {r["batch"]: r["count"] for r in spark.read.parquet(
        tracked.table("changes")).groupBy("batch").count().collect()}
    assert max(changes.values()) <= 2 * 12   # 12 rows a batch, 400 sessions open
    kept = sorted(x.name for x in (tmp_path / "out" / "open_sessions").iterdir())
    assert kept == ["batch=3", "batch=6"] or kept == ["batch=6"]
    assert not (tmp_path / "out" / "changes" / "batch=1").exists()


def test_filters_exits_and_cap_hold_over_batches(spark, trace, tmp_path):
    rows = []
    for i in range(120):
        sc = "exit_group" if i % 29 == 28 else ["open", "read", "read", "close"][i % 4]
        rows.append(event(i, sc, f"/p{i // 4 % 5}", str(3 + i % 3), pid=i // 8 % 3))
    tracked = DescriptorStream(str(tmp_path / "out"), TraceOptions(exit_closes=True, max_events=100))
    for b in range(4):
        tracked.process(normalize(trace(rows[30 * b:30 * b + 30])), b)
    got = {r["log_offset"]: (r["status"], r["reason"]) for r in spark.read.parquet(
        tracked.table("outcomes")).collect()}
    want, left = simulate(rows[:100], exits=True)
    assert got == {i: v[:2] for i, v in want.items()}
    assert tracked.open_sessions(spark).count() == left
