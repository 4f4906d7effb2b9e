"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Every query runs once and in full. The descriptor tables are built once per set
of options and shared, as in any session; ``descriptor_tables`` is that build alone.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tracecairn.plans import catalog
from tracecairn.session import tune

HEADLINE = (
    "parse_num", "classify_ops", "resolve_path", "event_line", "pid_filter", "bucket_profile",
    "syscall_distribution", "first_n_events", "time_order_gap", "replay_offset", "gap_by_pid",
    "virtual_fd", "fd_sessions", "fd_changelog", "io_attribution", "close_attribution",
    "dry_outcomes", "outcome_reasons", "run_stats", "run_stats_capped", "skip_rate_by_window",
    "io_by_path", "io_by_session", "side_consistency", "traversals", "replay_plan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    # Start the engine before the clock: one scan of the table.
    catalog.events_of(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    catalog.run_of(spark, sf_dir).state.sessions.write.format("noop").mode("overwrite").save()
    times["descriptor_tables"] = time.perf_counter() - t0
    queries = catalog.all_queries()
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = time.perf_counter() - t0
        print(f"{name} {times[name]:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
